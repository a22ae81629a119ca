"""What rows, roots and code sets must fulfil before they count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fields of a listed file and the JSON type each must have.
_TYPES = {"name": "STRING", "path": "STRING", "directory": "BOOLEAN", "size": "BIGINT"}


def listed_files(df: DataFrame, folder: str, item: str) -> DataFrame:
    """``df`` with name, path, directory, size, modified and fault of a file listed as JSON.

    fault: TYPE where a field is absent or of another JSON type (text that is no JSON and null too), NOT_A_CHILD where the
    path is not that name directly in the folder, else null. ``modified`` is optional: a text that is no instant
    gives null and no fault.
    """
    v = F.try_parse_json(item)
    kind = lambda n: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit(""))
    typed = F.lit(True)
    for name, wanted in _TYPES.items():
        typed = typed & (kind(name) == wanted)
    get = lambda n, t: F.try_variant_get(v, f"$.{n}", t)
    path, at = F.regexp_replace(get("path", "string"), "/+$", ""), get("lastModified", "string")
    child = path == F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), get("name", "string"))
    instant = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z$"), F.try_to_timestamp(at))
    return df.withColumns({
        "name": get("name", "string"), "path": path, "directory": F.when(typed, get("directory", "boolean")), "size": F.when(typed, get("size", "bigint")),
        "modified": instant, "fault": F.when(~typed, "TYPE").when(~F.coalesce(child, F.lit(False)), "NOT_A_CHILD")})


def whole_listings(listed: DataFrame, listing: str) -> DataFrame:
    """Rows of listings without any fault: one bad row rejects its whole answer."""
    return listed.join(listed.where("fault is not null").select(listing).distinct(), listing, "left_anti").drop("fault")


def _ancestors(path: str):
    """The path itself and every folder above it, "/" last."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.array_distinct(F.concat(above, F.array(F.lit("/"))))


def folder_roots(folders: DataFrame, states: DataFrame, folder: str = "folder", root: str = "root", state: str = "state") -> DataFrame:
    """(folder, root, gate) for every root that is the folder, holds it or stands in it.

    gate: READY if all roots of the folder have state SUCCESS, else NOT_READY; a folder without roots has one row
    with root null and NOT_BUILT. Roots and folders meet by equality with each other's ancestors, never pair by pair.
    """
    asked = folders.select(folder).distinct()
    known = states.select(root, (F.coalesce(F.col(state), F.lit("")) == "SUCCESS").alias("__ok"))
    above = asked.select(folder, F.explode(_ancestors(folder)).alias(root)).join(known, root)
    inside = known.select(root, "__ok", F.explode(_ancestors(root)).alias(folder)).join(asked, folder)
    pairs = above.select(folder, root, "__ok").unionByName(inside.select(folder, root, "__ok")).distinct()
    ready = pairs.groupBy(folder).agg(F.bool_and("__ok").alias("__all"))
    gate = F.when(F.col("__all"), "READY").when(F.col("__all").isNull(), "NOT_BUILT").otherwise("NOT_READY")
    return asked.join(ready, folder, "left").join(pairs.drop("__ok"), folder, "left").select(folder, root, gate.alias("gate"))


def files_under(folders: DataFrame, states: DataFrame, files: DataFrame, path: str = "path", folder: str = "folder", root: str = "root", state: str = "state") -> DataFrame:
    """(folder, path) of the distinct files below each folder whose roots are all read to the end; others show nothing."""
    open_ = folder_roots(folders, states, folder, root, state).where("gate = 'READY'").select(folder, root)
    placed = files.select(root, path, F.explode(_ancestors(path)).alias(folder)).where(F.col(folder) != F.col(path))
    return placed.join(open_, [root, folder]).select(folder, path).distinct()


def valid_codes(requested: Sequence[str] | None, pattern: str = "[0-9]{4}") -> list[str]:
    """The trimmed distinct codes; ``ValueError`` for none and for one that does not fit."""
    import re

    codes = list(dict.fromkeys((c or "").strip() for c in requested or []))
    if not codes or not all(re.fullmatch(pattern, c) for c in codes):
        raise ValueError("a set of codes has one or more, each of which fits the pattern")
    return codes


def replace_codes(current: DataFrame, requested: DataFrame, scope: str, code: str, pattern: str = "[0-9]{4}") -> DataFrame:
    """(scope, code) after a replacement of whole sets: a scope with requested codes that all fit gets them, trimmed and
    distinct; a scope without any, or with one that does not fit, keeps its own. No scope becomes empty."""
    trimmed = requested.select(scope, F.trim(code).alias(code))
    fits = F.coalesce(F.col(code).rlike(f"^(?:{pattern})$"), F.lit(False))
    taken = trimmed.groupBy(scope).agg(F.bool_and(fits).alias("__ok")).where("__ok").select(scope)
    kept = current.select(scope, code).join(taken, scope, "left_anti")
    return kept.unionByName(trimmed.join(taken, scope, "left_semi")).distinct()
