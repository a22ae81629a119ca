"""Change detection, versions and idempotent writes as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _paired(previous: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = previous.select(*keys, F.struct("*").alias("p"))
    return p.join(incoming.select(*keys, F.struct("*").alias("c")), list(keys), "full_outer")


def detect_changes(previous: DataFrame, incoming: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """keys and change: NEW, UNCHANGED, UPDATED, or MISSING for rows that no longer come."""
    both = _paired(previous, incoming, keys)
    same = F.col(f"p.{digest}").eqNullSafe(F.col(f"c.{digest}"))
    change = F.when(F.col("p").isNull(), "NEW").when(F.col("c").isNull(), "MISSING").when(same, "UNCHANGED").otherwise("UPDATED")
    return both.select(*keys, change.alias("change"))


def merge_current(previous: DataFrame, incoming: DataFrame, keys: Sequence[str], digest: str, first_seen: str, last_seen: str) -> DataFrame:
    """The table after the merge: incoming content wins, first_seen never changes, last_seen only grows."""
    both = _paired(previous, incoming, keys)
    out = list(keys)
    for c in previous.columns:
        if c in keys:
            continue
        old, new = F.col(f"p.{c}"), F.col(f"c.{c}")
        if c == first_seen:
            out.append(F.coalesce(old, new).alias(c))
        elif c == last_seen:
            out.append(F.greatest(old, new).alias(c))
        else:
            out.append(F.when(F.col("c").isNull(), old).otherwise(new).alias(c))
    return both.select(*out)


def archive_versions(previous: DataFrame, incoming: DataFrame, archive: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Old rows to append to the archive: replaced by other content, and not archived with this content yet."""
    changed = previous.join(incoming.select(*keys, F.col(digest).alias("__new")), list(keys)).where(~F.col(digest).eqNullSafe(F.col("__new"))).drop("__new")
    return insert_if_absent(changed, archive, [*keys, digest])


def insert_if_absent(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not exist yet, one per key."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace existing ones of their key; columns by name."""
    return existing.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def replace_scopes(existing: DataFrame, incoming: DataFrame, scope: Sequence[str]) -> DataFrame:
    """All rows of every scope that comes in are replaced by the incoming ones."""
    return existing.join(incoming.select(*scope).distinct(), list(scope), "left_anti").unionByName(incoming)


def replace_succeeded(existing: DataFrame, incoming: DataFrame, states: DataFrame, scope: str) -> DataFrame:
    """Rows after a refresh of scopes, of which ``states(scope, state, readable)`` has one row each: those of state SUCCESS
    are replaced as a whole, others keep their rows, and only readable scopes are shown."""
    known = states.select(scope, (F.col("state") == "SUCCESS").alias("__new"), F.col("readable").alias("__shown"))
    old = existing.join(known, scope).where("__shown and not __new")
    new = incoming.join(known, scope).where("__shown and __new")
    return old.select(*existing.columns).unionByName(new.select(*existing.columns))


def sync_actions(have: DataFrame, want: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and action: KEEP, INSERT or DELETE."""
    a = have.select(*keys, F.lit(True).alias("h")).distinct()
    b = want.select(*keys, F.lit(True).alias("w")).distinct()
    action = F.when(F.col("h") & F.col("w"), "KEEP").when(F.col("w"), "INSERT").otherwise("DELETE")
    return a.join(b, list(keys), "full_outer").select(*keys, action.alias("action"))


def compare_and_set(df: DataFrame, version: str, expected: Column, changes: dict[str, Column]) -> DataFrame:
    """Columns change, and the version grows, only where the version is the expected one."""
    hit = F.col(version).eqNullSafe(expected)
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()} | {version: F.when(hit, F.col(version) + 1).otherwise(F.col(version))})


def soft_delete(df: DataFrame, gone: Column, flag: str = "active") -> DataFrame:
    return df.withColumn(flag, F.when(gone, F.lit(False)).otherwise(F.col(flag)))


def cascade(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children whose parent still stands."""
    return children.join(parents.select(*keys), list(keys), "left_semi")


def merge_observations(df: DataFrame, key: Sequence[str], union: Sequence[str], status: str, ranks: Sequence[str]) -> DataFrame:
    """Per key the sorted union of list-like values and the best status ever seen (last of ``ranks``)."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(status))
    best = F.max_by(status, rank).alias(status)
    return df.groupBy(*key).agg(best, *[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in union])


def keep_last_good(old: Column, new: Column, available: Column) -> Column:
    """The new value only where it could be fetched."""
    return F.when(available, new).otherwise(old)


def union_lists(old: Column, new: Column) -> Column:
    """Sorted union of two lists in JSON."""
    read = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_sort(F.array_union(read(old), read(new))))


def changed_decisions(df: DataFrame, key: Sequence[str], old: Sequence[Column], new: Sequence[Column]) -> DataFrame:
    """Rows whose decision tuple differs, null-safe."""
    same = F.lit(True)
    for a, b in zip(old, new):
        same = same & a.eqNullSafe(b)
    return df.where(~same)


def last_state(audit: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of an append-only audit per key."""
    best = audit.groupBy(*key).agg(F.max_by(F.struct(*[c for c in audit.columns if c not in key]), F.struct(*order)).alias("r"))
    return best.select(*key, "r.*")


def unchanged_since(df: DataFrame, per: Sequence[str], order: Sequence[Column], digest: str) -> DataFrame:
    """Rows of a history that differ from the one before them."""
    before = F.lag(digest).over(Window.partitionBy(*per).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*per).orderBy(*order)) == 1
    return df.withColumns({"__b": before, "__f": first}).where(F.col("__f") | ~F.col(digest).eqNullSafe(F.col("__b"))).drop("__b", "__f")
