"""Tables pasted from a clipboard, and files on disk."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import squeeze
from noticeflow.sources.html import _read

_KIND = T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))


def _quoted_rows(text: str) -> list[tuple[list[str], str | None]]:
    """Tab-separated rows with quoted cells; a quote that never closes ends with its line and marks the row."""
    out, lines, i = [], text.replace("\r\n", "\n").split("\n"), 0
    while i < len(lines):
        line, error = lines[i], None
        while line.count('"') % 2 and i + 1 < len(lines):
            if "\t" in lines[i + 1] and lines[i + 1].count('"') % 2 == 0:
                error = "UNCLOSED_QUOTE"
                break
            i += 1
            line += "\n" + lines[i]
        cells = [re.sub(r'^"(.*)"$', r"\1", c.strip(), flags=re.S).replace('""', '"') for c in line.split("\t")]
        if any(cells):
            out.append((cells, error))
        i += 1
    return out


@F.pandas_udf(_KIND)
def pasted_rows(values: pd.Series) -> pd.Series:
    """Rows of a pasted HTML table or of tab-separated text, with the reason why a row is bad."""

    def one(x):
        found = [(r, None) for r in _read(x).rows] if "<table" in (x or "").lower() else _quoted_rows(x or "")
        return [{"row": i, "cells": c, "error": e} for i, (c, e) in enumerate(found, 1)]

    return values.map(one)


def import_rows(df: DataFrame, cells: str, keys: dict[str, int], required: int, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with ``required`` cells become columns by place; short, keyless and repeated rows
    are rejected with a reason."""
    names = list(keys)
    wide = df.withColumns({n: F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")) for n, i in keys.items()})
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size(cells) < required, "CELLS").when(F.col(names[0]).isNull(), "EMPTY_KEY")
    marked = wide.withColumn("reason", reason)
    if existing is not None:
        known = existing.select(F.col(names[0]).alias("__k")).distinct()
        marked = marked.join(known, F.col(names[0]) == F.col("__k"), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("__k").isNotNull(), F.lit("DUPLICATE")))).drop("__k")
    return marked.where("reason is null").select(*names), marked.where("reason is not null").select("row", "reason")


def is_header(cells: Column, names: list[str]) -> Column:
    """At least two cells are known headers."""
    return F.size(F.array_intersect(F.transform(cells, squeeze), F.array(*[F.lit(n) for n in names]))) >= 2


def placed_cells(rows: DataFrame, key: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows (``key``, row, cells, error) of pasted tables as (``key``, row, cells in the order of ``fields``, error).

    ``fields``: four names in order (title, client, period, amount), each with the headers that stand for it. A row that
    holds a header of each places the rows after it, up to the next such row, and is itself left out, as are blank rows. A
    row too short for its header stays as it is. Without a header four cells are title, client, period, amount if the
    third has a year and the second none, else title, period, amount, client; five are number, title, period, amount,
    client; others stay as they are. One shuffle by ``key``.
    """
    named = F.transform("cells", lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")))
    first = lambda headers: F.array_position(F.transform(named, lambda c: c.isin(*[h.lower() for h in headers])), F.lit(True)).cast("int")
    places = F.array(*[first(h) for h in fields.values()])
    heads = rows.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).withColumn("__at", places)
    is_head = F.forall("__at", lambda p: p > 0)
    last = F.last(F.when(is_head, F.col("__at")), ignorenulls=True).over(Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    body = heads.withColumns({"__head": is_head, "__last": last}).where("not __head")
    cell = lambda *at: F.array(*[F.get("cells", F.lit(i)) for i in at])
    year = lambda i: F.get("cells", F.lit(i)).rlike("[0-9]{4}")
    by_head = F.when(F.size("cells") < F.array_max("__last"), F.col("cells")).otherwise(F.transform("__last", lambda p: F.get("cells", p - 1)))
    bare = F.when(F.size("cells") == 4, F.when(year(2) & ~year(1), cell(0, 1, 2, 3)).otherwise(cell(0, 3, 1, 2))).when(F.size("cells") == 5, cell(1, 4, 2, 3)).otherwise(F.col("cells"))
    return body.select(key, "row", F.when(F.col("__last").isNotNull(), by_head).otherwise(bare).alias("cells"), "error")


def zipped_sections(spark: SparkSession, path: str, entry: str = r"Contents/section\d+\.xml", most_entries: int = 1000, most_bytes: int = 50_000_000, most_chars: int = 2_000_000) -> DataFrame:
    """(path, text, error) of zipped XML documents: the text of their sections in order, whole, or the error LIMIT
    where entries, unpacked bytes or characters are more than allowed."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("struct<text:string,error:string>")
    def read(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in contents:
            try:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    infos = z.infolist()
                    if len(infos) > most_entries or sum(i.file_size for i in infos) > most_bytes:
                        raise ValueError("LIMIT")
                    names = sorted(i.filename for i in infos if re.fullmatch(entry, i.filename))
                    text = "\n".join(t.strip() for n in names for t in ElementTree.fromstring(z.read(n)).itertext() if t.strip())
                if len(text) > most_chars:
                    raise ValueError("LIMIT")
                rows.append((text, None))
            except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                rows.append((None, type(e).__name__ if str(e) != "LIMIT" else "LIMIT"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return files.withColumn("r", read("content")).select("path", "r.text", "r.error")


def file_index(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, ext, size, modified) of the files below a folder, without hidden and temporary ones."""
    from noticeflow.functions.text import after_last, file_extension

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select("path", after_last(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return named.where(~F.col("name").startswith(".") & ~F.col("name").startswith("~$")).withColumn("ext", file_extension(F.col("name")))
