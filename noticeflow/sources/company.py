"""Bounded, read-only scans of another system's database."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*")


def bounded_read(spark: SparkSession, url: str, table: str, columns: Sequence[str], key: str, most_rows: int = 500, timeout_seconds: int = 10, where: Sequence[tuple[str, str, str]] = (), properties: Mapping[str, str] | None = None) -> DataFrame:
    """The first ``most_rows`` rows of a table by ``key``, with ``more``: whether there are others.

    The database itself selects the columns, filters and stops one row after the bound, under a time limit, so neither a
    large table nor a slow one reaches Spark. ``where`` holds (column, operator, text), all of which hold; texts are
    quoted, and columns are named exactly. Names that are not plain identifiers and other operators are errors: nothing but a SELECT can be sent.
    """
    names = [table, key, *columns, *(c for c, _, _ in where)]
    bad = [n for n in names if not _NAME.fullmatch(n)] + [op for _, op, _ in where if op not in ("=", "<>", "<", "<=", ">", ">=", "LIKE")]
    if bad:
        raise ValueError(f"not allowed in a read: {bad}")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    exact = lambda c: f'"{c}"'
    chosen = "".join(f" {'AND' if i else 'WHERE'} {exact(c)} {op} {quoted(x)}" for i, (c, op, x) in enumerate(where))
    query = f"(SELECT {', '.join(map(exact, columns))} FROM {table}{chosen} ORDER BY {exact(key)} FETCH FIRST {most_rows + 1} ROWS ONLY) bounded"
    found = spark.read.format("jdbc").options(**(properties or {})).options(url=url, dbtable=query, queryTimeout=str(timeout_seconds), fetchsize="100").load()
    named = found.toDF(*columns)
    w = Window.orderBy(F.col(key))  # of at most one row more than the bound
    placed = named.withColumns({"__place": F.row_number().over(w), "more": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > most_rows})
    return placed.where(F.col("__place") <= most_rows).drop("__place")
