"""Filters, pages and existence joins of stored-row listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_excluded(x: Column, excluded: Sequence[str]) -> Column:
    """Null-safe: the trimmed upper-case value is none of the excluded ones; null passes."""
    return ~F.coalesce(F.upper(F.trim(x)), F.lit("")).isin(*excluded)


def in_days(at: Column, first: str | None = None, last: str | None = None) -> Column:
    """From the start of ``first`` to the end of ``last``; with a bound set, null fails."""
    out = F.lit(True)
    if first is not None:
        out = out & (at >= F.lit(first).cast("date"))
    if last is not None:
        out = out & (at < F.date_add(F.lit(last).cast("date"), 1))
    return out


def optional_filters(df: DataFrame, **equals) -> DataFrame:
    """Equality filters; those of None are left out, so they reach the scan when set."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, largest: int = 100) -> DataFrame:
    """One page (from 0) of ``size`` rows, ``largest`` at most (a larger size is the largest). ``order`` ends in a unique
    key; a top-k plan, no full sort."""
    size = max(1, min(size, largest))
    return df.orderBy(*order).offset(number * size).limit(size)


def totals(df: DataFrame, size: int) -> DataFrame:
    """total and pages of a listing."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(float(size))).cast("bigint"))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def with_child(parents: DataFrame, children: DataFrame, on: Column) -> DataFrame:
    """Parents that have a child, each once."""
    return parents.join(children, on, "left_semi")


def without_child(parents: DataFrame, children: DataFrame, on: Column) -> DataFrame:
    return parents.join(children, on, "left_anti")


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by an ascending total order: one aggregation that combines before the shuffle."""
    named = {f"__key{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    places = F.struct(*[F.struct(c.isNull().alias("last"), c.alias("at")).alias(f"o{i}") for i, c in enumerate(order)])
    best = df.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*df.columns), places).alias("__row"))
    return best.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order`` (ends in a unique key): one partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def code_overlap(codes: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in wanted]))


def below_folder(path: Column, folder: str) -> Column:
    """Strictly below the folder; everything is below "/"."""
    return F.lit(True) if folder == "/" else path.startswith(folder.rstrip("/") + "/")


def overlapping_roots(root: Column, folder: str) -> Column:
    """The root holds the folder or stands in it."""
    return (root == folder) | below_folder(root, folder) | F.startswith(F.lit(folder), F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def unique_codes(df: DataFrame, code: str, fixed: DataFrame) -> DataFrame:
    """Rows whose code neither stands in ``fixed`` nor twice among themselves (then all of them go)."""
    alone = df.withColumn("__n", F.count("*").over(Window.partitionBy(code))).where("__n = 1").drop("__n")
    return alone.join(fixed.select(code), code, "left_anti")


def priority_budget(df: DataFrame, priority: Column, order: Sequence[Column], budget: int, per: Sequence[str] = ()) -> DataFrame:
    """The first ``budget`` rows per group by priority, then order. Without groups each task first gives its own best
    ``budget`` rows, and only these meet."""
    if not per:
        df = df.orderBy(priority, *order).limit(budget)
    w = Window.partitionBy(*per).orderBy(priority, *order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)


def collision_free_names(df: DataFrame, per: Sequence[str], name: str, order: Sequence[Column]) -> DataFrame:
    """Names that are equal without regard to case get (2), (3)… before their extension in order; a number is passed over
    where the name it makes is itself given, so all names of a group differ."""
    parts = [F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", i) for i in (1, 2)]
    numbered = F.regexp_extract(parts[0], r"^(.*) \(([0-9]{1,9})\)$", 2)
    base = F.lower(F.concat(F.regexp_extract(parts[0], r"^(.*) \(([0-9]{1,9})\)$", 1), parts[1]))
    given = df.where(numbered != "").groupBy(*per, base.alias("__base")).agg(F.array_sort(F.collect_set(numbered.cast("int"))).alias("__given"))
    n = F.row_number().over(Window.partitionBy(*per, F.col("__base")).orderBy(*order))
    ranked = df.withColumn("__base", F.lower(F.col(name))).withColumn("__n", n).join(given, [*per, "__base"], "left")
    free = F.aggregate(F.coalesce("__given", F.array().cast("array<int>")), F.col("__n"), lambda at, x: F.when(x <= at, at + 1).otherwise(at))
    made = F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(parts[0], F.lit(" ("), free.cast("string"), F.lit(")"), parts[1]))
    return ranked.withColumn("entry_name", made).select(*df.columns, "entry_name")
