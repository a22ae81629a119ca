"""Table constraints as queries that return what breaks them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, key) for each rule that does not hold, in one pass; null counts as holding, as in a CHECK."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(rule, key) of keys that stand more than once."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    """(rule, key) of child keys without a parent."""
    lost = children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(child_key).cast("string").alias("key")).distinct()


def exactly_one(*columns: Column) -> Column:
    """One of the columns is set, no more."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns]) == 1
