"""Texts against dictionaries of many names: an automaton finds all names of a text in one reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import four_digit_codes

#: Names of one automaton; a larger dictionary is read in so many shards.
NAMES = 200_000
#: Rows that a worker reads and sends on at a time.
ROWS = 1_000


def _squeezed(c: str):
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", "")


def with_names(df: DataFrame, text: str, names: DataFrame, name: str = "name", out: str = "names", most: int = NAMES, value: str | None = None) -> DataFrame:
    """``df`` with ``out``: the distinct names that stand in each row's text, in order, white space left out in both; of
    names with another ``value`` column, its distinct values.

    The automaton of at most ``most`` names is built once in a worker and reads each text once, whatever the number of
    names. A larger dictionary is dealt to shards by a hash, and rows go through one shard after the other. Rows stay
    whole and where they are: nothing is shuffled. Null and blank names match nothing.
    """
    spark = df.sparkSession
    wanted = names.select(F.col(value or name).cast("string").alias("name"), _squeezed(name).alias("form")).where("form <> ''").distinct()
    shards = max(1, -(-wanted.count() // most))
    given = wanted.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)))
    rows = df.withColumn("__form", _squeezed(text)).withColumn(out, F.array().cast("array<string>"))
    for k in range(shards):
        part = {}
        for r in given.where(F.col("shard") == k).select("form", "name").toLocalIterator():  # about ``most`` names
            part.setdefault(r["form"], []).append(r["name"])
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for form, own in shared.value.items():
                automaton.add_word(form, own)
            automaton.make_automaton()
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    form, before = some.column("__form").to_pylist(), some.column(out).to_pylist()
                    found = [sorted({*b, *(n for _, own in automaton.iter(x) for n in own)}, key=lambda n: (n is None, n)) for x, b in zip(form, before)]
                    yield some.set_column(some.schema.get_field_index(out), out, pa.array(found, pa.list_(pa.string())))

        if part:
            rows = rows.mapInArrow(run, rows.schema)
    return rows.drop("__form")


def names_found(df: DataFrame, key: str, text: str, names: DataFrame, name: str = "name", most: int = NAMES) -> DataFrame:
    """(``key``, ``name``) of the names that stand in a text, by ``with_names``; each pair once. Rows of one key count as
    one text each."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = with_names(rows, "text", names, name, most=most)
    return found.select(F.col("key").alias(key), F.explode("names").alias(name)).distinct()


def license_codes(df: DataFrame, key: str, text: str, verified: DataFrame, unique: bool = False) -> DataFrame:
    """(``key``, code, official_name): codes of four digits that a field names, and those of ``verified(code, name)``
    whose names stand in it. The official name of a code is that of ``verified``, else empty; each code once.

    A row's codes come together in the row; rows of one key are brought together, unless each key is ``unique``."""
    named = with_names(df.select(key, F.col(text).cast("string").alias("__text")), "__text", verified, out="__named", value="code")
    said = F.coalesce(four_digit_codes(F.col("__text")), F.array().cast("array<string>"))
    codes = named.select(key, F.explode(F.array_distinct(F.concat(said, "__named"))).alias("code"))
    official = verified.groupBy("code").agg(F.min("name").alias("official_name"))
    return (codes if unique else codes.distinct()).join(official, "code", "left").select(key, "code", F.coalesce("official_name", F.lit("")).alias("official_name"))
