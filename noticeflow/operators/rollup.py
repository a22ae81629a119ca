"""Counts, readiness and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.presets import RANKING_STOP_WORDS
from noticeflow.functions.pyudf import nfkc
from noticeflow.operators.dictionary import with_names


def child_counts(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One count per name: rows of a child table (with a column ``key``) for which its condition holds. Each child is
    aggregated before it is joined, so parents keep their number of rows."""
    out = parents
    for name, (child, condition) in children.items():
        out = out.join(child.groupBy(key).agg(F.count_if(condition).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return out


def readiness(total: Column, missing: Column) -> Column:
    """DRAFT without items, READY when nothing is missing, else COLLECTING."""
    return F.when(total == 0, "DRAFT").when(missing == 0, "READY").otherwise("COLLECTING")


def with_grand_total(df: DataFrame, group: str, sums: Mapping[str, Column], total: str = "TOTAL") -> DataFrame:
    """One row per group and one for all."""
    aggregates = [c.alias(n) for n, c in sums.items()]
    each = df.groupBy(group).agg(*aggregates)
    everything = each.agg(*[F.sum(n).cast("bigint").alias(n) for n in sums]).select(F.lit(total).alias(group), *sums)
    return each.select(group, *[F.col(n).cast("bigint").alias(n) for n in sums]).unionByName(everything)


def top_per_group(df: DataFrame, per: Sequence[str], order: Sequence[Column], k: int, place: str = "place") -> DataFrame:
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= k)


def value_if_unique(value: str) -> Column:
    """An aggregate: the value if a group has one distinct, else empty."""
    return F.when(F.min(value) == F.max(value), F.max(value)).otherwise("")


def with_latest_flag(df: DataFrame, per: Sequence[str], at: str) -> DataFrame:
    """The group's last time and whether a row has it."""
    last = F.max(at).over(Window.partitionBy(*per))
    return df.withColumns({"latest_at": last, "is_latest": F.coalesce(F.col(at) == last, F.lit(False))})


def tokens(name: Column, stop_words: Sequence[str], shortest: int = 2, years: str = "^(19|20)[0-9]{2}년?$") -> Column:
    """Distinct lower-case tokens of letters and digits, without years, stop words and short ones."""
    parts = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= shortest) & ~t.rlike(years) & ~t.isin(*stop_words)))


#: Rows of tokens up to which a join sends them to every task.
_FEW = 200_000


def rank_candidates(entries: DataFrame, files: DataFrame, k: int = 30, stop_words: Sequence[str] = RANKING_STOP_WORDS) -> DataFrame:
    """The ``k`` best files for each entry by token coverage and client.

    ``entries(entry_id, name, client)``, ``files(file_id, file_name, path, modified)``. Names are compared in NFKC and
    lower case. A file is a candidate if its name holds the whole squeezed entry name, or enough of its tokens: at least
    min(2, tokens) and half of them with the client in the file's name too, three quarters without. Score = coverage
    (1 if exact) * 0.8 + client * 0.2; ties by newest, nulls last, then path. A token counts wherever it stands in the
    squeezed file name, inside longer words too, and an exact name needs no token.

    An entry of n tokens that needs m of them is met by one of its n - m + 1 rarest, since a file without these has too
    few; without tokens, by its whole name. An automaton of these words reads each file's name once, and a pair is formed
    by the first of them that the name holds, so each pair comes once and is judged where it is formed: no pair is
    shuffled before it is a candidate, and files are never sent whole to every task.
    """
    squeezed = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    named = entries.select("entry_id", nfkc("name").alias("name"), nfkc("client").alias("client"))
    e = named.select("entry_id", squeezed(F.col("name")).alias("whole"), squeezed(F.col("client")).alias("client"), tokens(F.col("name"), stop_words).alias("wanted"))
    f = files.select("file_id", "path", "modified", squeezed(nfkc("file_name")).alias("file"))
    words = e.select(F.explode("wanted").alias("word")).distinct().unionByName(e.where(F.size("wanted") == 0).select(F.col("whole").alias("word"))).where("word <> ''").distinct()
    read = with_names(f, "file", words, "word", "held")
    often = read.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    by_rarity = F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")))
    asked = e.select("wanted", F.explode("wanted").alias("word")).join(often, "word", "left").groupBy("wanted").agg(by_rarity["word"].alias("sorted"))
    n = F.size("wanted")
    least = F.greatest(F.least(F.lit(2), n), F.ceil(n / 2).cast("int"))
    keys = F.when(n > 0, F.slice("sorted", F.lit(1), n - least + 1)).when(F.col("whole") != "", F.array("whole")).otherwise(F.array().cast("array<string>"))
    met = e.join(asked, "wanted", "left").select("*", keys.alias("keys")).drop("sorted").select("*", F.explode("keys").alias("word"))
    small = (e.agg(F.sum(F.greatest(n, F.lit(1)))).first()[0] or 0) <= _FEW
    met = F.broadcast(met) if small else met.hint("merge")
    offered = read.select("file_id", "path", "modified", "file", "held", F.explode("held").alias("word"))
    first = F.get(F.filter("keys", lambda x: F.array_contains(F.col("held"), x)), F.lit(0))
    pairs = offered.join(met, "word").where(F.col("word") == first)
    pairs = pairs.withColumn("hits", F.size(F.filter("wanted", lambda t: F.contains(F.col("file"), t))))
    coverage = F.when(F.size("wanted") > 0, F.col("hits") / F.size("wanted")).otherwise(0.0)
    exact = (F.col("whole") != "") & F.contains("file", "whole")
    client = F.coalesce((F.col("client") != "") & F.contains("file", "client"), F.lit(False))
    score = F.when(exact, 1.0).otherwise(coverage) * 0.8 + F.when(client, 0.2).otherwise(0.0)
    enough = (F.size("wanted") > 0) & (F.col("hits") >= F.least(F.lit(2), F.size("wanted"))) & (coverage >= F.when(client, 0.5).otherwise(0.75))
    scored = pairs.where(exact | enough).select("entry_id", "file_id", "path", "modified", F.round(score, 6).alias("score"))
    return top_per_group(scored, ["entry_id"], [F.desc("score"), F.col("modified").desc_nulls_last(), F.col("path"), F.col("file_id")], k)


def best_kind(ranked: DataFrame, per: Sequence[str], kind: str, order: Sequence[str]) -> DataFrame:
    """Rows of the first kind (by ``order``) that a group has at all."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(kind))
    best = F.min(F.when(rank > 0, rank)).over(Window.partitionBy(*per))
    return ranked.withColumns({"__r": rank, "__b": best}).where("__r = __b").drop("__r", "__b")
