"""Joins that resolve, overlay and match records of two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.hashing import index_id
from noticeflow.functions.text import java_trim


def with_fallback_id(df: DataFrame, registered: DataFrame, key: str, id_column: str) -> DataFrame:
    """The registered id of a key, or one computed from it."""
    return df.join(registered.select(key, id_column), key, "left").withColumn(id_column, F.coalesce(F.col(id_column).cast("string"), index_id(F.col(key))))


def same_number_and_prefix(api: DataFrame, pages: DataFrame, number: str, code: str, page_id: str) -> DataFrame:
    """API rows with the pages of the same number whose id begins with the row's code and a colon: one to many, never
    merged. Rows meet on the number; the prefix is checked on what meets."""
    joined = api.join(pages, number)
    return joined.where(F.startswith(page_id, F.concat(F.col(code), F.lit(":"))))


def overlay(base: DataFrame, detail: DataFrame, key: Sequence[str], columns: Sequence[str], detail_first: bool = True) -> DataFrame:
    """``base`` with the columns of ``detail`` laid over: non-blank values of the first win, the other fills gaps."""
    d = detail.select(*key, *[F.col(c).alias(f"__d_{c}") for c in columns])
    joined = base.join(d, list(key), "left")

    def pick(c: str) -> Column:
        values = [F.nullif(java_trim(F.col(f"__d_{c}")), F.lit("")), F.nullif(java_trim(F.col(c)), F.lit(""))]
        return F.coalesce(*(values if detail_first else values[::-1]))

    return joined.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in base.columns])


def resolve(wanted: DataFrame, masters: DataFrame, wanted_id: str, master_id: str, keys: Sequence[tuple[str, str]], names: Sequence[tuple[str, str]]) -> DataFrame:
    """(wanted_id, master_id, matched_by) of the best master: by reference, else by all names; the smaller id of
    several. Two equi joins stand for the either-or, so neither becomes a nested loop."""
    def matched(pairs: Sequence[tuple[str, str]], rank: int) -> DataFrame:
        m = masters.select(master_id, *[F.col(b).alias(f"__m{i}") for i, (_, b) in enumerate(pairs)])
        on = [F.col(a) == F.col(f"__m{i}") for i, (a, _) in enumerate(pairs)]
        return wanted.join(m, on).select(wanted_id, master_id, F.lit(rank).alias("rank"))

    both = matched(keys, 1).unionByName(matched(names, 2))
    w = Window.partitionBy(wanted_id).orderBy("rank", master_id)
    best = both.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    found = best.select(wanted_id, master_id, F.when(F.col("rank") == 1, "REFERENCE").otherwise("NAME").alias("matched_by"))
    return wanted.select(wanted_id).join(found, wanted_id, "left")


def site_status(sites: DataFrame, catalog: DataFrame, address: str) -> DataFrame:
    """SUPPORTED where the catalogue has the canonical address, else NEW_SITE."""
    known = catalog.select(F.col(address)).distinct().withColumn("__known", F.lit(True))
    return sites.join(known, address, "left").withColumn("status", F.when(F.col("__known"), "SUPPORTED").otherwise("NEW_SITE")).drop("__known")


def options(masters: DataFrame, existing: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """(key, origin): masters first, then existing ones without a master, then desired ones without either."""
    tagged = [df.select(key).distinct().withColumn("origin", F.lit(i)) for i, df in enumerate((masters, existing, desired))]
    everything = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    lowest = everything.groupBy(key).agg(F.min("origin").alias("origin"))
    return lowest.withColumn("origin", F.get(F.array(*map(F.lit, ("MASTER", "EXISTING", "DESIRED"))), F.col("origin")))


def relevant_first(license_match: Column, relevance: Column, takes_unknown: Column) -> Column:
    """A match of licenses decides; without one relevance does; unknown ones pass where the source takes them."""
    return F.coalesce(license_match, F.lit(False)) | (relevance == "RELEVANT") | ((relevance == "UNKNOWN") & takes_unknown)


def allowed_fields(fields: Column, names: Sequence[str], secret: str = r"(?i)(key|token|password)=") -> Column:
    """A map's allowed entries, values that hold a secret replaced."""
    kept = F.map_filter(fields, lambda k, _: k.isin(*names))
    return F.transform_values(kept, lambda _, v: F.when(v.rlike(secret), "[REDACTED]").otherwise(v))


def discover_links(links: DataFrame, site: str, pattern: str, least: int = 2) -> DataFrame:
    """(site, pattern, n, confidence, outcome): the pattern that most links of a site share, if ``least`` do.

    READY from a share of one half on, else MANUAL_REVIEW; sites without a shared pattern FAILED.
    """
    counted = links.groupBy(site, pattern).agg(F.count("*").alias("n"))
    total = counted.groupBy(site).agg(F.sum("n").alias("total"), F.max_by(F.struct("n", pattern), F.struct("n", F.col(pattern))).alias("best"))
    share = F.round(F.col("best.n") / F.col("total"), 4)
    enough = F.col("best.n") >= least
    outcome = F.when(~enough, "FAILED").when(share >= 0.5, "READY").otherwise("MANUAL_REVIEW")
    return total.select(site, F.when(enough, F.col(f"best.{pattern}")).alias(pattern), F.col("best.n").alias("n"), share.alias("confidence"), outcome.alias("outcome"))
