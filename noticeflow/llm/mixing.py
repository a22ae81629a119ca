"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.staging import free_prefix, stage

WORD = r"[^\x20\x09-\x0D]+"
#: A step of the search for a source's cut fixes so many bits of the drawing order; steps; bits of an order.
_BITS, _STEPS, _ORDER = 12, 2, 63


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_order(seed: int, *parts: Column) -> Column:
    """A seeded place in the drawing order, 0 to 2**63 - 1: the same on every run and machine."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 1)


def water_fill(sources: DataFrame, share: float = 1.5, most_epochs: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size)``, one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A source is
    clamped at ``most_epochs`` times its size and what is over goes to the others by weight, until none is above.
    In order of cap by weight the clamped sources are a prefix, so the fixed point needs running sums only.
    The windows run over one row per source. An empty table stays empty; sizes of zero give targets of zero.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    ranked = sources.select(
        "source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("place"),
        (F.sum("source_size").over(everything) * share).alias("total"), (F.col("source_size") * most_epochs).alias("cap"))
    weighed = ranked.withColumn("w", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    before = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    tried = weighed.withColumn("clamped", F.col("cap") * free <= left * F.col("w"))
    spare = F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("w"))).over(everything)
    return tried.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", spare * F.col("w") / open_weight)).alias("target"))


def _cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the drawing place at which its extra words run out, the words left there and the rows tied there.

    A radix search: sums by the leading bits of the place find the range that holds the cut, the next bits
    narrow it, and only rows of the last range are put in order. No step puts a source's rows in one task.
    """
    at = sources.select("source", "extra", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done")).where("extra > 0")
    for step in range(1, _STEPS + 1):
        lead = F.shiftright("u", _ORDER - _BITS * step)
        within = rows.withColumn("lead", lead)
        if step > 1:
            within = within.join(at.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("lead", _BITS) == F.col("prefix")))
        sums = within.groupBy("source", "lead").agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("lead"))
        sums = sums.select(F.col("source").alias("s"), "lead", "words", running.alias("through"))
        hit = sums.join(at, F.col("source").eqNullSafe(F.col("s"))).withColumn("through", F.col("through") + F.col("done"))
        hit = hit.where("through >= extra and through - words < extra")
        at = stage(hit.select("source", "extra", F.col("lead").alias("prefix"), (F.col("through") - F.col("words")).alias("done")), "mix-cut")
    last = rows.join(at.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("u", _ORDER - _BITS * _STEPS) == F.col("prefix")))
    ties = last.groupBy("source", "extra", "done", "u").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    through = F.col("done") + F.sum("words").over(Window.partitionBy("source").orderBy("u"))
    found = ties.withColumn("through", through).where("through >= extra and through - words < extra")
    return found.select("source", F.col("u").alias("cut"), F.expr("(extra - (through - words)) div ties").alias("rest"))


def plan_mix(rows: DataFrame, share: float = 1.5, most_epochs: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Decisions per source from staged ``rows(source, size, u)``: source_size, target, whole, cut, rest."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = water_fill(sizes, share, most_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = filled.withColumn("whole", whole).withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    planned = stage(planned, "mix-plan")
    cuts = _cuts(rows, planned).withColumnRenamed("source", "s")
    return stage(planned.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", "rest"), "mix-decisions")


def _with_extra(df: DataFrame, decisions: DataFrame, prefix: str) -> DataFrame:
    renamed = decisions.select([F.col(c).alias(prefix + c) for c in decisions.columns])
    joined = df.join(renamed, F.col(prefix + "key").eqNullSafe(F.col(prefix + "source")))
    u, cut = F.col(prefix + "u"), F.col(prefix + "cut")
    extra = F.when(u < cut, F.col(prefix + "size")).when(u == cut, F.col(prefix + "rest")).otherwise(0)
    return joined.withColumn(prefix + "extra", F.coalesce(extra, F.lit(0)).cast("long"))


def mix_report(docs: DataFrame, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", **plan) -> DataFrame:
    """Words that the mix takes from each document: doc_id, size, source_size, target, taken (and copies, extra).

    Each document is taken whole ``copies`` times; one further, fractional repetition goes through a source's
    documents in seeded order until the target is met, and stops inside the document that meets it (``extra``
    words). Per source the words taken equal the rounded target, but for less than one word per row of rows tied
    in that order (same id and text). A null text has size 0; a null source is a source of its own; repeated rows
    count each. Empty table: empty result. Other columns play no part.
    """
    u = draw_order(seed, F.col(doc_id), F.col(text))
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), u.alias("u")), "mix-rows")
    decided = _with_extra(rows.select("doc_id", "size", F.col("source").alias("_key"), F.col("u").alias("_u"), F.col("size").alias("_size")), plan_mix(rows, **plan), "_")
    return decided.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"), F.col("_whole").alias("copies"), F.col("_extra").alias("extra"))


def mix(docs: DataFrame, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", **plan) -> DataFrame:
    """The mixed corpus itself: rows of ``docs`` repeated as ``mix_report`` says, all columns kept.

    Whole repetitions repeat the row. The one document per source in which the target is met adds a row whose
    text is cut after the words it gives; a document that gives no word adds none. Documents of no words are
    taken by whole repetitions only. A column n_chars, where there is one, follows the cut text.
    """
    columns = docs.columns
    p = free_prefix(docs, "__mix_")
    keyed = docs.withColumns({p + "key": F.col(source), p + "size": word_count(F.col(text)), p + "u": draw_order(seed, F.col(doc_id), F.col(text))})
    rows = stage(keyed.select(F.col(p + "key").alias("source"), F.col(p + "size").alias("size"), F.col(p + "u").alias("u")), "mix-rows")
    decided = _with_extra(keyed, plan_mix(rows, **plan), p)
    copies = F.when(F.col(p + "whole") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col(p + "whole").cast("int"))).otherwise(F.array().cast("array<long>"))
    parts = F.concat(copies, F.when(F.col(p + "extra") > 0, F.array(p + "extra")).otherwise(F.array().cast("array<long>")))
    spread = decided.withColumn(p + "words", F.explode(parts))
    is_cut = (F.col(p + "words") >= 0) & (F.col(p + "words") < F.col(p + "size"))
    words = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before it
    kept = F.when(is_cut, F.array_join(F.slice(words, F.lit(1), F.col(p + "words").cast("int")), "")).otherwise(F.col(text))
    out = spread.withColumn(text, kept)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(is_cut, F.length(text)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in columns])
