"""Document lines: sections, context and list items as window computations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_lines(df: DataFrame, key: str, text: str, line_break: str = r"\n") -> DataFrame:
    """(key, pos, line): trimmed lines; blank ones keep their place in the count but are left out."""
    split = df.select(key, F.posexplode(F.split(text, line_break, -1)).alias("pos", "line"))
    return split.withColumn("line", F.trim("line")).where("line <> ''")


def distinct_lines(lines: DataFrame, key: str, norm: Column) -> DataFrame:
    """The first line of each normalised form in a document."""
    w = Window.partitionBy(key, norm).orderBy("pos")
    return lines.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def section_lines(lines: DataFrame, key: str, heading: Column, boundary: Column) -> DataFrame:
    """Lines after a heading, up to the next boundary or heading, with the heading's place."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(heading, F.struct(F.col("pos").alias("at"), F.lit(True).alias("open"))).when(boundary, F.struct(F.col("pos").alias("at"), F.lit(False).alias("open")))
    tagged = lines.withColumn("__m", F.last(mark, ignorenulls=True).over(w))
    return tagged.where("__m.open and pos > __m.at").withColumn("heading_pos", F.col("__m.at")).drop("__m")


def context_before(lines: DataFrame, key: str, keyword: Column, reach: int = 3, stop: Column | None = None) -> DataFrame:
    """Lines with the keyword in one of the ``reach`` lines before, none of the lines since being a stop."""
    w = Window.partitionBy(key).orderBy("pos")
    n = F.row_number().over(w)
    numbered = lines.withColumns({"__n": n, "__k": keyword, "__s": F.lit(False) if stop is None else stop})
    back = Window.partitionBy(key).orderBy("pos").rowsBetween(-reach, -1)
    seen = F.max(F.when(F.col("__k"), F.col("__n"))).over(back)
    stopped = F.max(F.when(F.col("__s"), F.col("__n"))).over(back)
    return numbered.withColumns({"__a": seen, "__b": stopped}).where("__a is not null and (__b is null or __b < __a)").drop("__n", "__k", "__s", "__a", "__b")


def value_after(lines: DataFrame, key: str, heading: Column, value: Column, stop: Column, reach: int = 4) -> DataFrame:
    """Headings with the first value in the ``reach`` lines after, before any stop."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumns({"__v": value, "__s": stop, "__h": heading})
    found = F.lit(None).cast("string")
    for i in range(reach, 0, -1):
        found = F.when(F.lead("__s", i).over(w), F.lit(None)).when(F.lead("__v", i).over(w).isNotNull(), F.lead("__v", i).over(w)).otherwise(found)
    return marked.withColumn("value", found).where("__h and value is not null").drop("__v", "__s", "__h")


def group_items(lines: DataFrame, key: str, starts: Column, separator: str = " ") -> DataFrame:
    """List items: an item's line and the lines after it that start none, joined. Lines before the first item go."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("item", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("item > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), separator)
    return tagged.groupBy(key, "item").agg(joined.alias("text"), F.count("*").alias("n_lines"))


def requirements(lines: DataFrame, key: str, signals: Sequence[str], kinds: Sequence[tuple[str, Sequence[str]]], conditional: Sequence[str]) -> DataFrame:
    """Lines that ask for something, with kind and whether they ask on a condition; once per document and kind."""
    from noticeflow.functions.text import name_key
    from noticeflow.operators.rules import any_in, file_kind

    low = F.lower("line")
    hits = lines.where(any_in(low, signals)).select(key, "pos", "line", file_kind(F.col("line"), kinds).alias("kind"), F.when(any_in(low, conditional), "CONDITIONAL").otherwise("REQUIRED").alias("need"))
    return distinct_lines(hits, key, name_key(F.col("line")))


def line_lists(lines: DataFrame, key: str, lists: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """One row per document: an array of lines for each named list, in the document's order, each normalised form once.

    A list takes a line that holds one of ``words`` and none of ``unless``, and every line of a section that one of
    ``headings`` starts (a line that begins with it), up to the next heading of any list. The heading itself is no entry.
    One window and one aggregation on the same key, so one shuffle; a document without an entry has empty arrays.
    """
    from noticeflow.functions.text import name_key
    from noticeflow.operators.rules import any_in

    low = F.lower("line")
    heads = [(name, h.lower()) for name, spec in lists.items() for h in spec.get("headings", ())]
    mark = F.coalesce(F.lit(None).cast("string"), *[F.when(F.startswith(low, F.lit(h)), F.lit(name)) for name, h in heads])
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("__mark", mark).withColumn("__in", F.last("__mark", ignorenulls=True).over(w))

    def taken(name: str, spec: Mapping[str, Sequence[str]]) -> Column:
        said = any_in(low, [x.lower() for x in spec["words"]]) if spec.get("words") else F.lit(False)
        if spec.get("unless"):
            said = said & ~any_in(low, [x.lower() for x in spec["unless"]])
        return F.col("__mark").isNull() & (said | F.coalesce(F.col("__in") == name, F.lit(False)))

    entry = F.struct("pos", "line", name_key(F.col("line")).alias("norm"))

    def firsts(entries: Column) -> Column:
        seen = F.aggregate(F.array_sort(entries), F.struct(F.array().cast("array<string>").alias("norms"), F.array().cast("array<string>").alias("lines")), lambda acc, x: F.when(
            F.array_contains(acc["norms"], x["norm"]), acc).otherwise(F.struct(F.array_append(acc["norms"], x["norm"]).alias("norms"), F.array_append(acc["lines"], x["line"]).alias("lines"))))
        return seen["lines"]

    gathered = tagged.groupBy(key).agg(*[F.collect_list(F.when(taken(n, s), entry)).alias(n) for n, s in lists.items()])
    return gathered.select(key, *[firsts(F.col(n)).alias(n) for n in lists])
