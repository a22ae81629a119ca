"""Paged listings as Spark sources: one input partition per window and page."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructType


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedJsonSource(DataSource):
    """``format("paged_json")``: option ``pages`` is a template with {page}, ``first`` and ``last`` page numbers.

    Each page is a JSON object with ``items`` (a list, or one object) and ``totalCount``; rows are (page, total,
    item as JSON). Pages are read in parallel by the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, total bigint, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedJsonReader(self.options)


class PagedJsonReader(DataSourceReader):
    def __init__(self, options):
        self.template, self.first, self.last = options["pages"], int(options.get("first", 1)), int(options.get("last", 1))

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(self.first, self.last + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        with open(self.template.format(page=partition.number), encoding="utf-8") as f:
            body = json.load(f)
        items = body.get("items") or []
        for item in items if isinstance(items, list) else [items]:
            yield partition.number, int(body.get("totalCount") or 0), json.dumps(item, ensure_ascii=False)


def paged_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, total, item) of stored pages, one JSON object each, read by Spark from any file system it knows. ``items`` is
    a list or one object; what is no JSON gives no rows."""
    body = F.from_json("value", "items string, totalCount bigint")
    items = F.when(F.startswith(F.ltrim("b.items"), F.lit("[")), F.from_json("b.items", "array<string>")).when(F.col("b.items").isNotNull(), F.array("b.items"))
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), body.alias("b"))
    return pages.select("file", F.coalesce("b.totalCount", F.lit(0)).alias("total"), F.explode(items).alias("item"))


def fetch_listings(requests: DataFrame, key: str, fetch: Callable[..., dict], size: int, tasks: int = 32, most_pages: int = 10_000, stored: DataFrame | None = None) -> DataFrame:
    """(key, page, total, item, error) of paged listings, one for each distinct key.

    ``fetch(key, page)`` runs in the tasks and gives {"items", "totalCount"}; pages from 1 to ceil(total of page 1 / size).
    A failure ends its own listing only: the rows of the pages before it stay, and one row (item null) names the
    page and the kind of error: that of ``fetch``, REPEATED_PAGE for a page equal to an earlier one, EMPTY_BEFORE_END for
    one without items before the last, TOO_MANY_PAGES beyond ``most_pages``. Keys are dealt to ``tasks`` tasks; a page is sent on as soon as it is read.

    With ``stored(key, page, body)``, pages that Spark holds come to the task of their listing in order, each once, and
    ``fetch(key, page, body)`` reads the page's own body (null where none is stored): no page costs a look through the others.
    """
    kinds = pa.schema([("key", pa.string()), ("page", pa.int32()), ("total", pa.int64()), ("item", pa.string()), ("error", pa.string())])

    def rows(k: str, page: int, total: int | None, items: list, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": k, "page": page, "total": total, "item": x, "error": error} for x in items], kinds)

    def listing(k: str, ask: Callable[[str, int], dict]) -> Iterator[pa.RecordBatch]:
        page, last, total, seen = 1, 1, None, set()
        while page <= last:
            if page > most_pages:
                yield rows(k, page, total, [None], "TOO_MANY_PAGES")
                return
            try:
                body = ask(k, page)
                given = body.get("items") or []
                total = int(body.get("totalCount") or 0)
                items = [json.dumps(x, ensure_ascii=False) for x in (given if isinstance(given, list) else [given])]
            except Exception as e:  # a listing that fails must not stop the others; the row tells
                yield rows(k, page, total, [None], type(e).__name__)
                return
            if page == 1:
                last = -(-total // size)
            content = hashlib.sha256("\n".join(items).encode()).digest()
            fault = "EMPTY_BEFORE_END" if not items and (page - 1) * size < total else "REPEATED_PAGE" if items and content in seen else None
            if fault:
                yield rows(k, page, total, [None], fault)
                return
            seen.add(content)
            yield rows(k, page, total, items, None)
            page += 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from listing(k, fetch)

    def read_stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((r["key"], r["page"], r["body"]) for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
        for k, pages in itertools.groupby(given, key=lambda r: r[0]):
            now = (None, 0, None)

            def ask(name: str, page: int, pages=pages) -> dict:
                nonlocal now
                while now is not None and (now[1] is None or now[1] < page):
                    now = next(pages, None)
                return fetch(name, page, now[2] if now is not None and now[1] == page else None)

            yield from listing(k, ask)

    kind = "key string, page int, total bigint, item string, error string"
    keys = requests.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    if stored is None:
        found = keys.repartition(tasks, "key").mapInArrow(read, kind)
    else:
        held = stored.select(F.col(key).cast("string").alias("key"), F.col("page").cast("int").alias("page"), F.col("body").cast("string").alias("body"))
        given = keys.join(held, "key", "left").repartition(tasks, "key").sortWithinPartitions("key", "page")
        found = given.mapInArrow(read_stored, kind)
    return found.withColumnRenamed("key", key)


def fetch_details(listed: DataFrame, key: str, needs: Column, fetch: Callable[[str], dict], table: str, tasks: int = 32) -> DataFrame:
    """``listed`` with detail (JSON) and detail_error: a second phase that fetches what the list does not give.

    ``fetch(key)`` runs in the tasks, once for each distinct key of the rows that ``needs`` holds for; the answers are
    written to ``table`` and joined back, so reading the result again fetches nothing. A failure gives its kind and no
    detail, and stops no other. Rows that need nothing have neither.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                try:
                    rows.append((k, json.dumps(fetch(k), ensure_ascii=False), None))
                except Exception as e:  # a detail that fails must not stop the others; the row tells
                    rows.append((k, None, type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["__key", "detail", "detail_error"])

    wanted = listed.where(needs).select(F.col(key).cast("string").alias("__key")).where("__key is not null").distinct().repartition(tasks, "__key")
    schema = "__key string, detail string, detail_error string"
    wanted.mapInArrow(read, schema).write.parquet(table)
    details = listed.sparkSession.read.schema(schema).parquet(table)
    marked = listed.withColumn("__needs", F.coalesce(needs, F.lit(False)))
    joined = marked.join(details, F.col("__needs") & (F.col(key).cast("string") == F.col("__key")), "left")
    return joined.drop("__needs", "__key")


def page_numbers(totals: DataFrame, total: str, size: int) -> DataFrame:
    """The pages that listings ask for: ceil(total / size) rows each."""
    pages = F.ceil(F.col(total) / F.lit(float(size))).cast("int")
    return totals.withColumn("page", F.explode(F.when(pages > 0, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))))


def page_faults(pages: DataFrame, listing: str, page: str, content: str, rows: str, total: str, size: int) -> DataFrame:
    """(listing, page, fault) of fetched pages: repeated content, an empty page before the end, another total than
    the first page, or a wrong number of rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(listing).orderBy(page)
    same = Window.partitionBy(listing, content).orderBy(page)
    last = F.ceil(F.first(total).over(w) / F.lit(float(size)))
    expected = F.when(F.col(page) < last, size).otherwise(F.first(total).over(w) - (last - 1) * size)
    fault = (
        F.when((F.row_number().over(same) > 1) & (F.col(rows) > 0), "REPEATED_PAGE").when((F.col(rows) == 0) & (F.col(page) < last), "EMPTY_BEFORE_END")
        .when(F.col(total) != F.first(total).over(w), "TOTAL_CHANGED").when(F.col(rows) != expected, "ROW_COUNT"))
    return pages.withColumn("fault", fault).where("fault is not null").select(listing, page, "fault")


def nested_json(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """JSON whose field ``data`` is JSON text again: both levels read with a declared schema, malformed as null."""
    outer = F.from_json(raw, "data string")
    return df.withColumn("parsed", F.from_json(outer["data"], schema))


@F.pandas_udf(ArrayType(StringType()))
def largest_array(values: pd.Series) -> pd.Series:
    """The items, as JSON, of the largest array anywhere in a JSON text; arrays inside arrays do not count, and of equal
    ones the first does. Empty where there is none, null for a null or malformed text."""

    def one(text):
        try:
            stack = [json.loads(text)]
        except (TypeError, ValueError):
            return None
        best: list = []
        while stack:
            now = stack.pop()
            if isinstance(now, list):
                best = now if len(now) > len(best) else best
            elif isinstance(now, dict):
                stack += reversed(now.values())
        return [json.dumps(x, ensure_ascii=False) for x in best]

    return values.map(one)


def nested_groups(df: DataFrame, pattern: str, out: str = "groups") -> DataFrame:
    """``df`` with ``out``: array<struct<group, requirements: array<struct<seq, name>>>> from the columns whose names
    match ``pattern`` (group number, place in the group). Blank cells and groups without any go; seq counts what is left."""
    import re

    found: dict[int, list[tuple[int, str]]] = {}
    for c in df.columns:
        if m := re.fullmatch(pattern, c):
            found.setdefault(int(m[1]), []).append((int(m[2]), c))

    def group(number: int) -> Column:
        names = F.filter(F.array(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for _, c in sorted(found[number])]), lambda x: x.isNotNull())
        return F.struct(F.lit(str(number)).alias("group"), F.transform(names, lambda x, i: F.struct((i + 1).alias("seq"), x.alias("name"))).alias("requirements"))

    empty = "array<struct<group:string,requirements:array<struct<seq:int,name:string>>>>"
    groups = F.array(*[group(n) for n in sorted(found)]) if found else F.array().cast(empty)
    return df.withColumn(out, F.filter(groups, lambda g: F.size(g["requirements"]) > 0))


def numeric_order(items: Column, by: str) -> Column:
    """An array of structs by the number that the text ``by`` is; what is no number comes after, as text."""
    keyed = F.transform(items, lambda x: F.struct(x[by].try_cast("int").isNull().alias("a"), x[by].try_cast("int").alias("b"), x[by].alias("c"), x.alias("item")))
    return F.transform(F.array_sort(keyed), lambda k: k["item"])


def name_value_map(entries) -> object:
    """array<struct<name, value>> as a map; the first value of a name stays."""
    first = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.when(F.map_contains_key(acc, e["name"]), acc).otherwise(F.map_concat(acc, F.create_map(e["name"], e["value"]))))
    return first


def xml_items(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """One row per item of an XML listing page, by a declared schema."""
    body = F.from_xml(F.col(raw), f"body struct<items:struct<item:array<struct<{schema}>>>,totalCount:bigint>")
    return df.withColumn("__x", body).select("*", F.col("__x.body.totalCount").alias("total"), F.explode_outer("__x.body.items.item").alias("item")).drop("__x")
