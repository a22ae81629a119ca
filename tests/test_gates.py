"""Listed files, roots, code sets, fetched listings and document lists on small cases."""

import json

import pytest

from noticeflow.operators import gates, lines
from noticeflow.sources.paged import fetch_listings, paged_files


def test_listed_files_faults(spark):
    good = {"name": "a", "path": "/f/a/", "directory": False, "size": 3, "lastModified": "2024-01-01T00:00:00Z"}
    items = [good, good | {"size": 1.5}, good | {"directory": "no"}, good | {"name": None}, good | {"path": "/g/a"}, good | {"lastModified": "soon"}]
    texts = [json.dumps(x) for x in items] + ["{", None, "[]"]
    df = spark.createDataFrame([(i, "/f", x) for i, x in enumerate(texts)], "id int, folder string, item string")
    got = {r.id: r for r in gates.listed_files(df, "folder", "item").collect()}
    assert [got[i].fault for i in range(9)] == [None, "TYPE", "TYPE", "TYPE", "NOT_A_CHILD", None, "TYPE", "TYPE", "TYPE"]
    assert got[0].path == "/f/a" and got[0].size == 3 and got[0].modified is not None and got[5].modified is None
    assert gates.whole_listings(gates.listed_files(df, "folder", "item"), "folder").count() == 0
    assert gates.listed_files(df.where("false"), "folder", "item").count() == 0


def test_roots_gate_files(spark):
    states = spark.createDataFrame([("/a/b", "SUCCESS"), ("/a/c", None), ("/ab", "SUCCESS")], "root string, state string")
    folders = spark.createDataFrame([("/a",), ("/a/b/x",), ("/a/b",), ("/z",), ("/",), (None,)], "folder string").where("folder is not null")
    got = {(r.folder, r.root): r.gate for r in gates.folder_roots(folders, states).collect()}
    assert got == {
        ("/a", "/a/b"): "NOT_READY", ("/a", "/a/c"): "NOT_READY", ("/a/b/x", "/a/b"): "READY", ("/a/b", "/a/b"): "READY", ("/z", None): "NOT_BUILT",
        ("/", "/a/b"): "NOT_READY", ("/", "/a/c"): "NOT_READY", ("/", "/ab"): "NOT_READY"}
    files = spark.createDataFrame([("/a/b", "/a/b/x/1"), ("/a/b", "/a/b/x/1"), ("/a/b", "/a/b/xy"), ("/ab", "/ab/2")], "root string, path string")
    assert sorted(map(tuple, gates.files_under(folders, states, files).collect())) == [("/a/b", "/a/b/x/1"), ("/a/b", "/a/b/xy"), ("/a/b/x", "/a/b/x/1")]


def test_code_sets(spark):
    assert gates.valid_codes([" 1234", "1234", "0001"]) == ["1234", "0001"]
    for bad in (None, [], ["12345"], ["1234", None]):
        with pytest.raises(ValueError):
            gates.valid_codes(bad)
    current = spark.createDataFrame([("a", "0001"), ("b", "0002"), ("c", "0003")], "s string, code string")
    asked = spark.createDataFrame([("a", " 1111 "), ("a", "1111"), ("b", "2222"), ("b", None), ("d", "4444")], "s string, code string")
    assert sorted(map(tuple, gates.replace_codes(current, asked, "s", "code").collect())) == [("a", "1111"), ("b", "0002"), ("c", "0003"), ("d", "4444")]


def test_fetched_and_stored_pages(spark, tmp_path):
    def fetch(key, page):
        if key == "bad" or (key == "late" and page == 2):
            raise ConnectionError
        return {"items": {"n": page}, "totalCount": 2} if key != "none" else {}

    keys = spark.createDataFrame([("ok",), ("ok",), ("bad",), ("late",), ("none",), (None,)], "k string")
    got = sorted((r.k, r.page, r.item, r.error) for r in fetch_listings(keys, "k", fetch, 1, tasks=2).collect())
    assert got == [("bad", 1, None, "ConnectionError"), ("late", 1, '{"n": 1}', None), ("late", 2, None, "ConnectionError"), ("ok", 1, '{"n": 1}', None), ("ok", 2, '{"n": 2}', None)]
    (tmp_path / "1.json").write_text('{"items": [{"a": 1}, {"a": 2}], "totalCount": 3}')
    (tmp_path / "2.json").write_text('{"items": {"a": 3}, "totalCount": 3}')
    (tmp_path / "3.json").write_text("no page")
    assert sorted((r.total, r.item) for r in paged_files(spark, str(tmp_path)).collect()) == [(3, '{"a":1}'), (3, '{"a":2}'), (3, '{"a":3}')]


def test_document_lists(spark):
    text = "Papers\n- form A\n- Form a\nlicense needed\nDates\nby May, together\nno license"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id int, text string")
    lists = {"papers": {"headings": ["papers"]}, "dates": {"headings": ["dates"]}, "rights": {"words": ["License"], "unless": ["no "]}}
    got = {r.id: (r.papers, r.dates, r.rights) for r in lines.line_lists(lines.to_lines(docs, "id", "text"), "id", lists).collect()}
    assert got == {1: (["- form A", "license needed"], ["by May, together", "no license"], ["license needed"]), 2: ([], [], [])}


def test_stored_pages_come_once_in_order(spark):
    asked = spark.sparkContext.accumulator(0)

    def fetch(key, page, body):
        asked.add(1)
        if body == "stop":
            raise TimeoutError
        return json.loads(body)

    page = lambda n, total: json.dumps({"items": [{"n": n}], "totalCount": total})
    stored = [("long", n, page(n, 700)) for n in range(700, 0, -1)] + [("stop", 1, page(1, 3)), ("stop", 2, "stop"), ("stop", 3, page(3, 3)), ("gap", 1, page(1, 3)), ("gap", 3, page(3, 3)), ("same", 1, page(1, 2)), ("same", 2, page(1, 2)), ("unasked", 1, page(1, 1))]
    keys = spark.createDataFrame([("long",), ("stop",), ("gap",), ("same",), ("absent",), ("long",)], "k string")
    found = fetch_listings(keys, "k", fetch, 1, tasks=2, stored=spark.createDataFrame(stored, "k string, page int, body string")).collect()
    got = sorted((r.k, r.page, r.item, r.error) for r in found if r.k != "long")
    assert got == [("absent", 1, None, "TypeError"), ("gap", 1, '{"n": 1}', None), ("gap", 2, None, "TypeError"), ("same", 1, '{"n": 1}', None), ("same", 2, None, "REPEATED_PAGE"), ("stop", 1, '{"n": 1}', None), ("stop", 2, None, "TimeoutError")]
    assert [r.item for r in found if r.k == "long"] == [json.dumps({"n": n}) for n in range(1, 701)]
    assert asked.value == 700 + 2 + 2 + 2 + 1


def test_keyword_listings_read_their_store_through_spark(spark, tmp_path):
    from noticeflow.plans.catalog import QUERIES

    docs = spark.range(130).selectExpr("id as doc_id", "case when id < 120 then 'en' when id < 125 then 'fr' end as lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # A path that only Spark's readers open.
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.stored.link./in", f"file://{tmp_path}")
    got = sorted((r.lang, r.page, r.doc_id, r.error) for r in QUERIES["keyword_listings"](spark, "viewfs://stored/in").collect())
    assert got == [("en", i // 50 + 1, i, None) for i in range(120)] + [("fr", 1, i, None) for i in range(120, 125)]
