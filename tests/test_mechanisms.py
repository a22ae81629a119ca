"""Dictionaries, selectors, crawls, budgets, details, guarded pages and nested values on hand-made rows."""

import os

import pytest
from pyspark.sql import functions as F

from noticeflow.operators.crawl import bounded_crawl, deal_budget
from noticeflow.operators.dictionary import license_codes, names_found
from noticeflow.sources import paged, pasted
from noticeflow.sources.selectors import Place, Selector, parse, selected_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_of_large_dictionaries(spark):
    texts = spark.createDataFrame([(1, "a supervision firm (6146) and soft ware"), (2, None), (3, "SUPERVISION firmx 12345 1468"), (4, ""), (1, "again supervisionfirm")], "id int, text string")
    names = spark.createDataFrame([("6146", "supervision firm"), ("1468", "software"), ("9", " "), ("8", None), ("7777", "firm"), ("6146", "super vision")], "code string, name string")
    want = [(1, "firm"), (1, "software"), (1, "super vision"), (1, "supervision firm"), (3, "firm")]
    for most in (2, 100):  # three shards and one
        assert rows(names_found(texts, "id", "text", names, most=most)) == want
    assert rows(license_codes(texts, "id", "text", names)) == [(1, "1468", "software"), (1, "6146", "super vision"), (1, "7777", "firm"), (3, "1468", "software"), (3, "7777", "firm")]
    assert names_found(texts, "id", "text", names.where("false")).count() == 0 and names_found(texts.where("false"), "id", "text", names).count() == 0


PAGE = """<html><body><ul class="list big"><li id=a><a href="/v/1" class=t>One &amp; <b>bold</b></a><span class="d">2024</span><li><a href='/v/2'>Two</a>
<li data-k="x y"><a href="/v/1">One again</a></ul><script>document.write("<li><a href='/no'>no</a></li>")</script>
<table><tr><th>no<th>title<tr><td>7<td><a href="?id=7">Seven</a><br>more<tr><td>8<td>Eight</table></body></html>"""


@pytest.mark.parametrize(("selector", "want"), [
    ("li > a", ["One & bold", "Two", "One again"]), ("ul.list li a.t", ["One & bold"]), ("#a .d", ["2024"]), ("li[data-k] a, .d", ["2024", "One again"]), ("li[data-k~=y] > a", ["One again"]), ("a[href^='/v']", ["One & bold", "Two", "One again"]),
    ("a[href$=\"7\"]", ["Seven"]), ("body > a", []), ("table td a", ["Seven"]), ("ul.list.big > li > span", ["2024"]), ("*.t b", ["bold"])])
def test_selectors(selector, want):
    assert [n.text() for n in Selector(selector).select(parse(PAGE))] == want


def test_places_and_rows(spark):
    tree = parse(PAGE)
    row = [n for n in tree.walk() if n.tag == "tr"][1]
    assert [Place(p).value(row) for p in ("table::column(0)", "table::column(1)", "table::column(2)", "a@href", "a::text", "a", "b@x")] == ["7", "Seven more", None, "?id=7", "Seven", "Seven", None]
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<li><a href='/q'>unclosed")], "id int, html string")
    got = pages.select("id", F.explode(selected_rows("li a@href", {"title": "a::text", "day": "span.d"})(F.col("html"))).alias("r")).select("id", "r.id", F.col("r.title"), F.col("r.day")).collect()
    assert [tuple(x) for x in got] == [(1, "/v/1", "One & bold", "2024"), (1, "/v/2", "Two", None), (4, "/q", "unclosed", None)]
    cells = pages.select(F.explode(selected_rows("table::column(0)", {"title": "table::column(1)", "link": "a@href"})(F.col("html"))).alias("r")).select("r.id", "r.title", "r.link").collect()
    assert [(x[0], x[1], x[2]) for x in cells] == [("7", "Seven more", "?id=7"), ("8", "Eight", None)]
    for bad in ("", "li >> a", "a:hover", "li[", "::text"):
        with pytest.raises(ValueError):
            Selector(bad)


def test_crawl_keeps_limits(spark):
    tree = [("/a", "/a/b", True), ("/a", "/a/.git", True), ("/a", "/a/~$x.doc", False), ("/a/b", "/a/b/f", False), ("/a/b", "/a", True), ("/deep", "/deep/1", True), ("/deep/1", "/deep/1/2", True), ("/deep/1/2", "/deep/1/2/f", False)]
    tree += [("/wide", f"/wide/{i}", True) for i in range(9)] + [("/many", f"/many/f{i}", False) for i in range(9)]
    children = spark.createDataFrame(tree, "parent string, path string, directory boolean").repartition(3)
    roots = spark.createDataFrame([("/a",), ("/deep",), ("/wide",), ("/many",), ("/none",), ("/a",)], "root string")
    found, states = bounded_crawl(roots, children, 1, 5, 5)
    assert rows(states.select("root", "status", "folders", "files")) == [("/a", "SUCCESS", 2, 1), ("/deep", "DEPTH", 2, 0), ("/many", "FILES", 1, 9), ("/none", "SUCCESS", 1, 0), ("/wide", "FOLDERS", 10, 0)]
    assert rows(found) == [("/a", "/a", True, 0), ("/a", "/a/b", True, 1), ("/a", "/a/b/f", False, 2), ("/none", "/none", True, 0)]
    whole, _ = bounded_crawl(roots, children, 9, 50, 50)
    assert rows(whole.where("root = '/deep'")) == [("/deep", "/deep", True, 0), ("/deep", "/deep/1", True, 1), ("/deep", "/deep/1/2", True, 2), ("/deep", "/deep/1/2/f", False, 3)]
    none, states = bounded_crawl(roots.where("false"), children, 1, 5, 5)
    assert none.count() == states.count() == 0


def test_budget_is_the_same_for_any_partitions(spark):
    listings = [(op, term, 1 + (7 * op + term) % 5) for op in range(4) for term in range(6)]
    want, left = [], 30
    for op, term, pages in listings:
        want += [(op, term, p) for p in range(1, min(pages, left) + 1)]
        left = max(0, left - pages)
    df = spark.createDataFrame(listings, "op int, term int, pages int")
    for n in (1, 64):
        assert rows(deal_budget(df.repartition(n), "op", [F.col("term")], "pages", 30).select("op", "term", "page")) == sorted(want, key=repr)
    assert deal_budget(df, "op", [F.col("term")], "pages", 0).count() == 0


def test_details_are_fetched_once(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)

    def fetch(key):
        with open(f"{log}/{os.getpid()}", "a", encoding="utf-8") as f:
            f.write(key + "\n")
        if key == "3":
            raise KeyError(key)
        return {"v": key * 2}

    listed = spark.createDataFrame([(i % 5, i % 2 == 0) for i in range(40)] + [(None, True), (9, None)], "k int, missing boolean").repartition(6)
    got = paged.fetch_details(listed, "k", F.col("missing"), fetch, f"{tmp_path}/details")
    for _ in range(3):
        assert got.count() == 42
    found = {(r.k, r.missing, r.detail, r.detail_error) for r in got.collect()}
    assert found == {(k, True, None if k in (3, None) else '{"v": "%s"}' % (str(k) * 2), "KeyError" if k == 3 else None) for k in (0, 1, 2, 3, 4, None)} | {(k, False, None, None) for k in range(5)} | {(9, None, None, None)}
    calls = [line for name in os.listdir(log) for line in open(f"{log}/{name}", encoding="utf-8").read().split()]
    assert sorted(calls) == ["0", "1", "2", "3", "4"]


def test_pages_are_guarded(spark):
    def fetch(key, page):
        total = {"empty": 10, "same": 10, "good": 10, "long": 10**6, "none": 0}[key]
        items = [] if key == "none" or (key == "empty" and page == 2) else [{"n": 0 if key == "same" else page * 10 + i} for i in range(5)]
        return {"items": items, "totalCount": total}

    keys = spark.createDataFrame([(k,) for k in ("empty", "same", "good", "long", "none", None)], "k string")
    got = rows(paged.fetch_listings(keys, "k", fetch, 5, most_pages=3).groupBy("k", "error").agg(F.count("item"), F.max("page")))
    assert got == sorted([("empty", None, 5, 1), ("empty", "EMPTY_BEFORE_END", 0, 2), ("same", None, 5, 1), ("same", "REPEATED_PAGE", 0, 2), ("good", None, 10, 2), ("long", None, 15, 3), ("long", "TOO_MANY_PAGES", 0, 4)], key=repr)


def test_nested_values(spark):
    texts = ['{"a": [1], "b": {"c": [1, 2, [3, 4, 5, 6]], "d": [7, 8, 9]}}', "[[1, 2, 3], 4]", "{}", "5", "no json", None, '{"a": [1], "b": [2]}', '{"x": ' * 400 + "[1, 2]" + "}" * 400]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", paged.largest_array(F.col("t")).alias("a")).orderBy("i").collect()
    assert [x.a for x in got] == [["1", "2", "[3, 4, 5, 6]"], ["[1, 2, 3]", "4"], [], [], None, None, ["1"], ["1", "2"]]
    wide = spark.createDataFrame([(1, "x", " ", None, "z"), (2, None, None, "", " ")], "id int, req2Reqlic2Nm string, req2Reqlic1Nm string, req1Reqlic1Nm string, req10Reqlic1Nm string")
    groups = {r.id: [(g.group, [(q.seq, q.name) for q in g.requirements]) for g in r.groups] for r in paged.nested_groups(wide, r"req(\d+)Reqlic(\d+)Nm").collect()}
    assert groups == {1: [("2", [(1, "x")]), ("10", [(1, "z")])], 2: []}
    assert paged.nested_groups(wide.select("id"), r"req(\d+)Reqlic(\d+)Nm").first().groups == []
    ordered = spark.createDataFrame([(["10", "b", "9", "a", "2"],)], "m array<string>").select(paged.numeric_order(F.transform("m", lambda m: F.struct(m.alias("no"))), "no").alias("o")).first().o
    assert [x.no for x in ordered] == ["2", "9", "10", "a", "b"]


def test_long_sections_are_an_error(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<s><p>one two three</p></s>")
    got = pasted.zipped_sections(spark, str(tmp_path), most_chars=5).first()
    assert (got.text, got.error) == (None, "LIMIT") and pasted.zipped_sections(spark, str(tmp_path)).first().text == "one two three"


def test_pasted_tables_find_their_columns(spark):
    from noticeflow.functions.presets import PASTED_HEADERS

    texts = [
        (1, "발주처\t사업 명\t사업기간\t계약금액\n한국\t하나\t2024\t5\n\t\t\t\n짧은\t줄\n사업명\t발주기관\t사업금액\t사업기간\n둘\t공사\t7\t2023"), (2, "이름\t발주\t2024.01\t9"), (3, "이름\t2024.01\t9\t발주"), (4, "1\t이름\t2024\t9\t발주"),
        (5, '"닫히지\t않은\t따옴표 2024\t8\n이름\t발주\t2024\t9'), (6, "<table><tr><th>사업명<th>발주처<th>사업기간<th>사업금액<tr><td>가<td>나<td>다<td>라</table>")]
    rows_of = spark.createDataFrame(texts, "id int, text string").select("id", F.explode(pasted.pasted_rows("text")).alias("r")).select("id", "r.*")
    got = {}
    for x in pasted.placed_cells(rows_of, "id", PASTED_HEADERS).orderBy("id", "row").collect():
        got.setdefault(x.id, []).append((x.cells, x.error))
    assert got[1] == [(["하나", "한국", "2024", "5"], None), (["짧은", "줄"], None), (["둘", "공사", "2023", "7"], None)]
    assert got[2] == got[3] == [(["이름", "발주", "2024.01", "9"], None)] and got[4] == [(["이름", "발주", "2024", "9"], None)]
    assert got[5][0][1] == "UNCLOSED_QUOTE" and got[5][1] == (["이름", "발주", "2024", "9"], None) and got[6] == [(["가", "나", "다", "라"], None)]


def test_bounded_reads_of_a_database(spark):
    """Derby, which comes with Spark, in memory."""
    from noticeflow.sources.company import bounded_read

    url = "jdbc:derby:memory:company;create=true"
    people = spark.createDataFrame([(i, f"name {i}" if i % 3 else "O'Neil", i % 2 == 0) for i in range(1200)], "id int, name string, active boolean")
    people.repartition(3).write.format("jdbc").options(url=url, dbtable="people", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="name VARCHAR(100)").mode("overwrite").save()
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    read = lambda **kind: bounded_read(spark, url, "people", ['id', 'name'], "id", properties=driver, **kind)
    first = read().collect()
    assert [r.id for r in first] == list(range(500)) and all(r.more for r in first) and first[1].name == "name 1"
    named = read(where=[("name", "=", "O'Neil")], most_rows=1000).collect()
    assert [r.id for r in named] == list(range(0, 1200, 3)) and not any(r.more for r in named)
    assert read(where=[("name", "LIKE", "%none")]).count() == 0
    for bad in (dict(table="people; DROP TABLE people"), dict(columns=["id", "1 FROM x"]), dict(where=[("name", "= '' OR", "x")])):
        with pytest.raises(ValueError):
            bounded_read(spark, url, bad.get("table", "people"), bad.get("columns", ["id"]), "id", where=bad.get("where", ()))


def test_links_leave_a_worker_a_few_pages_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from noticeflow.sources import html

    pages = [(i, None if i == 5 else "".join(f'<a href="/{i}/{k}">x  <b>{k}</b></a>' for k in range(i % 4))) for i in range(300)]
    df = spark.createDataFrame(pages, "id long, page string").coalesce(1)
    want = sorted((r.id, r.pos, r.link.href, r.link.text) for r in df.select("id", F.posexplode(html.links("page")).alias("pos", "link")).collect())
    found = html.link_rows(df, "page")
    assert found.columns == ["id", "pos", "href", "text"] and sorted(map(tuple, found.collect())) == want
    # The worker's own function: a batch of 300 pages goes out in pieces of at most 64 pages.
    kept = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
    html.link_rows(df, "page")
    batch = pa.RecordBatch.from_pylist([{"id": i, "page": x} for i, x in pages])
    pieces = [len(set(b.column("id").to_pylist())) for b in kept[0](iter([batch]))]
    assert len(pieces) == 5 and max(pieces) <= 64


def test_codes_of_a_row_meet_in_the_row(spark):
    texts = spark.createDataFrame([(1, "1234 Alpha  Beta"), (2, "beta alpha 12345"), (3, None), (4, "gamma 0007 Alpha Beta")], "k long, text string")
    verified = spark.createDataFrame([("alpha", "0001"), ("Alpha Beta", "0002"), ("gamma", "0007"), ("Gam ma", "0007"), ("", "0009")], "name string, code string")
    want = [(1, "0002", "Alpha Beta"), (1, "1234", ""), (2, "0001", "alpha"), (4, "0002", "Alpha Beta"), (4, "0007", "Gam ma")]
    for unique in (True, False):
        found = license_codes(texts, "k", "text", verified, unique=unique)
        assert rows(found) == want
        plan = license_codes(texts.repartition(2, "k"), "k", "text", verified.limit(1).cache(), unique=unique)._jdf.queryExecution().optimizedPlan().toString()
        assert ("Union" not in plan) and (plan.count("Aggregate") == (1 if unique else 2))
