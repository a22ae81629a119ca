"""Operators over tables: histories, listings, lines, sources and streams."""

import json

from pyspark.sql import functions as F

from noticeflow.operators import changes, constraints, incremental, lines, listing, rollup


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_same_batch_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], "id int, h string, first int, last int")
    new = spark.createDataFrame([(2, "B", 3, 3), (3, "c", 3, 0)], "id int, h string, first int, last int")
    merged = changes.merge_current(old, new, ["id"], "h", "first", "last")
    assert rows(merged) == [(1, "a", 1, 1), (2, "B", 1, 3), (3, "c", 3, 0)]
    assert {r.change for r in changes.detect_changes(merged, new, ["id"], "h").where("change <> 'MISSING'").collect()} == {"UNCHANGED"}
    archive = changes.archive_versions(old, new, old.limit(0), ["id"], "h")
    assert rows(archive.select("id", "h")) == [(2, "b")]
    assert changes.archive_versions(old, new, archive, ["id"], "h").count() == 0


def test_sets_of_rows(spark):
    have, want = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(changes.sync_actions(have, want, ["k"])) == [(1, "DELETE"), (2, "KEEP"), (3, "INSERT")]
    assert rows(changes.insert_if_absent(want.union(want), have, ["k"])) == [(3,)]
    merged = spark.range(1).select(changes.union_lists(F.lit('["b","a"]'), F.lit('["c","b"]')).alias("x"), changes.union_lists(F.lit("broken"), F.lit(None).cast("string")).alias("y")).first()
    assert (json.loads(merged.x), json.loads(merged.y)) == (["a", "b", "c"], [])
    audit = spark.createDataFrame([("s", 1, "NEW"), ("s", 2, "READY")], "source string, at int, state string")
    assert rows(changes.last_state(audit, ["source"], ["at"])) == [("s", 2, "READY")]


def test_violations_and_listing(spark):
    df = spark.createDataFrame([(1, 5, None), (2, -1, 3), (2, None, None)], "id int, a int, b int")
    found = constraints.violations(df, "id", {"positive": F.col("a") >= 0, "one": constraints.exactly_one(F.col("a"), F.col("b"))})
    assert rows(found) == [("one", "2"), ("one", "2"), ("positive", "2")]
    assert rows(constraints.duplicates(df, ["id"], "unique")) == [("unique", "2")]
    named = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b")], "id int, name string")
    assert [r.entry_name for r in listing.collision_free_names(named, [], "name", [F.col("id")]).orderBy("id").collect()] == ["a.pdf", "A (2).pdf", "b"]
    assert rows(listing.page(named.select("id"), [F.desc("id")], 1, 2)) == [(1,)]


def test_backoff_and_retries(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5, 400)], "n int")
    assert [r[0] for r in df.select(incremental.backoff_seconds(F.col("n")), "n").orderBy("n").collect()] == [0, 300, 600, 2400, 3600, 3600]
    queue = spark.createDataFrame([(1, 2), (2, 1)], "id int, attempts int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert rows(incremental.retry_queue(queue, ids(1, 3), ids(2), ["id"])) == [(1, 3), (3, 1)]


def test_ranking_rules(spark):
    entries = spark.createDataFrame([(1, "보안 관제 체계 사업 2023", "한국공사"), (2, "사업 용역", "x")], "entry_id int, name string, client string")
    files = spark.createDataFrame([
        (1, "보안관제체계사업2023.pdf", "a", 1), (2, "보안 관제(한국공사).pdf", "b", 2), (3, "보안 관제.pdf", "z", 3), (4, "보안 관제 체계.pdf", "z", None), (5, "보안 관제 체계.pdf", "y", 5)], "file_id int, file_name string, path string, modified int")
    got = rollup.rank_candidates(entries, files).orderBy("place").collect()
    # The first file's name holds the whole squeezed name of the entry.
    assert [r.file_id for r in got] == [5, 1, 4, 2] and abs(got[3].score - (2 / 3 * 0.8 + 0.2)) < 1e-6


def test_candidates_by_substring(spark):
    from noticeflow.operators.rollup import rank_candidates

    entries = spark.createDataFrame([(1, "하천 정비", "서울시"), (2, "사업 2020", ""), (3, "Blue River Park", None), (4, "--", "x"), (5, None, None), (6, "가", "")], "entry_id long, name string, client string")
    files = spark.createDataFrame([(1, "서울시하천정비계획.pdf", "a", 1), (2, "강하천정비공사.hwp", "a", 2), (3, "우리사업2020결과", "a", 3), (4, "blueriverpark.zip", "a", 4), (5, "parks of blueish rivers", "a", 5), (6, "river only", "a", 6), (7, None, "a", 7), (8, "가나", "a", 8)], "file_id long, file_name string, path string, modified long")
    got = {(x.entry_id, x.file_id): x.score for x in rank_candidates(entries, files).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.8, (2, 3): 0.8, (3, 4): 0.8, (3, 5): 0.8, (6, 8): 0.8}


def test_candidates_follow_the_file_name(spark):
    """The client counts in the file's name only; years in words and full-width letters make no difference."""
    entries = [
        (1, "alpha beta gamma delta", "seoul"), (2, "alpha beta 2020년", ""), (3, "ＡＢＣ river", ""), (4, "AI콜봇구축사업 개인정보 영향평가", "한국장학재단"),
        (5, "2026년 AI 기반 지역관광 문제해결 프로젝트 가이드라인 수립", "한국관광공사")]
    files = [
        (1, "alpha beta.pdf", "/seoul"), (2, "alphabeta.pdf", "/x"), (3, "abc_RIVER.hwp", "/x"), (4, "alpha beta (SEOUL).pdf", "/y"), (5, "154_260515_실적증명서(한국장학재단) AI콜봇 구축 사업 개인정보 영향평가.pdf", "/cert"),
        (6, "한국관광공사 AI 기반 지역관광 문제해결 가이드라인 실적증명원.pdf", "/cert"), (7, "2026 AI기반 지역관광 문제해결 프로젝트 가이드라인 수립 실적증명서.pdf", "/cert"), (8, "한국관광공사 전혀다른사업 실적증명서.pdf", "/cert")]
    e = spark.createDataFrame(entries, "entry_id long, name string, client string")
    f = spark.createDataFrame([(*x, None) for x in files], "file_id long, file_name string, path string, modified long")
    got = {(x.entry_id, x.file_id): x.score for x in rollup.rank_candidates(e, f).collect()}
    assert got == {(1, 4): 0.6, (2, 1): 0.8, (2, 2): 0.8, (2, 4): 0.8, (3, 3): 0.8, (4, 5): 1.0, (5, 6): 1.0, (5, 7): 0.8}
    assert rollup.rank_candidates(e.where("false"), f).count() == 0


def test_document_lines(spark):
    text = "head\nH: a\nx\n\ny\nB end\nz\nH: b\n1. one\nmore\n2. two"
    df = lines.to_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    got = lines.section_lines(df, "id", F.col("line").startswith("H:"), F.col("line").startswith("B"))
    assert [r.line for r in got.orderBy("pos").collect()] == ["x", "y", "1. one", "more", "2. two"]
    items = lines.group_items(df, "id", F.col("line").rlike(r"^\d\."))
    assert [r.text for r in items.orderBy("item").collect()] == ["1. one more", "2. two"]
    near = lines.context_before(df, "id", F.col("line").startswith("B"), 3, F.col("line").startswith("H"))
    assert [r.line for r in near.orderBy("pos").collect()] == ["z", "H: b"]


def test_paged_source_and_faults(spark, tmp_path):
    from noticeflow.sources.paged import PagedJsonSource, name_value_map, nested_json, page_faults, page_numbers, xml_items

    for p, items in ((1, [{"id": 1}, {"id": 2}]), (2, {"id": 3})):
        (tmp_path / f"p{p}.json").write_text(json.dumps({"items": items, "totalCount": 3}))
    spark.dataSource.register(PagedJsonSource)
    got = spark.read.format("paged_json").option("pages", f"{tmp_path}/p{{page}}.json").option("first", 1).option("last", 2).load()
    assert [json.loads(r.item)["id"] for r in got.orderBy("item").collect()] == [1, 2, 3] and {r.total for r in got.collect()} == {3}
    assert rows(page_numbers(spark.createDataFrame([(41,), (0,)], "total int"), "total", 20)) == [(41, 1), (41, 2), (41, 3)]
    pages = spark.createDataFrame([("a", 1, "x", 2, 5), ("a", 2, "x", 2, 5), ("a", 3, "z", 1, 6), ("b", 1, "q", 0, 3)], "l string, p int, c string, n int, t int")
    assert rows(page_faults(pages, "l", "p", "c", "n", "t", 2)) == [("a", 2, "REPEATED_PAGE"), ("a", 3, "TOTAL_CHANGED"), ("b", 1, "EMPTY_BEFORE_END")]
    raw = spark.createDataFrame([('{"data": "[{\\"name\\": \\"k\\", \\"value\\": \\"v\\"}, {\\"name\\": \\"k\\", \\"value\\": \\"w\\"}]"}',), ("bad",)], "raw string")
    parsed = nested_json(raw, "raw", "array<struct<name:string,value:string>>").select(name_value_map(F.col("parsed")).alias("m"))
    assert [r.m for r in parsed.collect()][0] == {"k": "v"}
    xml = spark.createDataFrame([("<response><body><items><item><no>1</no></item><item><no>2</no></item></items><totalCount>2</totalCount></body></response>",)], "x string")
    assert [(r.total, r.item.no) for r in xml_items(xml, "x", "no:string").collect()] == [(2, "1"), (2, "2")]


def test_html_and_pasted_tables(spark, tmp_path):
    import zipfile

    from noticeflow.sources import html, pasted

    page = "<table><tr><th>번 호</th><th>제목</th></tr><tr><td>1</td><td><a href='/v?id=1'>첫  공고</a></td></tr></table><table><tr><td>기관 :</td><td>A</td><td>마감*</td><td>B</td></tr></table><script>var x='<td>'</script>"
    df = spark.createDataFrame([(page,), (None,)], "page string").withColumn("rows", html.table_rows("page"))
    first = df.select(html.column_by_header(F.col("rows"), "제목").alias("c"), html.labelled_values(F.col("rows")).alias("m"), html.links("page").alias("l")).collect()[0]
    assert first.c[0] == "첫 공고" and first.m["기관"] == "A" and first.m["마감"] == "B" and [(x.href, x.text) for x in first.l] == [("/v?id=1", "첫 공고")]
    text = 'name\tclient\tperiod\tamount\n"a ""q"""\tb\tc\td\nshort\tx\nknown\tb\tc\td'
    cells = spark.createDataFrame([(text,)], "t string").select(F.explode(pasted.pasted_rows("t")).alias("r")).select("r.*")
    assert [r.row for r in cells.where(pasted.is_header(F.col("cells"), ["name", "client"])).collect()] == [1]
    good, bad = pasted.import_rows(cells.where("row > 1"), "cells", {"name": 0, "client": 1}, 4, spark.createDataFrame([("known",)], "name string"))
    assert rows(good) == [('a "q"', "b")] and rows(bad) == [(3, "CELLS"), (4, "DUPLICATE")]
    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<s><p>one</p><p>two</p></s>")
        z.writestr("other.xml", "<s>no</s>")
    (tmp_path / "b.hwpx").write_bytes(b"not a zip")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in pasted.zipped_sections(spark, str(tmp_path)).collect()}
    assert got == {"a.hwpx": ("one\ntwo", None), "b.hwpx": (None, "BadZipFile")}
    assert {r.ext for r in pasted.file_index(spark, str(tmp_path)).collect()} == {"hwpx"}


def test_stream_equals_batch_and_survives_reruns(spark, tmp_path):
    from noticeflow.streaming.changes import SnapshotTable, merge_batches, quota_stream

    schema = "id int, h string, first int, last int, seq int"
    tables = [SnapshotTable(spark, f"{tmp_path}/{n}", s) for n, s in (("current", schema), ("archive", schema), ("changes", "id int, change string"))]
    for k, batch in enumerate([[(1, "a", 1, 1, 1), (2, "b", 1, 1, 2)], [(1, "A", 2, 2, 3), (1, "AA", 2, 2, 4), (3, "c", 2, 2, 5)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        merge_batches(stream, *tables, ["id"], "h", "first", "last", ["seq"], f"{tmp_path}/cp").awaitTermination()
        assert k == len(tables[0]._versions()) - 1
    assert rows(tables[0].read().select("id", "h", "first", "last")) == [(1, "AA", 1, 2), (2, "b", 1, 1), (3, "c", 2, 2)]
    assert rows(tables[1].read_all().select("id", "h")) == [(1, "a")] and rows(tables[2].read()) == [(1, "UPDATED"), (3, "NEW")]
    calls = spark.createDataFrame([("s", f"2024-01-0{1 + i // 4} 00:00:0{i}", i) for i in range(8)], "source string, at string, id int").withColumn("at", F.to_timestamp("at"))
    calls.coalesce(1).write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/calls")
    quota_stream(stream, "source", "at", "id", 3).writeStream.format("memory").queryName("quota").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in spark.table("quota").where("accepted").orderBy("id").collect()] == [0, 1, 2, 4, 5, 6]


def test_declared_extraction(spark):
    from noticeflow.sources.html import mapped_rows

    page = "<table><tr><th>no</th><th>title</th></tr><tr><td>7</td><td><a href='/v/7'>One</a></td></tr><tr><td></td><td>x</td></tr></table>"
    get = mapped_rows({"id": "column(1)", "title": "link::text", "href": "link@href", "url": "https://a.kr/v/{id}"})
    got = spark.createDataFrame([(page,)], "p string").select(get("p").alias("r")).first().r
    assert got == [{"id": "7", "title": "One", "href": "/v/7", "url": "https://a.kr/v/7"}]


def test_parents_without_child_looks_at_every_child(spark, tmp_path):
    from noticeflow.plans.catalog import ORACLE_SQL, QUERIES

    customers = spark.createDataFrame([(1, "old order"), (2, "closed order"), (3, "none")], "c_custkey bigint, c_name string")
    orders = spark.createDataFrame([(1, 1, "O", "1995-01-01"), (2, 2, "F", "1999-01-01")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate string")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(QUERIES["parents_without_child"](spark, str(tmp_path))) == [(3, "none")]
    assert "o_orderdate" not in ORACLE_SQL["parents_without_child"] and "o_orderstatus" not in ORACLE_SQL["parents_without_child"]


def test_fan_out_forms_pairs_without_shuffling_them(spark):
    pending = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (None, "a")], "e int, scope string")
    people = spark.createDataFrame([(k, "a") for k in range(6)] + [(7, "b"), (None, "b"), (8, None)], "s int, scope string")
    done = spark.createDataFrame([(1, 0), (1, 0), (1, 5), (1, None), (3, 7), (9, 1), (None, 2)] + [(2, k) for k in range(5)], "e int, s int")
    want = sorted([(1, k) for k in (1, 2, 3, 4)] + [(2, 5)] * 2 + [(3, None)] + [(None, k) for k in range(6)], key=repr)
    for few in (0, 3, 64):
        got = incremental.fan_out(pending, people, done, "e", "s", ["scope"], few=few)
        assert set(got.columns) == {"e", "s", "scope"}
        assert sorted(((r.e, r.s) for r in got.collect()), key=repr) == want
    # Each event and each subscriber once a salt go through a shuffle, pairs do not.
    many = spark.range(2000).select(F.col("id").alias("e"), F.lit(1).alias("scope"))
    each = spark.range(500).select(F.col("id").alias("s"), F.lit(1).alias("scope"))
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert incremental.fan_out(many, each, many.selectExpr("e", "e as s"), "e", "s", ["scope"]).agg(F.count("*")).first()[0] == 2000 * 500 - 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert _shuffled(spark) - before < 100_000


def test_fan_out_gives_pairs_in_blocks_that_take_little_room(spark, tmp_path):
    pending = spark.range(3000).select(F.xxhash64("id").alias("e"), (F.col("id") % 2).alias("scope"))
    people = spark.range(6001).select(F.xxhash64(F.col("id") + 7).alias("s"), (F.col("id") % 2).alias("scope"), F.col("id").alias("place"))
    done = spark.range(3000).select(F.xxhash64("id").alias("e"), F.xxhash64(F.col("id") + 7).alias("s"))
    incremental.fan_out(pending, people, done, "e", "s", ["scope"]).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    n = 1500 * 3001 + 1500 * 3000 - 3000
    assert set(got.columns) == {"e", "s", "scope", "place"}
    assert got.count() == got.select("e", "s").distinct().count() == n and got.join(done, ["e", "s"]).count() == 0
    assert got.join(people, ["s", "scope", "place"], "left_anti").count() == got.join(pending, ["e", "scope"], "left_anti").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.8 * n  # bytes


def _shuffled(spark):
    """Records that shuffles wrote so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_candidates_send_no_files_to_every_task(spark, monkeypatch):
    """All pairs judged one by one, both ways of the join; what is broadcast holds entries only."""
    parts = ["alpha", "beta", "gamma", "al", "gam", "2020", "x"]
    entries = [(i, " ".join(parts[j] for j in range(7) if i >> j & 1), ["", "acme", None][i % 3]) for i in range(1, 128)]
    files = [(i, "-".join(parts[(i * k + k) % 7] for k in range(1, 2 + i % 4)) + [".pdf", " ACME", ""][i % 3], f"/{i % 5}", i % 4) for i in range(60)] + [(60, None, "/", 1)]
    want = {}
    for eid, name, client in entries:
        wanted, whole = [w for w in name.split() if len(w) > 1 and w != "2020"], name.replace(" ", "")
        for fid, file, _, _ in files:
            file = "".join(c for c in (file or "").lower() if c.isalnum())
            hits, own = sum(w in file for w in wanted), bool(client) and client in file
            if whole in file or wanted and hits >= min(2, len(wanted)) and hits / len(wanted) >= (0.5 if own else 0.75):
                want[eid, fid] = round((1 if whole in file else hits / len(wanted)) * 0.8 + 0.2 * own, 6)
    e = spark.createDataFrame(entries, "entry_id long, name string, client string")
    f = spark.createDataFrame(files, "file_id long, file_name string, path string, modified long")
    for few in (0, 200_000):
        monkeypatch.setattr(rollup, "_FEW", few)
        found = rollup.rank_candidates(e, f, k=100)
        got = [((r.entry_id, r.file_id), r.score) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == want
        plan, within = rollup.rank_candidates(e, f)._jdf.queryExecution().executedPlan().toString().splitlines(), None
        for line in plan:
            depth = len(line) - len(line.lstrip(" :+-"))
            within = None if within is not None and (depth <= within or "Aggregate" in line) else within
            assert within is None or "path" not in line
            if "BroadcastExchange" in line:
                within = depth
