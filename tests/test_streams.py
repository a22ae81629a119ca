"""Streams: collection in windows with a cursor that follows the sink, and quotas whose state does not grow."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from noticeflow.operators.incremental import daily_quota
from noticeflow.streaming.changes import quota_stream
from noticeflow.streaming.windows import Cursor, collect_windows, window_source

DAY = datetime.date(2024, 3, 1)


def store(log):
    """What a remote listing gives: two rows a window, and a failure on one; each call is logged in a file."""

    def fetch(operation, day):
        with open(f"{log}/{os.getpid()}.log", "a", encoding="utf-8") as f:
            f.write(f"{operation} {day}\n")
        if operation == "bad" and day.day == 2:
            raise TimeoutError
        return [{"id": f"{operation}-{day.day}-{k}"} for k in range(2)]

    return fetch


def calls(log):
    return sorted(line.strip() for name in os.listdir(log) for line in open(f"{log}/{name}", encoding="utf-8"))


def run(spark, root, days, name, per_batch=4, after=None):
    spark.dataSource.register(window_source(name, ["good", "bad"], DAY, DAY + datetime.timedelta(days=days - 1), store(f"{root}/log"), f"{root}/cursor.json", per_batch))
    query = collect_windows(spark.readStream.format(name).load(), f"{root}/table", f"{root}/cp", after)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def table(spark, root):
    return sorted(map(tuple, spark.read.parquet(f"{root}/table").select("operation", F.col("day").cast("string"), F.get_json_object("item", "$.id"), "error").collect()), key=repr)


def wanted(days):
    out = []
    for d in range(1, days + 1):
        for op in ("good", "bad"):
            out += [(op, f"2024-03-0{d}", None, "TimeoutError")] if (op, d) == ("bad", 2) else [(op, f"2024-03-0{d}", f"{op}-{d}-{k}", None) for k in range(2)]
    return sorted(out, key=repr)


def test_windows_are_collected_once_and_go_on(spark, tmp_path):
    (tmp_path / "log").mkdir()
    run(spark, tmp_path, 3, "windows_a")
    assert table(spark, tmp_path) == wanted(3)
    assert calls(f"{tmp_path}/log") == sorted(f"{op} 2024-03-0{d}" for op in ("good", "bad") for d in (1, 2, 3))
    run(spark, tmp_path, 5, "windows_a2")  # two more days: only these are fetched
    assert table(spark, tmp_path) == wanted(5) and len(calls(f"{tmp_path}/log")) == 10
    cursor = Cursor(f"{tmp_path}/cursor.json").read()
    assert cursor["planned"] == 10 and 6 <= cursor["committed"] <= 10


def test_a_run_killed_between_sink_and_commit_repeats_its_windows(spark, tmp_path):
    for name in ("whole", "killed"):
        (tmp_path / name / "log").mkdir(parents=True)
    run(spark, tmp_path / "whole", 4, "windows_b")
    seen = []

    def die(number):
        seen.append(Cursor(f"{tmp_path}/killed/cursor.json").read()["committed"])
        if number == 1 and len(seen) == 2:
            raise RuntimeError("killed when the rows are written")

    with pytest.raises(Exception, match="killed|terminated"):
        run(spark, tmp_path / "killed", 4, "windows_c", after=die)
    assert Cursor(f"{tmp_path}/killed/cursor.json").read()["committed"] <= 4
    run(spark, tmp_path / "killed", 4, "windows_d")
    assert table(spark, tmp_path / "killed") == table(spark, tmp_path / "whole") == wanted(4)
    again = calls(f"{tmp_path}/killed/log")
    assert len(set(again)) == 8 and len(again) == 12  # the second batch's four windows twice
    assert seen[0] == 0 and seen[1] <= 4  # never ahead of the sink


def quota(spark, tmp_path):
    kinds = "source string, at timestamp, id int"
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/calls")
    sink = quota_stream(stream, "source", "at", "id", 3).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp")
    query = sink.trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    return query, spark.read.parquet(f"{tmp_path}/out")


def test_quota_equals_the_batch_and_its_state_stays_small(spark, tmp_path):
    kinds = "source string, at timestamp, id int"
    rows = [(s, datetime.datetime(2024, 1, d, 0, 0, k), 100 * d + 10 * k + (s == "b")) for d in range(1, 8) for s in ("a", "b") for k in range(2 + d % 4)]
    whole = spark.createDataFrame(rows, kinds)
    for d in range(1, 8):
        whole.where(F.dayofmonth("at") == d).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    query, out = quota(spark, tmp_path)
    held = [sum(x.numRowsTotal for x in p.stateOperators) for p in query.recentProgress if p.numInputRows]
    assert len(held) == 7 and max(held) <= 4  # two days of two sources
    assert {(r.source, r.id) for r in out.where("accepted").collect()} == {(r.source, r.id) for r in daily_quota(whole, "source", "at", "id", 3).collect()}
    assert out.count() == len(rows)
    more = [("a", datetime.datetime(2024, 1, 1), 999), ("a", datetime.datetime(2024, 1, 8, 5), 998), ("c", datetime.datetime(2024, 1, 2), 997)]  # too late, a new day, a new source
    spark.createDataFrame(more, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/calls")
    _, out = quota(spark, tmp_path)
    assert {(r.source, r.id) for r in out.where("accepted and id > 900").collect()} == {("a", 998), ("c", 997)}


def test_buckets_that_a_batch_does_not_touch_stay(spark, tmp_path):
    """Merging by buckets gives the tables of the whole snapshots, and writes only what the batch touches."""
    from noticeflow.streaming.changes import SnapshotTable, merge_batches

    schema = "id int, h string, first int, last int, seq int"
    batches = [[(i, "a", 1, 1, i) for i in range(40)], [(3, "b", 2, 2, 100), (5, "a", 2, 2, 101), (99, "n", 2, 2, 102)], [(3, "a", 3, 3, 200)], [(3, "b", 4, 4, 300)]]
    got = {}
    for name, keys in (("whole", ()), ("buckets", ["id"])):
        root = f"{tmp_path}/{name}"
        tables = [SnapshotTable(spark, f"{root}/{n}", s, keys, 16) for n, s in (("current", schema), ("archive", schema), ("changes", "id int, change string"))]
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            merge_batches(spark.readStream.schema(schema).parquet(f"{root}/in"), *tables, ["id"], "h", "first", "last", ["seq"], f"{root}/cp").awaitTermination()
        got[name] = [sorted(map(tuple, x.collect())) for x in (tables[0].read().select("id", "h", "first", "last"), tables[1].read_all().select("id", "h"), tables[2].read_all())]
    assert got["whole"] == got["buckets"] and len(got["buckets"][0]) == 41 and got["buckets"][1] == [(3, "a"), (3, "b")]
    last = [n for n in os.listdir(f"{tmp_path}/buckets/current/v3") if n.startswith("__bucket")]
    assert len(last) == 1 and len(os.listdir(f"{tmp_path}/buckets/current/v0")) > 10
