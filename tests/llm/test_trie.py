"""The conversation trie and its running sums against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, depth string, chain string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def plain_trie(rows):
    """{(conv_id, depth): (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}"""
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in said.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(who) if rebuilt[c] == node)
        out[min(who), len(node)] = (min(members[node[:-1]]) if node else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out, rows


def branching(seed: int, convs: int, longest: int):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.randrange(400)
        rows += [(c, i, r.choice(["user", "assistant"]), r.choice(["yes", "no so", "a  b\tc"])) for i in range(len(rows) % longest)]
    return rows


def test_trie_equals_plain_python(spark):
    from noticeflow.llm.trie import rebuilt_trie

    one = [(40 + i, k, "user", f"step {k % 3}") for i in range(12) for k in range(3 * i + 2)]  # growing copies of one conversation
    same = [(c, k, "user", "same words") for c in range(200, 320) for k in range(2)]
    once = {(c, t): (c, t, r, x) for c, t, r, x in branching(1, 150, 9)}.values()
    for rows in (list(once), one, same + one):
        got, all_rows = found(rebuilt_trie(frame(spark, rows).repartition(7)))
        assert got == plain_trie(rows)
        assert sorted(x.preorder for x in all_rows) == list(range(1, len(all_rows) + 1))
        place = {(x.conv_id, x.depth): x for x in all_rows}
        for x in all_rows:  # a child's interval lies in its parent's
            up = place.get((x.parent_conv_id, x.depth - 1))
            assert up is None or up.preorder < x.preorder <= x.subtree_end <= up.subtree_end


def test_trie_takes_edge_cases(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns, turnless conversations."""
    from noticeflow.llm.trie import rebuilt_trie

    long_text = "word " * 200_000
    turnless = next(c for c in range(1000, 9000, 20) if zlib.crc32(str(c + 1).encode()) % 4 == 3) + 1
    rows = [
        (1, None, "user", "first of all"), (1, 0, None, None), (1, 0, "user", ""), (1, 1, "user", long_text), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "of none"),
        (3, 5, "a", "b"), (3, 5, "a", "a"), (20, 0, "user", "hi"), (21, 0, "user", "hi"), (21, 1, "user", None), (turnless, 0, "user", "gone"), (-3, 0, "user", "negative")]
    got, _ = found(rebuilt_trie(frame(spark, rows).repartition(4)))
    want = plain_trie([x for x in rows if x[0] is None or x[0] >= 0])
    minus = found(rebuilt_trie(frame(spark, [x for x in rows if x[0] is None or x[0] >= 0])))[0]
    counts = lambda nodes: sorted((k, v[:5]) for k, v in nodes.items())  # noqa: E731  tied texts stand in the order of their hashes
    assert counts(minus) == counts(want)
    assert got[-3, 0][1] == 7
    assert rebuilt_trie(frame(spark, [])).count() == 0
    only_null = spark.createDataFrame([(None, 1, "a", "b")], "conv_id int, turn int, role string, text string")
    assert rebuilt_trie(only_null).count() == 0


def test_hot_keys_are_spread(spark):
    """One conversation with most rows: the running order deals it to many tasks, and sums go on across them."""
    from noticeflow.llm.prefix import running
    from noticeflow.llm.trie import conversations, member_digests

    rows = [(7, i, "user", str(i % 5)) for i in range(3000)] + [(c, 0, "user", "x") for c in range(100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = conversations(frame(spark, rows)).collect()
        assert sorted(x.place for x in turns if x.conv_id == 7 and x.c1) == list(range(1, 3002))
        sums = running(spark.range(5000).select("id", (F.col("id") % 7).alias("v"), (F.col("id") * 77).alias("w")), None, ["id"], ["v"], ["w"]).orderBy("id").collect()
        total = x = 0
        for r in sums:
            total, x = total + r.v, x ^ r.w
            assert (r.v_run, r.w_run) == (total, x)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ends = spark.range(20_000).select((F.col("id") % 3 * F.when(F.col("id") > 9, 1).otherwise(5)).alias("g"), "id")
    want = {}
    for r in ends.collect():
        want.setdefault(r.g, []).append(r.id)
    assert {r.g: r.sha256 for r in member_digests(ends, "g", "id").collect()} == {g: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest() for g, x in want.items()}


def test_query_equals_sql(spark):
    import duckdb

    from noticeflow.llm.queries import ORACLE_SQL, op11_conversation_prefix_trie

    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(ORACLE_SQL["op11_conversation_prefix_trie"])
    columns = [c[0] for c in want.description]
    got = op11_conversation_prefix_trie(spark, "/root/testdata/sf0.01")
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_on_given_tables(spark, size):
    from noticeflow.llm.queries import op11_conversation_prefix_trie

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_conversation_prefix_trie(spark, f"/root/testdata/{size}"))[0] == plain_trie(rows)
