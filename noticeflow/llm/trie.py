"""Prefix trie of conversations in preorder intervals: distinct nodes are ranked lexicographically, each stores where its
subtree ends, and sums over subtrees are differences of distributed prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.prefix import running
from noticeflow.llm.staging import stage

#: Ids of a node's conversations that travel as one string on their way to the digest.
BLOCK = 4096
_WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "x1", "x2"]


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), c1, c2 (128 bits of role and text), words of every turn, in the order of the turns.

    Null turns come first; equal ones are ordered by role and by the text's hash. A null role or text is empty. Rows
    without conv_id belong to no conversation. Texts are not shuffled, and a long conversation is spread over tasks.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    narrow = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), by.alias("role"), F.xxhash64(F.lit(101), by, said).alias("c1"), F.xxhash64(F.lit(202), by, said).alias("c2"),
        F.regexp_count(said, F.lit(_WORD)).cast("long").alias("words"), F.lit(1).alias("place"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "c1", "c2"]
    return running(narrow, "conv_id", order, sums=["place"], keep=["conv_id", "c1", "c2", "words"], name="turns").withColumnRenamed("place_run", "place")


def shared_starts(turns: DataFrame, every: int = 20, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with shared starts, and all conv_ids with their numbers of rebuilt turns (``turns``).

    Conversation c gets the first h turns of conversation c - c % ``every`` (all if it has fewer, none if it is absent),
    then its own turns after its first h; h is the crc32 of the decimal c modulo ``least``.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    counts = stage(turns.groupBy("conv_id").agg(F.max("place").alias("own")).withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % least}), "conversations")
    held = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    convs = stage(
        counts.join(held, "base", "left").withColumn("k", F.least("h", F.coalesce("base_turns", F.lit(0)))).withColumn("turns", F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "rebuilt")
    after = turns.join(convs.select("conv_id", "h", "k", "turns"), "conv_id").where("place > h").withColumn("place", F.col("k") + F.col("place") - F.col("h"))
    starts = turns.where(F.col("place") < least).withColumnRenamed("conv_id", "base").join(convs.where("k > 0").select("base", "conv_id", "k", "turns"), "base").where("place <= k")
    columns = ["conv_id", "place", "c1", "c2", "words", (F.col("place") == F.col("turns")).alias("ends")]
    return after.select(*columns).unionByName(starts.select(*columns)), convs.select("conv_id", "turns")


def _rank(conv: str | Column) -> Column:
    """A scattered order of conversations; one to one, as XXH64 of a single long is."""
    return F.xxhash64(conv)


def member_digests(members: DataFrame, group: str, member: str) -> DataFrame:
    """(``group``, sha256): of each group's members in ascending order, as decimals joined by commas.

    Members are ordered and written to strings of ``BLOCK`` in many tasks; the task of a group then reads its strings
    one after another, as the digest needs.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            groups, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for g, i in zip(groups, ids):
                if held and (g != now or len(held) == BLOCK):
                    out.append((now, held[0], ",".join(map(str, held))))
                    held = []
                now = g
                held.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[group, "first", "block"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held[0]]), pa.array([",".join(map(str, held))])], names=[group, "first", "block"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            out = []
            for g, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and g == now:
                    state.update(b"," + block.encode())
                    continue
                if state is not None:
                    out.append((now, state.hexdigest()))
                state, now = hashlib.sha256(block.encode()), g
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[group, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=[group, "sha256"])

    dealt = members.select(F.col(group).cast("long"), F.col(member).cast("long")).repartitionByRange(group, member).sortWithinPartitions(group, member)
    strings = dealt.mapInArrow(blocks, f"{group} long, first long, block string")
    return strings.repartition(group).sortWithinPartitions(group, "first").select(group, "block").mapInArrow(digests, f"{group} long, sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, place from 1 without gaps, c1, c2, words, ends: the last turn) of the
    conversations ``convs`` (conv_id, turns), of which some may have no turns and belong to the root alone.

    Gives conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the interval: preorder (from 1) and subtree_end. No conversations: no nodes.

    A node is known by its depth and the exclusive-or of 128-bit hashes of (place, role, text), a running value. Every
    node is on the path of its member of lowest scattered rank; nodes of one such member are a chain, and along any
    path the chain changes about ln(members) times. A node's place in the preorder is so the order of (the depths at
    which chains branch off, deeper ones first, and the chains' ranks; its depth): keys stay short however long
    conversations are. A subtree ends where the last of its members does.
    """
    lanes = [F.xxhash64(F.lit(s), "c1", "c2", "place").alias(c) for s, c in ((11, "x1"), (12, "x2"))]
    marked = turns.select("conv_id", F.col("place").alias("depth"), *lanes, "words", "ends")
    scanned = running(marked, "conv_id", ["conv_id", "depth"], xors=["x1", "x2"], name="paths")
    held = scanned.select("conv_id", "depth", F.col("x1_run").alias("x1"), F.col("x2_run").alias("x2"), F.col("x1").bitwiseXOR(F.col("x1_run")).alias("p1"), F.col("x2").bitwiseXOR(F.col("x2_run")).alias("p2"), "words", "ends")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("words"), (F.col("turns") == 0).alias("ends"))
    steps = held.withColumn("depth", F.col("depth").cast("long")).unionByName(roots)

    nodes = stage(
        steps.groupBy(*_NODE).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(_rank("conv_id")).alias("chain"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
            F.sum(F.col("ends").cast("long")).alias("n_ends")), "nodes")
    top = F.lit((nodes.where("depth = 0").agg(F.min("chain")).first() or [None])[0]).cast("long")
    entered = steps.where("depth > 0").join(nodes.select(*_NODE, "chain"), _NODE).groupBy("conv_id", "chain").agg(F.min("depth").alias("depth"))
    paths = entered.where(F.col("chain") != top).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "chain"))).alias("path"))
    own = paths.where(F.element_at("path", -1)["chain"] == _rank("conv_id")).select(_rank("conv_id").alias("chain"), F.transform("path", lambda x: F.struct((-x["depth"]).alias("depth"), x["chain"].alias("chain"))).alias("path"))
    chained = nodes.join(own, "chain", "left")  # without a path: the chain that begins at the root
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    keyed = chained.select(
        *_NODE, "p1", "p2", "conv_id", "chain", "n_convs", "n_ends", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(1).alias("preorder"),
        F.coalesce("path", F.expr("cast(array() as array<struct<depth: bigint, chain: bigint>>)")).alias("path"))
    kept = [*_NODE, "p1", "p2", "conv_id", "chain", "n_convs", "n_ends", "leaves", "saved"]
    ranked = stage(running(keyed, None, ["path", "depth"], sums=["preorder", "leaves", "saved"], keep=kept, name="preorder"), "ranked")

    sums = ["preorder_run", "leaves_run", "saved_run"]
    last = stage(steps.where("ends").select("conv_id", *_NODE).join(ranked.select(*_NODE, "chain", *sums), _NODE).select("conv_id", "chain", *sums), "last")
    through = steps.select("conv_id", *_NODE).join(last.where(F.col("chain") == _rank("conv_id")).select("conv_id", *sums), "conv_id")  # copies end where the first of them does
    children = ranked.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), *[none.alias(c) for c in sums], F.lit(1).alias("child"))
    of_node = (
        through.select(*_NODE, *sums, F.lit(0).alias("child")).unionByName(children).groupBy(*_NODE)
        .agg(F.max("preorder_run").alias("subtree_end"), F.max("leaves_run").alias("leaves_end"), F.max("saved_run").alias("saved_end"), F.sum("child").alias("n_children")))
    parents = ranked.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    digests = member_digests(last, "preorder_run", "conv_id").withColumnRenamed("sha256", "digest")
    out = ranked.join(of_node, _NODE).join(parents, ["depth", "p1", "p2"], "left").join(digests, "preorder_run", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves_run") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_run") + F.col("saved")).alias("saved_tokens"), F.coalesce("digest", F.lit(_EMPTY)).alias("ends_sha256"), F.col("preorder_run").alias("preorder"), "subtree_end")


def rebuilt_trie(rows: DataFrame, every: int = 20, least: int = 4) -> DataFrame:
    """The trie of ``rows`` after ``shared_starts``."""
    turns, convs = shared_starts(conversations(rows), every, least)
    return prefix_trie(turns, convs)
