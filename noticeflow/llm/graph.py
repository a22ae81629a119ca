"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.staging import remove, stage_at


def spanning_edges(count: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what ``left[i]--right[i]`` connect.

    ``count`` nodes give fewer than ``count`` edges, however many pairs come in: blocks of a group of copies
    report their links this way instead of listing all pairs.
    """
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(count))
    return moved, label[moved]


def _toward_minimum(pairs: DataFrame, keep_self: bool, name: str) -> tuple[DataFrame, list[str]]:
    """Link every neighbour ``v`` of ``u`` to the smallest of ``u``'s neighbours and ``u``; and the folders used."""
    low, path = stage_at(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    joined = pairs.join(low, "u")
    if keep_self:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        out = out.select("e.u", "e.v")
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked, its_path = stage_at(out.where("u <> v").distinct(), name)
    return linked, [path, its_path]


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``; component is its smallest reachable node.

    Each round is one large-star and one small-star step over the edge table: aggregations with map-side combine
    and joins against a written table with one row per node, so a hub's rows may be split by adaptive skew handling.
    Rounds grow with the logarithm of the path lengths. The tables of each round are written to the shared folder.
    Edges with a null end and self-links give nothing; no edges give no rows.
    """
    spark = edges.sparkSession
    now, path = stage_at(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = _digest(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large, used = _toward_minimum(both, False, name)
        small, more = _toward_minimum(large, True, name)
        now = small
        for old in (path, *used, more[0]):
            remove(spark, old)
        path = more[1]
        digest = _digest(now)
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
