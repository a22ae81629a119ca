"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.staging import stage

#: Tables, and cells that a query looks into in each. Measured recall at 20: see the README.
TABLES, PROBES = 6, 22
#: Vectors of a cell, or queries that look into it, that go into one comparison.
TILE = 2048


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotate(x: np.ndarray, seed: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-rotation of the rows: sign flips and a fast Hadamard transform, ``rounds`` times. Pads to a power of 2."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        x = x * rng.choice([-1.0, 1.0], width)
        h = 1
        while h < width:
            pairs = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), width)
            h *= 2
        x = x / np.sqrt(width)
    return x


def nearest_axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each rotated row, nearest first: 2 * axis, plus 1 where it is negative."""
    r = rotate(x, seed)
    scores = np.stack([r, -r], axis=2).reshape(len(r), -1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cells(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """vec_id, v and the cells of each table that the vector is assigned to (probes = 1) or looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
            cells = [nearest_axes(unit, seed + t, probes) + (t << 32) for t in range(tables)]
            flat = np.concatenate(cells, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.reshape(-1).astype(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], names=["vec_id", "v", "cells"])

    return vectors.mapInArrow(run, "vec_id long, v array<double>, cells array<long>")


def _tiled(cells: DataFrame, tile: int, name: str) -> DataFrame:
    """(cell, part) tiles of about ``tile`` vectors: every cell is cut by a hash of id and vector into as many parts as it needs. There
    are twice as many cells in a table as the vectors have dimensions, so their counts may be broadcast."""
    rows = cells.select("vec_id", "v", F.explode("cells").alias("cell"))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    cut = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    return cut.groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias(name)).select("cell", F.col(f"{name}.vec_id").alias(f"{name}_ids"), F.flatten(f"{name}.v").alias(f"{name}_v"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = 17, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest inner product found for each query.

    Vectors are turned to unit length and hashed to the nearest signed axis after each table's pseudo-rotation; a
    query looks into its ``probes`` nearest cells of every table. All vectors of a cell are scored in double
    precision on the original vectors (a cell is cut into tiles, not capped), so vectors should be of about equal
    length for the cells to fit the inner product. A query is no candidate of itself; ties go to the smaller id.
    Null, zero, non-finite or empty vectors and null ids take no part; all vectors have one dimension. A repeated
    id counts once per distinct score, and repeated rows, of queries or candidates, change nothing. No queries or candidates: no rows. Other columns play no part.
    """

    def narrow(df: DataFrame) -> DataFrame:
        return df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).dropDuplicates(["vec_id", "v"])

    asked = stage(_tiled(_cells(narrow(queries), tables, probes, seed), TILE // 2, "q"), "ann-queries")
    held = stage(_tiled(_cells(narrow(candidates), tables, 1, seed), TILE, "c"), "ann-cells")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, c_ids = (batch.column(i)[row].values.to_numpy() for i in (0, 2))
                q, c = (batch.column(i)[row].values.to_numpy().reshape(len(ids), -1) for i, ids in ((1, q_ids), (3, c_ids)))
                yield pa.record_batch([pa.array(x) for x in _best(q_ids, q, c_ids, c, k)], names=["query_id", "vec_id", "score"])

    met = asked.join(held, "cell").select("q_ids", "q_v", "c_ids", "c_v")
    best = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Equal rows, of several tables or of several vectors of an id, share a dense rank; this limit holds before the shuffle.
    some = best.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    once = some.dropDuplicates(["query_id", "vec_id", "score"])
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one tile. A fast product finds all that may be among them; their scores are then
    summed in one fixed order, so equal vectors score equal wherever they stand."""
    ids, found, scores = [], [], []
    for i in range(0, len(q), 256):
        fast = q[i : i + 256] @ c.T
        fast[q_ids[i : i + 256, None] == c_ids[None, :]] = -np.inf
        least = np.partition(fast, -k, axis=1)[:, -k] if fast.shape[1] > k else np.full(len(fast), -np.inf)
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
        rows, columns = np.nonzero((fast >= (least - slack)[:, None]) & (fast > -np.inf))
        exact = (q[i + rows] * c[columns]).sum(axis=1)
        order = np.lexsort((c_ids[columns], -exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        new = np.ones(len(rows), bool)  # repeated rows count once
        new[1:] = (rows[1:] != rows[:-1]) | (c_ids[columns[1:]] != c_ids[columns[:-1]]) | (exact[1:] != exact[:-1])
        rows, columns, exact = rows[new], columns[new], exact[new]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        ids.append(q_ids[i + rows[top]])
        found.append(c_ids[columns[top]])
        scores.append(exact[top])
    return np.concatenate(ids), np.concatenate(found), np.concatenate(scores)
