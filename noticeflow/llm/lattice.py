"""Embedding near-dedup by lattice hashing: random projections decoded to E8 points, neighbouring cells probed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.ann import usable
from noticeflow.llm.graph import connected_components, spanning_edges
from noticeflow.llm.staging import stage

#: Tables, neighbouring cells probed in each, and the projection's scale. At cosine 0.93 a pair of unit vectors is
#: found with a probability of 0.99, at 0.97 of over 0.9999 (README); two unrelated ones meet in 1 of 40 cases.
TABLES, PROBES, SCALE = 5, 2, 0.6
#: Vectors of a cell that go into one comparison.
TILE = 1024
#: Signs of random projections that stand for a vector in its cells, and how many may differ for a pair to be verified:
#: at cosine 0.93 it is 15 of 128 in the mean, with a deviation of 3.7; two unrelated vectors differ in 64.
SKETCH_BITS, SKETCH_RADIUS = 128, 34


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [(i, j, s, t) for i, j in combinations(range(8), 2) for s, t in product((1.0, -1.0), repeat=2)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in zip(whole, pairs):
        row[i], row[j] = s, t
    half = np.array([x for x in product((0.5, -0.5), repeat=8) if sum(y < 0 for y in x) % 2 == 0])
    return np.concatenate([whole, half])


_NEIGHBOURS = _minimal_vectors()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the better of D8 and D8 moved by a half."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    first = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(first[:, None], a, b)


def _name(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of lattice points: a polynomial in twice their coordinates, which are whole."""
    code = np.full(points.shape[:-1], np.uint64(table + 1))
    for k in range(8):
        code = code * np.uint64(0x9E3779B97F4A7C15) + (np.rint(2 * points[..., k]).astype(np.int64)).view(np.uint64)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def lattice_cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Cells (rows, tables, 1 + probes): the own cell of each table, then the nearest neighbouring ones."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t])
        y = unit @ (rng.standard_normal((unit.shape[1], 8)) * scale) + rng.uniform(0, 1, 8)
        own = decode_e8(y)
        rest = y - own
        nearer = np.argsort(-(rest @ _NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]  # all neighbours have one length
        out[:, t, 0] = _name(own, t)
        out[:, t, 1:] = _name(own[:, None, :] + _NEIGHBOURS[nearer], t)
    return out


def _hashed(reps: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """``reps`` with the signs of ``SKETCH_BITS`` projections and the cells of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                unit = np.stack([_unit(v.values.to_numpy(zero_copy_only=False)) for v in part.column(4)])
                cells = lattice_cells(unit, tables, probes, scale, seed)
                signs = unit @ np.random.default_rng([seed, tables]).standard_normal((unit.shape[1], SKETCH_BITS)) > 0
                sketch = np.packbits(signs, axis=1).view(np.int64)
                yield pa.record_batch([*part.columns, *map(_lists, (sketch, cells.reshape(len(unit), -1)))], names=["node", "vec_id", "label", "copies", "v", "sketch", "cells"])

    return reps.mapInArrow(run, "node long, vec_id long, label string, copies long, v array<double>, sketch array<long>, cells array<long>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.reshape(-1)))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _suspects(own: np.ndarray, sketch: np.ndarray, part: np.ndarray, a: int, b: int) -> np.ndarray:
    """Which vectors of one or two tiles of a cell have a partner that their sketches do not rule out."""
    left = np.flatnonzero(part == a)
    right = left if a == b else np.flatnonzero(part == b)
    hit = np.zeros(len(part), bool)
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        differ = np.zeros((len(rows), len(right)), np.uint8)
        for word in range(sketch.shape[1]):
            differ += np.bitwise_count(sketch[rows, None, word] ^ sketch[None, right, word])
        near = (differ <= SKETCH_RADIUS) & (own[rows, None] | own[None, right])
        if a == b:
            near[np.arange(len(rows)), np.arange(k, k + len(rows))] = False
        hit[rows] |= near.any(axis=1)
        hit[right] |= near.any(axis=0)
    return hit


def _compare(own: np.ndarray, copies: np.ndarray, v: np.ndarray, cells: np.ndarray, part: np.ndarray, cell: int, table: int, cosine: float, a: int, b: int):
    """Counts (position, links) and connecting edges (positions) among the vectors of one or two tiles of a cell.

    A pair counts in the first cell that holds both and is the own cell of one: tables in order, then by name.
    """
    left = np.flatnonzero(part == a)
    right = left if a == b else np.flatnonzero(part == b)
    counts, none = np.zeros(len(own), np.int64), np.zeros(0, np.int64)
    ends = [(none, none)]
    for k in range(0, len(left) if len(right) else 0, 256):
        rows = left[k : k + 256]
        i, j = np.nonzero(v[rows] @ v[right].T >= cosine - 1e-9)
        i, j = rows[i], right[j]
        keep = (own[i] | own[j]) & ((i < j) if a == b else True)
        i, j = i[keep], j[keep]
        sure = (v[i] * v[j]).sum(axis=1) >= cosine
        i, j = i[sure], j[sure]
        ends.append((i, j))
        before = np.zeros(len(i), bool)
        for t in range(table):
            before |= (cells[i, t, 0, None] == cells[j, t]).any(axis=1) | (cells[j, t, 0, None] == cells[i, t]).any(axis=1)
        lower = lambda x, y: ((cells[x, table, 0] == cells[y, table].T) & (cells[x, table, 0] < cell)).any(axis=0)
        before |= lower(i, j) | lower(j, i)
        np.add.at(counts, i[~before], copies[j[~before]])
        np.add.at(counts, j[~before], copies[i[~before]])
    i, j = (np.concatenate(x) for x in zip(*ends))
    return counts, spanning_edges(len(own), i, j)


def _cell_members(hashed: DataFrame, tile: int, width: int) -> DataFrame:
    """(label, tbl, cell, a, b) tile pairs of cells, with node, own, part of the vectors there that may have a partner.

    A cell is cut into tiles by a hash and all pairs of its tiles are looked at, on sketches; what comes out are the
    vectors of a tile pair that some other one's sketch is near to, never pairs.
    """
    place = F.posexplode("cells").alias("at", "cell")
    keys = hashed.select("node", "label", "sketch", place).select("node", "label", "sketch", "cell", F.expr(f"at div {width}").cast("int").alias("tbl"), (F.col("at") % width == 0).alias("own"))
    sizes = keys.groupBy("label", "tbl", "cell").agg(F.count("*").alias("n"), F.bool_or("own").alias("any_own")).where("n > 1 and any_own")
    sizes = stage(sizes.select("label", "tbl", "cell", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "lattice-sizes")
    cut = keys.join(sizes, ["label", "tbl", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = cut.withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"a": F.least("part", "beside"), "b": F.greatest("part", "beside")})
    groups = met.groupBy("label", "tbl", "cell", "a", "b").agg(F.collect_list(F.struct("node", "own", "part", "sketch")).alias("g"))
    groups = groups.select("label", "tbl", "cell", "a", "b", "g.node", "g.own", "g.part", F.flatten("g.sketch").alias("sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                node, own, part, flat = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(5, 9))
                own = own.astype(bool)
                hit = _suspects(own, flat.view(np.uint64).reshape(len(node), -1), part, batch.column(3)[r].as_py(), batch.column(4)[r].as_py())
                if hit.any():
                    same = [pa.array([batch.column(i)[r].as_py()] * int(hit.sum()), batch.schema.field(i).type) for i in range(5)]
                    yield pa.record_batch([*same, pa.array(node[hit]), pa.array(own[hit]), pa.array(part[hit])], names=["label", "tbl", "cell", "a", "b", "node", "own", "part"])

    return groups.mapInArrow(run, "label string, tbl int, cell long, a int, b int, node long, own boolean, part int")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 23, tile: int = TILE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Two vectors link when their labels are equal and their cosine, in double precision, is ``cosine`` or more.
    Equal vectors of a label are collapsed first (by 128 bits of hashes) and counted by their number. Each other vector
    enters its own E8 cell of every table and ``probes`` neighbouring ones; pairs that share a cell which is the own one
    of either are compared. Sketches go to the cells, and vectors only where one has a partner that the sketches do not
    rule out; what comes out are counts per vector and edges that connect the same vectors, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without label or id, link
    with nothing and are components of their own. Repeated rows are linked as equal vectors; a repeated id with other
    vectors is a vector of its own in each. All usable vectors have one dimension. Empty table: no rows. Other columns
    play no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    takes_part = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = rows.withColumns({"k1": F.when(takes_part, F.xxhash64(F.lit(1), "label", "v")), "k2": F.xxhash64(F.lit(2), "label", "v")})
    equal = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = stage(equal.withColumn("node", F.monotonically_increasing_id()), "lattice-vectors")  # written with the row, so it stays
    hashed = stage(_hashed(reps.select("node", "vec_id", "label", "copies", "v"), tables, probes, scale, seed), "lattice-cells")
    width = 1 + probes
    members = stage(_cell_members(hashed, tile, width), "lattice-members")
    fetched = members.join(hashed.select("node", "copies", "v", "cells"), "node")
    groups = fetched.groupBy("label", "tbl", "cell", "a", "b").agg(F.collect_list(F.struct("node", "own", "copies", "part", "v", "cells")).alias("g"))
    groups = groups.select("tbl", "cell", "a", "b", "g.node", "g.own", "g.copies", "g.part", F.flatten("g.v").alias("v"), F.flatten("g.cells").alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, ns = [], [], []
            for r in range(batch.num_rows):
                table, cell, a, b = (batch.column(i)[r].as_py() for i in range(4))
                ids, own, copies, part, flat, cells = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(4, 10))
                v = np.stack([_unit(x) for x in flat.reshape(len(ids), -1)])
                counts, (node, root) = _compare(own.astype(bool), copies, v, cells.reshape(len(ids), tables, width), part, cell, table, cosine, a, b)
                some = np.flatnonzero(counts)
                us += [ids[some], ids[node]]
                vs += [ids[some], ids[root]]
                ns += [counts[some], np.zeros(len(node), np.int64)]
            if us:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (us, vs, ns)], names=["u", "v", "n"])

    found = stage(groups.mapInArrow(run, "u long, v long, n long"), "lattice-links")
    counted = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("n = 0").select("u", "v"), "lattice").withColumnRenamed("node", "m")
    placed = reps.drop("v", "label").join(counted, F.col("node") == F.col("u"), "left").join(joined, F.col("node") == F.col("m"), "left")
    placed = placed.select("k1", "k2", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = stage(placed, "lattice-classes")
    low = stage(placed.groupBy("component").agg(F.min("vec_id").alias("component_id")), "lattice-lowest")
    marked = placed.join(low, "component").select("k1", "k2", "n_links", "component_id")
    out = keyed.select("vec_id", "k1", "k2").join(marked, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
