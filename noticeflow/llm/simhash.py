"""SimHash near-dedup: exact comparison of fingerprints in tiles, by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.graph import connected_components, spanning_edges
from noticeflow.llm.staging import free_prefix, stage

#: Fingerprints that a tile holds on average at most: where quarters are told apart, and where whole counts are.
TILE, WIDE_TILE = 2048, 8192
#: Tiles that a tile meets in one task, about.
LANE = 128
#: Fingerprints of a set of shingles beside the first.
MORE_WORDS = 3


def hashes_of(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles: A-Z become lower case, words part at ASCII white space, shingles repeat;
    fewer words give the whole sequence as one shingle, no words (or null) none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())], "<u8")


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit b is 1 if it is set in over half of the hashes; zero of none."""
    return int(majorities(hashes[:, None])[0])


def majorities(words: np.ndarray) -> np.ndarray:
    """``majority`` of each column."""
    n, columns = words.shape
    votes = np.zeros((8 * columns, 8), np.int64)
    for i in range(0, n, 65_536):
        part = np.ascontiguousarray(words[i : i + 65_536]).view(np.uint8).reshape(-1, 8 * columns)
        if len(part) < 600:
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64).reshape(-1, 8)
        else:  # how often each byte stands at its place, then the bits of bytes
            counts = np.bincount((part + (np.arange(8 * columns) << 8)).ravel(), minlength=2048 * columns)
            votes += counts.reshape(-1, 256) @ _BITS_OF
    return np.packbits((2 * votes > n).ravel(), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text."""
    return majority(hashes_of(text, shingle))


def _remixed(hashes: np.ndarray) -> np.ndarray:
    """Other bits of the same shingles, for a second fingerprint."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and node (the fingerprint as a signed long) of every row, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "node"])

    return stage(_keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, node long"), "fingerprints")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def set_prints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, node (a name of the set of shingles), n (its size), fp (the set's fingerprint) and more (further
    ``MORE_WORDS`` ones, of other bits of the same shingles) of every row, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, more = np.zeros((3, batch.num_rows), np.uint64), np.zeros((batch.num_rows, MORE_WORDS), np.uint64)
            for i, t in enumerate(batch.column(2)):
                own = np.unique(hashes_of(t.as_py(), shingle))
                words = [own]
                for _ in range(MORE_WORDS):
                    words.append(_remixed(words[-1]))
                found = majorities(np.stack(words, axis=1))
                out[:, i], more[i] = (xxhash.xxh64_intdigest(own.tobytes()), len(own), found[0]), found[1:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, more.size + 1, MORE_WORDS, dtype=np.int32)), pa.array(more.view(np.int64).ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x.view(np.int64)) for x in out), lists], names=["doc_id", "text_key", "node", "n", "fp", "more"])

    return stage(_keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, text_key long, node long, n long, fp long, more array<long>"), "set-prints")


def _columnar(columns: Iterable[str]) -> Column:
    """A list ``g`` of rows as a row of lists."""
    return F.struct(*[(F.flatten(f"g.{c}") if c == "more" else F.col(f"g.{c}")).alias(c) for c in columns])


class _Tiles:
    """Distinct rows of ``prints(node, fp, *held)`` in tiles of equal bit counts, and the pairs of tiles within reach.

    The counts are those of each 16-bit quarter at a radius of up to 4, and of the whole above, where quarters would
    tell hardly any tiles apart. A tile is cut by a hash where it holds more than ``tile``. Counts that differ by more
    than the radius (summed over quarters) prove more differing bits, so tiles meet only within that distance.
    """

    def __init__(self, prints: DataFrame, radius: int, tile: int | None, held: tuple[str, ...] = ()):
        self.blocks = 4 if radius <= 4 else 1
        self.width = 64 // self.blocks
        tile, base = tile or (TILE if self.blocks == 4 else WIDE_TILE), self.width + 1
        quarter = (1 << self.width) - 1 if self.blocks > 1 else -1
        key = F.lit(0)
        for i in range(self.blocks):
            key = key * base + F.bit_count(F.shiftrightunsigned("fp", self.width * i).bitwiseAND(F.lit(quarter))).cast("int")
        columns = ["node", "fp", *held]
        keyed = stage(prints.select(*columns).dropDuplicates(["node"]).withColumn("key", key), "simhash-keys")
        parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
        self.parts = stage(parts, "simhash-parts")  # at most 17**4 rows, so it may be broadcast
        cut = keyed.join(F.broadcast(self.parts), "key").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("parts")).cast("int"))
        grouped = cut.groupBy("key", "part").agg(F.collect_list(F.struct(*columns)).alias("g"))
        self.rows = stage(grouped.select("key", "part", _columnar(columns).alias("g")), "simhash-tiles")
        self.steps = [d for d in product(range(-radius, radius + 1), repeat=self.blocks) if sum(map(abs, d)) <= radius and d >= (0,) * self.blocks]
        self.lanes = -(-len(self.steps) * (self.parts.agg(F.max("parts")).first()[0] or 1) // LANE)

    def _named(self) -> DataFrame:
        """(key, part, other, other_part): each pair of tiles within reach once."""
        base = self.width + 1
        places = [F.expr(f"key div {base ** (self.blocks - 1 - i)} % {base}") for i in range(self.blocks)]
        step = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in self.steps])).alias("d")
        reach = self.rows.select("key", "part", F.array(*places).alias("q"), step).withColumn("q", F.zip_with("q", "d", lambda a, b: a + b))
        reach = reach.where(F.forall("q", lambda x: x.between(0, self.width))).select("key", "part", F.aggregate("q", F.lit(0).cast("bigint"), lambda acc, x: acc * base + x).cast("int").alias("other"))
        met = reach.join(F.broadcast(self.parts.select(F.col("key").alias("other"), "parts")), "other")
        met = met.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return met.where("key <> other or part <= other_part").select("key", "part", "other", "other_part")

    def pairs(self) -> DataFrame:
        """(key, part, other, other_part, g, h): the two tiles of each pair; h is null where they are one.

        A tile that meets many goes to several lanes, by a hash of the tile it meets, so that no task holds them all.
        """
        lane = lambda *c: F.pmod(F.xxhash64(*c), F.lit(self.lanes)).cast("int")
        spread = self.rows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(self.lanes - 1))))
        names = self._named().withColumns({"lane": lane("key", "part"), "other_lane": lane("other", "other_part")})
        right = spread.select(F.col("key").alias("other"), F.col("part").alias("other_part"), "lane", F.col("g").alias("h"))
        met = names.join(right, ["other", "other_part", "lane"]).drop("lane").withColumnRenamed("other_lane", "lane")
        met = met.withColumn("h", F.when((F.col("key") != F.col("other")) | (F.col("part") != F.col("other_part")), F.col("h")))
        return met.join(spread, ["key", "part", "lane"]).select("key", "part", "other", "other_part", "g", "h")


def links(prints: DataFrame, radius: int = 3, tile: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct nodes of ``prints(node)``, fingerprints, that differ in ``radius`` or fewer
    bits. All pairs of two tiles within reach are compared; what a pair of tiles finds is reported as edges that
    connect the same nodes, fewer than it holds.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for a, b in zip(batch.column(0), batch.column(1)):
                x, y = _near(a["node"].values.to_numpy(), b["node"].values.to_numpy() if b.is_valid else None, radius)
                u.append(x)
                v.append(y)
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    tiles = _Tiles(prints.select("node", F.col("node").alias("fp")), radius, tile)
    return tiles.pairs().select("g", "h").mapInArrow(compare, "u long, v long")


def _pairs(left: np.ndarray, other: np.ndarray, radius: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all near fingerprints of two tiles, or of each two within one, block by block."""
    for k in range(0, len(left), 256):
        for m in range(k if within else 0, len(other), 8192):
            rows, columns = np.nonzero(np.bitwise_count(left[k : k + 256, None] ^ other[None, m : m + 8192]) <= radius)
            rows, columns = rows + k, columns + m
            keep = rows < columns if within else np.ones(len(rows), bool)
            if keep.any():
                yield rows[keep], columns[keep]


def _near(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Connecting edges between near fingerprints of two tiles, or within one."""
    other, shift = (left, 0) if right is None else (right, len(left))
    nodes = left if right is None else np.concatenate([left, right])
    found, held = [], 0
    for rows, columns in _pairs(left.view(np.uint64), other.view(np.uint64), radius, right is None):
        found.append((rows, columns + shift))
        held += len(rows)
        if held > 1_000_000:  # a group of copies: its links so far become fewer edges than it has members
            found = [spanning_edges(len(nodes), *(np.concatenate(x) for x in zip(*found)))]
            held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, root = spanning_edges(len(nodes), *(np.concatenate(x) for x in zip(*found)))
    return nodes[node], nodes[root]


def _components(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (a node of it) and component_id (its smallest doc_id) of every distinct node."""
    joined = connected_components(edges, "simhash").withColumnRenamed("node", "n")
    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = first.join(joined, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    placed = stage(placed, "simhash-classes")
    low = stage(placed.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-lowest")
    return placed.join(low, "component").select("node", "component", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    Exact copies share a fingerprint and are compared once. Null and empty texts have the fingerprint zero and link
    like any other; repeated rows stay; ids are cast to long and may be null (a component of null ids only has a null
    component_id). Empty table: no rows. Other columns play no part.
    """
    prints = fingerprints(docs, shingle, doc_id, text)
    found = prints.join(_components(prints, links(prints, radius)), "node")
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def _one_of_each(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of ``docs`` with the first of each component of ``members(component, doc_id, text_key)``."""
    kept = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("k"))
    p = free_prefix(docs, "__dup_")
    kept = kept.select(F.col("k.doc_id").alias(p + "kept_id"), F.col("k.text_key").alias(p + "kept_text"))
    keyed = docs.withColumns({p + "id": F.col(doc_id).cast("long"), p + "text": F.xxhash64(text)})
    stay = keyed.join(kept, F.col(p + "id").eqNullSafe(F.col(p + "kept_id")) & (F.col(p + "text") == F.col(p + "kept_text")), "left_semi")
    return stay.dropDuplicates([p + "id", p + "text"]).drop(p + "id", p + "text")


#: Jaccard similarity of near-duplicates as a fraction, and words of a shingle.
JACCARD, SET_SHINGLE = (4, 5), 5
_BLOCK = ["key", "part", "other", "other_part", "block", "within"]
#: Shingles that the sets of one group to verify have in all (8 bytes each); only a single larger set makes a larger group.
GROUP_SHINGLES = 4_000_000


class Filter(NamedTuple):
    """Differing bits up to which a pair of sets is verified: of the first 64, and of all 256 where both sets have
    ``large`` shingles or more, and where one has fewer. At just 0.8 a bit differs with probability 0.155 (sets of 4
    and 5: 0.19), so of 256 it is 40 in the mean with a deviation of 5.8 (49, 6.3): less than 1 pair in 2500 at just 0.8
    has more. ``EXACT`` verifies every pair whose sizes allow it."""

    first: int = 24
    all: int = 62
    small: int = 74
    large: int = 64


LIKELY, EXACT = Filter(), Filter(64, 256, 256)


def _candidates(left: tuple, right: tuple, within: bool, bits: Filter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (rows, columns, differing bits) of sets of two tiles (fp, more, n), or within one, that may be similar."""
    part, whole = JACCARD
    for rows, columns in _pairs(left[0], right[0], bits.first, within):
        low, high = np.minimum(left[2][rows], right[2][columns]), np.maximum(left[2][rows], right[2][columns])
        keep = whole * low >= part * high
        rows, columns, low = rows[keep], columns[keep], low[keep]
        differ = np.bitwise_count(left[0][rows] ^ right[0][columns]) + np.bitwise_count(left[1][rows] ^ right[1][columns]).sum(axis=1, dtype=np.int64)
        keep = differ <= np.where(low >= bits.large, bits.all, bits.small)
        yield rows[keep], columns[keep], differ[keep]


def _prints_of(fp: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return fp.view(np.uint64), more.view(np.uint64).reshape(len(fp), MORE_WORDS), n


def _chunks(sizes: np.ndarray, hit: np.ndarray, most: int) -> np.ndarray:
    """Numbers of chunks, for sets that were hit, of about ``most`` shingles; -1 for the others."""
    out = np.full(len(sizes), -1, np.int64)
    if hit.any():
        through = np.cumsum(sizes[hit])
        out[hit] = (through - sizes[hit]) // most
    return out


def _suspects(pairs: DataFrame, bits: Filter, most: int) -> DataFrame:
    """(key, part, other, other_part, block, within, side, node): the sets of each pair of tiles that may have a similar
    one there. Where they have more than ``most`` shingles they are dealt to blocks of a chunk of either side, of which
    those with a candidate stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                g, h = batch.column(4)[at], batch.column(5)[at]
                within = not h.is_valid
                h = g if within else h
                left, right = (_prints_of(*(x[c].values.to_numpy() for c in ("fp", "more", "n"))) for x in (g, h))
                hit = [np.zeros(len(left[0]), bool), np.zeros(len(right[0]), bool)]
                for rows, columns, _ in _candidates(left, right, within, bits):
                    hit[0][rows] = hit[0 if within else 1][columns] = True
                if within:
                    hit[1] = hit[0]
                chunk = [_chunks(x[2], y, max(1, most // 2)) for x, y in zip((left, right), hit)]
                whole = [max(0, int(x.max(initial=-1))) + 1 for x in chunk]
                met = np.zeros(whole, bool)
                if met.size == 1:
                    met[:] = hit[0].any()
                else:
                    for rows, columns, _ in _candidates(left, right, within, bits):
                        a, b = chunk[0][rows], chunk[1][columns]
                        met[(np.minimum(a, b), np.maximum(a, b)) if within else (a, b)] = True
                nodes = [x["node"].values.to_numpy() for x in (g, h)]
                for i, j in zip(*(x.tolist() for x in np.nonzero(met))):
                    for side, k in ((0, i),) if within and i == j else ((0, i), (1, j)):
                        own = nodes[side][chunk[side] == k]
                        name = [pa.array(np.full(len(own), v, np.int32)) for v in (*(batch.column(c)[at].as_py() for c in range(4)), i * whole[1] + j)]
                        yield pa.record_batch([*name, pa.array(np.full(len(own), within and i == j)), pa.array(np.full(len(own), side, np.int32)), pa.array(own)], names=[*_BLOCK, "side", "node"])

    return pairs.mapInArrow(run, "key int, part int, other int, other_part int, block int, within boolean, side int, node long")


def _sets(docs: DataFrame, prints: DataFrame, nodes: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """(node, hashes): the sets of ``nodes``, made again from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes_of(t.as_py(), shingle)) for t in batch.column(0)]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in sets)]))
            yield pa.record_batch([pa.array(names.view(np.int64)), pa.ListArray.from_arrays(offsets, values)], names=["node", "hashes"])

    one = prints.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).join(nodes, "node", "left_semi")
    one = one.select(F.col("k.doc_id").alias("one_id"), F.col("k.text_key").alias("one_key"))
    found = _keyed(docs, doc_id, text).join(one, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key")), "left_semi")
    sets = found.select("text").mapInArrow(run, "node long, hashes array<long>")
    return stage(sets.dropDuplicates(["node"]), "similar-sets")  # of rows equal in id and text one


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``JACCARD`` or more."""
    part, whole = JACCARD
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return (part + whole) * shared >= part * (len(a) + len(b))


def _similar_edges(left: tuple, right: tuple, within: bool, bits: Filter, of_left: list[np.ndarray], of_right: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges (place left, place right) that connect what similar sets of two tiles connect. The likeliest pairs come
    first, and pairs that are connected already are not looked at again."""
    shift = 0 if within else len(of_left)
    up = list(range(shift + len(of_right)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    u, v = [], []
    found = list(_candidates(left, right, within, bits))
    rows, columns, differ = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    order = np.argsort(differ, kind="stable")
    for i, j in zip(rows[order].tolist(), columns[order].tolist()):
        a, b = root(i), root(j + shift)
        if a != b and _alike(of_left[i], of_right[j]):
            up[max(a, b)] = min(a, b)
            u.append(i)
            v.append(j)
    return u, v


def similar_links(docs: DataFrame, prints: DataFrame, shingle: int = SET_SHINGLE, doc_id: str = "doc_id", text: str = "text", tile: int | None = None, bits: Filter = LIKELY, most: int = GROUP_SHINGLES) -> DataFrame:
    """Edges (u, v) that connect the nodes of ``set_prints`` whose sets have a Jaccard similarity of ``JACCARD`` or more.

    Copies are one node before. Tiles of fingerprints are compared whole; those sets of a pair of tiles that may have a
    similar one there (``bits``; ``EXACT`` leaves none out) are made again from the texts and go to the pair of tiles,
    in groups of about ``most`` shingles, where pairs are verified on the sets until what is similar is connected. Edges
    come out, fewer than a group has sets: never all pairs.
    """
    near = stage(_suspects(_Tiles(prints, bits.first, tile, ("n", "more")).pairs(), bits, most), "similar-suspects")
    sets = _sets(docs, prints, near.select("node").distinct(), shingle, doc_id, text)
    known = prints.select("node", "fp", "more").dropDuplicates(["node"]).join(sets, "node")
    held = F.collect_list(F.struct("side", "node", "fp", "more", F.size("hashes").cast("long").alias("n"), "hashes")).alias("g")
    groups = near.join(known, "node").groupBy(*_BLOCK).agg(held)
    groups = groups.select("within", "g.side", "g.node", "g.fp", F.flatten("g.more").alias("more"), "g.n", F.flatten("g.hashes").alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                within = batch.column(0)[at].as_py()
                side, node, fp, more, n, flat = (batch.column(i)[at].values.to_numpy() for i in range(1, 7))
                own = np.split(flat.view(np.uint64), np.cumsum(n)[:-1])
                prints_of = _prints_of(fp, more, n)
                a, b = (np.flatnonzero(side == x) for x in ((0, 0) if within else (0, 1)))
                u, v = _similar_edges(tuple(x[a] for x in prints_of), tuple(x[b] for x in prints_of), within, bits, [own[i] for i in a], [own[i] for i in b])
                if u:
                    yield pa.record_batch([pa.array(node[a[u]]), pa.array(node[b[v]])], names=["u", "v"])

    return stage(groups.mapInArrow(run, "u long, v long"), "similar-links")


def drop_similar(docs: DataFrame, shingle: int = SET_SHINGLE, doc_id: str = "doc_id", text: str = "text", bits: Filter = LIKELY) -> DataFrame:
    """Rows of ``docs``, all columns, with one document of each group linked by a Jaccard similarity of ``JACCARD`` or
    more of the sets of shingles: that of the smallest id. Texts without words are equal.

    Among rows with that id the one of the smallest text key stays, and of rows equal in id and text one. Groups of null
    ids keep one row.
    """
    prints = set_prints(docs, shingle, doc_id, text)
    members = prints.join(_components(prints, similar_links(docs, prints, shingle, doc_id, text, bits=bits)), "node")
    return _one_of_each(docs, members, doc_id, text)
