"""Packing documents into fixed-length sequences: first-fit decreasing by a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.tokens import Encoder, encoder

#: Characters of text that a group holds on average.
GROUP_CHARS = 4_000_000
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Tournament:
    """Free room of numbered bins; ``first`` finds the first bin with enough of it in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        k = 1
        while k < self.leaves:
            k *= 2
            if self.best[k] < need:
                k += 1
        return k - self.leaves

    def take(self, at: int, need: int) -> None:
        k = at + self.leaves
        self.best[k] -= need
        while k > 1:
            k //= 2
            self.best[k] = max(self.best[2 * k], self.best[2 * k + 1])


def pack_group(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, bin, offset) of one group.

    Documents longer than a sequence give full sequences first. The rest go by first-fit decreasing, ties in
    order. Bins left with room are then closed without padding: from the emptiest on, their pieces are cut to fill
    the others, and the last open bin is cut into bins whose lengths are powers of two, which need no padding.
    """
    pieces, rest, bins = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, bins, 0))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, d, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, filled = Tournament(len(rest), capacity), {}
    for n, d, start in rest:
        at = tree.first(n)
        tree.take(at, n)
        filled.setdefault(at, []).append((d, start, n))
    used = {at: sum(x[2] for x in own) for at, own in filled.items()}
    open_bins = sorted((at for at in used if used[at] < capacity), key=lambda at: (-used[at], at))
    low, high = 0, len(open_bins) - 1
    while low < high:  # the fullest open bin takes from the emptiest
        room, giver = capacity - used[open_bins[low]], filled[open_bins[high]]
        while room and giver:
            d, start, n = giver.pop()
            cut = min(n, room)
            filled[open_bins[low]].append((d, start + n - cut, cut))
            used[open_bins[low]] += cut
            used[open_bins[high]] -= cut
            room -= cut
            if cut < n:
                giver.append((d, start, n - cut))
        low += not room
        high -= not giver
    for at in sorted(filled):
        if not filled[at]:
            continue
        last = used[at] < capacity
        sizes = [1 << b for b in range(used[at].bit_length() - 1, -1, -1) if used[at] >> b & 1] if last else [capacity]
        queue = list(filled[at])[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                d, start, n = queue.pop()
                cut = min(n, size - offset)
                pieces.append((d, start, cut, bins, offset))
                offset += cut
                if cut < n:
                    queue.append((d, start + cut, n - cut))
            bins += 1
    return pieces


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.Array], list[pa.Array]]]:
    """(group, keys, texts) of rows (group, key, text) that come group by group; a new block begins with each group,
    and inside one as soon as the block holds ``most`` characters."""
    now, keys, texts, held = None, [], [], 0
    for batch in batches:
        sizes, a = pc.utf8_length(batch.column(2)).fill_null(0).to_pylist(), 0
        for i, (group, n) in enumerate(zip(batch.column(0).to_pylist(), sizes)):
            if held and (group != now or held >= most):
                yield now, [*keys, batch.column(1)[a:i]], [*texts, batch.column(2)[a:i]]
                keys, texts, held, a = [], [], 0, i
            now, held = group, held + n + 1
        keys.append(batch.column(1)[a:])
        texts.append(batch.column(2)[a:])
    if held:
        yield now, keys, texts


def _block(keys: list[pa.Array], texts: list[pa.Array], group: int, bins: int, enc: Encoder, end: np.ndarray, capacity: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a block, and the number of the group's sequences after it (``bins`` before)."""
    ids = [np.concatenate([x, end]) for part in texts for x in enc.encode_column(part)]
    pieces = pack_group([len(x) for x in ids], capacity)
    crcs = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
    d, start, length, at, offset = (np.array(x, np.int64) for x in zip(*pieces))
    numbers = (start, length, np.array(crcs, np.int64), np.array([len(x) for x in ids], np.int64)[d], (group << 32) + bins + at, offset)
    return pa.record_batch([pa.concat_arrays(keys).take(pa.array(d)), *map(pa.array, numbers)], names=_COLUMNS), bins + int(at.max()) + 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, seed: int = 11, group_chars: int = GROUP_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all ``docs`` in sequences of at most ``capacity`` tokens.

    Rows are dealt at random (by a seeded hash of id and text, so a task that runs again deals alike) into groups of
    about ``group_chars`` characters, sorted by the same hash and packed group by group as they stream by; what a
    group holds beyond twice that size is a block of its own, so no task holds more than a block, however many equal
    rows there are. Sequences depend on the rows alone, not on their partitions. A null text is empty: one sequence
    piece with the end id. Repeated rows are documents of their own. Empty table: no rows. Other columns play no part.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    total = narrow.agg(F.sum(F.length("text")), F.count("*")).first()
    groups = int(((total[0] or 0) + total[1]) // group_chars) + 1
    dealt = narrow.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("group", F.pmod("place", F.lit(groups)))
    ordered = dealt.repartition("group").sortWithinPartitions("group", "place", "doc_id").select("group", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        last, bins = None, 0
        for group, keys, texts in _blocks(batches, 2 * group_chars):
            bins = bins if group == last else 0
            out, bins = _block(keys, texts, group, bins, enc, end, capacity)
            last = group
            yield out

    kind = dict(narrow.dtypes)["doc_id"]
    return ordered.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
