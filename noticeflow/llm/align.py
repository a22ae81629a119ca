"""Cross-tokenizer alignment: two tokenizers' tokens of a text are cut into groups where both end at the same byte, and
tokens whose byte ranges overlap are linked. After tokenising, arrays in Spark do all: array_intersect, transform,
aggregate."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.staging import remove, stage, stage_at

#: Characters of text whose distinct pieces are numbered together, characters of a part of a long text, and id pairs up to
#: which their counts are broadcast (24 bytes each).
TOGETHER, PART, BROADCAST_PAIRS = 8_000_000, 2_000_000, 2_000_000
#: Most tasks to which batches are dealt one by one.
_TASKS = 10_000
#: Letters, and marks before which a text is cut where they follow a letter.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?"
_PIECE = re.compile(rf"(?s).(?:[^ {_MARKS}]+|(?<=\s) |(?<![{_LETTERS}])[{_MARKS}])*")
_CROSSING = re.compile(rf"[^▁]▁|[{_LETTERS}][{_MARKS}]|\n")
_TEXTS = "batch bigint, pieces array<struct<piece: string, n: bigint>>, docs array<struct<row: bigint, doc_id: bigint, part: int, parts: int, codes: array<int>>>"
_SUMS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
_KNOWN = "piece string, n bigint, sound boolean, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"


def pieces_of(text: str) -> list[str]:
    """What stands between the cuts of ``text``: before spaces that follow a character other than white space, and before
    marks that follow a letter."""
    return _PIECE.findall(text)


class _Vocabulary:
    """Bytes of each id, one after another."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for i, b in tokens.items():
            self.sizes[i] = len(b)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.sizes))), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        through = np.cumsum(sizes)
        return self.data[np.repeat(self.begins[ids] - (through - sizes), sizes) + np.arange(through[-1] if len(through) else 0)]


def _byte_level(token: str) -> bytes:
    """Byte-level BPE writes printable bytes as themselves, and the others as the characters from 256 on, in order."""
    return bytes(_BYTE_OF[c] for c in token)


_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class PairTokenizer:
    """Ids of a space and a text by a byte-level tokenizer (A), and of the text by a sentencepiece model that adds the
    space (B). Strings of special tokens are plain text.

    Texts are cut before spaces that follow a character other than white space: no pre-token of A and no piece of B goes across.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        added = set(self.a.get_added_tokens_decoder())
        self.bytes_a = _Vocabulary({i: t.encode() if i in added else _byte_level(t) for t, i in self.a.get_vocab().items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        if any(_CROSSING.search(p) for p in pieces.values()):
            raise ValueError("pieces that go on beyond a cut or hold a line's end are not supported")
        self.bytes_b = _Vocabulary({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})
        self.space_b, self.line_b = self.b.encode("a ")[-1:], self.b.encode("\n")

    def encode(self, pieces: list[str]) -> tuple[list, np.ndarray]:
        """(ids, sizes) of A and of B over pieces in turn, and which pieces both give back as they were."""
        of_a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        of_b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)  # no token goes beyond a line's end
        of_b = [x or self.space_b if p[0] == " " else x[len(self.line_b) :] for p, x in zip(pieces, of_b)]
        flat = [np.fromiter(chain.from_iterable(x), np.int32) for x in (of_a, of_b)]
        sizes = [np.fromiter(map(len, x), np.int64, len(pieces)) for x in (of_a, of_b)]
        want = np.frombuffer("".join(pieces).encode(), np.uint8)
        if all(np.array_equal(v.joined(f), want) for v, f in zip((self.bytes_a, self.bytes_b), flat)):
            given = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
            lengths = [np.add.reduceat(v.sizes[f], np.cumsum(n) - n) if len(n) else n for v, f, n in zip((self.bytes_a, self.bytes_b), flat, sizes)]
            sound = (lengths[0] == given) & (lengths[1] == given)
        else:
            sound = np.array([all(b"".join(v.tokens[i] for i in x) == p.encode() for v, x in ((self.bytes_a, a), (self.bytes_b, b))) for p, a, b in zip(pieces, of_a, of_b)], bool)
        return list(zip(flat, sizes)), sound


_loaded: dict[tuple[str, str], PairTokenizer] = {}


def _pair_tokenizer(path_a: str, path_b: str) -> PairTokenizer:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = PairTokenizer(path_a, path_b)
    return _loaded[path_a, path_b]


def _parts(text: str) -> list[str]:
    """A text in parts of about ``PART`` characters, cut where pieces part."""
    out, a, cut = [], 0, re.compile(r"(?<=\S) ")
    while len(text) - a > PART:
        hit = cut.search(text, a + PART)
        if hit is None:
            break
        out.append(text[a : hit.start()])
        a = hit.start()
    return [*out, text[a:]]


def _give_back() -> None:
    """Return what this worker has freed to the system: workers live on, idle, while the JVM works."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


class _Batch:
    """Texts whose distinct pieces are numbered together."""

    def __init__(self):
        self.codes, self.times, self.rows, self.chars = {}, [], [], 0

    def add(self, row: int, doc_id, part: int, parts: int, text: str) -> None:
        codes, n = self.codes, None
        if text:
            n = np.array([codes.setdefault(p, len(codes)) for p in pieces_of(text)], np.int32)
            self.times.append(n)
            self.chars += len(text)
        self.rows.append((row, doc_id, part, parts, n))

    def close(self, number: int) -> pa.RecordBatch:
        times = np.bincount(np.concatenate([np.zeros(0, np.int32), *self.times]), minlength=len(self.codes))
        pieces = pa.StructArray.from_arrays([pa.array(list(self.codes), pa.string()), pa.array(times)], names=["piece", "n"])
        row, doc_id, part, parts, codes = zip(*self.rows)
        given = [pa.array(row, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(part, pa.int32()), pa.array(parts, pa.int32()), pa.array(codes, pa.list_(pa.int32()))]
        docs = pa.StructArray.from_arrays(given, names=["row", "doc_id", "part", "parts", "codes"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(pieces), one(docs)], names=["batch", "pieces", "docs"])


def _cut_up(docs: DataFrame) -> DataFrame:
    """A row per about ``TOGETHER`` characters: its distinct pieces and their times, and its documents, each a space and
    its text, as numbers of pieces (null: no text). Longer texts come in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 40
        held = _Batch()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                parts = _parts(" " + text if text else "")
                for k, part in enumerate(parts):
                    held.add(row, doc_id, k, len(parts), part)
                    if held.chars >= TOGETHER or len(held.rows) >= 100_000:
                        yield held.close(number)
                        held, number = _Batch(), number + 1
                row += 1
        if held.rows:
            yield held.close(number)
        del held
        _give_back()

    return docs.mapInArrow(run, _TEXTS)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _tokenised(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Ids and byte ends of (piece, n) by A and B; a piece that either does not give back as it was is not sound and has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _pair_tokenizer(path_a, path_b)
        for batch in batches:
            tokens, sound = tokenizer.encode(batch.column(0).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array(sound)]
            for (ids, sizes), vocabulary in zip(tokens, (tokenizer.bytes_a, tokenizer.bytes_b)):
                ids, sizes = ids[np.repeat(sound, sizes)], np.where(sound, sizes, 0)
                ends = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])
                columns += [_lists(ids, sizes), _lists(ends[1:] - np.repeat(ends[np.cumsum(sizes) - sizes], sizes), sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "n", "sound", "a_ids", "a_ends", "b_ids", "b_ends"])
        _give_back()

    return pieces.mapInArrow(run, _KNOWN)


_SHIFT, _B, _PLACE = 33, 1 << 32, (1 << 32) - 1  # a token in the order of ends: end, whether it is B's, place


def _merged() -> Column:
    """A's and B's tokens of a piece in one ascending order of ends; where both end, A's comes first."""
    key = lambda side: lambda e, i: F.shiftleft(e.cast("long"), _SHIFT).bitwiseOR(i.cast("long") + F.lit(side))
    return F.sort_array(F.concat(F.transform("a_ends", key(0)), F.transform("b_ends", key(_B))))


def _end(x: Column) -> Column:
    return F.shiftright(x, _SHIFT)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE)).cast("int")


def _is_b(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_B)) != 0


def _link(x: Column, j: Column) -> Column:
    """The ids, A's above B's 32 bits, that the bytes before an end of ``merged`` lie in: each such stretch is the overlap
    of one linked pair. The tokens of the other side that end before are those between. Null at B's side of a cut."""
    other = j - _place(x)
    pair = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    return (
        F.when(~_is_b(x), pair(F.get("a_ids", _place(x)), F.get("b_ids", other)))
        .when(_end(x) != F.coalesce(_end(F.get("merged", j - 1)), F.lit(-1)), pair(F.get("a_ids", other), F.get("b_ids", _place(x)))))


def _written(b: bool) -> Column:
    """One side's ids in order, each group's joined by commas, as an array of groups."""
    ids, beside = ("b_ids", -1) if b else ("a_ids", 1)
    cut = lambda x, j: F.when(_end(F.get("merged", j + beside)) == _end(x), F.lit(";")).otherwise(F.lit(","))
    one = lambda x, j: F.when(_is_b(x) == F.lit(b), F.concat(F.get(ids, _place(x)).cast("string"), cut(x, j)))
    return F.split(F.rtrim(F.array_join(F.transform("merged", one), ""), F.lit(";")), ";")


def _aligned(tokens: DataFrame) -> DataFrame:
    """Of each piece: its counts, links and groups (`a1,a2|b1;a3|b2`)."""
    held = tokens.withColumns({"cuts": F.array_intersect("a_ends", "b_ends"), "merged": _merged()})
    links = F.filter(F.transform("merged", _link), lambda x: x.isNotNull())
    groups = F.array_join(F.zip_with(_written(False), _written(True), lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    return held.select("piece", "n", "sound", F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), F.size("cuts").alias("n_groups"), links.alias("links"), groups.alias("groups"))


def _unsound_times(held: DataFrame, places: DataFrame, unsound: DataFrame) -> DataFrame:
    """(piece, n): how often pieces stand in texts that hold an unsound piece."""
    codes = places.join(unsound, "piece").groupBy("batch").agg(F.collect_set("code").alias("unsound"))
    docs = held.select("batch", F.explode("docs").alias("d")).select("batch", "d.row", "d.codes")
    rows = docs.join(codes, "batch").where(F.arrays_overlap("codes", "unsound")).select("row").distinct()
    return docs.join(rows, "row").select("batch", F.explode("codes").alias("code")).groupBy("batch", "code").agg(F.count("*").alias("times")).join(places, ["batch", "code"]).groupBy("piece").agg(F.sum("times").alias("less"))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (as long), n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A text that is null or empty, or whose tokens' bytes by A or B are not a space and the text, has no tokens: zeros
    and an empty digest. Repeated rows and null ids are rows like others; other columns play no part; an empty table
    gives no rows. Texts beyond ``PART`` characters are worked on in parts; only the string of their groups, from
    which the digest is made, stands in one row. A text without spaces is one piece.

    Texts are cut into pieces that no token crosses, so tokens, groups and links are made once for each distinct piece
    of the corpus; an id pair's count is how many links of the corpus hold it, and n_best counts links whose pair has
    the highest count of its B id. What is known of pieces then goes to the batches of texts that hold them.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    texts, at_texts = stage_at(_cut_up(narrow), "texts", arrow_rows=1000, large_rows=True)
    places, at_places = stage_at(texts.select("batch", F.posexplode("pieces").alias("code", "p")).select("batch", "code", "p.piece", "p.n"), "places")
    held = stage_at(texts.select("batch", "docs"), "documents", compression="zstd", large_rows=True)[0]
    remove(spark, at_texts)
    known, at_known = stage_at(_aligned(_tokenised(places.groupBy("piece").agg(F.sum("n").alias("n")), path_a, path_b)), "pieces", free=True)
    times = known
    unsound = known.where("not sound").select("piece")
    if not unsound.isEmpty():
        times = known.join(_unsound_times(held, places.drop("n"), unsound), "piece", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")

    counts = times.where("n > 0").select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("times"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_PLACE)))  # as many as A has ids
    pairs = stage(counts.withColumn("best", (F.col("times") == F.max("times").over(of_b)).cast("long")), "pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    scored = known.select("piece", F.explode("links").alias("pair")).join(pairs, "pair").groupBy("piece").agg(F.sum("best").alias("n_best"), F.sum("times").alias("count_sum"))
    both = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.coalesce(F.col(b), F.lit(0)).cast("long"))  # noqa: E731  two counts in one long: a batch has less than 2^31 tokens
    groups = F.when(F.col("sound"), F.col("groups"))  # null: the texts that hold the piece have no tokens
    told = known.join(scored, "piece", "left").select("piece", both("n_a", "n_b").alias("tokens"), both("n_groups", "n_best").alias("marks"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), groups.alias("groups"))
    placed = stage_at(places.select("batch", "code", "piece").join(told, "piece").select("batch", F.struct("code", "tokens", "marks", "count_sum", "groups").alias("told")), "placed", free=True, compression="zstd")[0]
    remove(spark, at_places)
    remove(spark, at_known)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * held.count(), _TASKS))  # about a batch in each
    lists = placed.repartition(tasks, "batch").groupBy("batch").agg(F.sort_array(F.collect_list("told")).alias("told"))  # as many as a batch has pieces
    keys = ["row", "doc_id", "part", "parts"]

    def doc(d: Column) -> Column:
        def summed(told: Column) -> Column:
            string = F.array_join(told["groups"], ";")
            sums = [F.aggregate(told[c], F.lit(0).cast("long"), lambda s, x: s + x).alias(c) for c in ("tokens", "marks", "count_sum")]
            return F.struct(*[d[c].alias(c) for c in keys], (~F.exists(told["groups"], lambda g: g.isNull())).alias("sound"), *sums, F.when(d["parts"] > 1, string).otherwise(F.sha2(string, 256)).alias("groups"))

        return F.get(F.transform(F.array(F.transform(d["codes"], lambda c: F.get(F.col("told"), c))), summed), F.lit(0))  # looked up once, a text at a time

    found = held.repartition(tasks, "batch").join(lists, "batch", "left").select(F.explode(F.transform("docs", doc)).alias("d")).select("d.*").withColumn("sound", F.coalesce("sound", F.lit(False)))
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(_PLACE)))
    found = found.select("row", "doc_id", "part", "parts", "sound", high("tokens").alias("n_a"), low("tokens").alias("n_b"), high("marks").alias("n_groups"), low("marks").alias("n_best"), "count_sum", "groups")
    strings = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "groups"))), lambda x: x["groups"]), ";")  # the digest, or the parts' texts
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.bool_and("sound").alias("sound"), *[F.sum(c).alias(c) for c in _SUMS], F.max("parts").alias("parts"), strings.alias("groups"))
    every = whole.withColumns({"groups": F.when(F.col("parts") > 1, F.sha2("groups", 256)).otherwise(F.col("groups")), "n_links": F.col("n_a") + F.col("n_b") - F.col("n_groups")})
    return every.select("doc_id", *[F.when(F.col("sound"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.when(F.col("sound"), F.col("groups")).otherwise(F.lit("")).alias("groups_sha256"))
