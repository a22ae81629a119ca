"""Line dedup: winnowing over line hashes, joined positions, matches extended both ways, later runs deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.staging import free_prefix, stage, stage_at

#: Words that a repeated run of whole lines must have to be deleted, and words of the grams that are winnowed.
RUN_WORDS, GRAM_WORDS = 50, 20

#: Documents that go to a Python worker at a time where their lines go with them.
_ROWS = 500
_MIX, _LOW = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def line_marks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of 128 bits, as two numbers, and a number of words for every line: lines part at newlines, words at ASCII
    white space; how words are spaced does not matter. Lines without words have hash 0."""
    lines = [x.split() for x in (text or "").encode().split(b"\n")]
    whole = [xxhash.xxh3_128_intdigest(b" ".join(x)) if x else 0 for x in lines]
    hashes, more = np.array([h & _LOW for h in whole], np.uint64), np.array([h >> 64 for h in whole], np.uint64)
    return hashes, more, np.fromiter(map(len, lines), np.int64, len(lines))


def _ends(words: np.ndarray, least: int) -> np.ndarray:
    """For each start the index after the shortest run from it with ``least`` words; 0 where there is none."""
    through = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(through, through[:-1] + least, side="left")
    return np.where(ends < len(through), ends, 0)


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of lines: its hashes folded in order."""
    code = (ends - starts).astype(np.uint64)
    for k in range(int((ends - starts).max(initial=0))):
        live = starts + k < ends
        at = np.minimum(starts + k, len(hashes) - 1)
        step = (code ^ hashes[at]) * _MIX
        code = np.where(live, step ^ (step >> np.uint64(32)), code)
    return code


def runs(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest runs with ``least`` words, over the lines that have words, as
    positions among these."""
    full = np.flatnonzero(words)
    ends = _ends(words[full], least)
    starts = np.flatnonzero(ends)
    return starts, ends[starts], _run_hashes(hashes[full], starts, ends[starts])


def ending_runs(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the shortest runs with ``least`` words that end at each line, without those of ``runs``."""
    full = np.flatnonzero(words)
    through = np.concatenate(([0], np.cumsum(words[full])))
    ends = np.flatnonzero(through >= max(least, 1))
    starts = np.searchsorted(through, through[ends] - least, side="right") - 1
    new = _ends(words[full], least)[starts] != ends
    starts, ends = starts[new], ends[new]
    return starts, ends, _run_hashes(hashes[full], starts, ends)


def winnow(hashes: np.ndarray, words: np.ndarray, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a document and their positions (among the lines that have words): of the grams inside each
    window, the shortest run with ``run_words`` words from a line on, the smallest hash, the first of equals.

    What a window holds depends on its lines alone, so two documents that share a run of ``run_words`` words or
    more share a fingerprint inside each window of the run.
    """
    starts, ends, codes = runs(hashes, words, gram_words)
    window_ends = _ends(words[np.flatnonzero(words)], run_words)
    last = np.searchsorted(ends, window_ends, side="right")  # grams that end inside
    chosen = set()
    for s in np.flatnonzero(window_ends).tolist():
        a = np.searchsorted(starts, s)
        if last[s] > a:
            chosen.add(int(a + codes[a : last[s]].argmin()))
    chosen = np.array(sorted(chosen), np.int64)
    return codes[chosen], starts[chosen]


def _lists(values: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _marks(docs: DataFrame, run_words: int, gram_words: int) -> DataFrame:
    """One row per (id, text): hashes and words of its lines, and its fingerprints with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], [], []]
            for t in batch.column(2):
                hashes, more, words = line_marks(t.as_py())
                prints, at = winnow(hashes, words, run_words, gram_words)
                for held, x in zip(columns, (hashes.view(np.int64), more.view(np.int64), words, prints.view(np.int64), at)):
                    held.append(x)
            yield pa.record_batch([batch.column(0), batch.column(1), *map(_lists, columns)], names=["id", "key", "hashes", "more", "words", "prints", "places"])

    found = docs.mapInArrow(run, "id long, key long, hashes array<long>, more array<long>, words array<long>, prints array<long>, places array<long>")
    return stage(found, "line-marks")


def _around(places: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, gram_words: int) -> np.ndarray:
    """Which runs of lines hold one of the grams at ``places`` (sorted), all as positions among lines with words."""
    reach = _ends(words, gram_words)[places]
    at = np.searchsorted(places, starts)
    return (at < len(places)) & (np.append(reach, 0)[at] <= ends) & (np.append(reach, 0)[at] > 0)


def _seeds(shared: DataFrame, run_words: int, gram_words: int) -> DataFrame:
    """(code, id, key, first, end): every shortest run of ``run_words`` words (from a line on, or up to a line) around
    each shared position, as positions among the lines that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for i, key, h, w, p in zip(*(batch.column(k) for k in range(5))):
                words = w.values.to_numpy()
                hashes = h.values.to_numpy().view(np.uint64)
                both = (runs(hashes, words, run_words), ending_runs(hashes, words, run_words))
                starts, ends, codes = (np.concatenate(x) for x in zip(*both))
                near = _around(np.sort(p.values.to_numpy()), words[words > 0], starts, ends, gram_words)
                starts, ends = starts[near], ends[near]
                for part, values in zip(out, (codes[near].view(np.int64), [i.as_py()] * len(starts), np.full(len(starts), key.as_py()), starts, ends)):
                    part.append(pa.array(values, pa.int64()))
            if out[0]:
                yield pa.record_batch([pa.concat_arrays(x) for x in out], names=["code", "id", "key", "first", "end"])

    return shared.select("id", "key", "hashes", "words", "places").mapInArrow(run, "code long, id long, key long, first long, end long")


def extended(own: np.ndarray, other: np.ndarray, begin: int, seeds: np.ndarray) -> list[tuple[int, int]]:
    """Seeds (first, end, first in the other document) extended line by line both ways while the lines agree.

    ``own`` and ``other`` are the lines' hashes, (lines, 2); ``other`` begins at its document's line ``begin``. Gives
    the matches (first, end), each once; a seed whose lines do not agree gives none.
    """
    out: list[tuple[int, int]] = []
    reached: dict[int, int] = {}  # of each diagonal, where its last match ends
    for first, end, there in seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist():
        shift = there - first
        if end <= reached.get(shift, 0):
            continue
        a, b = first, end
        at = lambda k, shift=shift: k + shift - begin
        if at(a) < 0 or at(b) > len(other) or not np.array_equal(own[a:b], other[at(a) : at(b)]):
            continue
        while a > 0 and at(a) > 0 and (own[a - 1] == other[at(a) - 1]).all():
            a -= 1
        while b < len(own) and at(b) < len(other) and (own[b] == other[at(b)]).all():
            b += 1
        reached[shift] = b
        out.append((a, b))
    return out


def _matches(later: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, key, first, end, origin): positions of later documents paired with those of ``origin``, extended line by line
    on both documents' lines; first and end are places among all lines. Of the origin only as many lines come as the
    later document can match."""
    lines = lambda d: F.filter(F.arrays_zip("hashes", "more", "words"), lambda x: x["words"] > 0).alias(d)
    same = lambda a, b: F.col(f"{a}_id").eqNullSafe(F.col(f"{b}_id")) & (F.col(f"{a}_key") == F.col(f"{b}_key"))
    seeds = later.groupBy("id", "key", F.col("origin.id").alias("o_id"), F.col("origin.key").alias("o_key")).agg(F.collect_list(F.struct("first", "end", F.col("origin.first").alias("there"))).alias("seeds"))
    seeds = stage(seeds.withColumnsRenamed({"id": "l_id", "key": "l_key"}), "line-pairs")
    own = marks.select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "hashes", "more", "words")
    once = lambda side: own.join(seeds.select(f"{side}_id", f"{side}_key").distinct(), same("m", side), "left_semi").dropDuplicates(["m_id", "m_key"])  # noqa: E731  of rows equal in id and text one
    theirs = once("o").select(F.col("m_id").alias("t_id"), F.col("m_key").alias("t_key"), lines("other"))
    paired = seeds.join(theirs, same("o", "t"))
    begin = F.greatest(F.lit(0), F.array_min(F.transform("seeds", lambda s: s["there"] - s["first"])))
    until = F.array_max(F.transform("seeds", lambda s: s["there"] - s["first"])) + F.col("m_n")
    sized = paired.join(once("l").withColumn("m_n", F.size(F.filter("words", lambda x: x > 0))), same("l", "m"))
    sliced = sized.withColumns({"begin": begin.cast("int"), "until": F.least(until, F.size("other").cast("long")).cast("int")})
    pair = F.slice("other", F.col("begin") + 1, F.greatest(F.lit(0), F.col("until") - F.col("begin")))
    rows = sliced.select("l_id", "l_key", "o_id", "hashes", "more", "words", "begin", F.transform(pair, lambda x: x["hashes"]).alias("a"), F.transform(pair, lambda x: x["more"]).alias("b"), *[F.col(f"seeds.{c}").cast("array<long>").alias(f"s_{c}") for c in ("first", "end", "there")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                i, key, origin, begin = (batch.column(c)[at].as_py() for c in (0, 1, 2, 6))
                hashes, more, words, a, b, *seeds = (batch.column(c)[at].values.to_numpy() for c in (3, 4, 5, 7, 8, 9, 10, 11))
                full = np.flatnonzero(words)
                for first, end in extended(np.stack([hashes[full], more[full]], axis=1), np.stack([a, b], axis=1), begin, np.stack(seeds, axis=1)):
                    out.append((i, key, int(full[first]), int(full[end - 1]) + 1, origin))
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "key", "first", "end", "origin_id"])

    return rows.mapInArrow(run, "id long, key long, first long, end long, origin_id long")


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(id, key, runs) of the documents ``docs(id, key, text)`` that repeat earlier runs; runs holds (first, end) of
    lines, fused where they meet.

    1. Every document is winnowed: (fingerprint, id, position) of the smallest gram of each window.
    2. Positions meet by fingerprint; those whose fingerprint stands at one position only go.
    3. Around a shared position stand the shortest runs of ``run_words`` words that hold it. Runs that agree by a hash
       are paired with the first of them (ids in order, null last; then position).
    4. A pair is extended line by line both ways on the lines of both documents, which must agree in 128 bits each.
    5. Matches that overlap fuse: each line of a repeated run stands in the shortest run from it, in that up to it, or in
       that from the run's first line, and each of these holds a shared fingerprint. Whichever earlier documents have
       parts of it, the match goes as far as any of them does.
    Counts and minima combine before the shuffle, so a passage in a third of all documents is one row per task.
    """
    marks = _marks(docs.select("id", "key", "text"), run_words, gram_words)
    positions = marks.select("id", "key", F.explode(F.arrays_zip("prints", "places")).alias("p")).select("id", "key", F.col("p.prints").alias("print"), F.col("p.places").alias("at"))
    shared = positions.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    shared = stage(shared, "line-prints")  # a table of one row per fingerprint: rows of a frequent one may then be split
    met = positions.join(shared, "print").groupBy(F.col("id").alias("t_id"), F.col("key").alias("t_key")).agg(F.collect_set("at").alias("places"))
    touched = marks.drop("prints", "places").join(met, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("key") == F.col("t_key")))
    grid = stage_at(_seeds(touched, run_words, gram_words), "line-runs", arrow_rows=_ROWS)[0]
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "first")
    firsts = grid.groupBy("code").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").select("code", "origin")
    firsts = stage(firsts, "line-firsts")
    later = grid.join(firsts, "code").where(place != F.col("origin"))
    return _fused(stage_at(_matches(later, marks), "line-matches", arrow_rows=_ROWS)[0])


def _fused(later: DataFrame) -> DataFrame:
    """Marked (first, end) of a document fused to maximal runs, with the document that holds the first of each."""
    own = Window.partitionBy("id", "key").orderBy("first", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("starts", (F.col("first") > F.coalesce(reached, F.lit(-1))).cast("int"))
    islands = islands.withColumn("island", F.sum("starts").over(own))
    fused = islands.groupBy("id", "key", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min_by("origin_id", F.struct("first", "end")).alias("origin_id"))
    run = F.struct("first", "end", "origin_id")
    return fused.groupBy("id", "key").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS, doc_id: str = "doc_id", text: str = "text", prefix: str = "line_", report: bool = True) -> DataFrame:
    """Rows of ``docs``, all columns, with the text cleaned, and with ``report`` ``{prefix}runs`` (first, end,
    origin_id; empty where nothing goes), ``{prefix}count`` and ``{prefix}removed`` (lines before, lines deleted).
    A column n_chars, where there is one, follows the text it counts.

    A run is deleted when it is made of whole lines with ``run_words`` words or more in all and the same lines stand
    earlier: in a document of smaller id (null last; then by a hash of the text), or before in the same document.
    Lines compare by their words; blank lines inside a deleted run go with it, and shorter repeats stay. Rows equal
    in id and text are one document and keep the same lines. A null text stays null, with 0 lines. A document of
    which all goes keeps its row with an empty text. Empty table: no rows.
    """
    p, prefix = free_prefix(docs, "__line_"), free_prefix(docs, prefix)
    keyed = docs.withColumns({p + "id": F.col(doc_id).cast("long"), p + "key": F.xxhash64(text)})
    found = repeated_runs(keyed.where(F.col(text).isNotNull()).select(F.col(p + "id").alias("id"), F.col(p + "key").alias("key"), F.col(text).alias("text")), run_words, gram_words)
    found = found.select(F.col("id").alias(p + "i"), F.col("key").alias(p + "k"), F.col("runs").alias(p + "runs"))
    joined = keyed.join(found.hint("shuffle_hash"), F.col(p + "id").eqNullSafe(F.col(p + "i")) & (F.col(p + "key") == F.col(p + "k")), "left")
    hit = F.col(p + "runs").isNotNull()
    outside = F.filter(F.split(F.col(text), "\n", -1), lambda x, at: ~F.exists(p + "runs", lambda r: (at >= r["first"]) & (at < r["end"])))
    cleaned = joined.withColumns({p + "kept": F.when(hit, outside), p + "count": F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)})
    removed = F.when(hit, F.col(p + "count") - F.size(p + "kept")).otherwise(0).cast("long")
    new = {text: F.when(hit, F.array_join(p + "kept", "\n")).otherwise(F.col(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(F.array_join(p + "kept", "\n"))).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    kept = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    if not report:
        return cleaned.select(*kept)
    runs_of = F.coalesce(p + "runs", F.array().cast("array<struct<first:bigint,end:bigint,origin_id:bigint>>"))
    return cleaned.select(*kept, runs_of.alias(prefix + "runs"), F.col(p + "count").cast("long").alias(prefix + "count"), removed.alias(prefix + "removed"))
