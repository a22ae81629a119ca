"""Quality classifier: a linear-chain conditional random field labels every line good or bad; length-weighted
forward-backward marginals aggregate into the document's quality."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.langid import remainder
from noticeflow.llm.staging import stage

#: Labelled documents of each label (expected) that teach the model, and steps of its training.
SAMPLE_PER_LABEL, STEPS, ROUNDS = 2000, 120, 3
#: Lines of a chain that teaches (longer documents teach as several chains), of a step of the training, and of a sample
#: that is held between steps and not read again.
CHAIN_LINES, STEP_LINES, HELD_LINES = 2000, 60_000, 300_000
#: A document is good from this score on.
THRESHOLD = 0.3
#: Lines whose marginals are computed together, and lines from which on a document is computed in blocks.
_TOGETHER, _LONG = 60_000, 5_000

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_PUNCT, _SPACE, _HIGH = b".,;:?'\"-()", b" \t\n\v\f\r", bytes(range(128, 256))
_CLASSES = (_UPPER, _DIGIT, b"|", b"!", _PUNCT, _UPPER + _LOWER + _HIGH + _DIGIT + _PUNCT + _SPACE + b"|!")
OWN = ("upper", "digit", "pipe", "shout", "punct", "symbol", "repeated", "doubled", "long_words", "short_words", "few_words", "many_words", "ends", "starts", "again", "markup")
BESIDE = ("upper", "pipe", "shout", "symbol", "repeated", "doubled", "markup")
FEATURES = ("bias", *OWN, *(f"before_{x}" for x in BESIDE), "is_first", *(f"after_{x}" for x in BESIDE), "is_last")
_BESIDE_AT = [OWN.index(x) for x in BESIDE]


def _line(b: bytes, times: int) -> tuple[float, ...]:
    words = b.split()
    n, size = len(words), len(b)
    upper, digit, pipe, shout, punct, known = (size - len(b.translate(None, x)) for x in _CLASSES)
    symbol = size - known
    mean = (size - n + 1) / n
    doubled = sum(map(bytes.__eq__, words, words[1:])) / n
    return (
        upper / size, digit / size, 4 * pipe / size, 10 * shout / size, punct / size, 4 * symbol / size, 1 - len(set(words)) / n, doubled,
        min(2.0, max(0.0, mean - 8) / 4), min(2.0, max(0.0, 4 - mean)), float(n <= 3), min(2.0, n / 100), float(b[-1:] in b".?!\"'"), float(b[:1] in _UPPER),
        min(2.0, np.log(times)), float(b[:1] in b"<{[#" or b"://" in b))


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths in bytes of the lines that have words; a text without any is one empty line."""
    lines = [x.strip() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]
    lines = [x for x in lines if x]
    out = np.zeros((max(1, len(lines)), len(FEATURES)), np.float32)
    out[:, 0] = 1.0
    if lines:
        times = Counter(lines)
        a, b = 1 + len(OWN), len(BESIDE)
        for k in range(0, len(lines), 4096):
            out[k : k + 4096, 1:a] = [_line(x, times[x]) for x in lines[k : k + 4096]]
        beside = out[:, 1:a][:, _BESIDE_AT]
        out[1:, a : a + b] = beside[:-1]
        out[:-1, a + b + 1 : a + 2 * b + 1] = beside[1:]
    out[0, FEATURES.index("is_first")] = out[-1, FEATURES.index("is_last")] = 1.0
    return out, np.array([len(x) for x in lines] or [1], np.float64)


def marginals(emission: np.ndarray, sizes: np.ndarray, moves: np.ndarray, with_steps: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many documents at once.

    ``emission`` (documents, lines) scores a line as good against bad, ``moves`` (2, 2) a step from label to label
    (bad 0, good 1). Gives the chance of good for every line, the expected steps of each kind per document (zeros
    unless ``with_steps``), and the log of the sum over all labellings.
    """
    docs, longest = emission.shape
    scores = np.stack([np.zeros_like(emission), emission], axis=2)
    forward, backward = np.zeros((docs, longest, 2)), np.zeros((docs, longest, 2))
    forward[:, 0] = scores[:, 0]
    for t in range(1, longest):
        on = sizes > t
        forward[on, t] = np.logaddexp(forward[on, t - 1, 0, None] + moves[0], forward[on, t - 1, 1, None] + moves[1]) + scores[on, t]
    for t in range(longest - 2, -1, -1):
        on = sizes > t + 1
        ahead = backward[on, t + 1] + scores[on, t + 1]
        backward[on, t] = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
    last = forward[np.arange(docs), sizes - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    good[np.arange(longest)[None, :] >= sizes[:, None]] = 0.0
    steps = np.zeros((docs, 2, 2))
    if longest > 1 and with_steps:
        inner = forward[:, :-1, :, None] + moves + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        inner[np.arange(1, longest)[None, :] >= sizes[:, None]] = -np.inf
        steps = np.exp(inner).sum(axis=1)
    return np.clip(good, 0.0, 1.0), steps, total


def _messages(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward messages of one long chain ``scores`` (lines, 2), each up to a constant: blocks run side by side from
    either label before them, then the blocks are gone through in order."""
    n = len(scores)
    size = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // size)
    held = np.zeros((blocks * size, 2))
    held[:n] = scores
    held = held.reshape(blocks, size, 2)
    out = np.empty((blocks, 2, size, 2))  # by the label before the block
    out[:, :, 0] = moves + held[:, None, 0]
    out[0, :, 0] = held[0, 0]
    for t in range(1, size):
        out[:, :, t] = np.logaddexp(out[:, :, t - 1, 0, None] + moves[0], out[:, :, t - 1, 1, None] + moves[1]) + held[:, None, t]
    whole, last = np.empty((blocks, size, 2)), np.zeros(2)
    for b in range(blocks):
        whole[b] = np.logaddexp(last[0] + out[b, 0], last[1] + out[b, 1])
        last = whole[b, -1] - whole[b, -1].max()
    return whole.reshape(-1, 2)[:n]


def long_marginals(emission: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``marginals`` of one long document: each line's chance of being good."""
    scores = np.stack([np.zeros_like(emission), emission], axis=1)
    both = _messages(scores, moves) + _messages(scores[::-1], moves.T)[::-1] - scores
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))


def _blocks(sizes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Numbers of documents in groups of about equal sizes, of which none has more than ``cells`` lines when its
    documents are filled up to the longest (or it is one document)."""
    order, a = np.argsort(sizes, kind="stable"), 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * sizes[order[b]] <= cells:
            b += 1
        yield order[a:b]
        a = b


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), sizes.max(), *rows[0].shape[1:]), rows[0].dtype)
    for row, x in zip(out, rows):
        row[: len(x)] = x
    return out, sizes


class Chain(NamedTuple):
    """Lines of a document that teach: the document's number and how many lines it has in all."""

    doc: int
    features: np.ndarray
    lengths: np.ndarray
    total: int


@dataclass
class LineModel:
    """Weights of a line's features, scores of steps between labels, and the scale that turns quality to a chance."""

    weights: np.ndarray
    moves: np.ndarray
    scale: tuple[float, float]

    def emission(self, features: np.ndarray) -> np.ndarray:
        return (features @ self.weights).astype(np.float64)

    def line_chances(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Each line's chance of being good."""
        out: list = [None] * len(emissions)
        for part in _blocks(np.array([len(x) for x in emissions], np.int64), _TOGETHER):
            if len(part) == 1 and len(emissions[part[0]]) > _LONG:
                out[part[0]] = long_marginals(emissions[part[0]], self.moves)
                continue
            padded, sizes = _padded([emissions[i] for i in part])
            good, _, _ = marginals(padded, sizes, self.moves, with_steps=False)
            for i, row, n in zip(part, good, sizes):
                out[i] = row[:n]
        return out

    def quality(self, emissions: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean of the lines' chances."""
        return np.array([(g * w).sum() / w.sum() for g, w in zip(self.line_chances(emissions), lengths)])

    def score(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(quality, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.scale[0] + self.scale[1] * np.log(q / (1 - q)))))


class _Passes:
    """Steps of a sample (lists of chains), in the same order each time; a small sample is read once only."""

    def __init__(self, read: Callable[[], Iterable[Chain]]):
        self.read, self.held = read, None

    def __iter__(self) -> Iterator[list[Chain]]:
        if self.held is not None:
            yield from self.held
            return
        held, part, lines, seen = [], [], 0, 0
        for chain in self.read():
            if part and lines + len(chain.features) > STEP_LINES:
                yield part
                held, part, lines = [*held, part] if seen <= HELD_LINES else [], [], 0
            part.append(chain)
            lines += len(chain.features)
            seen += len(chain.features)
        if part:
            yield part
        if seen <= HELD_LINES:
            self.held = [*held, part] if part else held


def _ascent(part: list[Chain], labels: list[np.ndarray], share: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Gradient of the weighted likelihood of lines' labels; each document weighs its share."""
    g, whole = np.zeros(weights.size + 4), 0.0
    for block in _blocks(np.array([len(x) for x in labels], np.int64), _TOGETHER):
        x, sizes = _padded([part[i].features for i in block])
        y, _ = _padded([labels[i].astype(np.float64) for i in block])
        own = np.array([share[part[i].doc] / part[i].total for i in block])
        good, moved, _ = marginals((x @ weights).astype(np.float64), sizes, moves)
        live = np.arange(1, x.shape[1])[None, :] < sizes[:, None]
        seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & live).sum(axis=1) for b in (0, 1)] for a in (0, 1)]).transpose(2, 0, 1)
        g[:-4] += np.einsum("dt,dtf->f", (y - good) * own[:, None], x)
        g[-4:] += ((seen - moved) * own[:, None, None]).sum(axis=0).ravel()
        whole += (own * sizes).sum()
    return g / whole


def train_lines(read: Callable[[], Iterable[Chain]], good: np.ndarray, prior: float, rounds: int = ROUNDS, steps: int = STEPS) -> LineModel:
    """A model from documents marked good or bad. ``read()`` gives all their chains, each time in the same order.

    Lines begin with their document's label. After each round the lines of bad documents are labelled anew by the
    model: those held for good count as good, but the worst line of a bad document stays bad. ``prior`` is the share
    of good documents, to which the sample's weights are set. A round goes over all lines at least once, and takes
    ``steps`` steps of at most ``STEP_LINES`` lines or more; between steps a byte is kept for each line.
    """
    passes = _Passes(read)
    balanced = np.where(good == 1, 0.5 / max(1, (good == 1).sum()), 0.5 / max(1, (good == 0).sum()))
    labels = [np.full(len(c.features), good[c.doc], np.uint8) for part in passes for c in part]
    p, size = np.zeros(len(FEATURES) + 4), len(FEATURES)
    model = LineModel(p[:size], p[size:].reshape(2, 2), (0.0, 1.0))
    for _ in range(rounds):
        m, v, step = np.zeros_like(p), np.zeros_like(p), 0
        while step < steps:  # gradient ascent (Adam), with a small squared penalty
            at = 0
            for part in passes:
                step += 1
                g = _ascent(part, labels[at : at + len(part)], balanced, p[:size], p[size:].reshape(2, 2)) - 1e-4 * p
                at += len(part)
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                p = p + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model = LineModel(p[:size], p[size:].reshape(2, 2), (0.0, 1.0))
        labels, worst = [], {}
        sums, weights = np.zeros(len(good)), np.zeros(len(good))
        for part in passes:
            for c, chance in zip(part, model.line_chances([model.emission(c.features) for c in part])):
                sums[c.doc] += (chance * c.lengths).sum()
                weights[c.doc] += c.lengths.sum()
                if good[c.doc]:
                    labels.append(np.ones(len(chance), np.uint8))
                    continue
                k = int(chance.argmin())
                worst[c.doc] = min(worst.get(c.doc, (2.0, 0, 0)), (chance[k], len(labels), k))
                labels.append((chance > 0.5).astype(np.uint8))
        for _, chain, k in worst.values():
            labels[chain][k] = 0
    q = np.clip(sums / np.maximum(weights, 1e-12), 1e-4, 1 - 1e-4)
    weight = np.where(good == 1, prior / max(1, (good == 1).sum()), (1 - prior) / max(1, (good == 0).sum()))
    model.scale = _logistic(np.log(q / (1 - q)), good, weight)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of ``y`` on ``x`` by Newton's method, slightly penalised."""
    a, b = 0.0, 1.0
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(weight * (y - p)).sum() - 1e-3 * a, (weight * (y - p) * x).sum() - 1e-3 * (b - 1)])
        s = weight * p * (1 - p)
        h = np.array([[s.sum() + 1e-3, (s * x).sum()], [(s * x).sum(), (s * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, max(b, 1e-3)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL, seed: int = 41) -> LineModel:
    """A model from the labelled documents whose crc32(id as text) mod 5 is not 0.

    About ``sample_per_label`` documents of each label teach it (expected, by a seeded hash of the id), with all their
    lines; the shares of the labels are counted over all. The sample's ids are bounded so, which lets them be
    broadcast; its lines are staged in chains of ``CHAIN_LINES`` in the order of a hash, and the driver reads a step at
    a time. Null labels and texts teach nothing. Without labelled documents every score is one half or near it.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("good")).where("id is not null and good in (0, 1)").where(remainder(F.col("id"), 5) != 0)
    counts = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("good") == k, min(1.0, sample_per_label / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    picked = marks.withColumn("share", share).where(place < F.col("share"))
    taught = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(picked), "id").select("id", "text", "good")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text, good in zip(pdf["id"], pdf["text"], pdf["good"]):
                features, lengths = line_features(text)
                for k in range(0, len(lengths), CHAIN_LINES):
                    part = slice(k, k + CHAIN_LINES)
                    yield pd.DataFrame({"id": [str(i)], "good": [good], "chain": [k // CHAIN_LINES], "total": [len(lengths)], "f": [features[part].tobytes()], "w": [lengths[part].tobytes()]})

    chains = taught.mapInPandas(run, "id string, good int, chain int, total long, f binary, w binary").orderBy(F.xxhash64(F.lit(seed), "id", "chain"), "id", "good", "chain", "f")
    sample = stage(chains, "lines")
    docs_of = {(r["id"], r["good"]): k for k, r in enumerate(sample.select("id", "good").distinct().orderBy("id", "good").collect())}  # as many as the sample has documents
    if not docs_of:
        return LineModel(np.zeros(len(FEATURES)), np.zeros((2, 2)), (0.0, 1.0))

    def read() -> Iterator[Chain]:
        for r in sample.toLocalIterator(prefetchPartitions=True):
            yield Chain(docs_of[r["id"], r["good"]], np.frombuffer(r["f"], np.float32).reshape(-1, len(FEATURES)), np.frombuffer(r["w"], np.float64), r["total"])

    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return train_lines(read, np.array([g for _, g in docs_of], np.int64), min(0.99, max(0.01, prior)))


def score_column(model: LineModel, docs: DataFrame, text: str = "text") -> Column:
    """Each text's score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, out, emissions, lengths, lines = shared.value, [], [], [], 0
        for text in texts:
            features, sizes = line_features(text)
            emissions.append(model.emission(features))
            lengths.append(sizes)
            lines += len(sizes)
            if lines >= _TOGETHER:
                out.append(model.score(model.quality(emissions, lengths)))
                emissions, lengths, lines = [], [], 0
        return pd.Series(np.concatenate([np.zeros(0), *out, model.score(model.quality(emissions, lengths)) if emissions else np.zeros(0)]))

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", model: LineModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out and teach nothing. A text that is null or has no words
    is one empty line and is scored as such. Texts of any length are scored whole: about ``_TOGETHER`` lines are held
    at a time, or one text's. Repeated rows are scored each time. A null id is not held out. Empty table: no rows.
    Other columns play no part.
    """
    model = model or train(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), 5) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    scored = rows.withColumn("score", score_column(model, rows))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", model: LineModel | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is at least the threshold."""
    model = model or train(docs, labels, doc_id, text)
    return docs.where(score_column(model, docs, text) >= THRESHOLD)
