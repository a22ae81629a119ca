"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling reads windows of words, each given by
its word and its characters; trained in numpy, it scores all overlapping windows of a text, and the worst one decides."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.langid import remainder
from noticeflow.llm.staging import stage

#: Labelled documents (expected) that teach the model, clean and toxic ones; passes over their windows, windows of a
#: training step, and its rate, which falls from pass to pass.
SAMPLE, EPOCHS, STEP, RATE = (2500, 1000), 3, 128, 0.03
#: A document is toxic from this score on.
THRESHOLD = 0.7
#: Words of a window, and from one window's start to the next's.
WINDOW, STRIDE = 32, 24
#: Longest word; longer ones are several.
_LONGEST = 24
_WORD = re.compile(rf"\w{{1,{_LONGEST}}}")
_BREAK = re.compile(r"\W")
#: Buckets of words and of 3- to 5-grams of characters, and the widths of their vectors, of a state and of the attention.
BUCKETS, GRAMS, WORD_DIM, CHAR_DIM, STATE, ATTENTION = 1 << 15, (3, 4, 5), 8, 16, 12, 8
#: Characters of a text whose words are listed together, and words that are scored together.
_CHUNK, _BLOCK = 1_000_000, 400_000


# --- words and windows


def word_chunks(text: str | None) -> Iterator[list[str]]:
    """The lower-cased words of a text in turn, some hundred thousand at a time; a word said again and again counts once."""
    text, a, last = text or "", 0, None
    while a < len(text):
        hit = _BREAK.search(text, a + _CHUNK, a + 2 * _CHUNK)  # a word beyond that is cut
        b = hit.start() if hit else a + 2 * _CHUNK
        words = _WORD.findall(text[a:b].lower())
        yield [w for w, before in zip(words, [last, *words]) if w != before]
        a, last = b, words[-1] if words else last


def windows(text: str | None) -> Iterator[list[str]]:
    """Windows of ``WINDOW`` words, one every ``STRIDE``; the last one ends with the text. A shorter text is one window,
    filled up with empty words."""
    held, start, found = [], 0, False  # start: of the next window, in held
    for words in word_chunks(text):
        held += words
        while start + WINDOW <= len(held):
            yield held[start : start + WINDOW]
            start, found = start + STRIDE, True
        cut = max(0, min(start, len(held) - WINDOW))
        held, start = held[cut:], start - cut
    if not found:
        yield held + [""] * (WINDOW - len(held))
    elif start + WINDOW - STRIDE < len(held):
        yield held[-WINDOW:]


def word_ids(blocks: Iterable[list[str]]) -> tuple[np.ndarray, list[str]]:
    """Windows as numbers of distinct words, and those words."""
    known: dict[str, int] = {}
    ids = np.array([[known.setdefault(w, len(known)) for w in x] for x in blocks], np.int32).reshape(-1, WINDOW)
    return ids, list(known)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket; the buckets of the character grams of all words in turn, with marks at both ends; and how
    many each word has."""
    marked = [f"\x02{w}\x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), sizes)
    grams, owners, running = [], [], points.copy()
    for n in range(2, max(GRAMS) + 1):
        running = running[:-1] * np.uint64(1_000_003) + points[n - 1 :]
        if n in GRAMS:
            inside = owner[: len(running)] == owner[n - 1 :]
            grams.append(_mixed(running[inside] + np.uint64(n)))
            owners.append(owner[: len(running)][inside])
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners, kind="stable")
    powers = np.cumprod(np.full(_LONGEST + 2, 1_000_003, np.uint64)) if len(words) else np.zeros(0, np.uint64)
    begins = np.cumsum(sizes) - sizes
    whole = np.add.reduceat(points * powers[np.arange(len(points)) - np.repeat(begins, sizes)], begins) if len(words) else np.zeros(0, np.uint64)
    return _mixed(whole), grams[order], np.bincount(owners, minlength=len(words))


# --- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(rows: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Sums of ``rows`` by the numbers ``at``."""
    order = np.argsort(at, kind="stable")
    found, begins = np.unique(at[order], return_index=True)
    out = np.zeros((count, rows.shape[1]), np.float32)
    out[found] = np.add.reduceat(rows[order], begins, axis=0)
    return out


@dataclass
class Network:
    """Parameters by name, and the scale (a, b) that turns a document's largest logit x to the chance of a + b x."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (0.0, 1.0)

    @staticmethod
    def new(seed: int = 13) -> Network:
        r = np.random.default_rng(seed)
        size, h = WORD_DIM + CHAR_DIM, STATE
        shapes = {"words": ((BUCKETS, WORD_DIM), 0.1), "grams": ((BUCKETS, CHAR_DIM), 0.3), "input": ((2, size, 3 * h), 0.3), "bias": ((2, 1, 3 * h), 0.0), "state": ((2, h, 3 * h), 0.25), "look": ((2 * h, ATTENTION), 0.3), "look_bias": ((ATTENTION,), 0.0), "weigh": ((ATTENTION,), 0.5), "out": ((2 * h,), 0.3), "out_bias": ((1,), 0.0)}
        return Network({k: (r.standard_normal(s) * w).astype(np.float32) for k, (s, w) in shapes.items()})

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Vectors of distinct words: the word's, and the mean of its grams'."""
        own, grams, counts = features
        out = np.zeros((len(own), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["words"][own]
        begins = np.cumsum(counts) - counts
        for k in range(0, len(own), 50_000):  # some at a time: a gram's vector takes 64 bytes
            part = slice(k, k + 50_000)
            some, n = np.flatnonzero(counts[part]) + k, counts[part][counts[part] > 0]
            if len(some):
                vectors = self.p["grams"][grams[begins[some[0]] : begins[some[-1]] + n[-1]]]
                out[some, WORD_DIM:] = np.add.reduceat(vectors, begins[some] - begins[some[0]], axis=0) / n[:, None]
        return out

    def forward(self, given: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows. ``given``: of every distinct word, what it adds to the gates of both directions."""
        h, count, (b, steps) = STATE, ids.shape[0], ids.shape
        state, states = np.zeros((2, b, h), np.float32), np.empty((2, steps, b, h), np.float32)
        for t in range(steps):
            x = np.stack([given[0][ids[:, t]], given[1][ids[:, steps - 1 - t]]])
            g = state @ self.p["state"]
            gates = _sigmoid(x[:, :, : 2 * h] + g[:, :, : 2 * h])
            z, r = gates[:, :, :h], gates[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + r * g[:, :, 2 * h :])
            if keep is not None:
                keep.append((state, z, r, new, g[:, :, 2 * h :]))
            state = new + z * (state - new)
            states[0, t], states[1, steps - 1 - t] = state
        both = np.concatenate([states[0], states[1]], axis=2)
        seen = np.tanh(both @ self.p["look"] + self.p["look_bias"])
        weights = seen @ self.p["weigh"]
        weights = np.exp(weights - weights.max(axis=0))
        weights /= weights.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weights, both)
        if keep is not None:
            keep.append((both, seen, weights, pooled))
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def given(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["input"] + self.p["bias"]

    def gradients(self, ids: np.ndarray, words: list[str], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Chances of windows, and the gradients of their weighted mean logistic loss."""
        features, h, kept = word_features(words), STATE, []
        inputs = self.inputs(features)
        logits = self.forward(self.given(inputs), ids, kept)
        chance = _sigmoid(logits)
        both, seen, weights, pooled = kept.pop()
        d, steps = {}, ids.shape[1]
        of_logit = ((chance - y) * weight / weight.sum()).astype(np.float32)
        d["out"], d["out_bias"] = pooled.T @ of_logit, of_logit.sum(keepdims=True)
        of_pooled = of_logit[:, None] * self.p["out"]
        of_weight = np.einsum("bh,tbh->tb", of_pooled, both)
        of_score = weights * (of_weight - (weights * of_weight).sum(axis=0))
        d["weigh"] = np.einsum("tb,tbk->k", of_score, seen)
        of_seen = of_score[:, :, None] * self.p["weigh"] * (1 - seen * seen)
        d["look"], d["look_bias"] = np.einsum("tbh,tbk->hk", both, of_seen, optimize=True), of_seen.sum(axis=(0, 1))
        of_both = weights[:, :, None] * of_pooled + of_seen @ self.p["look"].T
        d["state"], of_gates, back = np.zeros_like(self.p["state"]), np.empty((2, steps, len(ids), 3 * h), np.float32), np.zeros((2, len(ids), h), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, new, g = kept[t]
            back = back + np.stack([of_both[t, :, :h], of_both[steps - 1 - t, :, h:]])
            of_z, of_new = back * (state - new) * z * (1 - z), back * (1 - z) * (1 - new * new)
            of_r = of_new * g * r * (1 - r)
            of_state = np.concatenate([of_z, of_r, of_new * r], axis=2)
            d["state"] += state.transpose(0, 2, 1) @ of_state
            back = back * z + of_state @ self.p["state"].transpose(0, 2, 1)
            gates = np.concatenate([of_z, of_r, of_new], axis=2)
            of_gates[0, t], of_gates[1, steps - 1 - t] = gates
        flat = ids.T.ravel()
        of_given = np.stack([_summed(x.reshape(-1, 3 * h), flat, len(words)) for x in of_gates])
        d["bias"], d["input"] = of_given.sum(axis=1, keepdims=True), inputs.T @ of_given
        of_inputs = (of_given @ self.p["input"].transpose(0, 2, 1)).sum(axis=0)
        own, grams, counts = features
        d["words"] = _summed(of_inputs[:, :WORD_DIM], own, BUCKETS)
        d["grams"] = _summed(np.repeat(of_inputs[:, WORD_DIM:] / np.maximum(counts, 1)[:, None], counts, axis=0), grams, BUCKETS) if len(grams) else np.zeros_like(self.p["grams"])
        return chance, d

    def logits(self, ids: np.ndarray, words: list[str]) -> np.ndarray:
        """Logits of many windows, some at a time."""
        given = self.given(self.inputs(word_features(words)))
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(given, ids[k : k + 2048]) for k in range(0, len(ids), 2048))])

    def worst(self, texts: Iterable[str | None]) -> np.ndarray:
        """The largest logit of each text's windows. Windows are scored in blocks, so a text of any length takes little memory."""
        out, held, owners = [], [], []

        def close() -> None:
            if held:
                np.maximum.at(best := np.asarray(out), np.array(owners), self.logits(*word_ids(held)))
                out[:] = best.tolist()
                held.clear()
                owners.clear()

        for text in texts:
            out.append(-np.inf)
            for window in windows(text):
                held.append(window)
                owners.append(len(out) - 1)
                if len(held) * WINDOW >= _BLOCK:
                    close()
        close()
        return np.array(out)

    def score(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.scale[0] + self.scale[1] * np.asarray(logit, np.float64), -30, 30))


class _Adam:
    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.steps = network, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in network.p.items()} for _ in range(2))

    def step(self, d: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
        for k, g in d.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12)) + 1e-6 * self.network.p[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.network.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8)


# --- training


def fit(passes, docs: int, label: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, step: int = STEP) -> Network:
    """A network from windows. ``passes()`` gives (document's number, words) of all windows, each time in one order;
    ``label`` is 1 for toxic documents.

    Windows begin with their document's label. After each pass the windows of toxic documents that the model holds for
    clean count as clean, but the worst window of a toxic document stays toxic. The windows of either label's documents
    weigh the same together.
    """
    network = Network.new()
    adam, target, share = _Adam(network, rate), None, np.ones(2)
    for epoch in range(epochs):
        rows, owners, chances, at = iter(passes()), [], [], 0
        while part := list(islice(rows, step)):
            owner = np.array([r[0] for r in part])
            ids, words = word_ids(r[1] for r in part)
            toxic = label[owner]
            y = toxic if target is None else target[at : at + len(part)]
            chance, d = network.gradients(ids, words, y.astype(np.float32), share[toxic])
            adam.rate = rate / (1 + epoch) ** 1.5
            adam.step(d)
            owners.append(owner)
            chances.append(chance)
            at += len(part)
        if not owners:
            break
        owner, chance = np.concatenate(owners), np.concatenate(chances)
        toxic = label[owner]
        worst = np.zeros(docs)
        np.maximum.at(worst, owner, chance)
        target = (toxic == 1) & ((chance > 0.5) | (chance >= worst[owner]))
        counts = np.bincount(toxic, minlength=2)
        share = counts.sum() / np.maximum(counts, 1) / 2
    return network


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE, seed: int = 43) -> Network:
    """A network from the labelled documents whose crc32(id as text) mod 3 is not 1.

    About ``sample`` clean and toxic documents, chosen by a seeded hash of the id, are cut into all their
    windows, which are staged in a scattered order and read back a step at a time: the driver holds a step, and some
    bytes for each window. Three quarters of the documents teach the network, the rest its scale, weighted by the
    shares of the labels among all labelled documents. Null labels and texts teach nothing; without labelled documents
    of both kinds every score is the share of toxic ones.
    """
    from noticeflow.llm.quality import _logistic

    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(remainder(F.col("id"), 3) != 1)
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = min(0.99, max(0.01, counts.get(1, 0) / max(1, sum(counts.values()))))
    if len(counts) < 2:
        return Network(Network.new().p, (float(np.log(prior / (1 - prior))), 0.0))
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, sample[1] / counts[1])).otherwise(min(1.0, sample[0] / counts[0]))
    picked = marks.where(place < share).withColumn("tests", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(4)) == 0)
    taught = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(picked), "id").select(F.col("id").cast("string").alias("id"), "text", "toxic", "tests")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc in pdf.itertuples():
                found = windows(doc.text)
                while part := list(islice(found, 10_000)):
                    yield pd.DataFrame({"id": doc.id, "toxic": doc.toxic, "tests": doc.tests, "words": [" ".join(x) for x in part]})

    cut = taught.mapInPandas(run, "id string, toxic int, tests boolean, words string")
    staged = stage(cut.orderBy(F.xxhash64(F.lit(seed), "words", "id"), "id", "words"), "windows")
    teaching = staged.where("not tests").select("id", "toxic", "words")
    numbers: dict[str, int] = {}
    label_of: list[int] = []
    for row in teaching.select("id", "toxic").distinct().orderBy("id", "toxic").collect():  # as many as the sample has documents
        if row["id"] not in numbers:
            numbers[row["id"]] = len(label_of)
            label_of.append(row["toxic"])
    network = fit(lambda: ((numbers[r["id"]], r["words"].split(" ")) for r in teaching.toLocalIterator(prefetchPartitions=True)), len(label_of), np.array(label_of, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logits = shared.value.logits(*word_ids(w.split(" ") for w in pdf["words"]))
            yield pd.DataFrame({"id": pdf["id"], "toxic": pdf["toxic"], "logit": logits.astype(float)})

    tested = staged.where("tests").select("id", "toxic", "words").mapInPandas(test, "id string, toxic int, logit double").groupBy("id", "toxic").agg(F.max("logit").alias("logit")).orderBy("id", "toxic").collect()
    y = np.array([r["toxic"] for r in tested])
    if len(np.unique(y)) == 2:
        weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
        network.scale = _logistic(np.array([r["logit"] for r in tested]), y, weight)
    return network


def score_column(network: Network, docs: DataFrame, text: str = "text") -> Column:
    """Each text's score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(shared.value.worst(texts)), dtype=float)

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", network: Network | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out and teach nothing. A text that is null or has no words is
    one window of empty words and is scored as such. Texts of any length are scored window by window. Repeated rows
    are scored each time. A null id is not held out. Empty table: no rows. Other columns play no part.
    """
    network = network or train(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), 3) == 1, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    scored = rows.withColumn("score", score_column(network, rows))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
