"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by a temperature."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.staging import stage

#: n-grams of 1 to GRAMS characters, hashed to BUCKETS features.
GRAMS, BUCKETS = 3, 1 << 16
#: Labelled documents (expected) that teach each language; passes over them; share kept for the temperature.
SAMPLE_PER_LANG, PASSES, CALIBRATION = 800, 2, 0.2
#: Fixed values of the training: learning rate, smoothing, and the penalties of absolute and of squared weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s+")
_WEIGHT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each stands in it: lower case, white space as single spaces."""
    points = np.frombuffer(_SPACE.sub(" ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), "<u4")
    code, all_codes = points * _WEIGHT[0], []
    for n in range(1, GRAMS + 1):
        mixed = (code ^ (code >> np.uint32(15))) * _WEIGHT[1]
        all_codes.append((mixed >> np.uint32(16)) % np.uint32(BUCKETS))
        if n < GRAMS:
            code = (code[:-1] + np.uint32(n)) * _WEIGHT[2] + points[n:] * _WEIGHT[0]
    counts = np.bincount(np.concatenate(all_codes), minlength=BUCKETS)
    index = np.flatnonzero(counts)
    return index, counts[index]


def _weighed(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[index]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class LanguageModel:
    """Languages, the features' weights (only those not zero), their inverse document frequencies, temperature."""

    langs: list[str]
    row_of: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or text is None or not _LETTER.search(text):
            return "und", 0.0
        index, counts = grams(text)
        x = _weighed(index, counts, self.idf)
        z = (x @ self.weights[self.row_of[index]] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def train_ftrl(rows: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], classes: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, classes) and bias by per-coordinate follow-the-proximally-regularised-leader. ``rows()`` gives
    each text's features, their values and its label, one text after another, once for each pass."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) > L1, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    for _ in range(passes):
        for index, x, label in rows():
            index, x = np.append(index, BUCKETS), np.append(x, 1.0)  # the last feature is the bias
            zs, ns = z[index], n[index]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p
            n[index] = ns + g * g
            z[index] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores at which the labels are likeliest (golden section over its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(_softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``texts(text)`` each feature stands, and their number, over all rows. A task gives one row per
    feature, so what comes to the driver is bounded by BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen[grams(t.as_py())[0]] += 1
                rows += 1
        hit = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(hit, -1)), pa.array(np.append(seen[hit], rows))], names=["feature", "n"])

    out, total = np.zeros(BUCKETS), 0
    for row in texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if row["feature"] < 0:
            total = row["n"]
        else:
            out[row["feature"]] = row["n"]
    return out, total


def train(labelled: DataFrame, key: Column, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """A model from ``labelled(text, lang)``: document frequencies over all rows, weights from a seeded sample of
    about ``sample_per_lang`` rows a language (expected; by a hash of ``key``). The whole texts of the sample teach:
    their features are staged in the order of a hash and read back one text at a time, of which each has at most
    BUCKETS. Rows without text or lang teach nothing; no rows give a model that answers ``und``."""
    rows = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    seen, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + seen)) + 1e-3
    place = F.pmod(F.xxhash64(F.lit(31), key), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, sample_per_lang / counts[lang])).otherwise(share)
    picked = rows.select("text", "lang", place.alias("place"), share.alias("share")).where("place < share")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [grams(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "spread": pdf["spread"], "i": [i.astype("<i4").tobytes() for i, _ in found], "c": [c.astype("<i4").tobytes() for _, c in found]})

    # Places order the rows of one language only up to its share, so they are spread over the unit interval first.
    spread = picked.select("text", "lang", (F.col("place") / F.col("share")).alias("spread"))
    sample = stage(spread.mapInPandas(features, "lang string, spread double, i binary, c binary").orderBy("spread", "lang", "i", "c"), "features")
    number = {x: k for k, x in enumerate(langs)}

    def rows_of(part: str) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """A text at a time; each has at most BUCKETS features."""
        for r in sample.where(part).toLocalIterator(prefetchPartitions=True):
            i = np.frombuffer(r["i"], "<i4")
            yield i, _weighed(i, np.frombuffer(r["c"], "<i4"), idf).astype(np.float32), number[r["lang"]]

    weights, bias = train_ftrl(lambda: rows_of(f"spread < {1 - CALIBRATION}"), max(1, len(langs)))
    tested = [(x @ weights[i] + bias, label) for i, x, label in rows_of(f"spread >= {1 - CALIBRATION}")]
    scores, labels = np.array([s for s, _ in tested]).reshape(-1, max(1, len(langs))), np.array([k for _, k in tested], np.int64)
    used = np.flatnonzero(np.abs(weights).sum(axis=1))
    row_of = np.zeros(BUCKETS, np.int32)
    row_of[used] = np.arange(1, len(used) + 1)
    return LanguageModel(langs, row_of, np.concatenate([np.zeros((1, weights.shape[1])), weights[used]]), bias, idf, temperature(scores, labels))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out; the others with text and lang teach the model, if none
    is given. A text that is null or has no letter is ``und`` with score 0; so is every text where nothing could be
    learned. A null id is not held out and teaches. Repeated rows teach and are answered each time. A text of any
    length is one vector of at most BUCKETS features. Empty table: no rows. Other columns play no part.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), 4) == 2, F.lit(False)).alias("held_out"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    if model is None:
        model = train(rows.where(~F.col("held_out")), F.col("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
