"""Language and quality models against plain Python, row by row, with long, repeated and clashing rows."""

from __future__ import annotations

import math
import random
import re
import resource
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import langid, quality

DOCS = "doc_id long, text string, lang string, source string, score string, id string, lang_pred string, good string"


def words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z", "w") for i, t, lang in rows], DOCS).repartition(4)


# --- language


def plain_feature(text: str) -> Counter:
    """Buckets of 1- to 3-grams of characters, by whole numbers."""
    low, out = 0xFFFFFFFF, Counter()
    points = [ord(c) for c in re.sub(r"\s+", " ", f" {text.lower()} ")]
    for a in range(len(points)):
        code = points[a] * 0x9E3779B1 & low
        for n in range(1, 4):
            if a + n > len(points):
                break
            if n > 1:
                code = ((code + n - 1) * 0xC2B2AE3D + points[a + n - 1] * 0x9E3779B1) & low
            mixed = (code ^ code >> 15) * 0x85EBCA77 & low
            out[(mixed >> 16) % langid.BUCKETS] += 1
    return out


def plain_language(model, text):
    if text is None or not re.search(r"[^\W\d_]", text):
        return "und", 0.0
    x = {k: (1 + math.log(n)) * model.idf[k] for k, n in plain_feature(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [(sum(v / norm * model.weights[model.row_of[k]][c] for k, v in x.items()) + model.bias[c]) / model.temperature for c in range(len(model.langs))]
    total = sum(math.exp(v - max(z)) for v in z)
    return model.langs[max(range(len(z)), key=z.__getitem__)], 1 / total


def test_languages_equal_plain_python(spark):
    r = random.Random(1)
    letters = {"aa": "abcdeé", "bb": "fghijß", "cc": "klmno日"}
    rows = [(i, words(r, letters[lang], r.randint(1, 60)), lang) for i in range(240) for lang in [list(letters)[i % 3]]]
    rows += [(300, None, "aa"), (301, "12 ?!", "bb"), (302, "", None), (None, "fgh hij", None), (303, words(r, letters["cc"], 30_000), "cc"), (304, "mixed ABC fgh klm", "aa"), (305, "aab", "bb"), (305, "aab", "bb"), (306, "\U0001f600 x ́", None)]
    docs = frame(spark, rows)
    model = langid.train(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"), F.col("doc_id"))
    got = sorted((x.doc_id is None, x.doc_id or 0, x.lang_pred, x.score) for x in langid.predict_languages(docs, model=model).collect())
    want = sorted((i is None, i or 0, *plain_language(model, t)) for i, t, _ in rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-6)


def test_whole_texts_teach_languages(spark):
    """What tells the languages apart stands after more distinct grams than the most frequent thousands."""
    r = random.Random(2)
    noise = "".join(chr(0x4E00 + k) for k in range(12_000))
    rows = [(i, " ".join([noise, words(r, "ab" if i % 2 else "xy", 1)]), "one" if i % 2 else "two") for i in range(120)]
    model = langid.train(frame(spark, rows), F.col("doc_id"))
    assert np.abs(model.weights[model.row_of[sorted(plain_feature("a"))]]).sum() > 0
    assert len(langid.grams(noise)[0]) > 8192


def test_few_or_no_rows_teach(spark):
    one = frame(spark, [(1, "only text", "aa")])
    assert {x.lang_pred for x in langid.predict_languages(one).collect()} == {"aa"}
    none = frame(spark, [(1, "only text", None)])
    assert [(x.lang_pred, x.score) for x in langid.predict_languages(none).collect()] == [("und", 0.0)]


# --- quality


def plain_quality(model, text):
    """The score of one text: features line by line, and sums over labels by the plain recursion."""
    lines = [x.strip() for x in (text or "").encode().split(b"\n")]
    lines = [x for x in lines if x]
    times = Counter(lines)
    own = [quality._line(x, times[x]) for x in lines] or [(0.0,) * len(quality.OWN)]
    beside = [quality.OWN.index(x) for x in quality.BESIDE]
    none = [0.0] * len(beside)
    scores = []
    for t, x in enumerate(own):
        before, after = [own[t - 1][k] for k in beside] if t else none, [own[t + 1][k] for k in beside] if t + 1 < len(own) else none
        row = [1.0, *x, *before, float(t == 0), *after, float(t + 1 == len(own))]
        scores.append(sum(a * float(np.float32(b)) for a, b in zip(model.weights, row)))
    m, n = model.moves, len(scores)
    join = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, back = [(0.0, scores[0])], [(0.0, 0.0)]
    for t in range(1, n):
        f = ahead[-1]
        ahead.append(tuple(join(f[0] + m[0][s], f[1] + m[1][s]) + s * scores[t] for s in (0, 1)))
    for t in range(n - 2, -1, -1):
        b = back[-1]
        back.append(tuple(join(m[s][0] + b[0], m[s][1] + b[1] + scores[t + 1]) for s in (0, 1)))
    back.reverse()
    good = [1 / (1 + math.exp(min(700, f[0] + b[0] - f[1] - b[1]))) for f, b in zip(ahead, back)]
    sizes = [len(x) for x in lines] or [1]
    q = min(1 - 1e-4, max(1e-4, sum(g * w for g, w in zip(good, sizes)) / sum(sizes)))
    return 1 / (1 + math.exp(-(model.scale[0] + model.scale[1] * math.log(q / (1 - q)))))


def graded(r, n=300):
    rows, marks = [], []
    for i in range(n):
        lines = [words(r, "abcdefgh", 12).capitalize() + "." for _ in range(r.randint(1, 8))]
        if i % 3 == 0:
            lines = [" | ".join(x.split()) if r.random() < 0.8 else x for x in lines]
        rows.append((i, "\n".join(lines), "en"))
        marks.append((i, int(i % 3 != 0), 0))
    return rows, marks


def test_scores_equal_plain_python(spark):
    rows, marks = graded(random.Random(3))
    long_text = "\n".join(f"Line {k} of many | with | marks." if k % 7 else "A plain line." for k in range(7000))
    rows += [(400, None, None), (401, "", None), (402, " \n \n", None), (403, long_text, None), (404, "one", None), (404, "one", None), (None, "No id.\nTwo lines.", None), (405, "a\n" * 3000, None)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks + [(403, 0, 0), (None, 1, 1), (405, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.score) for x in quality.score_documents(docs, labels, model=model).collect())
    want = sorted((i is None, i or 0, plain_quality(model, t)) for i, t, _ in rows)
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)
    kept = quality.keep_good(docs, labels, model=model)
    assert kept.columns == docs.columns and kept.count() == sum(x[2] >= quality.THRESHOLD for x in got)


def test_long_chains_equal_the_recursion():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 101, 400):
        emission, moves = r.normal(size=n) * 3, r.normal(size=(2, 2))
        want, _, _ = quality.marginals(emission[None], np.array([n]), moves)
        assert np.allclose(quality.long_marginals(emission, moves), want[0])


def test_a_million_lines_take_little_memory():
    model = quality.LineModel(np.random.default_rng(5).normal(size=len(quality.FEATURES)), np.eye(2), (0.0, 1.0))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    features, lengths = quality.line_features("a b\nc | d\n" * 500_000)
    assert len(lengths) == 1_000_000
    assert 0 < model.quality([model.emission(features)], [lengths])[0] < 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


def test_long_documents_teach_whole_and_in_steps(spark, monkeypatch):
    """The same model whether chains are held or read again; all lines of a long document teach."""
    rows, marks = graded(random.Random(6), 60)
    chains = []
    for k, (_, text, _) in enumerate(rows):
        f, w = quality.line_features(text)
        chains += [quality.Chain(k, f[a : a + 3], w[a : a + 3], len(w)) for a in range(0, len(w), 3)]
    good, reads = np.array([g for _, g, _ in marks]), []

    def read():
        reads.append(1)
        return iter(chains)

    held = quality.train_lines(read, good, 0.6, rounds=2, steps=5)
    assert len(reads) == 1
    monkeypatch.setattr(quality, "HELD_LINES", 0)
    again = quality.train_lines(read, good, 0.6, rounds=2, steps=5)
    assert len(reads) > 5 and np.allclose(held.weights, again.weights) and held.scale == pytest.approx(again.scale)
    monkeypatch.setattr(quality, "STEP_LINES", 20)
    parts = list(quality._Passes(read))
    assert len(parts) > 5 and [c for p in parts for c in p] == chains and all(sum(len(c.features) for c in p) <= 20 for p in parts)
    monkeypatch.setattr(quality, "CHAIN_LINES", 4)
    docs = frame(spark, rows + [(900, "\n".join(f"line {k} x." for k in range(101)), "en")])
    seen = []
    monkeypatch.setattr(quality, "train_lines", lambda read, good, prior: seen.extend(read()))
    quality.train(docs, spark.createDataFrame(marks + [(900, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sum(len(c.features) for c in seen if c.total == 101) == 101
