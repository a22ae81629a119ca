"""The toxicity network: gradients against differences, scores against plain Python, held-out labels, edge cases."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from noticeflow.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, source string, score string, held_out string"


def plain_logit(network, words):
    """One window, number by number."""
    p, h = {k: v.astype(float) for k, v in network.p.items()}, X.STATE
    inputs = []
    for w in words:
        own, grams, counts = X.word_features([w])
        chars = [sum(p["grams"][g][i] for g in grams) / len(grams) if len(grams) else 0.0 for i in range(X.CHAR_DIM)]
        assert counts.tolist() == [len(grams)]
        inputs.append([*p["words"][own[0]], *chars])
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def read(d, order):
        state, states = [0.0] * h, {}
        for t in order:
            x = [sum(inputs[t][i] * p["input"][d][i][j] for i in range(len(inputs[t]))) + p["bias"][d][0][j] for j in range(3 * h)]
            g = [sum(state[i] * p["state"][d][i][j] for i in range(h)) for j in range(3 * h)]
            z = [sigmoid(x[j] + g[j]) for j in range(h)]
            r = [sigmoid(x[h + j] + g[h + j]) for j in range(h)]
            n = [math.tanh(x[2 * h + j] + r[j] * g[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * n[j] + z[j] * state[j] for j in range(h)]
            states[t] = state
        return states

    ahead, back = read(0, range(len(words))), read(1, range(len(words) - 1, -1, -1))
    both = [ahead[t] + back[t] for t in range(len(words))]
    weigh = [sum(p["weigh"][k] * math.tanh(sum(c[i] * p["look"][i][k] for i in range(2 * h)) + p["look_bias"][k]) for k in range(X.ATTENTION)) for c in both]
    total = sum(math.exp(e) for e in weigh)
    pooled = [sum(math.exp(e) / total * c[i] for e, c in zip(weigh, both)) for i in range(2 * h)]
    return sum(a * b for a, b in zip(pooled, p["out"])) + p["out_bias"][0]


def plain_windows(text):
    words = X._WORD.findall((text or "").lower())
    words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
    if len(words) < X.WINDOW:
        return [words + [""] * (X.WINDOW - len(words))]
    starts = list(range(0, len(words) - X.WINDOW + 1, X.STRIDE))
    if starts[-1] + X.WINDOW < len(words):
        starts.append(len(words) - X.WINDOW)
    return [words[a : a + X.WINDOW] for a in starts]


def text(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


_LETTERS = random.Random(0)
WORDS = ["".join(_LETTERS.choice("abcdefghijklm") for _ in range(3 + i % 5)) for i in range(400)]


def test_gradients_equal_differences():
    network = X.Network.new(3)
    r = random.Random(1)
    ids, words = X.word_ids([[r.choice(WORDS[:30] + [""]) for _ in range(X.WINDOW)] for _ in range(6)])
    y, weight = np.array([1, 0, 1, 0, 0, 1], np.float32), np.array([1, 2, 1, 1, 3, 1], np.float32)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    chance, d = network.gradients(ids, words, y, weight)

    def loss():
        z = network.forward(network.given(network.inputs(X.word_features(words)).astype(np.float64)), ids).astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    for name, value in network.p.items():
        flat, steep = value.reshape(-1), d[name].reshape(-1)
        for k in np.argsort(-np.abs(steep))[:4]:
            flat[k] += 1e-2
            up = loss()
            flat[k] -= 2e-2
            down = loss()
            flat[k] += 1e-2
            assert (up - down) / 2e-2 == pytest.approx(steep[k], rel=0.03, abs=2e-5), name


def test_scores_equal_plain_python():
    network = X.Network.new(5)
    r = random.Random(2)
    texts = [None, "", "one", text(r, 20, WORDS), text(r, 75, WORDS), "again " * 50 + "and on", "É日本語 " * 40, "x" * 70]
    got = network.worst(texts)
    for value, t in zip(got, texts):
        assert list(X.windows(t)) == plain_windows(t)
        assert value == pytest.approx(max(plain_logit(network, w) for w in plain_windows(t)), abs=1e-4)


def test_windows_cover_long_texts(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(X, "_CHUNK", 100)
    for n in (0, 1, 31, 32, 33, 55, 56, 57, 500):
        t = text(r, n, WORDS)
        assert list(X.windows(t)) == plain_windows(t)


def labelled(spark, n=900):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = text(r, r.randrange(5, 150), WORDS).split()
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(r.randrange(len(words)), r.choice(["vilek", "krotz"]) + r.choice(["", "en", "isch", "a"]))
        rows.append((i, " ".join(words), "en", "s", "x", "y"))
        labels.append((i, int(i % 9 > 0), int(toxic)))
    return spark.createDataFrame(rows, DOCS).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_and_edge_cases(spark):
    docs, labels = labelled(spark)
    network = X.train(docs, labels)
    rows = {r.doc_id: r for r in X.score_documents(docs, labels, network=network).collect()}
    assert len(rows) == 900 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)

    long_clean = text(random.Random(9), 200_000, WORDS)
    odd = [(1, None), (2, ""), (3, "..."), (None, long_clean), (5, long_clean + " vilek krotz vileken " + text(random.Random(3), 50, WORDS)), (6, "same"), (6, "same"), (7, "VILEK KROTZ")]
    frame = spark.createDataFrame([(i, t, None, None, "x", "y") for i, t in odd], DOCS)
    got = X.score_documents(frame, labels, network=network).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= X.THRESHOLD) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5].predicted == 1 and by[7].predicted == 1 and by[None].score < by[5].score and by[None].held_out is False
    assert by[1].score == pytest.approx(by[2].score, abs=1e-6) == pytest.approx(by[3].score, abs=1e-6)
    for r, (_, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(odd, key=lambda x: (x[0] is None, x[0]))):
        if t is None or len(t) < 200:
            want = max(plain_logit(network, w) for w in plain_windows(t))
            assert r.score == pytest.approx(float(network.score(want)), abs=1e-4)
    none = spark.createDataFrame([], DOCS)
    assert X.score_documents(none, labels.where("false")).count() == 0
    one_kind = X.score_documents(frame, labels.where("toxic = 0")).collect()
    assert len(one_kind) == len(odd) and {r.predicted for r in one_kind} == {0}
    nulls = spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 1, None), (7, 1, 3)], "doc_id long, quality int, toxic int")
    assert X.score_documents(frame, nulls).count() == len(odd)


def test_training_is_the_same_again(spark):
    docs, labels = labelled(spark, 200)
    a, b = X.train(docs, labels), X.train(docs.repartition(3), labels)
    assert a.scale == b.scale and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_query_on_given_tables(spark):
    from noticeflow.llm.queries import op13_toxicity

    rows = {r.doc_id: r for r in op13_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    clean = [rows[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert len(rows) == 1000 and sum(clean) <= 0.05 * len(clean)
