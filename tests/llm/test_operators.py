"""Operators against plain Python, with the edge cases that their docstrings define."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, runs string, __score string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "a", "b", "c", "d") for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge_docs(spark):
    base = words(1, 200)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(base.split()[5], "zzz"), "fr", None), (4, None, None, None), (5, "", "en", "b"), (6, " \n\t ", None, "b"), (7, words(2, 60_000), "de", "hot"), (None, "some words here", "en", "a"), (8, "Ünï çødé 日本語 <|endoftext|> don't", "en", "a"), (9, "1234 5678 !!", "en", "a")]
    return frame(spark, rows + [(100 + i, words(100 + i, 30), "en", "hot") for i in range(60)]).repartition(5)


@pytest.fixture(scope="module")
def no_docs(spark):
    return frame(spark, [])


def components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


# --- graph


def test_components_equal_union_find(spark):
    from noticeflow.llm.graph import connected_components, spanning_edges

    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700 + i) for i in range(1, 80)]
    want = components(800, pairs)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    a, b = (np.array(x) for x in zip(*pairs))
    node, root = spanning_edges(800, a, b)
    assert components(800, zip(node.tolist(), root.tolist())) == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 mixing


def fill(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        left = total - sum(target.values())
        free = [s for s in order if s not in target]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}


def test_mix_reaches_water_filled_targets(edge_docs):
    from noticeflow.llm.mixing import mix_report

    out = mix_report(edge_docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(out) == edge_docs.count()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for x in edge_docs.collect():
        sizes[x.source] = sizes.get(x.source, 0) + count(x.text)
    want = fill(sizes)
    assert sorted({(x.source_size, round(x.target, 6)) for x in out}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    for s in sizes:
        own = [x for x in out if x.source_size == sizes[s]]
        assert abs(sum(x.taken for x in own) - want[s]) <= 2 + sum(1 for x in own if x.doc_id == 2)
    assert all(0 <= x.taken <= 2 * x.size for x in out)
    again = mix_report(edge_docs.repartition(2)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mix_repeats_rows_and_keeps_columns(edge_docs, no_docs):
    from noticeflow.llm.mixing import mix, mix_report, word_count

    mixed = mix(edge_docs)
    assert mixed.columns == edge_docs.columns
    taken = mix_report(edge_docs).agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(word_count(F.col("text")))).first()[0] == taken
    assert mixed.where("n_chars <> coalesce(length(text), 0)").count() == 0
    assert mix(no_docs).count() == 0 and mix_report(no_docs).count() == 0


# --- 2 language


def test_language_is_learned_and_held_out(spark, no_docs):
    from noticeflow.llm.langid import predict_languages, temperature

    stems = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = []
    for i in range(240):
        lang = list(stems)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choice(stems[lang]) for _ in range(5)) for _ in range(30)), lang, "s"))
    rows += [(900, None, "aa", "s"), (901, "123 !!", "bb", "s"), (902, "fghij ghfij", None, "s"), (None, "abcde", None, "s"), (903, "", "cc", "s")]
    got = {x.doc_id: x for x in predict_languages(frame(spark, rows)).collect()}
    for i in range(240):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in range(240) if got[i].held_out]
    assert sum(got[i].lang_pred == list(stems)[i % 3] for i in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 903))
    assert got[902].lang_pred == "bb" and got[None].lang_pred == "aa" and not got[None].held_out
    assert all(0 <= x.score <= 1 for x in got.values())
    assert predict_languages(no_docs).count() == 0
    assert temperature(np.array([[4.0, 0.0], [4.0, 0.0], [4.0, 0.0], [4.0, 0.0]]), np.array([0, 0, 0, 1])) > 2


# --- 3 lattice


def test_e8_points_are_nearest():
    from noticeflow.llm.lattice import _NEIGHBOURS, decode_e8

    x = np.random.default_rng(3).normal(size=(300, 8)) * 2
    p = decode_e8(x)
    assert len(_NEIGHBOURS) == 240 and np.allclose((_NEIGHBOURS**2).sum(axis=1), 2)
    whole, half = np.all(p == np.rint(p), axis=1), np.all(p - 0.5 == np.rint(p - 0.5), axis=1)
    assert (whole | half).all() and (p.sum(axis=1) % 2 == 0).all()
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - p[:, None] - _NEIGHBOURS[None]) ** 2).sum(axis=2) + 1e-9).all()


def vector_rows(seed=5, n=150, dims=16):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dims).tolist(), int(r.integers(3))) for i in range(n)]
    for k in range(60):  # near copies, chains and exact copies
        i = int(r.integers(n))
        v = np.array(rows[i][1])
        rows.append((n + k, (v + r.normal(size=dims) * r.choice([0, 0.05, 0.2]) * np.linalg.norm(v) / 4).tolist(), rows[i][2]))
    hot = r.normal(size=dims)
    rows += [(500 + k, (hot + r.normal(size=dims) * 0.01).tolist(), 1) for k in range(80)] + [(700 + k, hot.tolist(), 1) for k in range(40)]
    bad = [(900, None, 1), (901, [0.0] * dims, 1), (902, [float("nan")] + [1.0] * (dims - 1), 1), (903, [None] + [1.0] * (dims - 1), 1), (904, [float("inf")] + [0.0] * (dims - 1), 1), (905, rows[0][1], None)]
    return rows, bad


def test_near_vectors_equal_brute_force(spark):
    from noticeflow.llm.lattice import near_vectors

    rows, bad = vector_rows()
    schema = "vec_id long, embedding array<double>, label int, copies string, v string"
    df = spark.createDataFrame([(*x, "p", "q") for x in rows + bad], schema).repartition(4)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for *_, c in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = components(len(rows), zip(*np.nonzero(near)))
    for tile in (1024, 16, 1):
        got = {r.vec_id: r for r in near_vectors(df if tile > 1 else df.where("vec_id < 560 or vec_id >= 900"), tables=8, probes=6, tile=tile).collect()}
        if tile == 1:
            few = [k for k, (i, *_) in enumerate(rows) if i < 560]
            assert [got[rows[k][0]].n_links for k in few] == near[np.ix_(few, few)].sum(axis=1).tolist()
            continue
        assert [got[i].n_links for i, *_ in rows] == near.sum(axis=1).tolist()
        assert [got[i].component_id for i, *_ in rows] == [rows[c][0] for c in comp]
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert all(got[i].n_links == 0 and got[i].component_id == i for i, *_ in bad)
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_a_repeated_id_holds_several_vectors(spark):
    from noticeflow.llm.lattice import near_vectors

    v, w = [1.0, 0.5, 0.25, 0.0], [0.0, 0.0, 0.0, 1.0]
    rows = [(7, v, 1), (7, [-x for x in v], 1), (8, v, 1), *[(9, w, 2)] * 40]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=16).collect()))
    assert got == sorted([(7, 1, 7, True), (7, 0, 7, True), (8, 1, 7, False), *[(9, 39, 9, True)] * 40])


def test_production_cells_find_near_vectors(spark):
    """Recall of single pairs at a cosine of 0.93 to 0.95, among unrelated vectors, with the query's parameters."""
    from noticeflow.llm.lattice import near_vectors

    r, dims, pairs = np.random.default_rng(11), 64, 600
    x = r.normal(size=(pairs, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=(pairs, dims))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    c = r.uniform(0.9301, 0.95, (pairs, 1))
    y = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    got = {t.vec_id: t for t in near_vectors(df).collect()}
    found = sum(got[i].n_links == 1 and got[i + pairs].component_id == i for i in range(pairs))
    assert found >= 0.97 * pairs and all(t.n_links <= 1 for t in got.values())


# --- 4 lines


def plain_dedup(docs, least=50):
    """Every run of whole lines with ``least`` words or more, of any length, that stands earlier goes."""
    seen, out = set(), {}
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.split()]
        gone = set()
        for a in range(len(full)):
            n, run = 0, ()
            for b in range(a, len(full)):
                n += len(lines[full[b]].split())
                run += (" ".join(lines[full[b]].split()),)
                if n >= least:
                    if run in seen:
                        gone.update(range(full[a], full[b] + 1))
                    seen.add(run)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_equals_brute_force(spark, edge_docs, no_docs):
    from noticeflow.llm.linededup import dedup_lines

    r = random.Random(8)
    passages = [[words(1000 + k * 10 + i, r.choice([3, 20, 60])) for i in range(4)] for k in range(6)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.4:
                p = r.choice(passages)
                lines += p[r.randint(0, 1) : r.randint(2, 4)]
            lines.append(r.choice([words(r.randint(0, 10**6), r.randint(1, 30)), "a common short line", "", "  "]))
        docs.append((d, "\n".join(lines)))
    docs += [(70, "x y z\n" * 60), (71, "\n".join(passages[0])), (None, "\n".join(passages[1])), (72, "\n".join(["  " + passages[2][0].replace(" ", "  "), *passages[2][1:]]))]
    got = {x.doc_id: x for x in dedup_lines(frame(spark, [(i, t, "en", "s") for i, t in docs]).repartition(6)).collect()}
    want = plain_dedup(docs)
    assert {k: x.text for k, x in got.items()} == want
    assert sum(x.line_removed for x in got.values()) > 20
    assert got[71].line_count == 4 and all(x.line_count - x.line_removed in ((x.text.count("\n") + 1,) if x.text or not x.line_removed else (0, 1)) for x in got.values())
    edge = dedup_lines(edge_docs, report=False)
    assert edge.columns == edge_docs.columns and edge.count() == edge_docs.count()
    by = {x.doc_id: x.text for x in edge.collect()}
    assert by[4] is None and by[2] == "" and by[1]
    assert dedup_lines(no_docs).count() == 0


def test_repeated_runs_go_to_their_last_line(spark):
    """Against maximal equal runs: every run of 50 words or more, of any length, that stands earlier goes whole."""
    from noticeflow.llm.linededup import dedup_lines

    r = random.Random(9)
    docs = [(1, "\n".join([words(1, 60), words(2, 10), words(3, 10), words(4, 7)])), (2, "\n".join([words(5, 9), words(1, 60), "", words(2, 10), words(3, 10), words(6, 80)])), (3, "\n".join([words(2, 10), words(3, 10), words(7, 80)]))]
    passages = [[words(100 * k + i, r.choice([3, 10, 20, 60])) for i in range(6)] for k in range(5)]
    for d in range(10, 60):
        p, q = r.choice(passages), r.choice(passages)
        docs.append((d, "\n".join([words(10**6 + d, 9), *p[r.randint(0, 2) : r.randint(3, 6)], words(2 * 10**6 + d, 9), *q[r.randint(0, 3) :]])))
    want = plain_dedup(docs)
    assert want[2] == words(5, 9) + "\n" + words(6, 80)
    assert {x.doc_id: x.text for x in dedup_lines(frame(spark, [(i, t, "en", "s") for i, t in docs]).repartition(4)).collect()} == want


def test_equal_run_hashes_delete_nothing_unique(spark, monkeypatch):
    """Runs of different lines with one hash: pairs are compared on their lines, so nothing that stands once goes."""
    from noticeflow.llm import linededup

    seeds = linededup._seeds

    def collide(shared, run_words, gram_words):
        return seeds(shared, run_words, gram_words).withColumn("code", F.lit(7).cast("long"))

    passage = [words(3, 30), words(4, 30)]
    docs = [(1, "\n".join([words(1, 5), *passage])), (2, "\n".join([*passage, words(2, 40)])), (3, "\n".join([words(5, 60), *passage, words(6, 60)]))]
    plain = {x.doc_id: x.text for x in linededup.dedup_lines(frame(spark, [(i, t, "en", "s") for i, t in docs])).collect()}
    assert plain == plain_dedup(docs)
    monkeypatch.setattr(linededup, "_seeds", collide)
    found = linededup.dedup_lines(frame(spark, [(i, t, "en", "s") for i, t in docs])).collect()
    unique = {line for i, t in docs for line in t.split("\n") if line not in passage}
    assert unique <= {line for x in found for line in x.text.split("\n")}


def test_matches_are_extended_both_ways():
    from noticeflow.llm.linededup import extended

    own, other = (np.array([[x, x] for x in xs]) for xs in ([1, 2, 3, 4, 5, 6], [9, 1, 2, 3, 4, 8, 6]))
    assert extended(own, other, 0, np.array([[1, 2, 2], [2, 3, 3], [5, 6, 6]])) == [(0, 4), (5, 6)]
    assert extended(own, other[2:], 2, np.array([[1, 2, 2]])) == [(1, 4)] and extended(own, other, 0, np.array([[4, 5, 5]])) == []


def test_report_columns_never_clash(spark):
    from noticeflow.llm.linededup import dedup_lines

    docs = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "x", 5)], "doc_id int, text string, line_runs string, line_count int")
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "_line_runs", "_line_count", "_line_removed"] and got.count() == 2


# --- 5 SimHash


def plain_fingerprint(text, n=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("wide", [False, True])
def test_simhash_equals_brute_force(spark, edge_docs, no_docs, wide):
    from noticeflow.llm import simhash

    base = words(50, 400).split()
    more = [(300 + k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]]), "en", "s") for k in range(40)]
    docs = edge_docs.unionByName(frame(spark, more))
    kind = dict(radius=15, shingle=5) if wide else {}
    got = sorted(simhash.near_duplicates(docs, **kind).collect(), key=lambda x: (x.doc_id is None, x.doc_id))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda x: (x.doc_id is None, x.doc_id))
    n = 5 if wide else 3
    assert [x.fingerprint for x in got] == [f"{plain_fingerprint(x.text, n):016x}" for x in rows]
    hashes = [simhash.hashes_of(x.text, n) for x in rows]
    a = np.array([simhash.majority(h) for h in hashes], np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= (15 if wide else 3)
    comp = components(len(rows), zip(*np.nonzero(near)))
    low: dict = {}
    for x, c in zip(rows, comp):
        if x.doc_id is not None:
            low[c] = min(low.get(c, x.doc_id), x.doc_id)
    assert [x.component_id for x in got] == [low.get(c) for c in comp]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_similar(no_docs).count() == 0


def similar_groups(rows):
    """Component of each (id, text) by a Jaccard similarity of 0.8 of five-word shingles."""
    split = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j]))]
    return components(len(rows), pairs)


def test_similar_documents_equal_brute_force_jaccard(spark):
    """Copies with more and more words replaced: those below 0.8 stay, those at 0.8 or above go."""
    from corpus_pipeline import near_dedup

    docs, r = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), random.Random(3)
    more = []
    for k in range(60):
        w = words(700 + k, r.choice([12, 60, 300])).split()
        more.append((10**6 + 2 * k, " ".join(w)))
        for at in r.sample(range(len(w)), max(1, len(w) * (k % 6) // 100)):
            w[at] = f"new{k}x{at}"
        more.append((10**6 + 2 * k + 1, " ".join(w)))
    more += [(2 * 10**6, "a b c d e f g h"), (2 * 10**6 + 1, "a b c d e f g h i")]  # 4 of 5 shingles
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra.select(*[F.col(c).cast(t) for c, t in docs.dtypes]))
    rows = sorted((x.doc_id, x.text) for x in docs.collect())
    want = sorted(rows[c][0] for c in set(similar_groups(rows)))
    assert sorted(x.doc_id for x in near_dedup(spark, docs, "").collect()) == want
    assert 2 * 10**6 + 1 not in want and any(x >= 10**6 and x % 2 for x in want)


def test_a_group_of_near_copies_is_joined_by_few_pairs(spark):
    """A large group of near copies, most pairs of which are below 0.8: as brute force, in small tiles, with far fewer pairs."""
    from noticeflow.llm import simhash

    r, base = random.Random(5), words(900, 120).split()
    rows = []
    for i in range(160):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice([0, 1, 2, 3, 5])):
            w[at] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, words(5000 + i, 100)) for i in range(40)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    prints = simhash.set_prints(docs, 5)
    want, nodes = similar_groups(rows), {x.doc_id: x.node for x in prints.collect()}
    at = {n: k for k, n in enumerate(sorted(set(nodes.values())))}
    for kind in (dict(tile=32), dict(tile=1000), dict(tile=1000, bits=simhash.EXACT), dict(tile=1000, most=2000), dict(tile=32, bits=simhash.EXACT, most=300)):
        found = [(at[x.u], at[x.v]) for x in simhash.similar_links(docs, prints, **kind).collect()]
        comp = components(len(at), found)
        got = {i: comp[at[nodes[i]]] for i, _ in rows}
        assert {(i, j) for i, a in got.items() for j, b in got.items() if a == b} == {(rows[i][0], rows[j][0]) for i, a in enumerate(want) for j, b in enumerate(want) if a == b}
        assert kind.get("most") or len(found) < 160 * 159 / 4


def test_simhash_tiles_are_all_compared(spark):
    from noticeflow.llm.simhash import links

    r = np.random.default_rng(2)
    centre = r.integers(0, 2**63, 40)
    fps = np.unique(np.concatenate([centre, *[centre ^ (1 << int(b)) for b in r.integers(0, 63, 12)]]))
    df = spark.createDataFrame([(int(x), int(x), 0) for x in fps], "node long, fp long, more long")
    found = [(x.u, x.v) for x in links(df, tile=3).collect()]
    at = {int(x): i for i, x in enumerate(fps)}
    near = np.bitwise_count(fps.astype(np.uint64)[:, None] ^ fps.astype(np.uint64)[None]) <= 3
    assert components(len(fps), [(at[u], at[v]) for u, v in found]) == components(len(fps), zip(*np.nonzero(near)))


# --- tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_librarys(monkeypatch, name):
    """Random texts with the strings of special tokens, odd white space, combining marks and contractions."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from noticeflow.llm import tokens

    path = public_tokenizers.path(name)
    plain, mine, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(3)
    parts = ["a", "B", "don't", "it's", ".", ",", "!?", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "é", "É", "T\u0308", "\u0308", "日本", "1", "23", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "İ", "ſ", "\x1c", "\x85", "x.y", "»", "«;", "é.", "×.", "÷,", "ç;", "\u2009", "word", " the", "'", "'S", "\U0001f600", "ΑΣ", "\u212a", "\x0b", "\u200b", "'ll", "_", "-", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["".join(r.choice([*parts, "abc ", " de"]) for _ in range(5000))]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for together in (50, 1000, 2_000_000):
        monkeypatch.setattr(tokens, "TOGETHER", together)
        monkeypatch.setattr(tokens, "MEMORY", 100 * together)
        assert [x.tolist() for x in mine.encode_column(pa.array([*texts, None]))] == [*want, []]
    assert mine.encode("x <|endoftext|> y").tolist() == plain.encode("x <|endoftext|> y", add_special_tokens=False).ids


# --- 6 token files


def test_token_files_round_trip(edge_docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from noticeflow.llm.tokenbin import SequenceReader, read_documents, unpack_mask, write_sequences

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    root = f"file://{tmp_path}/out"
    manifest = write_sequences(edge_docs, path, root, length=64)
    got = sorted(read_documents(manifest, root).collect(), key=lambda x: x.start)
    rows = sorted(edge_docs.select("doc_id", "text").collect(), key=lambda x: (x.doc_id is not None, x.doc_id, x.text or ""))
    start, everything = 0, []
    for x, y in zip(got, rows, strict=True):
        ids = np.array([*plain.encode(y.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (y.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        everything.append(ids)
    first = manifest.orderBy("first_id").first()
    reader = SequenceReader(root, first["file"])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(unpack_mask(mask)) == 64 and unpack_mask(mask).all() and (ids == np.concatenate(everything)[:64]).all()
    assert not ids.flags.owndata and not mask.flags.owndata
    whole = [reader.sequence(i) for i in range(len(reader))]
    stored = np.concatenate([x[unpack_mask(m)] for x, m in whole])
    assert (stored == np.concatenate(everything)[: first["n_tokens"]]).all() and len(stored) == first["n_tokens"]
    assert read_documents(write_sequences(no_docs, path, root + "0"), root + "0").count() == 0


# --- 7 secrets


def test_secrets_equal_plain_patterns(spark, no_docs):
    from noticeflow.llm.secret_scan import find_secrets, labelled_samples, log_likelihood_ratio, train

    key = "q7Zx9Lm2Pv8Kd4Wn6Rt1Yb3Hs5Jc"
    texts = [
        'Password : "hunter22" and API-key=abc TOKEN="abcdefgh"', "api_key=short1 AKIA" + "A1" * 8 + " AKIAA", "é" * 5 + "0123456789abcdef01234567 0123456789abcdef", None, "", f"the value {key} stands alone",
        "ordinary_identifier_name AnotherOrdinaryIdentifierName2 some-very-long-hyphenated-word9", f"token={key}", "secret=x password=yy token='zzzzzz'", "PaSsWd=abcdef;secret=ghijkl", "4111111111111111 20240101", "passwordſ=abcdefg"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(50 + i, words(i, 300), "en", "s") for i in range(30)]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in find_secrets(docs).collect()}
    kinds = [("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for i, t, *_ in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, rx, g, n) in enumerate(kinds) for m in rx.finditer(t or "") if len(m[g]) >= n)
        base = [f"{kinds[k][0]}:{s}:{e}" for s, k, e in spans]
        x = got[i]
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, t, base, x)
        assert [y for y in x.spans.split(",") if y and not y.startswith("markov")] == base
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b.startswith(n) for b in base) for n, *_ in kinds)
    assert got[5].spans == f"markov:10:{10 + len(key)}"
    assert "markov" not in got[6].spans and "markov" not in got[7].spans and "markov" not in got[10].spans
    table = train(labelled_samples(docs))
    scores = {x.t: x.s for x in spark.createDataFrame([(key,), ("ordinaryIdentifierName",)], "t string").select("t", log_likelihood_ratio(F.col("t"), table).alias("s")).collect()}
    assert scores[key] > 10 > 0 > scores["ordinaryIdentifierName"] or scores["ordinaryIdentifierName"] < 0.3 * len("ordinaryIdentifierName")
    assert find_secrets(no_docs).count() == 0


def test_markov_spans_equal_plain_python(spark):
    """Random strings and identifiers, repeated rows, and a very long text with a thousand matches of each kind."""
    import time

    from noticeflow.llm import secret_scan as S

    r = random.Random(12)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
    def piece():
        kind = r.randrange(5)
        if kind == 0:
            return "".join(r.choice(mixed) for _ in range(r.randint(12, 40)))
        if kind == 1:
            return "_".join(words(r.randrange(10**6), 3).split())
        if kind == 2:
            return r.choice(["token=", "secret: ", "passwd='"]) + "".join(r.choice("abcXYZ09") for _ in range(r.randint(2, 12)))
        return words(r.randrange(10**6), r.randint(1, 9)) if kind == 3 else str(r.randrange(10**19))
    rows = [(i, " ".join(piece() for _ in range(12)), "en", "s") for i in range(60)]
    rows += [rows[0], rows[0], (900, "secret=token:abcdef", "en", "s")]
    long_text = "".join(f"{words(k, 900)} token=abc{k} {k % 7} {hashlib.md5(str(k).encode()).hexdigest()} " for k in range(1000))
    rows.append((901, long_text, "en", "s"))
    docs = frame(spark, rows)
    table = S.train(S.labelled_samples(docs))
    began = time.time()
    got = sorted(map(tuple, S.find_secrets(docs, table).collect()))
    assert len(long_text) > 4_000_000 and time.time() - began < 120
    base = [("assign", re.compile(S.BASE_KINDS[0][1][1:].replace("(?i:", "(").replace("password|passwd|secret|token|api_?key))", "(?i:password|passwd|secret|token|api_?key))", 1), re.ASCII), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]

    def ratio(token):
        states = [S._STATES - 1, *(S.ALPHABET.index("+" if c in "/_=-" else c) for c in token)]
        return sum(float(f"{table[a * S._STATES + b]:.6f}") for a, b in zip(states, states[1:]))

    want, judged = [], 0
    for i, text, *_ in rows:
        spans = [(m.start(), k, m.end()) for k, (_, rx, g, n) in enumerate(base) for m in rx.finditer(text) if len(m[g]) >= n]
        counts = [sum(k == x for _, k, _ in spans) for x in range(3)]
        written = lambda s: ",".join(f"{['assign', 'access', 'hex', 'markov'][k]}:{a}:{b}" for a, k, b in sorted(s))
        digest = hashlib.sha256(written(spans).encode()).hexdigest()
        taken = sorted((a, b) for a, _, b in spans)
        for m in re.finditer(S.CANDIDATE, text):
            if not any(a < m.end() and m.start() < b for a, b in taken) and re.search("[A-Za-z]", m[0]):
                judged += 1
                if ratio(m[0]) >= max(S.LEAST_TOTAL, S.LEAST_MEAN * len(m[0])):
                    spans.append((m.start(), 3, m.end()))
        want.append((i, *counts, digest, written(spans)))
    assert got == sorted(want)
    assert 20 < sum(w[5].count("markov") for w in want) < judged


def test_secret_scan_runs_no_python(spark, edge_docs, capsys):
    from noticeflow.llm.secret_scan import find_secrets

    find_secrets(edge_docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# --- 8 neighbours


def test_nearest_is_exact_with_all_cells_and_good_with_few(spark):
    from noticeflow.llm.ann import nearest

    rows, bad = vector_rows(seed=6, n=400, dims=24)
    unit = [(i, (np.array(v) / np.linalg.norm(v)).tolist(), c) for i, v, c in rows]
    schema = "vec_id long, embedding array<double>, label int, rank string, score string"
    df = spark.createDataFrame([(*x, "p", "q") for x in unit + [(i, (v or [0.0]) + [0.0] * 8 if v else v, c) for i, v, c in bad if i != 905]], schema).repartition(3)
    ids, x = np.array([i for i, *_ in unit]), np.array([v for _, v, _ in unit])
    asked = [i for i in ids if i % 20 == 0]

    def check(got, least):
        hit = total = 0
        for q in asked:
            s = (x * x[ids == q][0]).sum(axis=1)
            s[ids == q] = -np.inf
            best = np.lexsort((ids, -s))[:20]
            own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in own] == list(range(1, len(own) + 1))
            assert all(math.isclose(r.score, s[ids == r.vec_id][0], abs_tol=1e-12) for r in own)
            assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
            hit += len({r.vec_id for r in own} & set(ids[best].tolist()))
            total += 20
        assert hit >= least * total

    queries = df.where("vec_id % 20 = 0")
    check(nearest(queries, df, tables=1, probes=64).collect(), 1.0)
    check(nearest(queries, df).collect(), 0.9)
    few = df.where("vec_id < 5")
    assert nearest(few.where("vec_id = 0"), few, probes=64).count() == 4
    assert nearest(df.where("false"), df).count() == 0 and nearest(queries, df.where("false")).count() == 0


def test_repeated_vectors_take_no_places(spark):
    from noticeflow.llm.ann import nearest

    rows, _ = vector_rows(seed=6, n=400, dims=24)
    df = spark.createDataFrame([(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v, _ in rows], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 50 = 0")
    three = lambda x: x.unionByName(x).unionByName(x)
    whole = dict(tables=3, probes=64)
    want = sorted(map(tuple, nearest(queries, df, **whole).collect()))
    assert len(want) == 20 * queries.count()
    assert sorted(map(tuple, nearest(three(queries), three(df), **whole).collect())) == want
    one = df.where("vec_id in (0, 50)").select(F.lit(-1).cast("long").alias("vec_id"), "embedding")  # two vectors under one id
    assert nearest(three(one), df, **whole).count() == 20


# --- 9 quality


def test_marginals_equal_enumeration():
    from itertools import product

    from noticeflow.llm.quality import marginals

    r = np.random.default_rng(1)
    emission, sizes, moves = r.normal(size=(3, 5)), np.array([5, 1, 3]), r.normal(size=(2, 2))
    good, steps, total = marginals(emission, sizes, moves)
    for d, n in enumerate(sizes):
        weight, seen, step = 0.0, np.zeros(5), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = math.exp(sum(emission[d, t] for t in range(n) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weight += w
            seen[:n] += w * np.array(y)
            for a, b in zip(y, y[1:]):
                step[a, b] += w
        assert np.allclose(good[d], seen / weight) and np.allclose(steps[d], step / weight) and np.isclose(total[d], math.log(weight))


def test_quality_is_learned_and_held_out(spark, no_docs):
    from noticeflow.llm.quality import keep_good, score_documents, train

    rows, marks = [], []
    for i in range(300):
        lines = [words(i * 10 + k, 15).capitalize() + "." for k in range(4)]
        if i % 3 == 0:
            lines[1:3] = [" | ".join(x.split()) for x in lines[1:3]]
        rows.append((i, "\n".join(lines), "en", "s"))
        marks.append((i, int(i % 3 != 0), 0))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, "Words.", "en", "s"), (902, "a\n" * 3000, "en", "s")]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks + [(901, None, 0), (903, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = {x.doc_id: x for x in score_documents(docs, labels, model=model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(300) if got[i].held_out] == held
    assert sum(got[i].predicted == (i % 3 != 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    kept = keep_good(docs, labels, model=model)
    assert kept.columns == docs.columns and kept.count() == sum(x.predicted for x in got.values())
    assert score_documents(no_docs, labels.where("false")).count() == 0
    assert score_documents(docs, labels.where("false")).count() == len(rows)


# --- 10 packing


def test_tournament_finds_first_fit():
    from noticeflow.llm.packing import Tournament

    r = random.Random(1)
    tree, room = Tournament(40, 100), [100] * 40
    for need in sorted((r.randint(1, 60) for _ in range(60)), reverse=True):
        want = next(i for i, x in enumerate(room) if x >= need)
        assert tree.first(need) == want
        tree.take(want, need)
        room[want] -= need


def test_packing_covers_every_id_once(edge_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from noticeflow.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = pack(edge_docs, path, group_chars=60_000).collect()
    want: dict = {}
    for x in edge_docs.select("doc_id", "text").collect():
        want.setdefault(x.doc_id, []).append(np.array([*plain.encode(x.text or "", add_special_tokens=False).ids, 2], "<u4"))
    seen, bins = {}, {}
    for x in got:
        ids = want[x.doc_id][0]
        assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) and x.length > 0
        seen.setdefault(x.doc_id, np.zeros(len(ids), int))[x.start : x.start + x.length] += 1
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all((n == len(want[k])).all() for k, n in seen.items()) and set(seen) == set(want)
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        full = sum(n for _, n in own)
        assert full <= 4096 and (full == 4096 or full & (full - 1) == 0)
    assert sorted(map(tuple, pack(edge_docs.repartition(2), path, group_chars=60_000).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert pack(no_docs, path).count() == 0
