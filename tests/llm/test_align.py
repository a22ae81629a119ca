"""The alignment of two tokenizers against plain Python over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b, of


def tokens(libraries, text):
    a, b, of = libraries
    if not text:
        return None
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ba = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
    ib = b.encode(text)
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    whole = (" " + text).encode()
    return (ia, ba, ib, bb) if b"".join(ba) == whole and b"".join(bb) == whole else None


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain_align(libraries, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    links, heads = [], []
    for text in texts:
        got = tokens(libraries, text)
        if got is None:
            links.append([])
            heads.append((0, 0, 0, 0, ""))
            continue
        ia, ba, ib, bb = got
        sa, sb = spans(ba), spans(bb)
        pairs, j = [], 0
        for x, (p, q) in zip(ia, sa):
            while sb[j][1] <= p:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < q:
                pairs.append((x, ib[k]))
                k += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, s) if start < e <= c) for ids, s in ((ia, sa), (ib, sb))) if len(text) < 3000 else None)
            start = c
        links.append(pairs)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and groups[0] is not None else None
        heads.append((len(ia), len(ib), len(cuts), len(pairs), digest))
    count = Counter(p for x in links for p in x)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(*h[:4], sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), h[4]) for h, x in zip(heads, links)]


ODD = [
    None, "", " ", "  ", "\n", "\t x", "a  b   c ", " lead", "trail ", "tab\tand\nnew \n line\n", "wide space   em", "don't stop, it's <|endoftext|> here <s> </s> <0x41>", "▁ lower block", "x▁y", "日本語 \U0001f600\U0001f468‍\U0001f469",
    "é é ﬁ Ａ", "\x00\x01 nul", "0x1F 12345678901234567890 ===== ////", "a" * 700, "same text twice", "same text twice", "\u0085 next line", "\x1c sep \x1f"]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, libraries, texts, parts=5):
    from noticeflow.llm.align import align

    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts)], "doc_id int, text string, row int, pieces string, batch long").repartition(parts)
    got = {r.doc_id: tuple(r)[1:] for r in align(frame, A, B).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(plain_align(libraries, texts)):
        assert got[i][: 6 if want[6] is None else 7] == want[: 6 if want[6] is None else 7], (i, texts[i] and texts[i][:80])


def test_alignment_equals_plain_python(spark, libraries):
    r = random.Random(3)
    marks = ["a", "b", "the", "tion", " ", "  ", "\n", "é", "日", ".", ",", "'s", "<", ">", "0", " ", " ", "\U0001f600", "Z", "_", "\r\n", "�"]
    texts = ODD + ["".join(r.choice(marks) for _ in range(r.randrange(60))) for _ in range(250)]
    check(spark, libraries, texts)


def test_long_texts_go_in_parts(spark, libraries, monkeypatch):
    from noticeflow.llm import align as module

    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdeft") for _ in range(r.randrange(9))) for _ in range(n)) for n in (10, 300, 450)] + ["many words " * 60 + "▁ not given back", "ends at a cut " * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    want = found(module.align(frame, A, B))
    parts = module._parts
    monkeypatch.setattr(module, "PART", 100)
    assert all(len(parts(t)) > 1 for t in texts[1:])
    assert ["".join(parts(t)) for t in texts] == texts
    assert found(_with_parts(spark, frame)) == want
    check(spark, libraries, texts)


def _with_parts(spark, frame):
    """``align`` with small parts in the workers too."""
    from noticeflow.llm import align as module

    def small(docs):
        class Caught:
            def mapInArrow(self, f, schema):
                def run(batches):
                    module.PART, module.TOGETHER = 100, 300
                    yield from f(batches)

                return docs.mapInArrow(run, schema)

        return cut_up(Caught())

    cut_up = module._cut_up
    module._cut_up = small
    try:
        return module.align(frame, A, B)
    finally:
        module._cut_up = cut_up


def test_batches_are_staged_in_groups_of_few_rows(spark, monkeypatch):
    """A reader holds the rows of a group together, and a writer those it has not yet looked at."""
    from pyarrow import parquet

    from noticeflow.llm import align as module
    from noticeflow.llm import staging

    groups = {}

    def looked_at(df, name, **how):
        frame, path = staging.stage_at(df, name, **how)
        files = [parquet.ParquetFile(f.removeprefix("file://")).metadata for f in frame.inputFiles()]
        groups[name] = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
        return frame, path

    monkeypatch.setattr(module, "stage_at", looked_at)
    monkeypatch.setattr(module, "TOGETHER", 300)
    monkeypatch.setattr(staging, "GROUP", 1, raising=False)
    frame = spark.createDataFrame([(i, f"text {i} " * 60) for i in range(20)], "doc_id int, text string").coalesce(1)
    assert module.align(frame, A, B).count() == 20
    assert groups["texts"] == groups["documents"] == [1] * 20


def test_many_pairs_are_joined_by_shuffle(spark, monkeypatch):
    from noticeflow.llm import align as module

    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = found(module.align(frame, A, B))
    monkeypatch.setattr(module, "BROADCAST_PAIRS", 0)
    assert found(module.align(frame, A, B)) == want


def test_query_on_given_tables(spark, libraries):
    from noticeflow.llm.queries import op12_tokenizer_alignment

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op12_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    for row, want in zip(rows, plain_align(libraries, [r.text for r in rows])):
        assert got[row.doc_id][: 6 if want[6] is None else 7] == want[: 6 if want[6] is None else 7], row.doc_id


def test_empty_and_null_rows(spark):
    from noticeflow.llm.align import align

    schema = "doc_id long, text string, pair long, docs string"
    assert align(spark.createDataFrame([], schema), A, B).count() == 0
    got = found(align(spark.createDataFrame([(None, None, 1, "a"), (None, "some text", 1, "a"), (4, "some text", 2, "b"), (4, "some text", 2, "b")], schema), A, B))
    assert len(got) == 4 and got[0][:3] == (4, 2, 2) and [x[0] for x in got].count(None) == 2
