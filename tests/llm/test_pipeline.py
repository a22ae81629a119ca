"""The pipeline's stages, each on what the one before kept, against plain Python where it is exact."""

import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Each stage's input and result, written and read as run() does."""
    from noticeflow.llm.staging import stage

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, DATA), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_stages_keep_the_columns_of_documents(tables):
    for name, before, after in tables[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes, name


def test_quality_keeps_good_documents(spark):
    larger = "/root/testdata/sf0.01"  # the smallest tables have nine bad documents to learn from
    before, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    after = corpus_pipeline.quality(spark, before, larger).select("doc_id").join(labels, "doc_id").cache()
    good, bad = (labels.where(f"quality = {q}").count() for q in (1, 0))
    assert after.where("quality = 1").count() >= 0.97 * good
    assert after.where("quality = 0").count() <= 0.1 * bad


def test_lines_are_deduplicated_as_by_brute_force(tables):
    from tests.llm.test_operators import plain_dedup

    _, before, after = tables[1]
    want = plain_dedup([(x.doc_id, x.text) for x in before.collect()])
    assert {x.doc_id: x.text for x in after.collect()} == want
    assert all(x.n_chars == len(x.text) for x in after.collect())


def test_one_document_of_each_group_stays(tables):
    from tests.llm.test_operators import similar_groups

    _, before, after = tables[2]
    rows = sorted((x.doc_id, x.text) for x in before.collect())
    assert sorted(x.doc_id for x in after.collect()) == sorted(rows[c][0] for c in set(similar_groups(rows)))


def test_quality_keeps_what_plain_python_keeps(spark, tables):
    from noticeflow.llm.quality import THRESHOLD, train
    from tests.llm.test_models import plain_quality

    _, before, after = tables[0]
    model = train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = sorted(x.doc_id for x in before.collect() if plain_quality(model, x.text) >= THRESHOLD)
    assert sorted(x.doc_id for x in after.collect()) == want


def test_mixing_meets_its_targets(tables):
    """Whole texts and one cut text a source, in numbers that plain water-filling asks for."""
    from tests.llm.test_operators import fill

    _, before, after = tables[3]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    texts, sizes, taken, cut = {}, {}, {}, {}
    for x in before.collect():
        texts[x.doc_id] = words(x.text)
        sizes[x.source] = sizes.get(x.source, 0) + len(words(x.text))
    for x in after.collect():
        w = words(x.text)
        assert w == texts[x.doc_id][: len(w)] and x.n_chars == len(x.text)
        taken[x.source] = taken.get(x.source, 0) + len(w)
        cut[x.source] = cut.get(x.source, 0) + (len(w) < len(texts[x.doc_id]))
    want = fill(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes) and all(n <= 1 for n in cut.values())


def test_packing_holds_every_document(tables):
    """Every copy's ids lie in pieces, each once, as the library gives them; sequences are gapless and without padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, before, after = tables[4]
    want, got, bins = {}, {}, {}
    for x in before.collect():
        ids = np.array([*plain.encode(x.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(x.doc_id, []).append(ids)
    for x in after.collect():
        got.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, x.length, x.ids_crc32))
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for key, copies in want.items():
        for n in {len(c) for c in copies}:
            same = [c for c in copies if len(c) == n]
            pieces = got.pop((key, n))
            seen = np.zeros(n, int)
            for start, length, crc in pieces:
                assert any(crc == zlib.crc32(c[start : start + length].tobytes()) for c in same)
                seen[start : start + length] += 1
            assert (seen == len(same)).all()
    assert not got
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        full = sum(n for _, n in own)
        assert full <= 4096 and full & (full - 1) == 0


def test_run_gives_the_last_stage(spark, tables):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(tables[-1][2])


def test_stages_take_edge_cases(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, `group` string, cells string"
    long_text = "one two three four five six seven " * 20_000
    rows = [
        (1, "Some good words stand here.\nAnd more.", "en", "a", 37, 1, "x", "y", "z"), (1, "Some good words stand here.\nAnd more.", "en", "a", 37, 1, "x", "y", "z"), (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "", 0, 2, "", "", ""), (4, long_text, "en", "a", len(long_text), 3, "x", "y", "z"), (None, "No id has this text at all.", "en", "b", 26, 4, "x", "y", "z"), (5, " \n \n", "en", "b", 4, 5, "x", "y", "z")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for name, step in corpus_pipeline.STAGES[1:]:
        after = step(spark, docs, DATA)
        if name != "packing":
            assert after.columns == docs.columns, name
        n = after.count()
        assert n == {"line_dedup": 7, "near_dedup": 4}.get(name, n) and n > 0, (name, n)
        assert step(spark, docs.where("false"), DATA).count() == 0, name
    kept = corpus_pipeline.quality(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() <= 7
