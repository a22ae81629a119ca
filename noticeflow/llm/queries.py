"""The registered queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 3, 1, 2 takes from each document."""
    from noticeflow.llm.mixing import mix_report

    return mix_report(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of three quarters of them."""
    from noticeflow.llm.langid import predict_languages

    return predict_languages(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked at a cosine of 0.93 or more within equal labels."""
    from noticeflow.llm.lattice import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cleaned of runs of lines that stand earlier."""
    from noticeflow.llm.linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' fingerprints and groups at 3 or fewer differing bits."""
    from noticeflow.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from written sequence files."""
    from noticeflow.llm.tokenbin import token_documents

    return token_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from noticeflow.llm.secret_scan import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each vector whose id is divisible by 20."""
    from noticeflow.llm.ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, by a model of four fifths of the labelled ones."""
    from noticeflow.llm.quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    from noticeflow.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt with shared starts."""
    from noticeflow.llm.trie import rebuilt_trie

    return rebuilt_trie(_table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens by two tokenizers."""
    from noticeflow.llm.align import align

    return align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of two thirds of the labelled ones."""
    from noticeflow.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources, op2_language_id, op3_embedding_near_dedup, op4_line_dedup, op5_simhash_near_dedup, op6_token_binary, op7_secret_scan,
    op8_nearest_neighbours, op9_quality, op10_packing, op11_conversation_prefix_trie, op12_tokenizer_alignment, op13_toxicity)}

#: Paths are lists of hashes here, which is quadratic in a conversation's turns.
_TRIE = r"""
with said as (
    select conv_id::bigint as conv_id, coalesce(text, '') as text, coalesce(role, '') as role,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
    from conversations where conv_id is not null),
counted as (
    select conv_id, count(*) as own, conv_id - conv_id % 20 as base,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda r, c: list_reduce(list_prepend(xor(r, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 4 as h
    from said group by conv_id),
rebuilt as (
    select c.conv_id, c.own, c.h, least(c.h, coalesce(b.own, 0)) as k, c.base from counted c left join counted b on b.conv_id = c.base),
turns as (
    select conv_id, k + place - h as place, role, text from said join rebuilt using (conv_id) where place > h
    union all select r.conv_id, s.place, s.role, s.text from rebuilt r join said s on s.conv_id = r.base and s.place <= r.k),
paths as (
    select r.conv_id, coalesce(list(sha256(length(t.role) || ':' || t.role || t.text) order by t.place) filter (where t.place is not null), []) as path,
        coalesce(list(len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')) order by t.place) filter (where t.place is not null), []) as words
    from rebuilt r left join turns t using (conv_id) group by r.conv_id),
members as (select conv_id, d as depth, path[1:d] as node, path[1:d - 1] as above, coalesce(words[d], 0) as words, d = len(path) as ends from paths, lateral (select unnest(range(len(path) + 1)) as d)),
nodes as (
    select depth, node, min(above) as above, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from members group by depth, node),
children as (select above as node, count(*) as n_children from nodes where depth > 0 group by above),
full_nodes as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c using (node)),
under as (select a.node, count(*) filter (where f.n_children = 0) as n_leaves, sum((f.n_convs - 1) * f.words) as saved_tokens
    from full_nodes f, lateral (select f.node[1:d] as node from (select unnest(range(f.depth + 1)) as d)) a group by a.node)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_conversation_prefix_trie": _TRIE + "select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens::bigint as saved_tokens, f.ends_sha256 from full_nodes f left join nodes p on f.depth > 0 and p.node = f.above join under u on u.node = f.node"}
