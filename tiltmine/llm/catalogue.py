"""Queries of the operators for training-data pipelines, over their whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmine.llm import byte_bpe, interpolated_lm, minhash, ngram_join, packing, pu_quality, quotations, surrogates, topk, url_rules
from tiltmine.llm.shared import table


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.anonymise(table(spark, sf_dir, "documents"), count_column="n_entities")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.rebuild(table(spark, sf_dir, "conversations"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clustered(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pu_quality": op1_pu_quality,
    "op2_surrogates": op2_surrogates,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_rules": op4_url_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_interpolated_lm": op6_interpolated_lm,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quotations": op8_quotations,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_fingerprints": op10_fingerprints,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op3_ngram_jaccard_join": r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), g as (
    select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g
    from w
), s as (select doc_id, cast(len(g) as bigint) as n from g),
e as (select doc_id, unnest(g) as gram from g),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from e a join e b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
l as (select x, y from p join s a on a.doc_id = x join s b on b.doc_id = y where 100 * o >= 90 * (a.n + b.n - o)),
both_ways as (select x, y from l union all select y, x from l),
reach as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on b.x = r.y)
select s.doc_id, s.n as n_shingles, least(s.doc_id, coalesce(min(reach.y), s.doc_id)) as component_id
from s left join reach on reach.x = s.doc_id group by s.doc_id, s.n
""",
    "op9_exact_top_k": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)
    where a.vec_id % 50 = 0
), r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
""",
}
