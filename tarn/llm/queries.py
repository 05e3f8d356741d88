"""The registered queries of the training-data operators: opN_<name>, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, jaccard, merkle, mixing, pieces, pii, quality, simhash, substrings, suffix_dedup, topk, turns
from .common import table

#: op9's vocabulary: the path is a parameter of the query; the file must be there on the driver, which reads it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's topic is the label of the vector with its id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("topic"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chances(table(spark, sf_dir, "documents"), topics(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), pieces.vocabulary(vocabulary))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.manifest(table(spark, sf_dir, "documents"))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(table(spark, sf_dir, "conversations"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_exact_topk": op4_exact_topk,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLE_SQL = {
    "op2_mixing": mixing.oracle_sql(),
    "op4_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 5""",
    "op7_substring_dedup": """
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50),
h as (select doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) as h from p),
f as (select doc_id, i, min(doc_id) over (partition by h) as first from h),
g as (select distinct doc_id, unnest(range(i, i + 50)) as j from f where first < doc_id),
r as (select doc_id, list(j) as gone from g group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from d left join r on r.doc_id = d.doc_id""",
    "op11_merkle_manifest": merkle.oracle_sql(),
    "op12_conversation_repair": turns.oracle_sql(),
}
