"""The training-data pipeline: quality, near-duplicates, decontamination, PII, mixing; each stage on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Rows without an id pass the stages that need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.llm import decontaminate, mixing, pii, quality, simhash
from tarn.llm.common import stored, table
from tarn.llm.queries import topics


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is judged by the classifier's bias, a repeated row like its first, a row without an id too; a
    text of any length is read whole.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays (of its texts, that of the smallest hash); equal rows are one.

    The link is the stage's own: five-word shingles with a Jaccard similarity of 0.8 or more. Texts without words are
    alike; different texts under one id are told apart; rows without an id stay.
    """
    found = simhash.similar(docs)
    found = stored(found, "similar")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    gone = found.select("doc_id", "text_hash").join(first, ["doc_id", "text_hash"], "left_anti")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    key = ["doc_id", "text_hash"]
    left = rows.join(gone, key, "left_anti")
    # numbered where the join has dealt them, so the texts are shuffled once
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("text_hash"))
    return left.withColumn("nth", nth).where("nth = 1 or doc_id is null").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go; null texts hold none, rows without an id stay.

    A text of any length is read whole.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars follows the text. No row goes; null texts stay null.

    A text of any length is read whole, and repeated rows are changed alike.
    """
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, near the source, language and topic targets, with each document's chance.

    Null categories are one category; repeated rows, and rows without an id, share one draw.
    """
    return mixing.sampled(docs, topics(spark, sf_dir), fit=mixing.filled)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing to target weights", mix),
]

#: Trained weights and fitted fields are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
