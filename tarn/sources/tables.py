"""Tables of a data folder, and the stand-ins they give for units, embeddings, messages and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 2, 1)
SOURCE_TYPES = ("article", "knowledge_requirement", "document", "slack_message", "operational_action", "meeting_notes")
AUTHORITIES = ("approved_operational", "article_source", "governance", "committee_record", "meeting_transcript", "meeting_summary", "source_record")
VISIBILITIES = ("public", "member", "committee", "internal")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as retrieval units; the label, where there is one, is the review."""
    d, l = table(spark, folder, "documents"), table(spark, folder, "labels")
    i = F.col("doc_id")
    rows = d.join(l, "doc_id", "left")
    return rows.select(
        F.lpad(i.cast("string"), 8, "0").alias("unit_id"),
        _pick(SOURCE_TYPES, i).alias("source_type"),
        i.cast("string").alias("source_record_id"),
        F.concat(F.lit("p"), F.floor(i / 5).cast("string")).alias("source_parent_id"),
        F.sha2("text", 256).alias("source_version_id"),
        F.lit(0).alias("chunk_index"),
        F.regexp_replace(F.substring("text", 1, 80), "[\\r\\n]+", " ").alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("source_area"),
        F.col("lang").alias("topic"),
        F.concat(F.lit("c"), (i % 5).cast("string")).alias("channel"),
        F.lit(None).cast("string").alias("author"),
        F.when(F.col("toxic") == 1, "internal").otherwise(_pick(VISIBILITIES, i)).alias("visibility"),
        F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "proposed").alias("review_status"),
        _pick(AUTHORITIES, i).alias("authority"),
        (i % 10 != 9).alias("is_current"),
        (i % 11 == 10).alias("is_stale"),
        (i % 13 == 12).alias("is_deleted"),
        F.timestamp_add("DAY", (i % 30).cast("int"), F.expr("timestamp_ntz'2024-01-01'")).alias("occurred_at"),
        F.lit(None).cast("timestamp_ntz").alias("source_updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


UNITS_SQL = """units as (select lpad(doc_id::varchar, 8, '0') as unit_id,
  (['article', 'knowledge_requirement', 'document', 'slack_message', 'operational_action', 'meeting_notes'])[doc_id % 6 + 1] as source_type,
  doc_id::varchar as source_record_id, 'p' || (doc_id // 5)::varchar as source_parent_id, sha256(text) as source_version_id, 0 as chunk_index,
  regexp_replace(substr(text, 1, 80), '[\\r\\n]+', ' ', 'g') as title, text as content, source as source_area, lang as topic,
  'c' || (doc_id % 5)::varchar as channel, null::varchar as author,
  case when toxic = 1 then 'internal' else (['public', 'member', 'committee', 'internal'])[doc_id % 4 + 1] end as visibility,
  case quality when 1 then 'approved' when 0 then 'proposed' end as review_status,
  (['approved_operational', 'article_source', 'governance', 'committee_record', 'meeting_transcript', 'meeting_summary', 'source_record'])[doc_id % 7 + 1] as authority,
  doc_id % 10 <> 9 as is_current, doc_id % 11 = 10 as is_stale, doc_id % 13 = 12 as is_deleted,
  timestamp '2024-01-01' + to_days((doc_id % 30)::int) as occurred_at, null::timestamp as source_updated_at, null::timestamp as updated_at
  from documents left join labels using (doc_id))"""


def unit_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as unit embeddings of one model, one in ten of an older one."""
    e = table(spark, folder, "embeddings")
    i = F.col("vec_id")
    return e.select(
        F.lpad(i.cast("string"), 8, "0").alias("unit_id"),
        "embedding",
        F.lit("local").alias("provider"),
        F.when(i % 10 == 3, "old").otherwise("base").alias("model"),
        F.lit("1").alias("model_version"),
        F.size("embedding").alias("dimension"),
    )


EMBEDDINGS_SQL = """unit_embeddings as (select lpad(vec_id::varchar, 8, '0') as unit_id, embedding, 'local' as provider,
  case when vec_id % 10 = 3 then 'old' else 'base' end as model, '1' as model_version, len(embedding)::int as dimension from embeddings)"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as chat messages; a conversation is a thread, its first turn the root."""
    c = table(spark, folder, "conversations")
    ts = lambda turn: F.format_string("%d.%06d", 1704067200 + F.col("conv_id") * 1000 + turn, turn)
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.concat(F.lit("C"), (F.col("conv_id") % 7).cast("string")).alias("channel_id"),
        ts(F.col("turn")).alias("ts"),
        ts(F.lit(0).cast("long")).alias("thread_ts"),
        F.col("role").alias("user"),
        "text",
        "conv_id",
        "turn",
    )


MESSAGES_SQL = """messages as (select conv_id * 1000 + turn as message_id, 'C' || (conv_id % 7)::varchar as channel_id,
  (1704067200 + conv_id * 1000 + turn)::varchar || '.' || lpad(turn::varchar, 6, '0') as ts,
  (1704067200 + conv_id * 1000)::varchar || '.000000' as thread_ts, role as user, text, conv_id, turn from conversations)"""


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Events as delivery reports of one message a user and hour of the day."""
    e = table(spark, folder, "events")
    return e.select("event_id", F.col("ts").alias("reported_at"), "user_id", F.col("event_type"), F.element_at(F.create_map(*(F.lit(x) for p in EVENT_STATUS.items() for x in p)), F.col("event_type")).alias("status"), "value", "props")


EVENT_STATUS = {"signup": "sent", "view": "delivered", "click": "delivered", "error": "bounced", "purchase": "complained"}
DELIVERIES_SQL = """deliveries as (select event_id, ts as reported_at, user_id, event_type,
  case event_type when 'signup' then 'sent' when 'view' then 'delivered' when 'click' then 'delivered' when 'error' then 'bounced' when 'purchase' then 'complained' end as status, value, props from events)"""
