"""What each kind of source gives to the retrieval index: one select a source, all of one shape, united and chunked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from . import chunking

# The columns every unit has, with what holds where a source says nothing.
SHAPE = {
    "source_parent_id": ("string", None),
    "source_area": ("string", None),
    "topic": ("string", None),
    "channel": ("string", None),
    "author": ("string", None),
    "visibility": ("string", "internal"),
    "review_status": ("string", None),
    "authority": ("string", "source_record"),
    "is_stale": ("boolean", False),
    "occurred_at": ("timestamp_ntz", None),
    "source_updated_at": ("timestamp_ntz", None),
    "source_url": ("string", None),
    "permalink": ("string", None),
    "relative_path": ("string", None),
}
DERIVED = ("requirement", "timing_rule", "process", "resource", "contact")
OPERATIONAL = {"decision": "operational_decision", "action_item": "operational_action", "commitment": "operational_commitment", "open_question": "operational_question", "status_update": "operational_status"}
ARTIFACTS = ("transcript", "summary", "notes")


def _shaped(rows: DataFrame, source_type, record_id: Column, version_id: Column, title: Column, content: Column, more: tuple[str, ...] = (), **given: Column) -> DataFrame:
    kind = F.lit(source_type) if isinstance(source_type, str) else source_type
    rest = (F.coalesce(given[c], F.lit(d)).cast(t).alias(c) if c in given else F.lit(d).cast(t).alias(c) for c, (t, d) in SHAPE.items())
    return rows.select(kind.alias("source_type"), record_id.cast("string").alias("record_id"), version_id.cast("string").alias("version_id"), title.alias("title"), F.coalesce(content, F.lit("")).alias("content"), *more, *rest)


def _filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def of_articles(articles: DataFrame) -> DataFrame:
    c = F.col
    return _shaped(articles, "article", c("id"), c("content_hash"), c("title"), _filled(c("markdown"), c("raw_html")), source_area=c("category"), review_status=c("relevance_review_status"), authority=F.lit("article_source"), source_updated_at=c("source_updated_at"), source_url=c("url"))


def of_derived(rows: DataFrame, kind: str) -> DataFrame:
    """Requirements, timing rules, processes, resources or contacts: a heading, then the text it stands over.

    `rows` has heading and body; for requirements and timing rules both are the same sentence.
    """
    c = F.col
    title = _filled(c("heading"), F.lit(f"Knowledge {kind.replace('_', ' ').title()}"))
    body = _filled(c("body"), c("heading"), F.lit(""))
    return _shaped(rows, f"knowledge_{kind}", c("id"), c("source_content_hash"), title, F.concat_ws("\n\n", title, F.coalesce(body, F.lit(""))), source_parent_id=c("source_article_id").cast("string"), topic=c("topic_id").cast("string"), visibility=c("visibility"), review_status=c("review_status"), authority=F.lit("approved_operational"), is_stale=c("is_stale"), source_updated_at=c("source_updated_at"), source_url=c("source_url"))


def of_steps(steps: DataFrame) -> DataFrame:
    c = F.col
    title = _filled(c("title"), F.concat(F.lit("Process step "), c("step_number").cast("string")))
    condition = F.concat(F.lit("Condition: "), F.nullif(c("condition"), F.lit("")))
    return _shaped(steps, "knowledge_process_step", c("id"), c("source_content_hash"), title, F.concat_ws("\n\n", title, c("instruction"), condition), source_parent_id=c("process_id").cast("string"), visibility=c("visibility"), review_status=c("review_status"), authority=F.lit("approved_operational"), is_stale=c("is_stale"), source_updated_at=c("source_updated_at"), source_url=c("source_url"))


def of_documents(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents that are there, with the text of their current version if it could be read."""
    d = documents.where("not is_missing and not is_unavailable")
    v = versions.where("extraction_status = 'extracted'").select(F.col("version_id").alias("current_version_id"), "raw_text", "source_modified_at")
    c = F.col
    return _shaped(d.join(v, "current_version_id"), "document", c("id"), c("current_version_id"), c("title"), c("raw_text"), source_area=c("source_area"), authority=F.lit("governance"), source_updated_at=F.coalesce("source_modified_at", "filesystem_modified_at"), source_url=c("source_url"), relative_path=c("relative_path"))


def of_messages(messages: DataFrame, channels: DataFrame, users: DataFrame, settings: DataFrame) -> DataFrame:
    """Messages of the channels that are switched on, with the author's name where the author is known."""
    on = channels.join(settings.where("enabled").select("channel_id"), "channel_id", "left_semi").select("channel_id", F.col("name").alias("channel_name"))
    people = users.select(F.col("user_id").alias("author_user_id"), _filled(F.col("display_name"), F.col("real_name")).alias("author_name"))
    rows = messages.where("not is_deleted").join(on, "channel_id").join(people, "author_user_id", "left")
    c = F.col
    return _shaped(rows, "slack_message", c("id"), c("content_hash"), F.concat(F.lit("#"), c("channel_name")), c("message_text"), source_parent_id=c("channel_id"), channel=c("channel_name"), author=c("author_name"), authority=F.lit("committee_record"), occurred_at=c("posted_at"), source_updated_at=c("edited_at"), permalink=c("permalink"))


def of_mail(mail: DataFrame) -> DataFrame:
    c = F.col
    return _shaped(mail.where("not is_deleted"), "mail_message", c("id"), c("content_hash"), c("subject"), F.concat(c("subject"), F.lit("\n\n"), c("body_text")), author=c("sender_address"), review_status=F.lit("source_generated"), authority=F.lit("mail"), occurred_at=c("received_at"), source_updated_at=F.coalesce("modified_at", "received_at"), source_url=c("web_link"))


def _artifacts(meetings: DataFrame, artifacts: DataFrame) -> DataFrame:
    m = meetings.where("not is_missing").select("meeting_id", F.col("title").alias("meeting_title"), "started_at", F.col("source_updated_at").alias("meeting_updated_at"), "online")
    return m.join(artifacts.where("is_current"), "meeting_id")


def of_meetings(meetings: DataFrame, artifacts: DataFrame, segments: DataFrame) -> DataFrame:
    """Summaries and notes of meetings, and transcripts that have no segments (those that have: of_transcripts)."""
    rows = _artifacts(meetings, artifacts)
    rows = rows.join(segments.select("artifact_id", F.lit("transcript").alias("artifact_type")).distinct(), ["artifact_id", "artifact_type"], "left_anti")
    c = F.col
    spoken = c("artifact_type") == "transcript"
    kind = F.concat(F.lit("meeting_"), c("artifact_type"))
    title = F.when(spoken, c("meeting_title")).otherwise(F.concat(c("meeting_title"), F.lit(" — "), c("artifact_type")))
    return _shaped(rows.where(c("artifact_type").isin(*ARTIFACTS)), kind, c("meeting_id"), c("artifact_id"), title, c("content"), source_parent_id=c("meeting_id").cast("string"), review_status=c("review_status"), authority=kind, occurred_at=c("started_at"), source_updated_at=F.coalesce("source_updated_at", "meeting_updated_at"), source_url=F.when(~spoken & c("online"), c("source_reference")))


def of_transcripts(meetings: DataFrame, artifacts: DataFrame, segments: DataFrame, most: int = 2400) -> DataFrame:
    """Transcripts by groups of segments, with chunk_index, start_ms and end_ms beside; a group is not cut again."""
    groups = chunking.transcript_groups(segments, most).select("artifact_id", F.col("group").alias("chunk_index"), "start_ms", "end_ms", "content")
    rows = _artifacts(meetings, artifacts.drop("content")).where("artifact_type = 'transcript'").join(groups, "artifact_id")
    c, kind, more = F.col, "meeting_transcript", ("chunk_index", "start_ms", "end_ms")
    return _shaped(rows, kind, c("meeting_id"), c("artifact_id"), c("meeting_title"), c("content"), more=more, source_parent_id=c("meeting_id").cast("string"), review_status=c("review_status"), authority=F.lit(kind), occurred_at=c("started_at"), source_updated_at=F.coalesce("source_updated_at", "meeting_updated_at"))


def of_operations(records: DataFrame) -> DataFrame:
    """Current decisions, actions, commitments, questions and status reports: what is known of each in paragraphs."""
    c = F.col
    said = lambda label, value: F.concat(F.lit(f"{label}: "), F.nullif(value.cast("string"), F.lit("")))
    parts = (c("title"), c("description"), said("Workstream", c("workstream")), said("Owner", c("owner_text")), said("Due", _filled(c("due_text"), c("due_at").cast("string"))), said("Status", c("execution_status")))
    kinds = F.create_map(*(F.lit(x) for pair in OPERATIONAL.items() for x in pair))
    authority = F.when(c("review_status") == "approved", "approved_operational").otherwise("operational_candidate")
    rows = records.where(c("is_current") & c("record_type").isin(*OPERATIONAL))
    return _shaped(rows, kinds[c("record_type")], c("id"), c("review_version"), c("title"), F.concat_ws("\n\n", *(F.nullif(p, F.lit("")) for p in parts)), visibility=c("visibility"), review_status=c("review_status"), authority=authority, occurred_at=c("occurred_at"), source_updated_at=c("updated_at"))


def united(*sources: DataFrame) -> DataFrame:
    """All sources as one table of records; columns that only some have are null in the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def index_units(records: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """`records` cut into chunks, and transcript groups as they are, each with its stable key, id and hashes."""
    units = chunking.make_units(records, F.col("source_type"))
    if transcripts is None:
        return units
    part = F.concat_ws(":", "version_id", "chunk_index")
    key = identity.stable_key(F.col("source_type"), F.col("record_id"), part, F.lit(0))
    hashed = {c: F.col(c) for c in ("title", "content", "source_type", "start_ms", "end_ms", *SHAPE)}
    groups = transcripts.withColumn("stable_key", key).withColumns({"unit_id": identity.unit_id(F.col("stable_key")), "content_hash": identity.content_hash(F.col("content")), "index_hash": identity.json_hash(**hashed)})
    return units.unionByName(groups, allowMissingColumns=True)
