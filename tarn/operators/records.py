"""Mail and meeting-note records, account reviews, rosters, benchmark files, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.files import html_text

MOST_BODY, MOST_SUBJECT = 50_000, 500
MAIL_HOSTS = ("outlook.office.com", "outlook.office365.com", "outlook.live.com")
DOC_LINK = "https://docs\\.google\\.com/document/(?:u/\\d+/)?d/([A-Za-z0-9_-]+)(?=[/?#\\s<>|\"\\\\]|$)"
NOTE_HEADINGS = ("notes", "quick notes", "transcript")


def zoned_time(value: Column) -> Column:
    """A strict ISO time with a zone; null without one."""
    return F.when(value.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), F.try_to_timestamp(value))


def safe_link(url: Column) -> Column:
    """The link if it is https, on a known mail host, without user or port and of sensible length."""
    host = F.regexp_extract(url, "^https://([^/?#]*)(?:[/?#]|$)", 1)
    return F.when((F.length(url) <= 4096) & F.lower(host).isin(*MAIL_HOSTS), url)


def mail_records(messages: DataFrame, sender: str) -> tuple[DataFrame, DataFrame]:
    """(good, refused) of raw mails (id, address, subject, body, content_type, received, modified, link).

    A mail is refused, with the reason, that is not from exactly this sender or has no usable id or zoned time of
    receipt. HTML bodies become text, long bodies are cut and marked.
    """
    plain = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), "\\r\\n", "\n"))
    as_text = F.trim(F.when(F.lower(F.coalesce("content_type", F.lit(""))) == "html", html_text(F.coalesce("body", F.lit("")))).otherwise(plain))
    subject = F.substring(F.trim(F.coalesce(F.nullif("subject", F.lit("")), F.lit("(No subject)"))), 1, MOST_SUBJECT)
    received = zoned_time(F.col("received"))
    reason = (
        F.when(~F.coalesce(F.lower(F.trim("address")) == sender.strip().lower(), F.lit(False)), "another sender")
        .when(F.coalesce(F.length("id"), F.lit(0)).between(1, 2048) == F.lit(False), "no usable id")
        .when(F.col("received").isNull(), "no time of receipt")
        .when(received.isNull(), "time of receipt without a zone or not valid")
    )
    rows = messages.withColumns({"_reason": reason, "_text": as_text, "_subject": subject})
    good = rows.where("_reason is null").select(
        "id",
        F.lit(sender.strip().lower()).alias("sender"),
        F.col("_subject").alias("subject"),
        F.substring("_text", 1, MOST_BODY).alias("body"),
        (F.length("_text") > MOST_BODY).alias("body_truncated"),
        received.alias("received_at"),
        zoned_time(F.col("modified")).alias("modified_at"),
        safe_link(F.col("link")).alias("web_link"),
        F.sha2(F.to_json(F.array("_subject", "_text")), 256).alias("content_hash"),
    )
    return good, rows.where("_reason is not null").select("id", F.col("_reason").alias("reason"))


def linked_documents(messages: DataFrame) -> DataFrame:
    """(document_id, first_ts, references): shared documents in the text or raw payload of messages that stand.

    `messages` is (message_id, ts, text, raw, deleted). References are counted, not gathered.
    """
    ids = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "text", "raw"), F.lit(DOC_LINK), 1))
    rows = messages.where("not deleted").select("message_id", "ts", F.explode(ids).alias("document_id"))
    return rows.groupBy("document_id").agg(F.min_by("ts", F.col("ts").try_cast("double")).alias("first_ts"), F.count("*").alias("references"))


def note_title(content: Column) -> Column:
    """The first line that is more than a stock heading, else the first line."""
    lines = F.filter(F.transform(F.split(content, "\\r\\n|\\n|\\r"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), 0), " ")
    own = F.filter(lines, lambda x: ~words(x).isin(*NOTE_HEADINGS))
    return F.substring(F.coalesce(F.get(own, F.lit(0)), F.get(lines, F.lit(0))), 1, 240)


def current_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Note versions (document_id, content_hash, is_current) after a look; content that comes back reuses its version."""
    both = stored.select("document_id", "content_hash").unionByName(incoming.select("document_id", "content_hash")).distinct()
    now = incoming.select("document_id", F.col("content_hash").alias("_now"))
    old = stored.where("is_current").select("document_id", F.col("content_hash").alias("_was"))
    rows = both.join(now, "document_id", "left").join(old, "document_id", "left")
    return rows.select("document_id", "content_hash", F.col("content_hash").eqNullSafe(F.coalesce("_now", "_was")).alias("is_current"))


def delivery_key(address: Column, identity: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lower(F.trim(address)), identity.cast("string")), 256)


# Which roles an action starts from, and the role and status it leads to (None: as before).
ACCOUNT_MOVES = {
    "verify": (("viewer", "member"), "verified", "approved"),
    "decline": (("viewer", "member"), None, "declined"),
    "promote_committee": (("verified", "member"), "committee", None),
    "promote_admin": (("verified", "committee"), "admin", None),
    "demote_member": (("committee", "admin"), None, None),
    "link_officer": (("committee", "admin"), None, None),
}


def reviewed_accounts(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its outcome: (request_id, account_id, outcome, role, status, officer_id, version).

    `accounts` is (account_id, role, status, officer_id, version, active), `requests` (request_id, actor_id, account_id,
    action, expected_version, reason, officer_id), judged against the accounts as they stand. Only active
    administrators review, nobody their own access, promotion needs an approved account, and the last active
    administrator stays one. Of several requests that fit one account's version the first wins, and of several that
    demote administrators only the first is done, so a batch can never demote them all.
    """
    admins = accounts.where("active and role = 'admin'")
    several = admins.limit(2).agg((F.count("*") > 1).alias("_several"))
    actors = admins.select(F.col("account_id").alias("actor_id"), F.lit(True).alias("_admin"))
    target = accounts.withColumnsRenamed({"officer_id": "_officer"})
    rows = requests.join(actors, "actor_id", "left").join(target, "account_id", "left").join(several, F.lit(True), "left")
    by = lambda k: F.create_map(*(F.lit(x) for a, m in ACCOUNT_MOVES.items() for x in (a, m[k])))[F.col("action")]
    starts = F.lit(False)
    for action, (roles, _, _) in ACCOUNT_MOVES.items():
        starts = starts | ((F.col("action") == action) & F.col("role").isin(*roles))
    promotion = F.col("action").isin("promote_committee", "promote_admin")
    problem = (
        F.when(F.col("_admin").isNull(), "admin required")
        .when(~F.col("action").isin(*ACCOUNT_MOVES), "unsupported action")
        .when(F.length("reason") > 500, "reason too long")
        .when(F.col("role").isNull(), "no such account")
        .when(~F.col("active"), "inactive account")
        .when(F.col("version") != F.col("expected_version"), "account changed")
        .when((F.col("account_id") == F.col("actor_id")) & (F.col("action") != "link_officer"), "own access")
        .when(~starts, "not from this role")
        .when(promotion & ~F.col("status").eqNullSafe("approved"), "not verified")
        .when((F.col("action") == "demote_member") & (F.col("role") == "admin") & ~F.col("_several"), "last admin")
    )
    rows = rows.withColumn("_problem", problem)
    first = F.row_number().over(Window.partitionBy("account_id", F.col("_problem").isNull()).orderBy("request_id"))
    rows = rows.withColumn("_problem", F.when(F.col("_problem").isNull() & (first > 1), "account changed").otherwise(F.col("_problem")))
    ok, demoted = F.col("_problem").isNull(), F.col("action") == "demote_member"
    first_demotion = rows.where(ok & demoted & (F.col("role") == "admin")).agg(F.min("request_id").alias("_first"))
    rows = rows.join(first_demotion, F.lit(True), "left")
    later = ok & demoted & (F.col("role") == "admin") & (F.col("request_id") > F.col("_first"))
    rows = rows.withColumn("_problem", F.when(later, "one administrator at a time").otherwise(F.col("_problem")))
    lowered = F.when(F.col("status") == "approved", "verified").otherwise("member")
    role = F.when(ok & demoted, lowered).when(ok, F.coalesce(by(1), "role")).otherwise(F.col("role"))
    status = F.when(ok, F.coalesce(by(2), "status")).otherwise(F.col("status"))
    officer = F.when(ok & demoted, None).when(ok & (F.col("action") == "link_officer"), F.col("officer_id")).otherwise(F.col("_officer"))
    outcome = F.coalesce("_problem", F.lit("done"))
    version = (F.col("version") + F.when(ok, 1).otherwise(0)).alias("version")
    return rows.select("request_id", "account_id", outcome.alias("outcome"), role.alias("role"), status.alias("status"), officer.alias("officer_id"), version)


def roster_matches(names: DataFrame, officers: DataFrame) -> DataFrame:
    """(name, academic_year, officer_id, outcome): names that are one active officer's; a year is optional."""
    key = lambda c: F.lower(F.trim(c))
    people = officers.where("active").select("officer_id", key("name").alias("_k"), F.col("academic_year").alias("_y"))
    fits = (key("name") == F.col("_k")) & (F.col("academic_year").isNull() | (F.col("academic_year") == F.col("_y")))
    rows = names.join(people, fits, "left").groupBy("name", "academic_year").agg(F.count("officer_id").alias("_n"), F.min("officer_id").alias("_id"))
    outcome = F.when(F.trim("name") == "", "empty name").when(F.col("_n") == 0, "no active officer").when(F.col("_n") > 1, "several officers").otherwise("matched")
    return rows.select("name", "academic_year", F.when(outcome == "matched", F.col("_id")).alias("officer_id"), outcome.alias("outcome"))


def public_resources(resources: DataFrame, articles: DataFrame) -> DataFrame:
    """Approved, fresh, public resources with the title and address of the article they come from."""
    a = articles.select(F.col("article_id"), F.col("title").alias("source_article_title"), F.col("url").alias("source_article_url"))
    open_ = resources.where((F.col("review_status") == "approved") & ~F.col("is_stale") & (F.col("visibility") == "public"))
    return open_.join(a, "article_id").drop("article_id", "review_status", "is_stale", "visibility")


def benchmark_rows(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a benchmark file: a JSON list of them, or an object that holds the list as `queries`."""
    item = "query string, source_family string, category string, primary_expected_ids array<string>, expected_retrieval_unit_ids array<string>, acceptable_expected_ids array<string>"
    raw = spark.read.schema(f"queries array<struct<{item.replace(' string', ':string').replace(' array', ':array')}>>, {item}").option("multiLine", True).json(path)
    wrapped = raw.where("queries is not null").select(F.explode("queries").alias("q")).select("q.*")
    rows = wrapped.unionByName(raw.where("queries is null").drop("queries"))
    first = F.coalesce(F.when(F.size("primary_expected_ids") > 0, F.col("primary_expected_ids")), F.col("expected_retrieval_unit_ids"))
    return rows.select("query", "source_family", "category", first.alias("primary_ids"), F.col("acceptable_expected_ids").alias("acceptable_ids"))


def export_rows(ranked: DataFrame, units: DataFrame) -> DataFrame:
    """A row a result with rank, score, state and provenance, for comparing retrieval elsewhere."""
    have = lambda c: F.col(c) if c in units.columns else F.lit(None).cast("string").alias(c)
    provenance = F.struct(*(have(c) for c in ("source_url", "permalink", "relative_path", "content_hash"))).alias("provenance")
    u = units.select("unit_id", "source_type", "source_record_id", "source_version_id", "title", "authority", "visibility", "is_current", "is_stale", "source_area", provenance)
    return ranked.select("query", "unit_id", "rank", "score").join(u, "unit_id")


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as JSON lines in one file (rows are sums already)."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def previews(rows: DataFrame, column: str = "content", most: int = 220) -> DataFrame:
    return rows.withColumn("preview", F.substring(F.regexp_replace(column, "[\\r\\n]+", " "), 1, most))


def outcome_of(status_code: Column, timed_out: Column) -> Column:
    """What a delivery attempt came to: posted, rejected (may be tried again) or unknown (must not be)."""
    return F.when(timed_out | status_code.isNull() | (status_code >= 500), "unknown").when(status_code.between(200, 299), "posted").otherwise("rejected")


def snapshot_event(action: Column, record: Column) -> Column:
    """An outbox payload: the action with the record as it stood, as JSON."""
    return F.to_json(F.struct(action.alias("action"), record.alias("record")), {"ignoreNullFields": "false"})


def links_in_messages(messages: DataFrame) -> DataFrame:
    """(message_id, url, canonical, domain): links of a message, each canonical address once, as first written."""
    rows = messages.select("message_id", F.posexplode(text.urls(F.col("text"))).alias("n", "url"))
    rows = rows.withColumn("canonical", text.canonical_url(F.col("url")))
    first = F.row_number().over(Window.partitionBy("message_id", "canonical").orderBy("n"))
    rows = rows.withColumn("_k", first).where("_k = 1")
    return rows.select("message_id", "url", "canonical", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))).alias("domain"))
