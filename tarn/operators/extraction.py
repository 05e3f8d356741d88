"""Obligations, timing rules, steps, resources, contacts and topics, extracted from article text by fixed rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text

# First match decides.
REQUIREMENT_TYPES = (
    ("\\b(form|application|submit)\\b", "required_form"),
    ("finance|budget|claim|reimburse|purchase|receipt|invoice", "financial_rule"),
    ("risk|insurance|safety|incident|welfare|under 18", "compliance_obligation"),
    ("train|course", "required_training"),
    ("eligible|eligibility|qualif", "eligibility_rule"),
    ("document|record|evidence|receipt", "documentation_requirement"),
)
APPLIES_TO = (
    ("driver", "driver"),
    ("coach", "coach or instructor"),
    ("committee member", "committee member"),
    ("treasurer", "treasurer"),
    ("chair", "chair"),
    ("club or society", "club or society"),
    ("under 18", "activities involving under-18s"),
)
OBLIGATION = "\\b(must|shall|required|need to|needs to|have to|you are expected to)\\b"
MANDATORY = "\\b(must|shall|required|have to)\\b"
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = f"(?i)\\b(?:\\d{{1,2}}(?:st|nd|rd|th)?\\s+(?:{MONTH})(?:\\s+\\d{{4}})?|(?:{MONTH})\\s+\\d{{1,2}}(?:st|nd|rd|th)?,?(?:\\s+\\d{{4}})?|\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})\\b"


def first_match(value: Column, rules, otherwise=None) -> Column:
    out = F.lit(otherwise).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("record_id"), F.posexplode(text.sentences(F.col(text_col))).alias("n", "sentence"))
    return rows.withColumn("low", F.lower("sentence"))


def _distinct(rows: DataFrame, *keys: str) -> DataFrame:
    """The first sentence of equal ones in a record, in order."""
    by = Window.partitionBy("record_id", *keys).orderBy("n")
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def obligations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record_id, n, sentence, requirement_type, mandatory, applies_to); "need to" obliges but is not mandatory."""
    rows = _sentences(docs, id_col, text_col).where(F.col("low").rlike(OBLIGATION))
    rows = _distinct(rows, "low")
    return rows.select(
        "record_id",
        "n",
        "sentence",
        first_match(F.col("low"), REQUIREMENT_TYPES, "operational_requirement").alias("requirement_type"),
        F.col("low").rlike(MANDATORY).alias("mandatory"),
        first_match(F.col("low"), APPLIES_TO).alias("applies_to"),
    )


def timing_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record_id, n, sentence, kind, days, working_days, on_date): up to five rules a sentence.

    Ordinal endings are taken off digits only, so dates in August are read like others.
    """
    low, value = F.col("low"), F.col("sentence")
    notice = "(?:at least\\s+)?(\\d+)\\s+(working|business|calendar)?\\s*days?\\s+(?:in advance|before|prior to)"
    lasting = "(?:allow|within|takes?|processing time of)\\s+(\\d+)\\s+(working|business|calendar)?\\s*days?"
    date = F.regexp_extract(value, DATE, 0)
    parsed = scalar.human_date(date)
    has_date = date != ""

    def rule(when: Column, kind: Column, days=None, working=None, on=None) -> Column:
        item = F.struct(kind.alias("kind"), (days if days is not None else F.lit(None).cast("int")).alias("days"), (working if working is not None else F.lit(None).cast("boolean")).alias("working_days"), (on if on is not None else F.lit(None).cast("date")).alias("on_date"))
        return F.when(when, item)

    part = lambda p, g: F.regexp_extract(low, p, g)
    rules = F.array(
        rule(low.rlike(notice), F.lit("relative_notice"), part(notice, 1).try_cast("int"), part(notice, 2).isin("working", "business")),
        rule(low.rlike(lasting), F.lit("duration"), part(lasting, 1).try_cast("int"), part(lasting, 2).isin("working", "business")),
        rule(has_date & low.rlike("\\b(close|closing|deadline|due|open|opens|submit|application|from|to|between)\\w*\\b"), F.when(parsed.isNotNull(), "absolute_date").otherwise("date_window"), on=parsed),
        rule(low.rlike("\\b(every|each|annual|annually|per year|every year)\\b") & (has_date | low.rlike("year|september|term")), F.lit("recurring_window")),
        rule(low.rlike("\\b(before|prior to)\\s+(the\\s+)?(start|beginning) of term\\b"), F.lit("seasonal_term")),
    )
    rows = _sentences(docs, id_col, text_col).select("record_id", "n", "sentence", "low", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    rows = rows.select("record_id", "n", "sentence", "low", "r.*")
    return _distinct(rows, "low", "kind", "days", "working_days", "on_date").drop("low")


def steps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record_id, step, instruction): numbered lines, the first of each number, of records with two or more."""
    pattern = "^\\s*(?i:Step\\s*)?(\\d+)[.)\\-:]\\s*(\\S.*?)\\s*$"
    lines = docs.select(F.col(id_col).alias("record_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\\r\\n|\\n|\\r")).alias("n", "line"))
    found = lines.where(F.col("line").rlike(pattern)).select("record_id", "n", F.regexp_extract("line", pattern, 1).try_cast("int").alias("step"), text.collapsed(F.regexp_extract("line", pattern, 2)).alias("instruction"))
    found = _distinct(found.where("step is not null"), "step")
    found = found.withColumn("_all", F.count("*").over(Window.partitionBy("record_id"))).where("_all >= 2")
    return found.select("record_id", "step", "instruction")


def resources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", systems: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(record_id, url, name, resource_type, system): links of a text, named ones first, each address once.

    `systems` is (host pattern, system name): the caller's own hosts.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = lambda u: F.regexp_replace(F.trim(u), "[.,;:]+$", "")
    named = F.zip_with(F.regexp_extract_all(t, F.lit(text.MARKDOWN_LINK), 1), F.regexp_extract_all(t, F.lit(text.MARKDOWN_LINK), 2), lambda n, u: F.struct(trimmed(u).alias("url"), F.trim(n).alias("name")))
    bare = F.transform(F.regexp_extract_all(t, F.lit(text.URL), 0), lambda u: F.struct(trimmed(u).alias("url"), F.lit(None).cast("string").alias("name")))
    rows = docs.select(F.col(id_col).alias("record_id"), F.posexplode(F.concat(named, bare)).alias("n", "l")).select("record_id", "n", "l.*")
    rows = _distinct(rows.where(~F.lower("url").startswith("mailto:")), "url")
    both, host = F.lower(F.concat_ws(" ", "name", "url")), F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    system = first_match(host, systems)
    kind = (
        F.when(both.rlike("form|application|request"), "form")
        .when(system.isNotNull(), "system")
        .when(both.contains("template"), "template")
        .when(both.rlike("\\.(pdf|docx?|xlsx?|pptx?)($|[?#])") | both.contains("/attachments/"), "download")
        .otherwise("link")
    )
    return rows.select("record_id", "url", F.coalesce("name", "url").alias("name"), kind.alias("resource_type"), F.when(kind == "system", system).alias("system"))


def contacts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record_id, email, evidence): addresses with the line they stand in, each pair once."""
    lines = docs.select(F.col(id_col).alias("record_id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))
    lines = lines.where(F.col("line").contains("@"))
    return lines.select("record_id", F.explode(text.emails(F.col("line"))).alias("email"), text.collapsed(F.col("line")).alias("evidence")).distinct()


# The controlled vocabulary.
TOPIC_KEYWORDS = {
    "finance": ("finance", "budget", "claim", "reimburse", "purchase order", "invoice", "spend", "payment"),
    "funding": ("funding", "grant", "fund application", "funding application"),
    "sponsorship": ("sponsor", "sponsorship", "partner"),
    "events": ("event", "activity", "social", "stall", "ticket", "production"),
    "room_booking": ("room booking", "bookable space", "celcat", "venue"),
    "external_speakers": ("speaker", "supplier", "external partner"),
    "risk_compliance": ("risk", "insurance", "incident", "safety", "under 18", "compliance", "welfare concern"),
    "membership": ("membership", "membership types"),
    "marketing": ("newsletter", "marketing", "what's on", "communications"),
    "data_privacy": ("data", "privacy", "personal information"),
    "trips_transport": ("trip", "minibus", "transport", "driver", "boat party"),
    "training": ("training", "coach", "instructor"),
    "elections": ("election", "co-opt", "resignation"),
    "wellbeing": ("wellbeing", "belonging", "accessibility", "inclusivity", "content warning"),
    "services": ("helpdesk", "equipment", "refund", "space access"),
    "fundraising": ("fundrais",),
    "new_activities": ("incubator", "new activity"),
}
FOLDER_TOPICS = {
    "COMMITTEE MANAGEMENT": ("governance", "committee_management"),
    "FINANCES": ("finance",),
    "FUNDING": ("funding",),
    "SPONSORSHIPS": ("sponsorship",),
    "EVENTS & TRIPS": ("events", "trips_transport"),
    "ROOM BOOKINGS": ("room_booking",),
    "EXTERNALS & PARTNERSHIPS": ("external_speakers",),
    "COMPLIANCE & REGULATION": ("risk_compliance",),
    "MINIBUSES": ("trips_transport", "risk_compliance"),
    "TRAINING": ("training",),
    "BELONGING & WELLBEING": ("wellbeing",),
    "SERVICES": ("services",),
    "FUNDRAISING": ("fundraising",),
    "NEW ACTIVITIES INCUBATOR": ("new_activities",),
}
ROLE_TOPICS = {
    "chair": ("governance", "committee_management", "risk_compliance", "events", "finance", "funding"),
    "treasurer": ("finance", "funding", "sponsorship", "events", "trips_transport", "risk_compliance"),
    "secretary": ("governance", "committee_management", "membership", "room_booking", "training", "elections", "services"),
    "social_secretary": ("events", "room_booking", "risk_compliance", "trips_transport", "wellbeing", "services"),
    "events_officer": ("events", "room_booking", "risk_compliance", "trips_transport", "external_speakers", "services"),
    "competition_officer": ("events", "risk_compliance", "trips_transport", "funding"),
}
CRITICAL_TERMS = ("insurance", "reporting an incident", "under 18", "welfare concern", "high risk", "frozen account")
HIGH_TERMS = ("finance", "funding", "sponsor", "room booking", "minibus", "risk assessment", "event", "training", "election")
HIGH_TOPICS = ("finance", "funding", "sponsorship", "events", "room_booking", "risk_compliance", "trips_transport", "training", "governance")
MEDIUM_TOPICS = ("wellbeing", "services", "membership", "marketing", "data_privacy", "fundraising")
RELEVANCE = ("irrelevant", "low", "medium", "high", "critical")


def _any(value: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(value, F.lit(t)) for t in terms))


def classified(articles: DataFrame) -> DataFrame:
    """`articles` (title, category, folder, text) with topics, roles (both sorted), relevance and confidence.

    Title, category, folder and the first 4,000 characters are searched: an article opens with its summary.
    """
    hay = F.lower(F.concat_ws(" ", "title", "category", "folder", F.substring("text", 1, 4000)))
    folders = F.create_map(*(x for k, v in FOLDER_TOPICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    of_folder = F.coalesce(folders[F.upper(F.coalesce("folder", F.lit("")))], F.array().cast("array<string>"))
    by_word = F.filter(F.array(*(F.when(_any(F.col("_hay"), words), F.lit(t)) for t, words in TOPIC_KEYWORDS.items())), lambda t: t.isNotNull())
    rows = articles.withColumn("_hay", hay)
    rows = rows.withColumn("topics", F.array_sort(F.array_union(of_folder, by_word)))
    rows = rows.withColumn("topics", F.when(F.size("topics") == 0, F.array(F.lit("other"))).otherwise(F.col("topics")))
    overlap = lambda names: F.arrays_overlap("topics", F.array(*map(F.lit, names)))
    critical = _any(F.col("_hay"), CRITICAL_TERMS)
    high = overlap(HIGH_TOPICS) | _any(F.col("_hay"), HIGH_TERMS)
    level = lambda a, b, c, d, e: F.when(critical, a).when(high, b).when(overlap(MEDIUM_TOPICS), c).when(overlap(("other",)), d).otherwise(e)
    roles = F.filter(F.array(*(F.when(overlap(v), F.lit(k)) for k, v in sorted(ROLE_TOPICS.items()))), lambda r: r.isNotNull())
    rows = rows.withColumns({"relevance": level("critical", "high", "medium", "low", "low"), "confidence": level(*map(F.lit, (0.90, 0.84, 0.76, 0.55, 0.60)))})
    roles = F.when((F.size(roles) == 0) & F.col("relevance").isin("critical", "high"), F.array(F.lit("chair"))).otherwise(roles)
    return rows.withColumn("roles", roles).drop("_hay")


def at_least(relevance: Column, minimum: str) -> Column:
    return F.array_position(F.array(*map(F.lit, RELEVANCE)), relevance) >= RELEVANCE.index(minimum) + 1


def vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(topic, keyword) and (role, topic): the vocabulary as small tables."""
    topics = spark.createDataFrame([(t, w) for t, words in TOPIC_KEYWORDS.items() for w in words], "topic string, keyword string")
    roles = spark.createDataFrame([(r, t) for r, names in ROLE_TOPICS.items() for t in names], "role string, topic string")
    return topics, roles


def parsed_tickets(messages: DataFrame, officers: DataFrame, officer_id: str = "officer_id") -> DataFrame:
    """Tickets in archived messages (message_id, text, reactions array): code, title, fields, status, assigned officers.

    A check mark closes a ticket whatever its text says; "all committee" and "everyone" set assign_all, others are
    matched by first name.
    """
    header = "(?i)^\\s*(ACTION-\\d{3})\\s*[—–-]\\s*(.+?)\\s*$"
    first = F.split("text", "\n")[0]
    field = lambda name: F.nullif(F.trim(text.unescaped(F.regexp_extract("text", f"(?m)^\\s*{name}:\\s*(.*)$", 1))), F.lit(""))
    low = F.lower(F.coalesce(field("Status"), F.lit("")))
    priority = F.lower(F.coalesce(field("Priority"), F.lit("medium")))
    rows = messages.where(first.rlike(header)).select(
        "message_id",
        F.upper(F.regexp_extract(first, header, 1)).alias("code"),
        F.regexp_extract(text.unescaped(first), header, 2).alias("title"),
        field("People Assigned").alias("owner_text"),
        field("Due").alias("due_text"),
        F.when(priority.isin("low", "medium", "high", "urgent"), priority).otherwise("medium").alias("priority"),
        F.when(F.array_contains("reactions", "white_check_mark"), "completed").when(low.contains("in progress"), "in_progress").otherwise("open").alias("status"),
    )
    owner = F.lower(F.coalesce("owner_text", F.lit("")))
    rows = rows.withColumn("assign_all", owner.rlike("\\ball committee\\b|\\beveryone\\b"))
    words = rows.where(~F.col("assign_all")).select("message_id", F.explode(F.array_distinct(F.regexp_extract_all(owner, F.lit("[\\p{L}\\p{N}_]+"), 0))).alias("first"))
    people = officers.select(F.col(officer_id).alias("_officer"), F.lower(F.split(F.trim("name"), "\\s+")[0]).alias("first"))
    named = words.join(people, "first").groupBy("message_id").agg(F.array_sort(F.collect_set("_officer")).alias("officer_ids"))
    return rows.join(named, "message_id", "left").withColumn("officer_ids", F.coalesce("officer_ids", F.array()))


def due(articles: DataFrame, minimum: str | None = None, force: bool = False) -> DataFrame:
    """`articles` (id, content_hash, last_hash, what classified() reads) with `step`: extract or skipped_unchanged.

    Articles below the `minimum` relevance are left out. One is extracted if its text changed since it last was.
    """
    rows = articles
    if minimum is not None:
        rows = classified(rows).where(at_least(F.col("relevance"), minimum)).select(*articles.columns)
    same = F.col("content_hash").eqNullSafe(F.col("last_hash")) & F.lit(not force)
    return rows.withColumn("step", F.when(same, "skipped_unchanged").otherwise("extract"))


def refreshed(stored: DataFrame, work: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(article_id, kind, source_content_hash, found, is_stale): what is stored and what the rules find in the work now.

    `work` is due()'s rows with article_id and text; each rule gives record_id and its own columns, kept as JSON in
    `found`. What was extracted from another text of an article in work is stale; equal finds of one text are kept once.
    The rules work row by row and answer nothing where they find nothing, so one article cannot stop another.
    """
    asked = work.where("step = 'extract'")
    current = asked.select("article_id", F.col("content_hash").alias("_now"))

    def found(kind: str, rule) -> DataFrame:
        rows = rule(asked.select(F.col("article_id").alias("doc_id"), "text"))
        told = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns) if c != "record_id")))
        return rows.select(F.col("record_id").alias("article_id"), F.lit(kind).alias("kind"), told.alias("found"))

    new = reduce(DataFrame.unionByName, (found(k, r) for k, r in rules.items())).join(current, "article_id")
    new = new.select("article_id", "kind", F.col("_now").alias("source_content_hash"), "found", F.lit(False).alias("is_stale"))
    old = stored.join(current, "article_id", "left")
    stale = F.col("is_stale") | (F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("source_content_hash")))
    both = old.withColumn("is_stale", stale).select(*new.columns).unionByName(new)
    return both.groupBy("article_id", "kind", "source_content_hash", "found").agg(F.bool_and("is_stale").alias("is_stale"))


def finished(work: DataFrame) -> DataFrame:
    """`work` with last_hash moved on where it was extracted."""
    return work.withColumn("last_hash", F.when(F.col("step") == "extract", F.col("content_hash")).otherwise(F.col("last_hash")))
