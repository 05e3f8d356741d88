"""Registered queries of unit builders, incremental extraction, strategies and reactions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import builders, changes, evaluation, extraction
from ..sources.tables import UNITS_SQL, messages, table, units
from . import operations, retrieval

DAY = "timestamp_ntz'2024-01-01'"


def _articles(spark, folder):
    p = table(spark, folder, "pages")
    return p.select(F.col("page_id").alias("id"), F.sha2("html", 256).alias("content_hash"), F.col("url").alias("title"), F.when(F.col("page_id") % 2 == 0, "").alias("markdown"), F.col("html").alias("raw_html"), F.lit("help").alias("category"), F.lit("high").alias("relevance_review_status"), F.expr(DAY).alias("source_updated_at"), "url")


def _derived(spark, folder, nth):
    d = table(spark, folder, "documents").where(F.col("doc_id") % 5 == nth)
    i = F.col("doc_id")
    heading = F.when(i % 3 == 0, "").otherwise(F.substring("text", 1, 60))
    return d.select(i.alias("id"), F.sha2("text", 256).alias("source_content_hash"), heading.alias("heading"), F.when(i % 4 > 0, F.col("text")).alias("body"), F.floor(i / 5).alias("source_article_id"), F.col("lang").alias("topic_id"), F.lit("member").alias("visibility"), F.lit("approved").alias("review_status"), (i % 11 == 10).alias("is_stale"), F.expr(DAY).alias("source_updated_at"), F.lit(None).cast("string").alias("source_url"))


def _steps(spark, folder):
    i = F.col("p_partkey")
    return table(spark, folder, "part").select(i.alias("id"), F.lit("v").alias("source_content_hash"), F.when(i % 3 == 0, F.col("p_name")).alias("title"), (i % 7).alias("step_number"), F.col("p_name").alias("instruction"), F.when(i % 2 == 0, "dry").alias("condition"), (i % 9).alias("process_id"), F.lit("committee").alias("visibility"), F.lit("proposed").alias("review_status"), F.lit(False).alias("is_stale"), F.expr(DAY).alias("source_updated_at"), F.lit("u").alias("source_url"))


def _documents(spark, folder):
    i = F.col("doc_id")
    d = table(spark, folder, "documents")
    have = d.select(i.alias("id"), (i * 10).alias("current_version_id"), F.substring("text", 1, 40).alias("title"), F.col("source").alias("source_area"), (i % 13 == 12).alias("is_missing"), (i % 17 == 3).alias("is_unavailable"), F.expr(DAY).alias("filesystem_modified_at"), F.lit(None).cast("string").alias("source_url"), F.concat(F.col("source"), F.lit("/"), i.cast("string")).alias("relative_path"))
    return have, d.select((i * 10).alias("version_id"), F.col("text").alias("raw_text"), F.lit(None).cast("timestamp_ntz").alias("source_modified_at"), F.when(i % 19 == 1, "failed").otherwise("extracted").alias("extraction_status"))


def _messages(spark, folder):
    m = messages(spark, folder).select(F.col("message_id").alias("id"), "channel_id", F.when(F.col("turn") < 3, F.col("user")).alias("author_user_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("message_text"), (F.col("turn") == 5).alias("is_deleted"), F.expr(DAY).alias("posted_at"), F.lit(None).cast("timestamp_ntz").alias("edited_at"), F.lit(None).cast("string").alias("permalink"))
    channels = table(spark, folder, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("channel_id"), F.lower("n_name").alias("name"), (F.col("n_nationkey") % 4 != 1).alias("enabled"))
    users = m.select(F.col("author_user_id").alias("user_id")).where("user_id = 'user'").distinct().select("user_id", F.lit("").alias("display_name"), F.lit("A person").alias("real_name"))
    return m, channels.select("channel_id", "name"), users, channels.select("channel_id", "enabled")


def _mail(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("id"), F.sha2("c_name", 256).alias("content_hash"), F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("body_text"), F.concat(k.cast("string"), F.lit("@example.org")).alias("sender_address"), F.expr(DAY).alias("received_at"), F.lit(None).cast("timestamp_ntz").alias("modified_at"), F.lit(None).cast("string").alias("web_link"), (k % 8 == 0).alias("is_deleted"))


def _meetings(spark, folder):
    """Conversations as meetings: the first turn is the transcript as a whole, the second a summary, the third the notes."""
    c = table(spark, folder, "conversations")
    meetings = c.where("turn = 0").select(F.col("conv_id").alias("meeting_id"), F.concat(F.lit("Meeting "), F.col("conv_id").cast("string")).alias("title"), F.expr(DAY).alias("started_at"), F.expr(DAY).alias("source_updated_at"), (F.col("conv_id") % 6 == 5).alias("is_missing"), (F.col("conv_id") % 2 == 0).alias("online"))
    turn = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, builders.ARTIFACTS)), turn.cast("int") + 1)
    artifacts = c.where("turn < 3").select("conv_id", (F.col("conv_id") * 1000 + turn).alias("artifact_id"), F.col("conv_id").alias("meeting_id"), kind.alias("artifact_type"), F.col("text").alias("content"), F.lit("proposed").alias("review_status"), F.lit(None).cast("timestamp_ntz").alias("source_updated_at"), F.lit("ref").alias("source_reference"), ((F.col("conv_id") + turn) % 7 != 6).alias("is_current")).drop("conv_id")
    segments = c.where("conv_id % 3 = 0").select((F.col("conv_id") * 1000).alias("artifact_id"), F.col("turn").alias("seq"), (turn * 61000).alias("start_ms"), (turn * 61000 + 60000).alias("end_ms"), F.col("role").alias("speaker"), "text")
    return meetings, artifacts, segments


def _operational(spark, folder):
    i = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, (*builders.OPERATIONAL, "other"))), (i % 6 + 1).cast("int"))
    return table(spark, folder, "orders").select(i.alias("id"), kind.alias("record_type"), F.concat(F.lit("Task "), i.cast("string")).alias("title"), F.when(i % 2 == 0, F.col("o_orderpriority")).alias("description"), F.when(i % 3 == 0, "ws").alias("workstream"), F.when(i % 4 == 0, "").otherwise(F.lit("Sam")).alias("owner_text"), F.when(i % 5 == 0, "Friday").alias("due_text"), F.lit(None).cast("timestamp_ntz").alias("due_at"), F.col("o_orderstatus").alias("execution_status"), F.when(i % 7 == 0, "approved").otherwise("proposed").alias("review_status"), F.lit(3).alias("review_version"), F.lit("committee").alias("visibility"), (i % 10 != 9).alias("is_current"), F.expr(DAY).alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("occurred_at"))


def _sources(spark, folder):
    meetings, artifacts, segments = _meetings(spark, folder)
    derived = (builders.of_derived(_derived(spark, folder, i), kind) for i, kind in enumerate(builders.DERIVED))
    rows = builders.united(builders.of_articles(_articles(spark, folder)), *derived, builders.of_steps(_steps(spark, folder)), builders.of_documents(*_documents(spark, folder)), builders.of_messages(*_messages(spark, folder)), builders.of_mail(_mail(spark, folder)), builders.of_meetings(meetings, artifacts, segments), builders.of_operations(_operational(spark, folder)))
    return rows, builders.of_transcripts(meetings, artifacts, segments)


def unit_builders(spark, folder):
    """Every source's rows, before they are cut."""
    rows = builders.united(*_sources(spark, folder))
    return rows.select("source_type", "record_id", "version_id", "title", F.sha2("content", 256).alias("content_hash"), "source_parent_id", "source_area", "topic", "channel", "author", "visibility", "review_status", "authority", "is_stale", "source_url", "relative_path", "chunk_index", "start_ms", "end_ms")


def index_units(spark, folder):
    """The whole index by source: units, different keys and ids, characters."""
    rows = builders.index_units(*_sources(spark, folder))
    return rows.groupBy("source_type").agg(F.count("*").alias("units"), F.countDistinct("unit_id").alias("ids"), F.sum(F.length("content")).alias("characters"))


_NONE = "null::varchar"
BUILDERS_SQL = f"""with parts as (select conv_id * 1000 as artifact_id, turn, '[' || lpad((turn * 61 // 60)::varchar, 2, '0') || ':' || lpad((turn * 61 % 60)::varchar, 2, '0') || '] ' as stamp from conversations),
derived as (select doc_id, (['requirement', 'timing_rule', 'process', 'resource', 'contact'])[doc_id % 5 + 1] as kind, (['Requirement', 'Timing Rule', 'Process', 'Resource', 'Contact'])[doc_id % 5 + 1] as named, case when doc_id % 3 = 0 then '' else substr(text, 1, 60) end as heading, case when doc_id % 4 > 0 then nullif(text, '') end as body, text, lang from documents),
titled as (select *, case when heading = '' then 'Knowledge ' || named else heading end as title from derived),
met as (select conv_id, 'Meeting ' || conv_id as title from conversations where turn = 0 and conv_id % 6 <> 5),
op as (select *, (['operational_decision', 'operational_action', 'operational_commitment', 'operational_question', 'operational_status', null])[o_orderkey % 6 + 1] as kind from orders where o_orderkey % 10 <> 9)
select 'article' as source_type, page_id::varchar as record_id, sha256(html) as version_id, url as title, sha256(html) as content_hash, {_NONE} as source_parent_id, 'help' as source_area, {_NONE} as topic, {_NONE} as channel, {_NONE} as author, 'internal' as visibility, 'high' as review_status, 'article_source' as authority, false as is_stale, url as source_url, {_NONE} as relative_path from pages
union all select 'knowledge_' || kind, doc_id::varchar, sha256(text), title, sha256(title || chr(10) || chr(10) || coalesce(body, heading)), (doc_id // 5)::varchar, null, lang, null, null, 'member', 'approved', 'approved_operational', doc_id % 11 = 10, null, null from titled
union all select 'knowledge_process_step', p_partkey::varchar, 'v', t, sha256(t || chr(10) || chr(10) || p_name || case when p_partkey % 2 = 0 then chr(10) || chr(10) || 'Condition: dry' else '' end), (p_partkey % 9)::varchar, null, null, null, null, 'committee', 'proposed', 'approved_operational', false, 'u', null from (select *, case when p_partkey % 3 = 0 then p_name else 'Process step ' || p_partkey % 7 end as t from part)
union all select 'document', doc_id::varchar, (doc_id * 10)::varchar, substr(text, 1, 40), sha256(text), null, source, null, null, null, 'internal', null, 'governance', false, null, source || '/' || doc_id from documents where doc_id % 13 <> 12 and doc_id % 17 <> 3 and doc_id % 19 <> 1
union all select 'slack_message', (conv_id * 1000 + turn)::varchar, sha256(text), '#' || lower(n_name), sha256(text), 'C' || n_nationkey, null, null, lower(n_name), case when turn < 3 and role = 'user' then 'A person' end, 'internal', null, 'committee_record', false, null, null from conversations join nation on n_nationkey = conv_id % 7 where n_nationkey % 4 <> 1 and turn <> 5
union all select 'mail_message', c_custkey::varchar, sha256(c_name), c_name, sha256(c_name || chr(10) || chr(10) || c_mktsegment), null, null, null, null, c_custkey || '@example.org', 'internal', 'source_generated', 'mail', false, null, null from customer where c_custkey % 8 <> 0
union all select 'meeting_' || k, conv_id::varchar, (conv_id * 1000 + turn)::varchar, case when turn = 0 then title else title || ' — ' || k end, sha256(text), conv_id::varchar, null, null, null, null, 'internal', 'proposed', 'meeting_' || k, false, case when turn > 0 and conv_id % 2 = 0 then 'ref' end, null
  from (select *, (['transcript', 'summary', 'notes'])[turn + 1] as k from conversations join met using (conv_id)) where turn < 3 and (conv_id + turn) % 7 <> 6 and not (turn = 0 and conv_id % 3 = 0)
union all select kind, o_orderkey::varchar, '3', t, sha256(concat_ws(chr(10) || chr(10), t, case when o_orderkey % 2 = 0 then o_orderpriority end, case when o_orderkey % 3 = 0 then 'Workstream: ws' end, case when o_orderkey % 4 > 0 then 'Owner: Sam' end, case when o_orderkey % 5 = 0 then 'Due: Friday' end, 'Status: ' || o_orderstatus)),
  null, null, null, null, null, 'committee', case when o_orderkey % 7 = 0 then 'approved' else 'proposed' end, case when o_orderkey % 7 = 0 then 'approved_operational' else 'operational_candidate' end, false, null, null from (select *, 'Task ' || o_orderkey as t from op where kind is not null)"""


def unit_sources(spark, folder):
    """Every source's rows but the grouped transcripts."""
    return unit_builders(spark, folder).where("chunk_index is null").drop("chunk_index", "start_ms", "end_ms")


def _gold(spark, folder):
    """For the question of the two lists: documents whose title holds "and", the first five by id; the next two will do."""
    u = units(spark, folder).where("title ilike '%and%'").select("unit_id")
    ids = u.orderBy("unit_id").limit(7).agg(F.array_sort(F.collect_list("unit_id")).alias("ids"))
    return ids.select(F.lit("the and").alias("query"), F.slice("ids", 1, 5).alias("primary_ids"), F.slice("ids", 6, 2).alias("acceptable_ids"))


def strategy_lists(spark, folder):
    u, words, near = retrieval._lists(spark, folder)
    return evaluation.strategies(words, near, u)


def strategy_metrics(spark, folder):
    rows = evaluation.evaluated(strategy_lists(spark, folder), _gold(spark, folder))
    return evaluation.averaged(rows, ["strategy"]).select("strategy", "hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "mrr")


def strategy_failures(spark, folder):
    join = lambda c: F.array_join(c, ",").alias(c)
    return evaluation.failures(strategy_lists(spark, folder), _gold(spark, folder)).select("strategy", "query", join("expected"), join("acceptable"), join("returned"))


_FUSED = """select '{name}' as strategy, unit_id, row_number() over (order by round(coalesce(1.0::double / (60 + lexical_rank), 0) + coalesce({weight}::double / (60 + semantic_rank), 0)
  + case u.authority when 'approved_operational' then 0.012 when 'article_source' then 0.008 when 'governance' then 0.008 else 0.0 end::double + case when u.is_current then 0.004 else 0.0 end::double, 9) desc, unit_id)::int as rank
  from lx full join sx using (unit_id) join units u using (unit_id) qualify rank <= 100"""
_STRATEGIES = f"""with {retrieval._LISTS}, capped as (select unit_id, semantic_rank, row_number() over (partition by source_type, case when source_type = 'document' then source_record_id else source_parent_id end order by semantic_rank) as n from sx join units using (unit_id)),
ranked as (select 'weighted_fts' as strategy, unit_id, lexical_rank as rank from lx union all select 'semantic', unit_id, semantic_rank from sx union all {_FUSED.format(name="rrf_equal", weight="1.0")} union all {_FUSED.format(name="rrf_semantic_2", weight="2.0")}
  union all select 'semantic_primary_exact', unit_id, semantic_rank from sx union all select 'semantic_primary_exact_dedup', unit_id, row_number() over (order by semantic_rank)::int from capped where n <= 2)"""
STRATEGY_LISTS_SQL = _STRATEGIES + " select strategy, 'the and' as query, unit_id, rank from ranked"
_GOLD_SQL = """, ids as (select list(unit_id order by unit_id) as ids from (select unit_id from units where title ilike '%and%' order by unit_id limit 7)),
ways as (select distinct strategy from (values ('weighted_fts'), ('semantic'), ('rrf_equal'), ('rrf_semantic_2'), ('semantic_primary_exact'), ('semantic_primary_exact_dedup')) t(strategy)),
firsts as (select strategy, min(rank) filter (list_contains(ids[1:7], unit_id)) as f, list(unit_id order by rank) filter (rank <= 5) as top from ways left join ranked using (strategy), ids group by strategy)"""
STRATEGY_METRICS_SQL = _STRATEGIES + _GOLD_SQL + " select strategy, " + ", ".join(f"(coalesce(f, 999) <= {k})::int::double as hit_at_{k}" for k in (1, 3, 5, 10)) + ", round(coalesce(1.0::double / f, 0), 4) as mrr from firsts"
STRATEGY_FAILURES_SQL = _STRATEGIES + _GOLD_SQL + " select strategy, 'the and' as query, array_to_string(ids[1:5], ',') as expected, array_to_string(ids[6:7], ',') as acceptable, array_to_string(coalesce(top, []), ',') as returned from firsts, ids where coalesce(f, 999) > 5"

TERMS = ("und", "the", "Les", "zzzz")


def label_selection(spark, folder):
    return evaluation.labelled(units(spark, folder), TERMS)


LABEL_SQL = f"""with {UNITS_SQL}, t as (select unnest([{", ".join(f"'{t}'" for t in TERMS)}]) as term)
select term, unit_id from units join t on contains(lower(title), lower(term)) or contains(lower(content), lower(term))
qualify row_number() over (partition by term order by lower(title) <> lower(term), not contains(lower(title), lower(term)), length(content) desc, unit_id) = 1"""


def run_counters(spark, folder):
    return changes.run_counters(operations.cdc_snapshot_diff(spark, folder))


RUN_COUNTERS_SQL = f"with diff as ({operations.CDC_SQL}) select change_type as change, count(*) as n from diff group by 1 union all select 'seen', count(*) from diff"


def reactions(spark, folder):
    """Events as reactions to the conversations they fall on, twice each and some without a name."""
    e = table(spark, folder, "events")
    one = F.struct(F.when(F.col("value") < 20, " ").otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("name"), F.array(F.col("user_id").cast("string"), F.col("user_id").cast("string"), F.lit("u1")).alias("users"))
    return changes.reactions(e.select((F.col("event_id") % 90).alias("message_id"), F.array(one, one).alias("reactions")))


REACTIONS_SQL = "select distinct event_id % 90 as message_id, event_type as name, unnest([user_id::varchar, 'u1']) as user_id from events where value >= 20"


def incremental_extraction(spark, folder):
    """Links and addresses, found in documents whose text changed, beside what earlier texts gave."""
    i = F.col("doc_id")
    d = operations._articles(spark, folder)
    work = d.select(i.alias("article_id"), "text", F.sha2("text", 256).alias("content_hash"), F.when(i % 2 == 0, F.sha2("text", 256)).when(i % 3 == 0, "older").alias("last_hash"))
    stored = d.select(i.alias("article_id"), F.lit("contact").alias("kind"), F.when(i % 2 == 0, F.sha2("text", 256)).otherwise("older").alias("source_content_hash"), F.lit("{}").alias("found"), (i % 5 == 0).alias("is_stale"))
    rows = extraction.refreshed(stored, extraction.due(work), {"contact": extraction.contacts, "resource": extraction.resources})
    return rows.groupBy("article_id", "kind", "source_content_hash", "is_stale").agg(F.count("*").alias("n"))


QUERIES = {
    "unit_sources": (unit_sources, BUILDERS_SQL),
    "unit_builders": (unit_builders, None),
    "index_units": (index_units, None),
    "strategy_lists": (strategy_lists, STRATEGY_LISTS_SQL),
    "strategy_metrics": (strategy_metrics, STRATEGY_METRICS_SQL),
    "strategy_failures": (strategy_failures, STRATEGY_FAILURES_SQL),
    "label_selection": (label_selection, LABEL_SQL),
    "run_counters": (run_counters, RUN_COUNTERS_SQL),
    "reactions": (reactions, REACTIONS_SQL),
    "incremental_extraction": (incremental_extraction, None),
}
