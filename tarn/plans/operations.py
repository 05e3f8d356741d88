"""Registered change-detection, evaluation, extraction and operations queries and the SQL they are held against."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import documents, policies, scalar, text
from ..functions.access import ROLES, Filters, visible
from ..operators import changes, chunking, evaluation, extraction, operations, reviews
from ..sources import chat, listing
from ..sources.files import html_text
from ..sources.tables import DELIVERIES_SQL, EMBEDDINGS_SQL, MESSAGES_SQL, NOW, UNITS_SQL, deliveries, messages, table, unit_embeddings, units
from .retrieval import _ELIGIBLE_SQL, SEMANTIC_SQL, _eligible, semantic_topk

N = "timestamp '2024-02-01'"


def doc_dedup_hash(spark, folder):
    return changes.duplicate_groups(table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), "hash", "doc_id")


def version_latest(spark, folder):
    e = table(spark, folder, "events")
    return chunking.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts")


def _customers(spark, folder):
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 9 != 1).select(k, "c_name", F.when(k % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 4 == 0, "OLD").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (k % 7 == 0).alias("deleted"))
    return old, c.where(k % 8 != 3).select(k, "c_name", "c_acctbal", "c_mktsegment")


def cdc_snapshot_diff(spark, folder):
    old, new = _customers(spark, folder)
    out = changes.snapshot_diff(old, new, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], deleted="deleted")
    return out.select("c_custkey", "change_type", F.array_join("fields_changed", ",").alias("fields"))


CDC_SQL = """with o as (select c_custkey as k, c_name as n, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as b, case when c_custkey % 4 = 0 then 'OLD' else c_mktsegment end as m, c_custkey % 7 = 0 as gone from customer where c_custkey % 9 <> 1),
n as (select c_custkey as k, c_name as n, c_acctbal as b, c_mktsegment as m from customer where c_custkey % 8 <> 3),
d as (select k, o.n is null as fresh, n.n is null as missing, coalesce(gone, false) as gone, concat_ws(',', case when o.n is distinct from n.n then 'c_name' end, case when o.b is distinct from n.b then 'c_acctbal' end, case when o.m is distinct from n.m then 'c_mktsegment' end) as f from o full join n using (k)),
t as (select k as c_custkey, case when fresh then 'created' when missing then 'missing' when gone then 'restored' when f <> '' then 'updated' else 'unchanged' end as change_type, f, gone from d)
select c_custkey, change_type, case when change_type = 'updated' then f else '' end as fields from t where not (change_type = 'missing' and gone)"""


def upsert_latest(spark, folder):
    old, new = _customers(spark, folder)
    rows = changes.upsert(old.drop("deleted").withColumn("v", F.lit(1)), new.withColumn("v", F.lit(2)), ["c_custkey"], F.desc("v"))
    return rows.select("c_custkey", "c_acctbal", "c_mktsegment", "v")


UPSERT_SQL = """with o as (select c_custkey, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 4 = 0 then 'OLD' else c_mktsegment end as c_mktsegment, 1 as v from customer where c_custkey % 9 <> 1
union all select c_custkey, c_acctbal, c_mktsegment, 2 from customer where c_custkey % 8 <> 3)
select c_custkey, c_acctbal, c_mktsegment, v from o qualify row_number() over (partition by c_custkey order by v desc) = 1"""


def insert_if_absent(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return changes.insert_absent(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), "hash").select("hash")


def _recording(spark, folder):
    """Conversations as the rows of a recorded workspace: roots and their replies, some of these in the history as well."""
    m = messages(spark, folder)
    turn = F.col("turn")
    raw = F.to_json(F.struct("ts", F.when(turn > 0, F.col("thread_ts")).alias("thread_ts"), "user", "text", F.when(turn % 7 == 5, F.lit("channel_join")).when(turn % 3 == 2, F.lit("thread_broadcast")).alias("subtype")))
    rows = m.select(F.when(turn == 0, "message").otherwise("reply").alias("kind"), F.col("channel_id").alias("channel"), "ts", raw.alias("raw"), "turn")
    both = rows.unionByName(rows.where("turn % 3 = 2").withColumn("kind", F.lit("message"))).drop("turn")
    person = m.select("user").distinct().select(F.lit("user").alias("kind"), F.to_json(F.struct(F.col("user").alias("id"), F.col("user").alias("name"), F.struct(F.lit(" ").alias("display_name"), F.upper("user").alias("real_name"), F.concat(F.upper("user"), F.lit("@x.org")).alias("email")).alias("profile"), (F.col("user") == "system").alias("is_bot"))).alias("raw"))
    place = m.select("channel_id").distinct().select(F.lit("channel").alias("kind"), F.to_json(F.struct(F.col("channel_id").alias("id"), F.concat(F.lit("room-"), F.col("channel_id")).alias("name"), (F.col("channel_id") == "C3").alias("is_private"))).alias("raw"))
    return both.unionByName(person, allowMissingColumns=True).unionByName(place, allowMissingColumns=True)


def chat_messages(spark, folder):
    return chat.messages(_recording(spark, folder), "https://chat.example")


def chat_people_and_places(spark, folder):
    rows = _recording(spark, folder)
    a = chat.users(rows).select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "name", "email", F.col("is_bot").alias("flag"))
    b = chat.channels(rows).select(F.lit("channel").alias("kind"), F.col("channel_id").alias("id"), "name", F.lit(None).cast("string").alias("email"), F.col("is_private").alias("flag"))
    return a.unionByName(b)


CHAT_SQL = f"""with {MESSAGES_SQL} select channel_id, ts, case when turn > 0 then thread_ts end as thread_ts, turn > 0 as is_reply, "user" as user_id, text, null::varchar as edited_ts,
  'https://chat.example/archives/' || channel_id || '/p' || replace(ts, '.', '') || case when turn > 0 then '?thread_ts=' || thread_ts || '&cid=' || channel_id else '' end as permalink from messages where turn % 7 <> 5"""
CHAT_WHO_SQL = f"""with {MESSAGES_SQL} select distinct 'user' as kind, "user" as id, upper("user") as name, lower("user") || '@x.org' as email, "user" = 'system' as flag from messages
union all select distinct 'channel', channel_id, 'room-' || channel_id, null, channel_id = 'C3' from messages"""


def _listing(spark, folder):
    """Documents as a listing of one root a source: some are gone, some changed, some cannot be looked at, one root was not listed."""
    i = F.col("doc_id")
    kind = F.when(i % 97 == 0, "error").when(i % 41 == 0, "excluded").otherwise("file")
    rows = table(spark, folder, "documents").where(i % 10 != 0)
    kind = F.when(F.col("source").isin("src1", "src2", "src3"), F.when(kind == "excluded", kind).otherwise("file")).otherwise(kind)
    return rows.where("source <> 'src5'").select(F.col("source").alias("root"), kind.alias("kind"), F.concat(F.col("lang"), F.lit("/d"), i.cast("string")).alias("norm_path"), (F.length("text") + F.when(i % 7 == 0, 1).otherwise(0)).alias("size"))


def listing_summary(spark, folder):
    return listing.summary(_listing(spark, folder))


def listing_diff(spark, folder):
    rows = _listing(spark, folder)
    stored = table(spark, folder, "documents").where("doc_id % 8 <> 0").select(F.col("source").alias("root"), F.concat(F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("norm_path"), F.length("text").alias("size"))
    return changes.listed_diff(stored, rows.where("kind = 'file'"), listing.summary(rows), fields=("size",))


_LISTED_SQL = """l as (select source as root, lang || '/d' || doc_id as norm_path, length(text) + (doc_id % 7 = 0)::int as size,
  case when doc_id % 97 = 0 and source not in ('src1', 'src2', 'src3') then 'error' when doc_id % 41 = 0 and not (doc_id % 97 = 0) then 'excluded' else 'file' end as kind from documents where doc_id % 10 <> 0 and source <> 'src5'),
s as (select root, count(*) filter (kind = 'file') as files, count(*) filter (kind = 'excluded') as excluded, count(*) filter (kind = 'error') as errors, count(*) filter (kind = 'error') = 0 as complete from l group by root)"""
LISTING_SUMMARY_SQL = f"with {_LISTED_SQL} select * from s"
LISTING_DIFF_SQL = f"""with {_LISTED_SQL}, o as (select source as root, lang || '/d' || doc_id as norm_path, length(text) as size from documents where doc_id % 8 <> 0)
select coalesce(o.root, n.root) as root, coalesce(o.norm_path, n.norm_path) as norm_path,
  case when o.root is null then 'created' when n.root is null then case when complete then 'missing' else 'unknown' end when o.size = n.size then 'unchanged' else 'updated' end as change_type
from o full join (select * from l where kind = 'file') n on n.root = o.root and n.norm_path = o.norm_path left join s on s.root = coalesce(o.root, n.root)"""


def rename_match(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    old = d.select("hash", F.concat_ws("/", "source", name).alias("path"))
    new = d.select("hash", F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("source"), F.lit("/new-"), name)).otherwise(F.concat(F.lit("moved/"), name)).alias("path"))
    return changes.renames(old, new)


RENAME_SQL = """with d as (select sha256(text) as hash, source || '/d' || doc_id as old_path, case when doc_id % 10 = 0 then source || '/new-d' || doc_id else 'moved/d' || doc_id end as new_path,
  case when doc_id % 10 = 0 then 'renamed' else 'moved' end as change_type from documents)
select hash, min(old_path) as old_path, min(new_path) as new_path, min(change_type) as change_type from d group by hash having count(*) = 1"""


def two_strike_delete(spark, folder):
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    state = c.select(k, F.when(k % 3 == 0, 1).otherwise(0).alias("misses"), F.when(k % 5 == 0, F.expr("timestamp_ntz'2024-01-31 22:00:00'")).when(k % 5 < 4, F.expr("timestamp_ntz'2024-01-31 12:00:00'")).alias("last_checked"), F.lit(False).alias("deleted"))
    return changes.two_strikes(state, c.where(k % 2 == 0).select(k), "c_custkey", NOW)


TWO_STRIKE_SQL = f"""with s as (select c_custkey, case when c_custkey % 3 = 0 then 1 else 0 end as misses, case when c_custkey % 5 = 0 then timestamp '2024-01-31 22:00:00' when c_custkey % 5 < 4 then timestamp '2024-01-31 12:00:00' end as last_checked, c_custkey % 2 = 0 as seen from customer),
d as (select *, last_checked is null or misses = 0 or last_checked <= {N} - interval 6 hour as due from s),
m as (select c_custkey, seen, due, last_checked, case when seen then 0 when due then misses + 1 else misses end as misses from d)
select c_custkey, misses::int as misses, case when seen or due then {N} else last_checked end as last_checked, not seen and misses >= 2 as deleted from m"""


def recheck_rotation(spark, folder):
    c = table(spark, folder, "customer")
    k = F.col("c_custkey")
    state = c.select(k, "c_nationkey", F.when(k % 6 == 0, 1).otherwise(0).alias("misses"), F.when(k % 5 != 0, F.timestamp_add("HOUR", (k % 400).cast("int"), F.expr("timestamp_ntz'2024-01-01'"))).alias("last_checked"), (k % 11 == 0).alias("deleted"))
    return changes.recheck_order(state, "c_nationkey", "c_custkey", 20).select("c_nationkey", "c_custkey", "turn")


RECHECK_SQL = """select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by (c_custkey % 6 = 0) desc, case when c_custkey % 5 <> 0 then timestamp '2024-01-01' + to_hours((c_custkey % 400)::int) end asc nulls first, c_custkey)::int as turn
from customer where c_custkey % 11 <> 0 qualify turn <= 20"""


def hwm_lookback(spark, folder):
    e = table(spark, folder, "events")
    marks = e.where("event_type <> 'view'").groupBy("event_type").agg(F.max("ts").alias("high_water"))
    return changes.since_watermark(e, marks, "event_type", "ts", timedelta(days=7), datetime(2024, 1, 28)).select("event_id", "event_type")


HWM_SQL = """with m as (select event_type, max(ts) as h from events where event_type <> 'view' group by event_type)
select event_id, event_type from events left join m using (event_type) where ts >= coalesce(h - interval 7 day, timestamp '2024-01-28')"""


def checkpoint_numeric(spark, folder):
    return changes.latest_checkpoint(messages(spark, folder), "channel_id", "ts")


def message_cdc(spark, folder):
    m = messages(spark, folder)
    h, i = F.sha2("text", 256), F.col("message_id")
    stored = m.where(i % 5 != 2).select(F.col("message_id").alias("ts"), F.when(i % 4 == 0, "x").otherwise(h).alias("content_hash"), (i % 6 == 0).alias("deleted"))
    return changes.message_changes(stored, m.select(F.col("message_id").alias("ts"), h.alias("content_hash"), (i % 9 == 0).alias("deleted")))


MESSAGE_CDC_SQL = f"""with {MESSAGES_SQL}, m as (select message_id as i, sha256(text) as h from messages)
select i as ts, case when i % 5 = 2 then case when i % 9 = 0 then 'skipped' else 'created' end when i % 9 = 0 then case when i % 6 = 0 then 'skipped' else 'deleted' end when i % 6 = 0 then 'restored' when i % 4 = 0 then 'edited' else 'skipped' end as change from m"""


def status_latest_wins(spark, folder):
    return operations.latest_status(deliveries(spark, folder), "user_id", "status", "reported_at")


STATUS_SQL = f"""with {DELIVERIES_SQL}, r as (select user_id, status, reported_at, case status when 'complained' then 5 when 'bounced' then 4 when 'failed' then 3 when 'delivered' then 2 when 'sent' then 1 else 0 end as s from deliveries)
select user_id, status, reported_at from r qualify row_number() over (partition by user_id order by reported_at desc, s desc, status desc) = 1"""


def delivery_health(spark, folder):
    d = deliveries(spark, folder)
    s, recent = F.col("status"), F.col("reported_at") >= F.expr("timestamp_ntz'2024-01-25'")
    measures = {"sent": s == "sent", "delivered": s == "delivered", "bounced": s == "bounced", "complained": s == "complained", "recent": recent, "recent_bounced": recent & (s == "bounced"), "large": F.col("value") > 50}
    return operations.health(d, measures, {"oldest_bounce": ("reported_at", s == "bounced")}, {"newest": ("reported_at", F.lit(True))})


HEALTH_SQL = f"""with {DELIVERIES_SQL} select count(*) filter (status = 'sent') as sent, count(*) filter (status = 'delivered') as delivered, count(*) filter (status = 'bounced') as bounced, count(*) filter (status = 'complained') as complained,
  count(*) filter (reported_at >= timestamp '2024-01-25') as recent, count(*) filter (reported_at >= timestamp '2024-01-25' and status = 'bounced') as recent_bounced, count(*) filter (value > 50) as large, min(reported_at) filter (status = 'bounced') as oldest_bounce, max(reported_at) as newest from deliveries"""


def queue_health(spark, folder):
    o = table(spark, folder, "orders")
    s = F.col("o_orderstatus")
    return operations.health(o, {"open": s == "O", "done": s == "F", "partial": s == "P", "urgent_open": (s == "O") & (F.col("o_orderpriority") == "1-URGENT")}, {"oldest_open": ("o_orderdate", s == "O")}, by=["o_orderpriority"])


QUEUE_SQL = """select o_orderpriority, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'P') as partial, count(*) filter (o_orderstatus = 'O' and o_orderpriority = '1-URGENT') as urgent_open, min(o_orderdate) filter (o_orderstatus = 'O') as oldest_open from orders group by o_orderpriority"""


def oldest_checkpoint_due(spark, folder):
    return operations.refresh_due(table(spark, folder, "events").groupBy("event_type").agg(F.max("ts").alias("checked_at")), NOW)


DUE_SQL = f"""with c as (select event_type, max(ts) as t from events group by event_type) select count(*) as checkpoints, min(t) as oldest, bool_or(t is null) or min(t) <= {N} - interval 12 hour as due from c"""


def _outbox(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "posted").when(k % 3 == 0, "pending").when(k % 3 == 1, "retry").otherwise("sending")
    return o.select(k.alias("id"), F.col("o_custkey").alias("ticket_id"), state.alias("state"), (k % 9).cast("int").alias("attempts"), F.timestamp_add("HOUR", (k % 48).cast("int"), F.expr("timestamp_ntz'2024-01-31'")).alias("retry_at"), F.timestamp_add("HOUR", (k % 30).cast("int"), F.expr("timestamp_ntz'2024-01-31'")).alias("claimed_at"))


_OUTBOX = """outbox as (select o_orderkey as id, o_custkey as ticket_id, case when o_orderstatus = 'F' then 'posted' when o_orderkey % 3 = 0 then 'pending' when o_orderkey % 3 = 1 then 'retry' else 'sending' end as state, (o_orderkey % 9)::int as attempts,
  timestamp '2024-01-31' + to_hours((o_orderkey % 48)::int) as retry_at, timestamp '2024-01-31' + to_hours((o_orderkey % 30)::int) as claimed_at from orders)"""


def outbox_head_of_line(spark, folder):
    return operations.head_of_line(_outbox(spark, folder), "ticket_id", "id").select("id", "ticket_id", "state")


def outbox_claim(spark, folder):
    return operations.claimable(_outbox(spark, folder), NOW).select("id", "ticket_id", "state")


HEAD_SQL = f"with {_OUTBOX} select id, ticket_id, state from outbox where state <> 'posted' qualify row_number() over (partition by ticket_id order by id) = 1"
CLAIM_SQL = f"""with {_OUTBOX}, h as (select * from outbox where state <> 'posted' qualify row_number() over (partition by ticket_id order by id) = 1)
select id, ticket_id, state from h where state = 'pending' or (state = 'retry' and retry_at <= {N}) or (state = 'sending' and claimed_at <= {N} - interval 2 hour) order by id limit 20"""


def outbox_settle(spark, folder):
    o = _outbox(spark, folder)
    outcomes = o.where("id % 4 <> 0").select("id", F.when(F.col("id") % 4 == 1, "posted").when(F.col("id") % 4 == 2, "rejected").otherwise("unknown").alias("outcome"))
    return operations.settled(o, outcomes, NOW).select("id", "state", "attempts", "retry_at")


SETTLE_SQL = f"""with {_OUTBOX}, x as (select *, case id % 4 when 1 then 'posted' when 2 then 'rejected' when 3 then 'unknown' end as outcome from outbox),
y as (select id, state as was, outcome, retry_at, case when state = 'posted' then 'posted' when outcome = 'posted' then 'posted' when outcome = 'rejected' then 'retry' when outcome = 'unknown' then 'uncertain' else state end as state,
  (attempts + case when outcome is not null and state <> 'posted' then 1 else 0 end)::int as attempts from x)
select id, state, attempts, case when state = 'retry' then case when outcome = 'rejected' then {N} + to_seconds(least(3600, 30 * pow(2, least(attempts, 7)))::int) else retry_at end end as retry_at from y"""


def retry_backoff(spark, folder):
    return _outbox(spark, folder).select("attempts", scalar.backoff_seconds(F.col("attempts")).alias("seconds")).distinct()


def thread_parent_join(spark, folder):
    m = messages(spark, folder).where("turn <> 0 or conv_id % 5 <> 0")
    return changes.with_parent(m, "channel_id", "ts", "thread_ts").select("message_id", "parent_ts")


PARENT_SQL = f"""with {MESSAGES_SQL}, m as (select * from messages where turn <> 0 or conv_id % 5 <> 0)
select a.message_id, b.ts as parent_ts from m a left join m b on a.channel_id = b.channel_id and a.thread_ts = b.ts and a.thread_ts <> a.ts"""


def thread_recap(spark, folder):
    m = messages(spark, folder)
    line = F.concat_ws(": ", "user", F.substring("text", 1, 40))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("recap"), F.count("*").alias("turns"))


RECAP_SQL = "select conv_id, string_agg(role || ': ' || substr(text, 1, 40), chr(10) order by turn) as recap, count(*) as turns from conversations group by conv_id"


def transcript_groups(spark, folder):
    """Conversations as transcripts: some lines have no start, no end, no speaker or no words."""
    c, n = table(spark, folder, "conversations"), F.col("turn")
    start = F.when(n % 5 != 3, n * 15000)
    end = F.when(n % 4 == 1, None).when(n % 4 == 3, 0).otherwise(n * 15000 + 14000)
    return chunking.transcript_groups(c.select(F.col("conv_id").alias("artifact_id"), n.alias("seq"), start.alias("start_ms"), end.alias("end_ms"), F.when(n % 6 != 5, F.col("role")).otherwise("").alias("speaker"), F.when(n % 7 == 6, "  ").otherwise(F.col("text")).alias("text")))


TRANSCRIPT_SQL = """with recursive l as (select conv_id, case when turn % 5 <> 3 then turn * 15000 end as s, case when turn % 4 in (1, 3) then case when turn % 5 <> 3 then turn * 15000 end else turn * 15000 + 14000 end as e, row_number() over (partition by conv_id order by turn) as n,
  case when turn % 5 <> 3 then '[' || lpad((turn * 15 // 3600)::varchar, 2, '0') || ':' || lpad((turn * 15 // 60 % 60)::varchar, 2, '0') || ':' || lpad((turn * 15 % 60)::varchar, 2, '0') || '] ' else '' end
    || case when turn % 6 <> 5 and role <> '' then role || ': ' else '' end || case when turn % 7 = 6 then '  ' else text end as line from conversations),
g as (select conv_id, n, 0 as grp, length(line) as size from l where n = 1
union all select l.conv_id, l.n, case when size + 1 + length(line) > 2400 then grp + 1 else grp end, case when size + 1 + length(line) > 2400 then length(line) else size + 1 + length(line) end from g join l on l.conv_id = g.conv_id and l.n = g.n + 1)
select conv_id as artifact_id, grp as "group", arg_min(s, n) filter (s is not null) as start_ms, (list(e order by n desc))[1] as end_ms, string_agg(line, chr(10) order by n) as content from g join l using (conv_id, n) group by conv_id, grp"""


def evidence_join(spark, folder):
    m = messages(spark, folder).select("message_id", "channel_id", F.sha2("text", 256).alias("content_hash"), F.timestamp_add("HOUR", (F.col("message_id") % 1500).cast("int"), F.expr("timestamp_ntz'2023-12-01'")).alias("at"), (F.col("turn") == 3).alias("deleted"))
    channels = m.select("channel_id").distinct().select("channel_id", (F.col("channel_id") != "C3").alias("is_public"), (F.col("channel_id") != "C5").alias("enabled"))
    u = m.select(F.concat(F.lit("u"), F.col("message_id").cast("string")).alias("unit_id"), F.col("message_id").cast("string").alias("source_record_id"), F.when(F.col("message_id") % 4 == 0, "old").otherwise(F.col("content_hash")).alias("source_version_id"), F.lit(0).alias("chunk_index"), F.lit(True).alias("is_current"), F.lit("t").alias("title"))
    return operations.evidence(m, channels, u, NOW)


EVIDENCE_SQL = f"""with {MESSAGES_SQL}, m as (select message_id, channel_id, turn, timestamp '2023-12-01' + to_hours((message_id % 1500)::int) as sent_at from messages)
select 'u' || message_id as unit_id, message_id, 't' as title, round(1 - greatest(0.0, (epoch_us({N}) - epoch_us(sent_at)) / 86400000000.0 / 30.0), 6) as score from m
where sent_at >= {N} - interval 30 day and turn <> 3 and channel_id not in ('C3', 'C5') and message_id % 4 <> 0 order by score desc, unit_id limit 12"""


def owner_recipients_join(spark, folder):
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    assignees = o.select(F.col("o_orderkey").alias("ticket_id"), F.col("o_custkey").alias("officer_id"))
    officers = c.select(F.col("c_custkey").alias("officer_id"), F.col("c_nationkey").alias("profile_id"), (F.col("c_acctbal") > 0).alias("active"))
    profiles = n.select(F.col("n_nationkey").alias("profile_id"), F.concat("n_name", F.lit("@Example.org")).alias("email"), (F.col("n_regionkey") != 3).alias("active"), F.when(F.col("n_regionkey") < 2, "committee").otherwise("member").alias("role"))
    return operations.recipients(assignees, officers, profiles, ("committee", "admin"))


RECIPIENTS_SQL = "select distinct o_orderkey as ticket_id, lower(n_name || '@Example.org') as email from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where c_acctbal > 0 and n_regionkey < 2"


def ticket_history(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.col("user_id").alias("actor_id"), F.col("ts").alias("at"))
    c = table(spark, folder, "customer")
    people = c.select(F.col("c_custkey").alias("actor_id"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_mktsegment"), F.lit("@x.org"))).alias("email"))
    return operations.ticket_history(e, people.where("actor_id % 7 <> 0"), 500)


HISTORY_SQL = """select event_id, user_id as actor_id, ts as at, case when c_custkey is null then 'Unknown' when c_custkey % 3 <> 0 then c_name when c_custkey % 2 = 0 then c_mktsegment else 'Unknown' end as display_name
from events left join customer on c_custkey = user_id and c_custkey % 7 <> 0 order by ts desc, event_id desc limit 500"""


def reference_numbering(spark, folder):
    n = table(spark, folder, "nation")
    k = F.col("n_nationkey")
    rows = n.select(k, F.when(k % 3 == 0, F.concat(F.lit("ACTION-"), F.lpad((k * 41).cast("string"), 3, "0"))).alias("code"))
    return operations.numbered(rows, "code", ["n_nationkey"])


NUMBER_SQL = """with r as (select n_nationkey, case when n_nationkey % 3 = 0 then 'ACTION-' || lpad((n_nationkey * 41)::varchar, 3, '0') end as code from nation),
t as (select max(replace(code, 'ACTION-', '')::int) as top from r)
select n_nationkey, code from r where code is not null union all select n_nationkey, 'ACTION-' || printf('%03d', top + row_number() over (order by n_nationkey)) from r, t where code is null"""


def progress_map(spark, folder):
    e = table(spark, folder, "events").select((F.col("event_id") % 40).alias("ticket"), "user_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("open").alias("status"), F.struct("ts", "event_id").alias("at"))
    out = operations.progress_maps(e, "ticket", "user_id", "status", "at")
    pairs = F.array_join(F.transform(F.map_entries("statuses"), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"])), ",")
    return out.select("ticket", pairs.alias("statuses"), "done", "everyone")


PROGRESS_SQL = """with l as (select event_id % 40 as ticket, user_id, arg_max(case when event_type = 'purchase' then 'completed' else 'open' end, struct_pack(ts := ts, event_id := event_id)) as s from events group by 1, 2)
select ticket, string_agg(user_id || '=' || s, ',' order by user_id) as statuses, count(*) filter (s = 'completed') as done, count(*) as everyone from l group by ticket"""


def json_props_extract(spark, folder):
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(k.isNotNull()).alias("with_k"), F.max(k).alias("max_k"))


JSON_SQL = "select event_type, sum((props->>'k')::int)::bigint as sum_k, count(props->>'k') as with_k, max((props->>'k')::int) as max_k from events group by event_type"


def _guarded_tables(spark, folder):
    """Units and their vectors, orders as records with lines as evidence and customers as assignees and profiles, parts as requirements."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    seen, states = ("internal", "committee", "member", "public"), ("approved", "proposed", "approved")
    k, c, p = F.col("o_orderkey"), F.col("c_custkey"), F.col("p_partkey")
    orders = table(spark, folder, "orders").select(k.alias("record_id"), pick(seen, k).alias("visibility"), pick(states, k).alias("review_status"), (k % 5 != 0).alias("is_current"), pick(("action_item", "decision"), F.floor(k / 2)).alias("record_type"))
    made = {
        "retrieval_units": lambda: units(spark, folder),
        "retrieval_embeddings": lambda: unit_embeddings(spark, folder).select("unit_id", F.lit(1).alias("one")),
        "operational_records": lambda: orders,
        "operational_record_evidence": lambda: table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_linenumber"),
        "ticket_assignees": lambda: table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("ticket_id"), F.col("l_linenumber").alias("nth")),
        "operational_review_events": lambda: table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("record_id"), "l_quantity"),
        "profiles": lambda: table(spark, folder, "customer").select(F.concat(F.lit("u"), c.cast("string")).alias("auth_user_id")),
        "knowledge_requirements": lambda: table(spark, folder, "part").select(p, pick(seen, p).alias("visibility"), pick(states, p).alias("review_status"), (p % 7 == 0).alias("is_stale")),
        "documents": lambda: table(spark, folder, "documents").select("doc_id", F.when(F.col("source") == "src0", "filesystem").when(F.col("source") != "src1", F.col("source")).alias("source_type")),
        "ingestion_runs": lambda: table(spark, folder, "region"),
    }
    return lambda name: made[name]()


GUARDED = ("retrieval_units", "retrieval_embeddings", "operational_records", "operational_record_evidence", "ticket_assignees", "operational_review_events", "profiles", "knowledge_requirements", "documents", "ingestion_runs")


def policy_rows(spark, folder):
    """How many rows of each table a reader of each role may see."""
    tables = _guarded_tables(spark, folder)
    counts = [policies.guarded(name, policies.Reader(role, "u7"), tables).agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), F.lit(name).alias("table_name"), "n") for role in ROLES for name in GUARDED]
    return reduce(DataFrame.unionByName, counts)


POLICY_SQL = f"""with {UNITS_SQL}, {EMBEDDINGS_SQL}, roles(role, rank) as (values ('anon', 0), ('member', 1), ('verified', 2), ('committee', 3), ('admin', 4)),
level as (select 'public' as seen, 0 as need union all select 'member', 1 union all select 'committee', 3 union all select 'internal', 4),
u as (select role, unit_id from units join roles on rank = 4 or (source_type not in ('document', 'slack_message', 'meeting_transcript', 'meeting_summary', 'meeting_notes') and review_status = 'approved' and is_current and not is_stale and not is_deleted
  and rank >= (select need from level where seen = visibility))),
o as (select o_orderkey as id, (['internal', 'committee', 'member', 'public'])[o_orderkey % 4 + 1] as seen, (['approved', 'proposed', 'approved'])[o_orderkey % 3 + 1] = 'approved' and o_orderkey % 5 <> 0 as good, o_orderkey // 2 % 2 = 0 as action from orders),
r as (select role, rank, o.* from o join roles on rank = 4 or (good and (rank >= 1 and seen in ('member', 'public') or rank >= 3 and seen = 'committee'))),
p as (select p_partkey as k, (['internal', 'committee', 'member', 'public'])[p_partkey % 4 + 1] as seen, (['approved', 'proposed', 'approved'])[p_partkey % 3 + 1] = 'approved' and p_partkey % 7 <> 0 as good from part),
n as (select role, 'retrieval_units' as t, count(*) as n from u group by role
  union all select role, 'retrieval_embeddings', count(*) from u join unit_embeddings using (unit_id) group by role
  union all select role, 'operational_records', count(*) from r group by role
  union all select role, 'operational_record_evidence', count(*) from r join lineitem on l_orderkey = id group by role
  union all select role, 'ticket_assignees', count(*) from r join lineitem on l_orderkey = id where action group by role
  union all select role, 'operational_review_events', count(*) from roles cross join lineitem join o on l_orderkey = id where rank = 4 or rank = 3 and good and action and seen = 'committee' group by role
  union all select role, 'profiles', count(*) from roles join customer on rank = 4 or c_custkey = 7 group by role
  union all select role, 'knowledge_requirements', count(*) from roles join p on rank >= 3 or rank >= 1 and good and seen in ('member', 'public') group by role
  union all select role, 'documents', count(*) from roles join documents on rank = 4 or rank = 3 and source is distinct from 'src0' group by role
  union all select role, 'ingestion_runs', count(*) from roles join region on rank = 4 group by role)
select role, t as table_name, coalesce(n, 0) as n from roles cross join (select unnest({list(GUARDED)}) as t) left join n using (role, t)"""


def _order_documents(spark, folder):
    """Orders as JSON texts with every kind of value; some are arrays, some no JSON at all."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(k.alias("id"), "o_orderpriority", (k % 3 == 0).alias("late"), F.struct((k % 7).alias("n"), F.struct(F.col("o_orderstatus").alias("s")).alias("deep")).alias("at"), F.array(k % 2, k % 5).alias("list")))
    body = F.when(k % 11 == 0, F.concat(F.lit('{"none":null,'), F.substring(body, 2, 10000))).when(k % 13 == 0, F.lit("[1,2]")).when(k % 17 == 0, F.lit("{broken")).otherwise(body)
    return table(spark, folder, "orders").select(k.alias("order_id"), F.col("o_orderstatus").alias("status"), body.alias("body"))


def json_kinds(spark, folder):
    """Every field of every document by key and kind of value, and what is no object."""
    docs = _order_documents(spark, folder)
    fields = documents.exploded(docs, "body", "order_id").groupBy("key", "kind").agg(F.count("*").alias("n"), F.min(F.when(F.col("kind") != "object", F.col("value"))).alias("least"))
    top = docs.select(F.coalesce(documents.kind(documents.parsed(F.col("body"))), F.lit("invalid")).alias("kind"))
    return fields.unionByName(top.groupBy("kind").agg(F.count("*").alias("n")), allowMissingColumns=True)


def json_set_path(spark, folder):
    """Documents with a value put deep inside, beside what was there."""
    docs = _order_documents(spark, folder)
    put = documents.with_value(F.col("body"), ("at", "deep", "put"), F.concat(F.lit('{"by":"'), F.col("status"), F.lit('"}')))
    out = docs.select("order_id", documents.parsed(put).alias("v"))
    return out.select("order_id", *(F.try_variant_get("v", F.lit(path), kind).alias(name) for name, path, kind in (("put_by", "$.at.deep.put.by", "string"), ("was", "$.at.deep.s", "string"), ("n", "$.at.n", "long"), ("id", "$.id", "long"))))


_BODIES_SQL = """b as (select o_orderkey as k, o_orderstatus as status, '{"id":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","late":' || (o_orderkey % 3 = 0) || ',"at":{"n":' || (o_orderkey % 7) || ',"deep":{"s":"' || o_orderstatus || '"}},"list":[' || (o_orderkey % 2) || ',' || (o_orderkey % 5) || ']}' as body from orders),
d as (select k, status, case when k % 11 = 0 then '{"none":null,' || body[2:] when k % 13 = 0 then '[1,2]' when k % 17 = 0 then '{broken' else body end as body from b)"""
JSON_KINDS_SQL = f"""with {_BODIES_SQL}, o as (select body from d where json_valid(body) and json_type(body) = 'OBJECT'),
f as (select unnest(json_keys(body)) as key, body from o), t as (select key, json_extract(body, '$.' || key) as value from f)
select key, case json_type(value) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind, count(*) as n, min(case when json_type(value) <> 'OBJECT' then value::varchar end) as least from t group by all
union all select null, case when not json_valid(body) then 'invalid' when json_type(body) = 'ARRAY' then 'array' else 'object' end, count(*), null from d group by all"""
JSON_SET_SQL = f"""with {_BODIES_SQL} select k as order_id, status as put_by, case when ok then status end as was, case when ok then k % 7 end as n, case when ok then k end as id
from (select *, json_valid(body) and coalesce(json_type(case when json_valid(body) then body end) = 'OBJECT', false) as ok from d)"""


def emails_extract(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


EMAILS_SQL = "select distinct doc_id, lower(regexp_replace(unnest(regexp_extract_all(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+')), '[.,;:)]+$', '')) as email from documents"


def links_extract(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.explode(text.urls(F.concat_ws(" ", "html", "url"))).alias("url"))


LINKS_SQL = "select distinct page_id, regexp_replace(unnest(regexp_extract_all(html || ' ' || url, 'https?://[^\\s)\\]>]+')), '[.,;:]+$', '') as url from pages"


def canonical_urls(spark, folder):
    p = table(spark, folder, "pages").withColumn("url", F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substring(url, 13)"), F.lit("#part")))
    return p.select("page_id", text.canonical_url(F.col("url")).alias("url"))


CANONICAL_SQL = """with u as (select page_id, regexp_replace(upper(substr(url, 1, 12)) || substr(url, 13), '#.*$', '') as u from pages), h as (select page_id, u, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*') as h from u)
select page_id, lower(h) || substr(u, length(h) + 1) as url from h"""

ARTICLES = [
    (1, "Trip forms", "EVENTS & TRIPS", "You must submit the form at least 5 working days in advance.\nDrivers need to keep a record. Chairs shall report every incident."),
    (2, "Budget rules", "FINANCES", "Claims close on 15 August 2026.\nApply every September before the start of term. See [the form](https://forms.example.org/claim.pdf) or write to Help@Example.org."),
    (3, "How to book", "ROOM BOOKINGS", "1. Choose a venue\n2) Send the request\nStep 3: Wait\n2. Again\nAllow 10 days. See https://example.org/rooms."),
    (4, "Nothing here", None, "Plain words only."),
]


def _articles(spark, folder):
    """Documents, with a few made-up articles that hold what the rules look for."""
    own = spark.createDataFrame([(-i, t, f, x) for i, t, f, x in ARTICLES], "doc_id long, title string, folder string, text string")
    d = table(spark, folder, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"), F.when(F.col("source") == "src1", "FINANCES").when(F.col("source") == "src2", "MINIBUSES").alias("folder"), "text")
    return d.unionByName(own)


def _lit(x):
    return "null" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ARTICLES_SQL = f"""articles as (select doc_id, substr(text, 1, 80) as title, case source when 'src1' then 'FINANCES' when 'src2' then 'MINIBUSES' end as folder, text from documents
union all select * from (values {", ".join(f"({-i}, {_lit(t)}, {_lit(f)}, {_lit(x)})" for i, t, f, x in ARTICLES)}) as v(doc_id, title, folder, text))"""


def topic_classify(spark, folder):
    out = extraction.classified(_articles(spark, folder).withColumn("category", F.lit(None).cast("string")))
    return out.select("doc_id", F.array_join("topics", ",").alias("topics"), "relevance", "confidence", F.array_join("roles", ",").alias("roles"))


def _topics_sql() -> str:
    holds = lambda terms: "(" + " or ".join(f"contains(hay, {_lit(t)})" for t in terms) + ")"
    topics = ", ".join(f"case when {holds(w)} then '{t}' end" for t, w in extraction.TOPIC_KEYWORDS.items())
    folders = " ".join(f"when {_lit(k)} then {list(v)}" for k, v in extraction.FOLDER_TOPICS.items())
    roles = ", ".join(f"case when list_has_any(topics, {list(v)}) then '{r}' end" for r, v in sorted(extraction.ROLE_TOPICS.items()))
    high = f"(list_has_any(topics, {list(extraction.HIGH_TOPICS)}) or {holds(extraction.HIGH_TERMS)})"
    medium = f"list_has_any(topics, {list(extraction.MEDIUM_TOPICS)})"
    level = lambda a, b, c, d, e: f"case when {holds(extraction.CRITICAL_TERMS)} then {a} when {high} then {b} when {medium} then {c} when list_contains(topics, 'other') then {d} else {e} end"
    return f"""with {ARTICLES_SQL}, h as (select doc_id, folder, lower(concat_ws(' ', title, folder, substr(text, 1, 4000))) as hay from articles),
t as (select *, list_sort(list_distinct(list_filter(list_concat(case upper(coalesce(folder, '')) {folders} else [] end, [{topics}]), lambda x: x is not null))) as found from h),
u as (select doc_id, hay, case when len(found) = 0 then ['other'] else found end as topics from t),
r as (select *, {level("'critical'", "'high'", "'medium'", "'low'", "'low'")} as relevance, {level("0.90", "0.84", "0.76", "0.55", "0.60")}::double as confidence, list_filter([{roles}], lambda x: x is not null) as roles from u)
select doc_id, array_to_string(topics, ',') as topics, relevance, confidence, array_to_string(case when len(roles) = 0 and relevance in ('critical', 'high') then ['chair'] else roles end, ',') as roles from r"""


def _gold(spark, folder):
    e = unit_embeddings(spark, folder).join(table(spark, folder, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("unit_id"), "label"), "unit_id")
    asked = e.where(F.col("unit_id").isin("00000000", "00000007", "00000019")).select(F.col("unit_id").alias("query"), "label")
    like = e.where("model = 'base'").select("unit_id", "label")
    ranked = asked.join(like, "label").withColumn("nth", F.row_number().over(Window.partitionBy("query", "label").orderBy("unit_id")))
    rows = ranked.where("nth <= 5").groupBy("query", "label").agg(F.array_sort(F.collect_list("unit_id")).alias("ids"))
    alternatives = F.when(F.col("query") == "00000007", F.slice("ids", 4, 2)).otherwise(F.array().cast("array<string>"))
    return rows.select("query", F.col("label").cast("string").alias("category"), F.slice("ids", 1, 3).alias("primary_ids"), alternatives.alias("acceptable_ids"))


def hit_at_k_mrr(spark, folder):
    ranked = semantic_topk(spark, folder).withColumnRenamed("semantic_rank", "rank")
    m = evaluation.query_metrics(ranked, _gold(spark, folder))
    return m.select("query", "category", "hit_at_1", "hit_at_3", "hit_at_5", "hit_at_8", "hit_at_10", F.round("mrr", 6).alias("mrr"), F.round("recall_at_5", 6).alias("recall_at_5"), F.round("recall_at_10", 6).alias("recall_at_10"))


_METRICS = f"""{SEMANTIC_SQL.rsplit("select * from k", 1)[0].rstrip()},
lab as (select lpad(vec_id::varchar, 8, '0') as unit_id, label from embeddings),
ids as (select a.unit_id as query, a.label, list(b.unit_id order by b.unit_id) as ids from lab a join lab b using (label) join unit_embeddings m on m.unit_id = b.unit_id and m.model = 'base' where a.unit_id in ('00000000', '00000007', '00000019') group by all),
gold as (select query, label::varchar as category, ids[1:3] as p, case when query = '00000007' then ids[4:5] else [] end as alt from ids),
f as (select g.query, g.category, g.p, g.alt, list(unit_id order by semantic_rank) filter (semantic_rank <= 20) as found from gold g left join k using (query) group by all),
m as (select *, list_min(list_filter(list_transform(found, lambda x, i: case when list_contains(list_concat(p, alt), x) then i end), lambda y: y is not null)) as first from f),
met as (select query, category, (coalesce(first, 999) <= 1)::int::double as hit_at_1, (coalesce(first, 999) <= 3)::int::double as hit_at_3, (coalesce(first, 999) <= 5)::int::double as hit_at_5, (coalesce(first, 999) <= 8)::int::double as hit_at_8, (coalesce(first, 999) <= 10)::int::double as hit_at_10,
  coalesce(1.0::double / first, 0) as mrr,
  case when len(alt) > 0 then list_has_any(found[1:5], list_concat(p, alt))::int::double else len(list_intersect(found[1:5], p))::double / len(p) end as recall_at_5,
  case when len(alt) > 0 then list_has_any(found[1:10], list_concat(p, alt))::int::double else len(list_intersect(found[1:10], p))::double / len(p) end as recall_at_10 from m)"""
HIT_SQL = f"{_METRICS} select query, category, hit_at_1, hit_at_3, hit_at_5, hit_at_8, hit_at_10, round(mrr, 6) as mrr, round(recall_at_5, 6) as recall_at_5, round(recall_at_10, 6) as recall_at_10 from met"


def metric_breakdown(spark, folder):
    ranked = semantic_topk(spark, folder).withColumnRenamed("semantic_rank", "rank")
    return evaluation.averaged(evaluation.query_metrics(ranked, _gold(spark, folder)), ["category"])


BREAKDOWN_SQL = f"{_METRICS} select category, count(*) as queries, " + ", ".join(f"round(avg({n}), 4) as {n}" for n in ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_8", "hit_at_10", "mrr", "recall_at_5", "recall_at_10")) + " from met group by category"


def latency_percentiles(spark, folder):
    return evaluation.latencies(table(spark, folder, "events"), "value", ["event_type"])


LATENCY_SQL = """with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events)
select event_type, median(value) as median, max(value) filter (i = greatest(floor(n * 0.95), 1)) as p95 from r group by event_type"""


def _benchmark(spark, folder):
    b = table(spark, folder, "benchmark")
    return b.select(F.concat_ws(" ", F.col("item_id").cast("string"), "text").alias("query"), F.when(F.col("item_id") % 9 == 0, "rare").otherwise(F.concat(F.lit("f"), (F.col("item_id") % 3).cast("string"))).alias("source_family"), F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")).alias("category"))


def hash_split(spark, folder):
    return evaluation.split(_benchmark(spark, folder), "tarn-split-1").select("query", "split")


SPLIT_SQL = """with b as (select item_id || ' ' || text as query, case when item_id % 9 = 0 then 'rare' else 'f' || (item_id % 3) end as f, 'c' || (item_id % 7) as c from benchmark),
h as (select *, sha256('tarn-split-1|' || query || '|' || f || '|' || c) as h from b),
o as (select *, row_number() over (order by h, query) <= greatest(1, round(count(*) over () * 0.30)) as o from h),
p as (select query, h, f, c, o or (count(*) over (partition by f) >= 2 and not bool_or(o) over (partition by f) and row_number() over (partition by f order by h, query) = 1) as o from o),
q as (select query, o or (count(*) over (partition by c) >= 2 and not bool_or(o) over (partition by c) and row_number() over (partition by c order by h, query) = 1) as o from p)
select query, case when o then 'holdout' else 'dev' end as split from q"""


def benchmark_validation(spark, folder):
    b = table(spark, folder, "benchmark")
    i = F.col("item_id")
    good = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(i.cast("string"), 12, "0"))
    rows = b.select(i.alias("row_id"), F.when(i % 10 == 0, " ").when(i % 4 == 1, "Same").otherwise(F.col("text")).alias("query"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(good)).alias("primary_ids"), F.when(i % 6 == 0, F.array(good)).when(i % 7 == 0, F.array(F.lit("nope"))).alias("acceptable_ids"))
    return evaluation.benchmark_errors(rows)


VALID_SQL = """with r as (select item_id as i, case when item_id % 10 = 0 then '' when item_id % 4 = 1 then 'same' else lower(trim(text)) end as q from benchmark)
select i as row_id, 'query is empty' as error from r where q = '' union all select i, 'duplicate query' from r where q <> '' qualify row_number() over (partition by q order by i) > 1
union all select i, 'no expected id' from r where i % 5 = 0 union all select i, 'duplicate id' from r where i % 6 = 0 and i % 5 <> 0 union all select i, 'invalid id' from r where i % 7 = 0 and i % 6 <> 0"""


def _targets(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("query"), F.lpad((F.col("doc_id") * 3).cast("string"), 8, "0").alias("unit_id"))


def target_status(spark, folder):
    return evaluation.target_status(_targets(spark, folder), units(spark, folder), unit_embeddings(spark, folder).where("model = 'base'"), _eligible())


TARGET_SQL = f"""with {UNITS_SQL}, {EMBEDDINGS_SQL}, t as (select 'q' || (doc_id % 50) as query, lpad((doc_id * 3)::varchar, 8, '0') as unit_id from documents)
select t.query, t.unit_id, case when u.unit_id is null then 'MISSING' when not is_current or is_deleted then 'NOT_CURRENT' when not {_ELIGIBLE_SQL} then 'EXCLUDED_BY_POLICY' when e.unit_id is null then 'NOT_EMBEDDED' else 'EVALUABLE' end as status
from t left join units u on u.unit_id = t.unit_id left join unit_embeddings e on e.unit_id = t.unit_id and e.model = 'base'"""


def _own_targets(spark, folder):
    """One query for every four documents."""
    return table(spark, folder, "documents").select(F.concat(F.lit("q"), F.floor(F.col("doc_id") / 4).cast("string")).alias("query"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("unit_id"))


def scoped_benchmark(spark, folder):
    return evaluation.in_scope(_own_targets(spark, folder), units(spark, folder), visible("admin") & Filters().column())


SCOPED_SQL = f"""with {UNITS_SQL}, t as (select 'q' || (doc_id // 4) as query, lpad(doc_id::varchar, 8, '0') as unit_id from documents)
select query from t left join units using (unit_id) group by query having bool_and(coalesce(is_current, false))"""


def status_transition_check(spark, folder):
    e = table(spark, folder, "events")
    state = F.element_at(F.array(*map(F.lit, ("proposed", "approved", "rejected", "superseded", "needs_review", "deferred"))), (F.col("event_id") % 6 + 1).cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("approve", "reject", "defer", "supersede", "needs_review", "edit_approve", "publish"))), (F.col("user_id") % 7 + 1).cast("int"))
    rows = e.select(state.alias("state"), action.alias("action"))
    return rows.groupBy("state", "action").agg(F.count("*").alias("n")).withColumn("to_state", reviews.next_state(F.col("state"), F.col("action")))


MOVES_SQL = """with e as (select (['proposed', 'approved', 'rejected', 'superseded', 'needs_review', 'deferred'])[event_id % 6 + 1] as state, (['approve', 'reject', 'defer', 'supersede', 'needs_review', 'edit_approve', 'publish'])[user_id % 7 + 1] as action from events)
select state, action, count(*) as n, case when state = 'deferred' then null when action in ('approve', 'edit_approve') then 'approved' when action = 'reject' then 'rejected'
  when action in ('needs_review', 'defer') then 'needs_review' when action = 'supersede' then 'superseded' end as to_state from e group by state, action"""


def review_fold(spark, folder):
    """Customers' reviews folded: where each stands, and how many of its events applied or were refused."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    log = e.select(
        i, F.lit("requirement").alias("knowledge_type"), F.col("user_id").cast("string").alias("record_id"), F.element_at(F.array(*map(F.lit, ("approve", "needs_review", "reject", "defer", "supersede"))), (i % 5 + 1).cast("int")).alias("action"), (i % 3 + 1).cast("int").alias("expected_version"),
        F.create_map().cast("map<string,string>").alias("patch"), F.lit(None).cast("string").alias("reason_code"), F.when(i % 2 == 0, "why").alias("reason_note"), F.lit(None).cast("string").alias("visibility"), F.lit("admin").alias("actor_role"), F.lit(True).alias("actor_active"),
    )
    none = F.lit(None).cast("string")
    records = table(spark, folder, "customer").select(F.lit("requirement").alias("knowledge_type"), F.col("c_custkey").cast("string").alias("record_id"), none.alias("process_id"), F.lit("proposed").alias("status"), F.lit(1).alias("version"), F.lit(False).alias("is_stale"), F.lit("internal").alias("visibility"), F.lit(None).cast("int").alias("step_number"))
    told = reviews.folded(records, log)
    counts = reviews.outcomes(told).groupBy("record_id").agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") != "applied").alias("refused"))
    rows = reviews.standing(told).join(counts, "record_id", "left")
    return rows.select(F.col("record_id").cast("long").alias("record_id"), F.col("status").alias("state"), "version", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("applied", "refused")))


REVIEW_FOLD_SQL = """with recursive commands as (select user_id as record_id, event_id, (['approve', 'needs_review', 'reject', 'defer', 'supersede'])[event_id % 5 + 1] as act, event_id % 3 + 1 as expected, event_id % 2 = 0 as reasoned, row_number() over (partition by user_id order by event_id) as n from events),
steps as (select c_custkey as record_id, 0::bigint as n, 'proposed' as state, 1 as version, 0::bigint as applied, 0::bigint as refused from customer
union all select record_id, n, case when not ok then state when act = 'approve' then 'approved' when act = 'reject' then 'rejected' when act = 'supersede' then 'superseded' else 'needs_review' end, version + ok::int, applied + ok::int, refused + 1 - ok::int from (
  select c.record_id, c.n, c.act, s.state, s.version, s.applied, s.refused, c.expected = s.version and (c.act <> 'reject' or c.reasoned) as ok from steps s join commands c on c.record_id = s.record_id and c.n = s.n + 1))
select record_id, state, version, applied, refused from steps qualify row_number() over (partition by record_id order by n desc) = 1"""


def priority_pivot(spark, folder):
    return operations.pivot_counts(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


PIVOT_SQL = "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as n_0, count(*) filter (o_orderstatus = 'O') as n_1, count(*) filter (o_orderstatus = 'P') as n_2, count(*) as n_all from orders group by o_orderpriority"


def union_legacy(spark, folder):
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"))
    return operations.union_legacy(p, o)


LEGACY_SQL = """select 'decision:' || p_partkey as record_id, 'decision' as record_type, p_name as title, 'approved' as review_status, null::varchar as execution_status from part
union all select 'action:' || o_orderkey, 'action', o_orderpriority, 'proposed', case o_orderstatus when 'F' then 'completed' when 'P' then 'in_progress' else 'open' end from orders"""


def default_row_if_empty(spark, folder):
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    default = spark.createDataFrame([(-1, "none")], "n_nationkey int, n_name string")
    return operations.or_default(n.where("n_nationkey > 1000"), default).unionByName(operations.or_default(n.where("n_nationkey < 3"), default))


DEFAULT_SQL = "select -1::int as n_nationkey, 'none' as n_name union all select n_nationkey, n_name from nation where n_nationkey < 3"


def account_cap_check(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("role"), (F.col("c_custkey") % 1000).alias("created_at"), (F.col("c_acctbal") > 5000).alias("active"))
    return operations.over_cap(c, "role").select("account_id", "role", "nth")


CAP_SQL = "select c_custkey as account_id, c_nationkey as role, row_number() over (partition by c_nationkey order by c_custkey % 1000, c_custkey)::int as nth from customer where c_acctbal > 5000 qualify nth > 2"


def rate_window(spark, folder):
    return operations.spaced(table(spark, folder, "events"), "user_id", "ts", 3600.0).select("event_id", "user_id")


RATE_SQL = "select event_id, user_id from events qualify coalesce((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1e6 >= 3600, true)"


def reminder_timers(spark, folder):
    e = table(spark, folder, "events").select((F.col("event_id") % 97).alias("ticket_id"), (F.col("user_id") % 4).alias("version"), F.col("ts").alias("at"))
    return operations.reminder_jobs(e, datetime(2024, 1, 2))


REMINDER_SQL = """with e as (select event_id % 97 as ticket_id, user_id % 4 as version, ts from events), m as (select ticket_id, max(version) as version from e group by ticket_id)
select ticket_id, min(ts) + interval 2 minute as due_at, min(ts) + interval 2 minute <= timestamp '2024-01-02' as due from e join m using (ticket_id, version) group by ticket_id"""


def version_notices(spark, folder):
    e = table(spark, folder, "events")
    return operations.version_notices(e.select(F.col("user_id").alias("account_id"), F.col("event_id").alias("version"), F.col("event_type").alias("status")))


NOTICE_SQL = "select user_id as account_id, event_id as version, lag(event_type) over w as from_status, event_type as to_status from events window w as (partition by user_id order by event_id) qualify lag(event_type) over w is distinct from event_type"


def html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def _rows(f):
    return lambda spark, folder: f(_articles(spark, folder))


QUERIES = {
    "doc_dedup_hash": (doc_dedup_hash, "select sha256(text) as hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1"),
    "version_latest": (version_latest, "select user_id, event_type, event_id, ts from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"),
    "cdc_snapshot_diff": (cdc_snapshot_diff, CDC_SQL),
    "upsert_latest": (upsert_latest, UPSERT_SQL),
    "insert_if_absent": (insert_if_absent, "select distinct sha256(text) as hash from documents where doc_id % 3 <> 0 and sha256(text) not in (select sha256(text) from documents where doc_id % 3 = 0)"),
    "rename_match": (rename_match, RENAME_SQL),
    "two_strike_delete": (two_strike_delete, TWO_STRIKE_SQL),
    "recheck_rotation": (recheck_rotation, RECHECK_SQL),
    "hwm_lookback": (hwm_lookback, HWM_SQL),
    "checkpoint_numeric": (checkpoint_numeric, f"with {MESSAGES_SQL} select channel_id, arg_max(ts, ts::double) as ts from messages group by channel_id"),
    "message_cdc": (message_cdc, MESSAGE_CDC_SQL),
    "status_latest_wins": (status_latest_wins, STATUS_SQL),
    "delivery_health": (delivery_health, HEALTH_SQL),
    "queue_health": (queue_health, QUEUE_SQL),
    "oldest_checkpoint_due": (oldest_checkpoint_due, DUE_SQL),
    "outbox_head_of_line": (outbox_head_of_line, HEAD_SQL),
    "outbox_claim": (outbox_claim, CLAIM_SQL),
    "outbox_settle": (outbox_settle, SETTLE_SQL),
    "retry_backoff": (retry_backoff, "select distinct (o_orderkey % 9)::int as attempts, least(3600, 30 * pow(2, least(o_orderkey % 9, 7)))::int as seconds from orders"),
    "thread_parent_join": (thread_parent_join, PARENT_SQL),
    "thread_recap": (thread_recap, RECAP_SQL),
    "transcript_groups": (transcript_groups, TRANSCRIPT_SQL),
    "evidence_join": (evidence_join, EVIDENCE_SQL),
    "owner_recipients_join": (owner_recipients_join, RECIPIENTS_SQL),
    "ticket_history": (ticket_history, HISTORY_SQL),
    "reference_numbering": (reference_numbering, NUMBER_SQL),
    "progress_map": (progress_map, PROGRESS_SQL),
    "json_props_extract": (json_props_extract, JSON_SQL),
    "policy_rows": (policy_rows, POLICY_SQL),
    "json_kinds": (json_kinds, JSON_KINDS_SQL),
    "json_set_path": (json_set_path, JSON_SET_SQL),
    "emails_extract": (emails_extract, EMAILS_SQL),
    "links_extract": (links_extract, LINKS_SQL),
    "canonical_urls": (canonical_urls, CANONICAL_SQL),
    "obligation_sentences": (_rows(extraction.obligations), None),
    "timing_rules": (_rows(extraction.timing_rules), None),
    "numbered_steps": (_rows(extraction.steps), None),
    "resource_links": (_rows(extraction.resources), None),
    "contact_lines": (_rows(extraction.contacts), None),
    "topic_classify": (topic_classify, _topics_sql()),
    "html_text": (html_to_text, None),
    "hit_at_k_mrr": (hit_at_k_mrr, HIT_SQL),
    "metric_breakdown": (metric_breakdown, BREAKDOWN_SQL),
    "latency_percentiles": (latency_percentiles, LATENCY_SQL),
    "hash_split": (hash_split, SPLIT_SQL),
    "benchmark_validation": (benchmark_validation, VALID_SQL),
    "target_status": (target_status, TARGET_SQL),
    "scoped_benchmark": (scoped_benchmark, SCOPED_SQL),
    "status_transition_check": (status_transition_check, MOVES_SQL),
    "chat_messages": (chat_messages, CHAT_SQL),
    "chat_people_and_places": (chat_people_and_places, CHAT_WHO_SQL),
    "listing_summary": (listing_summary, LISTING_SUMMARY_SQL),
    "listing_diff": (listing_diff, LISTING_DIFF_SQL),
    "review_fold": (review_fold, REVIEW_FOLD_SQL),
    "priority_pivot": (priority_pivot, PIVOT_SQL),
    "union_legacy": (union_legacy, LEGACY_SQL),
    "default_row_if_empty": (default_row_if_empty, DEFAULT_SQL),
    "account_cap_check": (account_cap_check, CAP_SQL),
    "rate_window": (rate_window, RATE_SQL),
    "reminder_timers": (reminder_timers, REMINDER_SQL),
    "version_notices": (version_notices, NOTICE_SQL),
}
