"""Registered queries of review transactions and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reviews
from ..sources.tables import table

ACTIONS = ("approve", "edit_approve", "reject", "needs_review", "defer", "supersede", "publish", "unpublish", "add_process_step", "remove_process_step", "link_resource", "unlink_resource", "edit_approve", "odd")
SEEN = ("internal", "committee", "member", "public", "odd")


def _of(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def records(spark, folder):
    """Customers as processes, their orders as steps, parts as requirements."""
    customer, orders, part = (table(spark, folder, t) for t in ("customer", "orders", "part"))

    def shaped(df, kind, key, of, number, fields):
        return df.select(F.lit(kind).alias("knowledge_type"), F.col(key).cast("string").alias("record_id"), of.cast("string").alias("process_id"), _of(reviews.STATES, F.col(key)).alias("status"), F.lit(1).alias("version"), (F.col(key) % 4 == 0).alias("is_stale"), _of(reviews.VISIBILITIES, F.col(key)).alias("visibility"), number.cast("int").alias("step_number"), F.create_map(*(x for k, c in fields.items() for x in (F.lit(k), F.col(c)))).alias("fields"))

    none = F.lit(None)
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    steps = shaped(orders.withColumn("nth", nth), "process_step", "o_orderkey", F.col("o_custkey"), F.col("nth"), {"instruction": "o_orderpriority"})
    return shaped(customer, "process", "c_custkey", none, none, {"name": "c_name", "description": "c_mktsegment"}).unionByName(steps).unionByName(shaped(part, "requirement", "p_partkey", none, none, {"requirement_text": "p_name"}))


def commands(spark, folder):
    """Events as commands of a user on a process, its steps (added ones too) and a requirement of the same number."""
    i, u = F.col("event_id"), F.col("user_id")
    half = F.floor(i / 4)
    e = table(spark, folder, "events").select(i, u, _of(("process", "process", "process_step", "requirement"), i).alias("knowledge_type"), _of(ACTIONS, half).alias("action"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("made", F.last(F.when((F.col("knowledge_type") == "process") & (F.col("action") == "add_process_step"), i), ignorenulls=True).over(before))
    steps = records(spark, folder).where("knowledge_type = 'process_step'").select(F.col("process_id").cast("long").alias("user_id"), F.col("step_number").cast("long").alias("nth"), F.col("record_id").alias("step"))
    rows = e.withColumn("nth", F.when(F.col("knowledge_type") == "process_step", half % 6 + 1)).join(steps, ["user_id", "nth"], "left")
    step = F.when(i % 12 == 6, F.concat(F.lit("step:"), F.col("made").cast("string"))).otherwise(F.col("step"))
    kind, a = F.col("knowledge_type"), F.col("action")
    entries = lambda *pairs: F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), when.alias("ok")) for k, v, when in pairs))
    edit, said = a == "edit_approve", F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit(" said "), i.cast("string")))
    patch = entries(
        ("name", said, edit & (kind == "process") & (i % 13 != 0)),
        ("instruction", said, edit & (kind == "process_step") & (i % 13 != 0)),
        ("requirement_text", said, edit & (kind == "requirement") & (i % 13 != 0)),
        ("topic_id", F.when(i % 2 == 0, F.lit("")).otherwise((i % 5).cast("string")), edit & (kind != "process_step") & (i % 5 == 0) & (i % 13 != 0)),
        ("step_number", F.when(i % 11 == 0, 0).otherwise(i % 8 + 1), edit & (kind == "process_step") & (i % 3 == 0) & (i % 13 != 0)),
        ("confidence", F.lit("1"), i % 29 == 0),
        ("instruction", said, a == "add_process_step"),
        ("resource_id", i % 7, a.isin("link_resource", "unlink_resource") & (i % 17 != 0)),
    )
    patch = F.map_from_entries(F.transform(F.filter(patch, lambda x: x["ok"]), lambda x: F.struct(x["key"], x["value"])))
    expected = F.when(kind == "process", i % 5 + 1).when(kind == "process_step", i % 2 + (i % 41 != 0).cast("int")).otherwise(i % 3 + 1)
    return rows.select(
        i, kind, F.when(kind == "process_step", step).otherwise(u.cast("string")).alias("record_id"), a, expected.cast("int").alias("expected_version"), patch.alias("patch"), F.when(i % 4 == 0, "code").alias("reason_code"),
        F.when(i % 3 == 0, "why").otherwise(" ").alias("reason_note"), _of(SEEN, i).alias("visibility"), F.when(i % 31 == 0, "member").otherwise("admin").alias("actor_role"), (i % 37 != 0).alias("actor_active"),
    )


def review_outcomes(spark, folder):
    return reviews.outcomes(reviews.folded(records(spark, folder).drop("fields"), commands(spark, folder)))


def review_children(spark, folder):
    """Processes and their steps after all commands: exchanged numbers, added and removed steps, versions of both."""
    told = reviews.folded(records(spark, folder).drop("fields"), commands(spark, folder))
    return reviews.standing(told)


def review_fields(spark, folder):
    r, c = records(spark, folder), commands(spark, folder)
    out = reviews.fields(r, c, reviews.folded(r.drop("fields"), c))
    return out.select("knowledge_type", "record_id", *(F.col("fields")[k].alias(k) for k in ("name", "instruction", "requirement_text", "topic_id")), *(F.col("original")[k].alias(f"original_{k}") for k in ("name", "instruction", "requirement_text")))


def review_links(spark, folder):
    r, c = records(spark, folder), commands(spark, folder)
    had = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("process_id"), F.col("s_nationkey").cast("string").alias("resource_id"))
    return reviews.links(had, c, reviews.folded(r.drop("fields"), c))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RECORDS_SQL = """recs as (
  select 'process' as kt, c_custkey::varchar as id, null::varchar as pid, c_custkey as k, null::int as num, c_name as name, null::varchar as instruction, null::varchar as requirement_text, 'p' || c_custkey as fam from customer
  union all select 'process_step', o_orderkey::varchar, o_custkey::varchar, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey))::int, null, o_orderpriority, null, 'p' || o_custkey from orders
  union all select 'requirement', p_partkey::varchar, null, p_partkey, null, null, null, p_name, 'r' || p_partkey from part),
began as (select fam, list(struct_pack(kt := kt, id := id, pid := pid, st := (['proposed', 'approved', 'rejected', 'superseded', 'needs_review'])[k % 5 + 1], v := 1, stale := k % 4 = 0, vis := (['internal', 'committee', 'member', 'public'])[k % 4 + 1], num := num)) as recs from recs group by fam)"""
COMMANDS_SQL = f"""sent as (select event_id as i, user_id as u, (['process', 'process', 'process_step', 'requirement'])[event_id % 4 + 1] as kt, ({_list(ACTIONS)})[event_id // 4 % 14 + 1] as a from events),
made as (select *, last_value(case when kt = 'process' and a = 'add_process_step' then i end ignore nulls) over (partition by u order by i rows between unbounded preceding and 1 preceding) as made from sent),
cmds as (select m.i, m.u, m.kt, m.a, case when m.kt <> 'process_step' then u::varchar when i % 12 = 6 then 'step:' || made else r.id end as id,
  case m.kt when 'process' then i % 5 + 1 when 'process_step' then i % 2 + (i % 41 <> 0)::int else i % 3 + 1 end as expected,
  case when i % 37 = 0 then 'inactive_profile' when i % 31 = 0 then 'unauthorized' when (case m.kt when 'process' then i % 5 + 1 when 'process_step' then i % 2 + (i % 41 <> 0)::int else i % 3 + 1 end) < 1 then 'validation_error' when i % 29 = 0 then 'validation_error' end as refusal,
  case when i % 9 = 0 then null else 'said ' || i end as said, (i % 4 <> 0 and i % 3 <> 0) as speechless, (['internal', 'committee', 'member', 'public', 'odd'])[i % 5 + 1] as asked,
  case when a = 'edit_approve' and m.kt = 'process_step' and i % 3 = 0 and i % 13 <> 0 then case when i % 11 = 0 then 0 else i % 8 + 1 end end as target,
  case m.kt when 'requirement' then 'r' || u else 'p' || u end as fam, row_number() over (partition by case m.kt when 'requirement' then 'r' || u else 'p' || u end order by i) as n
  from made m left join recs r on m.kt = 'process_step' and r.kt = 'process_step' and r.pid = u::varchar and r.num = i // 4 % 6 + 1)"""
FOLD_SQL = f"""with recursive {RECORDS_SQL}, {COMMANDS_SQL},
steps(fam, n, recs, i, akt, aid, logged, outcome, was, before) as (
  select fam, 0::bigint, recs, null::bigint, null::varchar, null::varchar, null::varchar, null::varchar, null::varchar, null::int from began
  union all
  select fam, n,
    case when outcome <> 'applied' then recs
      when a = 'add_process_step' then list_append(list_transform(recs, lambda x: case when x.kt = kt and x.id = id then struct_update(x, v := x.v + 1) else x end),
        struct_pack(kt := 'process_step', id := 'step:' || i, pid := id, st := 'approved', v := 1, stale := r.stale, vis := r.vis, num := (coalesce(list_max(list_transform(recs, lambda x: x.num)), 0) + 1)::int))
      else list_transform(recs, lambda x: case when x.kt = kt and x.id = id then struct_pack(kt := x.kt, id := x.id, pid := x.pid,
          st := case when a in ('approve', 'edit_approve') then 'approved' when a = 'reject' then 'rejected' when a in ('needs_review', 'defer') then 'needs_review' when a in ('supersede', 'remove_process_step') then 'superseded' else x.st end,
          v := x.v + 1, stale := x.stale and a not in ('approve', 'edit_approve'), vis := case when a = 'publish' then asked when a = 'unpublish' then 'internal' else x.vis end, num := coalesce(target, x.num)::int)
        when target is not null and x.num = target then struct_update(x, num := r.num) else x end) end,
    i, kt, case when outcome = 'applied' and a = 'add_process_step' then 'step:' || i else id end, case when a = 'defer' then 'needs_review' when a = 'publish' and asked = 'internal' then 'unpublish' else a end, outcome,
    case when outcome = 'applied' and a = 'add_process_step' then null else r.st end, case when outcome = 'applied' and a = 'add_process_step' then null else r.num end
  from (select *, case when refusal is not null then refusal when r is null then 'record_not_found' when r.v <> expected then 'concurrency_conflict'
      when a in ('approve', 'needs_review', 'defer', 'supersede') then 'applied'
      when a = 'reject' then case when speechless then 'validation_error' else 'applied' end
      when a = 'edit_approve' then case when i % 13 = 0 or said is null or target < 1 then 'validation_error' else 'applied' end
      when a in ('publish', 'unpublish') then case when r.st <> 'approved' or a = 'publish' and r.stale then 'stale_record' when a = 'publish' and asked = 'odd' then 'invalid_visibility' else 'applied' end
      when a = 'remove_process_step' and kt = 'process_step' then 'applied'
      when a = 'add_process_step' and kt = 'process' then case when said is null then 'validation_error' else 'applied' end
      when a in ('link_resource', 'unlink_resource') and kt = 'process' then case when i % 17 = 0 then 'validation_error' else 'applied' end
      else 'invalid_transition' end as outcome
    from (select c.*, s.recs, list_filter(s.recs, lambda x: x.kt = c.kt and x.id = c.id)[1] as r from steps s join cmds c on c.fam = s.fam and c.n = s.n + 1))),
told as (select i, case when outcome = 'applied' and logged = 'add_process_step' then 'process_step' else akt end as kt, aid, logged, outcome, was, before,
  list_filter(recs, lambda x: x.kt = (case when outcome = 'applied' and logged = 'add_process_step' then 'process_step' else akt end) and x.id = aid)[1] as r from steps where n > 0)"""
OUTCOMES_SQL = FOLD_SQL + " select i as event_id, kt as knowledge_type, aid as record_id, logged as action, outcome, was as previous_status, r.st as status, r.v as version, r.stale as is_stale, r.vis as visibility, before as number_before, r.num as step_number from told"
CHILDREN_SQL = FOLD_SQL + """, last as (select fam, unnest(recs) as r from (select fam, recs from steps qualify n = max(n) over (partition by fam)))
select r.kt as knowledge_type, r.id as record_id, r.pid as process_id, r.st as status, r.v as version, r.stale as is_stale, r.vis as visibility, r.num as step_number from last"""
FIELDS_SQL = FOLD_SQL + """, done as (select t.kt, t.aid, c.i, c.a, c.said, c.kt as ckt, case when c.a = 'edit_approve' and i % 5 = 0 and c.kt <> 'process_step' then true else false end as topical, case when i % 2 = 0 then null else (i % 5)::varchar end as topic
  from told t join cmds c using (i) where outcome = 'applied' and c.a in ('edit_approve', 'add_process_step')),
last as (select kt, aid, arg_max(said, i) as said, max(topical) as topical, arg_max(coalesce(topic, ' '), i) filter (topical) as topic, min(i) filter (a = 'edit_approve') as first from done group by kt, aid)
select coalesce(r.kt, l.kt) as knowledge_type, coalesce(r.id, l.aid) as record_id, case when coalesce(r.kt, l.kt) = 'process' then coalesce(l.said, r.name) end as name, case when coalesce(r.kt, l.kt) = 'process_step' then coalesce(l.said, r.instruction) end as instruction,
  case when coalesce(r.kt, l.kt) = 'requirement' then coalesce(l.said, r.requirement_text) end as requirement_text, nullif(l.topic, ' ') as topic_id,
  case when l.first is not null then r.name end as original_name, case when l.first is not null then r.instruction end as original_instruction, case when l.first is not null then r.requirement_text end as original_requirement_text
from recs r full join last l on l.kt = r.kt and l.aid = r.id"""
LINKS_SQL = FOLD_SQL + """, now as (select s_suppkey::varchar as p, s_nationkey::varchar as q, -1 as i, true as on_ from supplier
  union all select c.id, (i % 7)::varchar, i, c.a = 'link_resource' from told t join cmds c using (i) where outcome = 'applied' and c.a in ('link_resource', 'unlink_resource'))
select p as process_id, q as resource_id from now group by p, q having arg_max(on_, i)"""

QUERIES = {
    "review_outcomes": (review_outcomes, OUTCOMES_SQL),
    "review_children": (review_children, CHILDREN_SQL),
    "review_fields": (review_fields, FIELDS_SQL),
    "review_links": (review_links, LINKS_SQL),
}
