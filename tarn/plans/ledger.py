"""Registered queries of commands on records and tickets, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources.tables import UNITS_SQL, table, units

RECORD_ACTIONS = ("edit", "approve", "publish", "complete", "reject", "defer", "edit_approve", "assign_owner", "unpublish", "supersede", "attach_evidence", "create", "reopen", "change_due_date", "resolve", "change_execution_status", "detach_evidence", "archive")
TICKET_ACTIONS = ("update", "status", "assign", "create", "status", "update", "close")
PROGRESS = ("in_progress", "completed", "answered", "lost", "closed")


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _commands(spark, folder, actions, patch):
    """Events as commands, five a record in turn; every other one expects the version before."""
    i = F.col("event_id")
    action = _pick(actions, F.floor(i / 200) + i * 7)
    return table(spark, folder, "events").select(
        (i % 200).alias("record_id"), i, action.alias("action"), (F.floor(i / 400) % 4 + 1).cast("int").alias("expected_version"),
        F.when(i % 3 > 0, "why").alias("reason"), F.when(i % 23 == 0, "member").when(i % 23 == 1, "committee").otherwise("admin").alias("actor_role"), F.col("ts").alias("at"), patch(i, action).alias("patch"),
    )


def _records(spark, folder):
    """Customers as records and tickets."""
    k = F.col("c_custkey")
    fields = ledger._map(record_type=_pick(ledger.RECORD_TYPES, k), title=F.col("c_name"), visibility=F.when(k % 5 == 4, "internal").otherwise("committee"))
    return table(spark, folder, "customer").select(k.alias("record_id"), F.lit(1).alias("version"), F.when(k % 3 == 0, "proposed").otherwise("approved").alias("state"), fields.alias("fields"))


def _record_patch(i, a):
    return (
        F.when(a.isin("edit", "edit_approve"), ledger._map(title=F.when(i % 11 == 0, "  ").otherwise(F.concat(F.lit(" title "), i.cast("string"))), workstream=F.lit("w")))
        .when(a == "publish", ledger._map(visibility=_pick(("public", "member", "secret"), F.floor(i / 3))))
        .when(a == "create", ledger._map(record_type=_pick(("decision", "action_item", "wish"), F.floor(i / 7)), title=F.concat(F.lit("new "), i.cast("string"))))
        .when(a == "assign_owner", ledger._map(owner_text=F.lit(" someone ")))
        .when(a == "change_due_date", ledger._map(due_text=F.lit("soon")))
        .when(a == "change_execution_status", ledger._map(execution_status=_pick(PROGRESS, F.floor(i / 5))))
        .when(a == "supersede", ledger._map(superseded_by_id=F.floor(i / 2) % 180))
        .when(a == "attach_evidence", ledger._map(retrieval_unit_id=F.lpad((i % 230).cast("string"), 8, "0")))
        .when(a == "detach_evidence", ledger._map(evidence_id=(i - 200)))
    )


def _told_records(spark, folder):
    return ledger.record_commands(_records(spark, folder), _commands(spark, folder, RECORD_ACTIONS, _record_patch), units(spark, folder))


def record_outcomes(spark, folder):
    return _told_records(spark, folder).select("event_id", "record_id", "outcome", "version", "state")


def record_standing(spark, folder):
    f = F.col("fields")
    rows = ledger.standing(_records(spark, folder), _told_records(spark, folder))
    return rows.select("record_id", "version", "state", f["title"].alias("title"), f["visibility"].alias("visibility"), f["execution_status"].alias("execution_status"), f["owner_text"].alias("owner_text"))


def evidence_links(spark, folder):
    return ledger.evidence_links(_told_records(spark, folder))


RECORDS_SQL = f"""records as (select c_custkey as record_id, ({_list(ledger.RECORD_TYPES)})[c_custkey % 5 + 1] as record_type, c_name as title,
  case when c_custkey % 5 = 4 then 'internal' else 'committee' end as visibility, 1 as version, case when c_custkey % 3 = 0 then 'proposed' else 'approved' end as state from customer)"""


def _commands_sql(actions):
    return f"""commands as (select event_id as i, event_id % 200 as record_id, ({_list(actions)})[(event_id // 200 + event_id * 7) % {len(actions)} + 1] as a, (event_id // 400 % 4 + 1)::int as expected,
  event_id % 3 > 0 as reasoned, case event_id % 23 when 0 then 'member' when 1 then 'committee' else 'admin' end as actor, ts as at, row_number() over (partition by event_id % 200 order by event_id) as n from events)"""


def _fold_sql(step):
    """Commands of a record, one after another; `step` is the outcome given c, s (version, state) and f (fault)."""
    return f"""steps as (select record_id, 0::bigint as n, null::bigint as i, null::varchar as a, coalesce(version, 0) as version, state, null::varchar as outcome
    from (select distinct record_id from commands) left join records using (record_id)
  union all select record_id, n, i, a, (version + (outcome = 'applied')::int)::int, case when outcome = 'applied' then to_state else state end, outcome from ({step}))"""


RECORD_FOLD_SQL = f"""with recursive {UNITS_SQL}, {RECORDS_SQL}, {_commands_sql(RECORD_ACTIONS)},
checked as (select c.*, r.record_type, case when a in ('edit', 'edit_approve') then case when i % 11 = 0 then '' else 'title ' || i end when a = 'create' then 'new ' || i end as title,
  (['decision', 'action_item', 'wish'])[i // 7 % 3 + 1] as made, (['public', 'member', 'secret'])[i // 3 % 3 + 1] as shown, i // 2 % 180 as heir, lpad((i % 230)::varchar, 8, '0') as unit_id,
  case a when 'complete' then 'completed' when 'reopen' then 'open' when 'resolve' then 'resolved' when 'change_execution_status' then ({_list(PROGRESS)})[i // 5 % 5 + 1] end as progress
  from commands c left join records r using (record_id)),
faulted as (select x.*, case when actor <> 'admin' then 'unauthorized'
  when a = 'create' and made = 'wish' or title = '' or a = 'reject' and not reasoned or progress = 'lost' then 'validation_error'
  when a = 'supersede' and (coalesce(record_type, '') <> 'decision' or heir = record_id or heir not in (select record_id from records where record_type = 'decision')) then 'validation_error'
  when a = 'attach_evidence' and unit_id not in (select unit_id from units) then 'evidence_not_found'
  when a = 'publish' and shown = 'secret' then 'invalid_visibility' end as fault from checked x),
{_fold_sql('''select record_id, n, i, a, version, state, to_state, case when a = 'create' then case when fault is not null then fault when version > 0 then 'validation_error' else 'applied' end
    when fault = 'unauthorized' then fault when version = 0 then 'not_found' when expected <> version then 'concurrency_conflict'
    when to_state is null then case when a in ('publish', 'unpublish') then 'not_publishable' else 'invalid_transition' end when fault is not null then fault else 'applied' end as outcome
    from (select c.*, s.version, s.state, case when c.a = 'create' then 'proposed' when c.a = 'archive' then null
      when c.a = 'approve' then case when s.state in ('proposed', 'needs_review') then 'approved' end when c.a in ('publish', 'unpublish') then case when s.state = 'approved' then s.state end
      when c.a = 'supersede' then 'superseded, past' when c.a in ('edit_approve', 'reject', 'defer') then (map {'edit_approve': 'approved', 'reject': 'rejected', 'defer': 'needs_review'})[c.a] || case when s.state like '%, past' then ', past' else '' end
      else s.state end as to_state from steps s join faulted c on c.record_id = s.record_id and c.n = s.n + 1)''')}"""
RECORD_OUTCOMES_SQL = RECORD_FOLD_SQL + " select i as event_id, record_id, outcome, version, state from steps where n > 0"
RECORD_STANDING_SQL = RECORD_FOLD_SQL + """, done as (select f.*, s.version, s.state from steps s join faulted f using (record_id, n) where s.outcome = 'applied'),
last as (select record_id, arg_max(version, i) as version, arg_max(state, i) as state, arg_max(title, i) as title,
  arg_max(case when a in ('publish') then shown else 'internal' end, i) filter (a in ('publish', 'unpublish', 'create')) as visibility,
  arg_max_null(case when a = 'create' then case when made <> 'decision' then 'open' end else progress end, i) filter (progress is not null or a = 'create') as execution_status,
  arg_max('someone', i) filter (a = 'assign_owner') as owner_text from done group by record_id)
select record_id, coalesce(l.version, r.version) as version, coalesce(l.state, r.state) as state, coalesce(l.title, r.title) as title, coalesce(l.visibility, r.visibility) as visibility, execution_status, owner_text
from records r full join last l using (record_id)"""
EVIDENCE_LINKS_SQL = RECORD_FOLD_SQL + """, done as (select f.* from steps s join faulted f using (record_id, n) where s.outcome = 'applied')
select record_id, i::varchar as evidence_id, unit_id from done d where a = 'attach_evidence' and not exists (select 1 from done t where t.record_id = d.record_id and t.a = 'detach_evidence' and t.i - 200 = d.i)"""


def _ticket_patch(i, a):
    people = F.concat(F.lit('["'), (i % 27).cast("string"), F.lit('","3","3"]'))
    return (
        F.when(a == "update", ledger._map(title=F.when(i % 9 == 0, " ").otherwise(F.concat(F.lit("ticket "), i.cast("string"))), priority=_pick((*ledger.PRIORITIES, "odd"), F.floor(i / 2))))
        .when(a == "status", ledger._map(execution_status=_pick(PROGRESS, F.floor(i / 3))))
        .when(a == "assign", ledger._map(assignee_ids=people))
        .when(a == "create", ledger._map(title=F.concat(F.lit("made "), i.cast("string"))))
    )


def _tickets(spark, folder):
    """The records as action items, one in five a decision."""
    kind = F.when(F.col("record_id") % 5 == 0, "decision").otherwise("action_item")
    return _records(spark, folder).withColumn("fields", ledger.merged(F.col("fields"), ledger._map(record_type=kind)))


def _told_tickets(spark, folder):
    officers = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("officer_id"), (F.col("n_nationkey") % 6 != 5).alias("active"))
    return ledger.ticket_commands(_tickets(spark, folder), _commands(spark, folder, TICKET_ACTIONS, _ticket_patch), officers)


def ticket_outcomes(spark, folder):
    return _told_tickets(spark, folder).select("event_id", "record_id", "outcome", "version", "state")


def ticket_standing(spark, folder):
    f = F.col("fields")
    rows = ledger.standing(_tickets(spark, folder), _told_tickets(spark, folder))
    return rows.select("record_id", "version", "state", *(f[k].alias(k) for k in ("title", "priority", "execution_status", "assignee_ids", "owner_officer_id")))


TICKET_FOLD_SQL = f"""with recursive all_{RECORDS_SQL}, records as (select * from all_records where record_id % 5 <> 0), {_commands_sql(TICKET_ACTIONS)},
checked as (select c.*, r.visibility, r.state as at_first, case when a = 'update' then case when i % 9 = 0 then '' else 'ticket ' || i end when a = 'create' then 'made ' || i end as title,
  (['low', 'medium', 'high', 'urgent', 'odd'])[i // 2 % 5 + 1] as priority, ({_list(PROGRESS)})[i // 3 % 5 + 1] as progress, i % 27 as who from commands c left join records r using (record_id)),
faulted as (select x.*, case when actor = 'member' or actor = 'committee' and visibility = 'internal' or a <> 'create' and at_first <> 'approved' then 'unauthorized'
  when title = '' or a = 'update' and priority = 'odd' or a = 'status' and progress not in ('in_progress', 'completed') or a = 'assign' and who not in (select n_nationkey from nation where n_nationkey % 6 <> 5) then 'validation_error' end as fault from checked x),
{_fold_sql('''select record_id, n, i, a, version, state, 'approved' as to_state, case when a = 'create' then case when fault is not null then fault when version > 0 then 'validation_error' else 'applied' end
    when fault = 'unauthorized' then fault when version = 0 then 'not_found' when expected <> version then 'concurrency_conflict' when a = 'close' then 'invalid_transition' when fault is not null then fault else 'applied' end as outcome
    from (select c.*, s.version, s.state from steps s join faulted c on c.record_id = s.record_id and c.n = s.n + 1)''')}"""
TICKET_OUTCOMES_SQL = TICKET_FOLD_SQL + " select i as event_id, record_id, outcome, version, state from steps where n > 0"
TICKET_STANDING_SQL = TICKET_FOLD_SQL + """, done as (select f.*, s.version, s.state from steps s join faulted f using (record_id, n) where s.outcome = 'applied'),
last as (select record_id, arg_max(version, i) as version, arg_max(state, i) as state, arg_max(title, i) as title, arg_max(case when a = 'create' then 'medium' else priority end, i) filter (a in ('create', 'update')) as priority,
  arg_max(case when a = 'create' then 'open' else progress end, i) filter (a in ('create', 'status')) as execution_status,
  nullif(arg_max(case when a = 'create' then ' ' when who::varchar < '3' then who::varchar else '3' end, i) filter (a in ('create', 'assign')), ' ') as owner_officer_id,
  arg_max(case when a = 'create' then '[]' when who = 3 then '["3"]' when who::varchar < '3' then '["' || who || '","3"]' else '["3","' || who || '"]' end, i) filter (a in ('create', 'assign')) as assignee_ids from done group by record_id)
select record_id, coalesce(l.version, r.version) as version, coalesce(l.state, r.state) as state, coalesce(l.title, r.title) as title, priority, execution_status, assignee_ids, owner_officer_id from all_records r full join last l using (record_id)"""


QUERIES = {
    "record_outcomes": (record_outcomes, RECORD_OUTCOMES_SQL),
    "record_standing": (record_standing, RECORD_STANDING_SQL),
    "evidence_links": (evidence_links, EVIDENCE_LINKS_SQL),
    "ticket_outcomes": (ticket_outcomes, TICKET_OUTCOMES_SQL),
    "ticket_standing": (ticket_standing, TICKET_STANDING_SQL),
}
