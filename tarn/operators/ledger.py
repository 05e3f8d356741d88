"""Commands on records and tickets: checked, decided in order with version checks, and folded into what stands.

A command is (record_id, event_id, action, expected_version, patch map<string,string>, reason, actor_role, at). What it
would change and whether it is well formed follows from the row alone and is expressions; only the version and the
review state need the order, so only they are folded, one row at a time over partitions sorted by record.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of records, states, fields and limits.
RECORD_TYPES = ("decision", "action_item", "commitment", "open_question", "status_update")
REVIEW_STATES = ("proposed", "needs_review", "approved", "rejected", "superseded")
VISIBILITIES = ("internal", "committee", "member", "public")
RECORD_PROGRESS = ("open", "in_progress", "blocked", "completed", "cancelled", "answered", "resolved", "closed")
TICKET_PROGRESS = ("open", "in_progress", "blocked", "completed", "cancelled")
PRIORITIES = ("low", "medium", "high", "urgent")
RECORD_FIELDS = ("title", "description", "priority", "owner_profile_id", "owner_officer_id", "owner_text", "due_at", "due_text", "occurred_at", "workstream", "execution_status", "metadata")
TICKET_FIELDS = ("title", "description", "workstream", "priority", "due_at")
KEEPS_STATE = ("edit", "assign_owner", "change_due_date", "change_execution_status", "complete", "reopen", "resolve", "attach_evidence", "detach_evidence")
LONGEST_TITLE, LONGEST_DESCRIPTION, LONGEST_WORKSTREAM, MOST_ASSIGNEES = 300, 5000, 100, 20

PAST = ", past"  # marks the state of a record that another one replaced


def _record_moves() -> dict[tuple[str, str], str]:
    moves = {}
    for review in REVIEW_STATES:
        for end in ("", PAST):
            at = review + end
            to = {a: at for a in KEEPS_STATE} | {"edit_approve": "approved" + end, "reject": "rejected" + end, "defer": "needs_review" + end, "supersede": "superseded" + PAST}
            if not end and review in ("proposed", "needs_review"):
                to["approve"] = "approved"
            if not end and review == "approved":
                to |= {"publish": at, "unpublish": at}
            moves |= {(at, a): s for a, s in to.items()}
    return moves


RECORD_MOVES = _record_moves()
RECORD_ACTIONS = frozenset(a for _, a in RECORD_MOVES) | {"create"}
TICKET_MOVES = {("approved", a): "approved" for a in ("update", "status", "assign")}


def merged(a: Column, b: Column) -> Column:
    """Two string maps as one; where both have a key, `b` has the last word, null included."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))


def _value(key: str) -> Column:
    """A patch's value without blanks around it; null where it has none."""
    return F.nullif(F.trim(F.col("patch")[key]), F.lit(""))


def _map(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def _patched(fields: tuple[str, ...]) -> Column:
    return F.transform_values(F.map_filter("patch", lambda k, _: k.isin(*fields)), lambda _, v: F.nullif(F.trim(v), F.lit("")))


def _only(*fields: str) -> Column:
    return F.forall(F.map_keys("patch"), lambda k: k.isin(*fields))


def decided(commands: DataFrame, moves: dict[tuple[str, str], str], first: str, refusal: Callable[[str], str] = lambda action: "invalid_transition") -> DataFrame:
    """`commands` with outcome, version and state after each, in order of event_id within a record.

    Beside the command's columns it reads start_version (0 or null: no such record yet), start_state and fault (null if
    the command is well formed). A record's rows pass one after another; no more than a batch is held, however many
    there are. A command applies if it expects the record's version and its state allows it, and raises the version.
    """

    def judged(version: int, state: str | None, action: str, expected: int | None, fault: str | None) -> tuple[str, str | None]:
        if action == "create":
            return (fault or "validation_error", state) if fault or version else ("applied", first)
        if fault == "unauthorized" or not version:
            return fault if fault == "unauthorized" else "not_found", state
        if expected != version:
            return "concurrency_conflict", state
        to = moves.get((state, action))
        if fault or not to:
            return fault if to else refusal(action), state
        return "applied", to

    read = ("record_id", "start_version", "start_state", "action", "expected_version", "fault")

    def run(batches):
        record, version, state = object(), 0, None
        for b in batches:
            out = []
            for key, start, at, action, expected, fault in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in read)):
                if key != record:
                    record, version, state = key, start or 0, at
                outcome, state = judged(version, state, action, expected, fault) if key is not None else ("not_found", None)
                version += outcome == "applied"
                out.append((outcome, version, state))
            told = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(b.columns + told, b.schema.names + ["outcome", "version", "state"])

    schema = T.StructType(commands.schema.fields + [T.StructField("outcome", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("state", T.StringType())])
    return commands.repartition("record_id").sortWithinPartitions("record_id", "event_id").mapInArrow(run, schema)


def standing(records: DataFrame, told: DataFrame) -> DataFrame:
    """(record_id, version, state, fields): `records` (and those created) with every applied command's effect.

    Each field has the value of the last applied command that set it. Fields are few, so a record's map is small.
    """
    done = told.where("outcome = 'applied'")
    last = done.groupBy("record_id").agg(F.max_by(F.struct("version", "state"), "event_id").alias("last"))
    fields = done.select("record_id", "event_id", F.explode("effect").alias("key", "value")).groupBy("record_id", "key").agg(F.max_by("value", "event_id").alias("value"))
    fields = fields.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("changed"))
    rows = records.select("record_id", F.col("version").alias("was"), F.col("state").alias("before"), F.col("fields").alias("old"))
    rows = rows.join(last, "record_id", "full").join(fields, "record_id", "left")
    return rows.select("record_id", F.coalesce("last.version", "was").alias("version"), F.coalesce("last.state", "before").alias("state"), merged(F.col("old"), F.col("changed")).alias("fields"))


def _started(records: DataFrame, commands: DataFrame) -> DataFrame:
    start = records.select("record_id", F.col("version").alias("start_version"), F.col("state").alias("start_state"), F.col("fields").alias("start_fields"))
    return commands.withColumn("patch", F.coalesce("patch", F.create_map().cast("map<string,string>"))).join(start, "record_id", "left")


def _flagged(rows: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    """`rows` with a boolean column: whether the event is among `bad` (event_id)."""
    return rows.join(bad.select("event_id", F.lit(True).alias(name)).distinct(), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def record_commands(records: DataFrame, commands: DataFrame, units: DataFrame) -> DataFrame:
    """The seventeen actions on operational records, decided: see `decided`; `effect` is what a command sets.

    `records` is (record_id, version, state, fields with record_type and visibility), `units` has unit_id. Whether a
    decision may replace another is judged on `records` as they stand before the commands.
    """
    named = commands.select("event_id", "record_id", "action", F.col("patch")["superseded_by_id"].alias("by"), F.col("patch")["retrieval_unit_id"].alias("unit_id"))
    heirs = records.where((F.col("fields")["record_type"] == "decision") & ~F.endswith("state", F.lit(PAST))).select(F.col("record_id").cast("string").alias("by"))
    orphans = named.where("action = 'supersede'").join(heirs, "by", "left_anti")
    unknown = named.where("action = 'attach_evidence' or (action = 'create' and trim(unit_id) <> '')").join(units.select("unit_id"), "unit_id", "left_anti")
    rows = _flagged(_flagged(_started(records, commands), orphans, "no_heir"), unknown, "no_unit")
    a, at = F.col("action"), F.col("at").cast("string")
    progress = F.when(a == "complete", "completed").when(a == "reopen", "open").when(a == "resolve", "resolved").otherwise(F.col("patch")["execution_status"])
    visibility = F.when(a == "unpublish", "internal").otherwise(F.col("patch")["visibility"])
    blank_title = F.map_contains_key("patch", "title") & _value("title").isNull()
    invalid = (
        F.when(a == "create", ~F.coalesce(_value("record_type").isin(*RECORD_TYPES), F.lit(False)) | _value("title").isNull())
        .when(a.isin("edit", "edit_approve"), ~_only(*RECORD_FIELDS) | blank_title)
        .when(a == "reject", F.trim(F.coalesce("reason", F.lit(""))) == "")
        .when(a.isin("change_execution_status", "complete", "reopen", "resolve"), ~F.coalesce(progress.isin(*RECORD_PROGRESS), F.lit(False)))
        .when(a == "supersede", F.col("no_heir") | ~F.coalesce(F.col("start_fields")["record_type"] == "decision", F.lit(False)) | F.col("patch")["superseded_by_id"].eqNullSafe(F.col("record_id").cast("string")))
        .otherwise(False)
    )
    fault = (
        F.when(~F.coalesce(F.col("actor_role") == "admin", F.lit(False)), "unauthorized")
        .when(invalid, "validation_error")
        .when(F.col("no_unit"), "evidence_not_found")
        .when((a == "publish") & ~F.coalesce(visibility.isin(*VISIBILITIES), F.lit(False)), "invalid_visibility")
    )
    opened = F.when(_value("record_type") != "decision", F.coalesce(_value("execution_status"), F.lit("open")))
    effect = (
        F.when(a == "create", merged(_patched(RECORD_FIELDS), _map(record_type=_value("record_type"), execution_status=opened, visibility=F.lit("internal"))))
        .when(a.isin("edit", "edit_approve"), _patched(RECORD_FIELDS))
        .when(a.isin("publish", "unpublish"), _map(visibility=visibility))
        .when(a == "assign_owner", _map(owner_profile_id=_value("owner_profile_id"), owner_officer_id=_value("owner_officer_id"), owner_text=_value("owner_text")))
        .when(a == "change_due_date", _map(due_at=_value("due_at"), due_text=_value("due_text")))
        .when(progress.isin("completed") & a.isin("change_execution_status", "complete"), _map(execution_status=progress, completed_at=at))
        .when(progress.isin("resolved", "closed") & a.isin("change_execution_status", "resolve"), _map(execution_status=progress, resolved_at=at))
        .when(a.isin("change_execution_status", "reopen"), _map(execution_status=progress))
        .when(a == "supersede", _map(superseded_by_id=F.col("patch")["superseded_by_id"]))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    rows = rows.withColumns({"fault": fault, "effect": effect}).drop("no_heir", "no_unit", "start_fields")
    return decided(rows, RECORD_MOVES, "proposed", lambda action: "not_publishable" if action in ("publish", "unpublish") else "invalid_transition")


def evidence_links(told: DataFrame) -> DataFrame:
    """(record_id, evidence_id, unit_id) attached by applied commands and not detached since; an evidence's id is its event's."""
    done = told.where("outcome = 'applied'")
    given = done.where("action in ('attach_evidence', 'create')").select("record_id", F.col("event_id").cast("string").alias("evidence_id"), F.col("patch")["retrieval_unit_id"].alias("unit_id")).where("trim(unit_id) <> ''")
    taken = done.where("action = 'detach_evidence'").select("record_id", F.col("patch")["evidence_id"].alias("evidence_id"))
    return given.join(taken, ["record_id", "evidence_id"], "left_anti")


def ticket_commands(tickets: DataFrame, commands: DataFrame, officers: DataFrame) -> DataFrame:
    """create, update, status and assign on tickets, decided: see `decided`; `effect` is what a command sets.

    `tickets` is (record_id, version, state, fields with visibility), `officers` (officer_id, active). Assignees are a
    JSON list of officer ids, all active, twenty at most; the first in order owns the ticket, whatever owner was written
    down before. A record that says it is not an action item is not found.
    """
    ids = F.from_json(F.col("patch")["assignee_ids"], "array<string>")
    asked = commands.where(F.map_contains_key("patch", "assignee_ids")).select("event_id", F.explode_outer(ids).alias("officer_id"))
    strangers = asked.where("officer_id is not null").join(officers.where("active").select("officer_id"), "officer_id", "left_anti")
    mine = tickets.where(F.coalesce(F.col("fields")["record_type"], F.lit("action_item")) == "action_item")
    rows = _flagged(_started(mine, commands), strangers, "stranger")
    a, at = F.col("action"), F.col("at").cast("string")
    longer = lambda key, most: F.length(F.coalesce(F.col("patch")[key], F.lit(""))) > most
    has = lambda key: F.map_contains_key("patch", key)
    texts = longer("title", LONGEST_TITLE) | longer("description", LONGEST_DESCRIPTION) | longer("workstream", LONGEST_WORKSTREAM)
    priority = has("priority") & ~F.coalesce(F.col("patch")["priority"].isin(*PRIORITIES), F.lit(False))
    length = F.json_array_length(F.col("patch")["assignee_ids"])
    people = has("assignee_ids") & (length.isNull() | (length > MOST_ASSIGNEES) | F.col("stranger"))
    status = F.col("patch")["execution_status"]
    invalid = (
        F.when(a == "create", ~_only(*TICKET_FIELDS, "assignee_ids") | _value("title").isNull() | texts | priority | people)
        .when(a == "update", ~_only(*TICKET_FIELDS) | (has("title") & _value("title").isNull()) | texts | priority)
        .when(a == "status", ~_only("execution_status") | ~F.coalesce(status.isin(*TICKET_PROGRESS), F.lit(False)))
        .when(a == "assign", ~_only("assignee_ids") | ~has("assignee_ids") | people)
        .otherwise(False)
    )
    seen = F.coalesce(F.col("start_fields")["visibility"], F.lit("committee"))
    allowed = (F.col("actor_role") == "admin") | ((F.col("actor_role") == "committee") & (seen == "committee"))
    closed = F.col("start_state") != "approved"
    fault = F.when(~F.coalesce(allowed, F.lit(False)) | (closed & (a != "create")), "unauthorized").when(invalid, "validation_error")
    people_ids = F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))))
    assigned = _map(assignee_ids=F.to_json(people_ids), owner_officer_id=F.get(people_ids, F.lit(0)), owner_text=F.lit(None))
    opened = merged(_map(priority=F.coalesce(F.col("patch")["priority"], F.lit("medium")), execution_status=F.lit("open"), visibility=F.lit("committee")), assigned)
    effect = (
        F.when(a == "create", merged(_patched(TICKET_FIELDS), opened))
        .when(a == "update", _patched(TICKET_FIELDS))
        .when(a == "status", _map(execution_status=status, completed_at=F.when(status == "completed", at)))
        .when(a == "assign", assigned)
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    rows = rows.withColumns({"fault": fault, "effect": effect}).drop("stranger", "start_fields")
    return decided(rows, TICKET_MOVES, "approved")
