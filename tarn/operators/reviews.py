"""Review transactions on knowledge records: twelve actions, checked in turn within a process and its steps.

A command is (event_id, knowledge_type, record_id, action, expected_version, patch map<string,string>, reason_code,
reason_note, visibility, actor_role, actor_active, at). Whether it is well formed follows from its row and is
expressions. What depends on order (versions, states, step numbers, steps added on the way) is folded over one stream for
each process with its steps, or for each other record: partitions sorted by family, a row at a time, with the family's
records as small tuples. What the fields become is aggregation.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of records, states, what an action leads to, fields a reviewer may edit, and those nobody may send.
STATES = ("proposed", "approved", "rejected", "superseded", "needs_review")
LEADS_TO = {"approve": "approved", "edit_approve": "approved", "reject": "rejected", "needs_review": "needs_review", "defer": "needs_review", "supersede": "superseded"}
VISIBILITIES = ("internal", "committee", "member", "public")
FIELDS = {
    "requirement": ("requirement_text", "requirement_type", "applies_to", "mandatory", "topic_id", "role_ids"),
    "timing_rule": ("description", "deadline_type", "absolute_date", "notice_period_value", "notice_period_unit", "working_days", "recurrence_rule", "relative_to_event_type", "topic_id"),
    "process": ("name", "description", "topic_id", "role_ids"),
    "process_step": ("title", "instruction", "condition", "step_number"),
    "resource": ("name", "resource_type", "url", "description", "topic_id"),
    "contact": ("name", "organisation", "email", "url", "description"),
}
REQUIRED = {"requirement": "requirement_text", "timing_rule": "description", "process": "name", "process_step": "instruction"}
PROTECTED = (
    "source_article_id", "source_url", "source_content_hash", "source_updated_at", "evidence_text", "evidence_start", "evidence_end", "extraction_run_id",
    "extracted_at", "extraction_method", "confidence", "fingerprint", "metadata", "review_status", "reviewed_by_officer_id", "reviewed_by_profile_id",
    "reviewed_at", "is_stale", "published_at", "published_by_profile_id", "visibility", "review_version",
)


def next_state(state: Column, action: Column) -> Column:
    """Where a review action leads, from any known state; null for an unknown state or action."""
    out = F.lit(None).cast("string")
    for name, to in LEADS_TO.items():
        out = F.when(action == name, F.lit(to)).otherwise(out)
    return F.when(state.isin(*STATES), out)


def reasoned(action: Column, *reasons: Column) -> Column:
    """A rejection gives a reason that is not blank."""
    given = F.coalesce(*(F.nullif(F.trim(r), F.lit("")) for r in reasons))
    return (action != "reject") | given.isNotNull()


def _said(key: str) -> Column:
    return F.nullif(F.trim(F.col("patch")[key]), F.lit(""))


def checked(commands: DataFrame) -> DataFrame:
    """`commands` with refusal (whoever and whatever it is about) and fault (if the record is there and of the version)."""
    a, kind, keys = F.col("action"), F.col("knowledge_type"), F.map_keys("patch")
    rows = commands.withColumn("patch", F.coalesce("patch", F.create_map().cast("map<string,string>")))
    refusal = (
        F.when(~F.coalesce(F.col("actor_active"), F.lit(False)), "inactive_profile")
        .when(~F.coalesce(F.col("actor_role") == "admin", F.lit(False)), "unauthorized")
        .when(F.coalesce("expected_version", F.lit(0)) < 1, "validation_error")
        .when(F.exists(keys, lambda k: k.isin(*PROTECTED)) | ~F.coalesce(kind.isin(*FIELDS), F.lit(False)), "validation_error")
    )
    blank = reduce(lambda x, y: x | y, ((kind == k) & F.map_contains_key("patch", f) & _said(f).isNull() for k, f in REQUIRED.items()))
    number = (kind == "process_step") & F.map_contains_key("patch", "step_number") & ~F.coalesce(F.try_to_number(_said("step_number"), F.lit("999999999")) >= 1, F.lit(False))
    fault = (
        F.when((a == "edit_approve") & ((F.size("patch") == 0) | blank | number), "validation_error")
        .when(~reasoned(a, F.col("reason_code"), F.col("reason_note")), "validation_error")
        .when((a == "publish") & ~F.coalesce(F.col("visibility").isin(*VISIBILITIES), F.lit(False)), "invalid_visibility")
        .when((a == "add_process_step") & _said("instruction").isNull(), "validation_error")
        .when(a.isin("link_resource", "unlink_resource") & ~F.map_contains_key("patch", "resource_id"), "validation_error")
    )
    return rows.withColumn("refusal", refusal).withColumn("fault", fault)


_OUT = "kind string, event_id long, knowledge_type string, record_id string, action string, outcome string, previous_status string, status string, version int, is_stale boolean, visibility string, number_before int, step_number int, process_id string"


def _folded(batches):
    """Families in order: a family's records, then its commands by event."""
    names = [f.split() for f in _OUT.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])

    def rows():
        for b in batches:
            yield from b.to_pylist()

    def applied(at: dict, c: dict, key: tuple):
        """(outcome, record to report) of a command; what it changes is changed in `at`."""
        r, a, kind = at[key], c["action"], c["knowledge_type"]
        if a in LEADS_TO:
            if c["fault"]:
                return c["fault"], key
            r["status"] = LEADS_TO[a]
            if a in ("approve", "edit_approve"):
                r["is_stale"] = False
            if a == "edit_approve" and kind == "process_step" and c["target"] is not None:
                for other in at.values():
                    if other is not r and other["step_number"] == c["target"]:
                        other["step_number"] = r["step_number"]
                r["step_number"] = c["target"]
        elif a in ("publish", "unpublish"):
            if r["status"] != "approved" or (a == "publish" and r["is_stale"]):
                return "stale_record", key
            if c["fault"]:
                return c["fault"], key
            r["visibility"] = c["visibility"] if a == "publish" else "internal"
        elif a == "remove_process_step" and kind == "process_step":
            r["status"] = "superseded"
        elif a in ("add_process_step", "link_resource", "unlink_resource") and kind == "process":
            if c["fault"]:
                return c["fault"], key
            if a == "add_process_step":
                new = "process_step", f"step:{c['event_id']}"
                last = max((x["step_number"] for x in at.values() if x["step_number"] is not None), default=0)
                at[new] = {"status": "approved", "version": 1, "is_stale": r["is_stale"], "visibility": r["visibility"], "step_number": last + 1, "process_id": key[1]}
                r["version"] += 1
                return "applied", new
        else:
            return "invalid_transition", key
        r["version"] += 1
        return "applied", key

    def out():
        for _, family in groupby(rows(), key=lambda r: r["family"]):
            at: dict[tuple, dict] = {}
            for c in family:
                key = c["knowledge_type"], c["record_id"]
                if c["kind"] == 0:
                    at[key] = {k: c[k] for k in ("status", "version", "is_stale", "visibility", "step_number", "process_id")}
                    continue
                before = dict(at[key]) if key in at else {}
                if c["refusal"] or not before or c["expected_version"] != before["version"]:
                    outcome = c["refusal"] or ("concurrency_conflict" if before else "record_not_found")
                    told = key
                else:
                    outcome, told = applied(at, c, key)
                logged = "needs_review" if c["action"] == "defer" else "unpublish" if c["action"] == "publish" and c["visibility"] == "internal" else c["action"]
                was = before.get("status") if told == key else None
                yield "event", c["event_id"], *told, logged, outcome, was, *(at.get(told, {}).get(k) for k in ("status", "version", "is_stale", "visibility")), before.get("step_number") if told == key else None, *(at.get(told, {}).get(k) for k in ("step_number", "process_id"))
            for (kind, record), r in at.items():
                yield "record", None, kind, record, None, None, None, r["status"], r["version"], r["is_stale"], r["visibility"], None, r["step_number"], r["process_id"]

    held = []
    for row in out():
        held.append(row)
        if len(held) == 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def folded(records: DataFrame, commands: DataFrame) -> DataFrame:
    """Every command's outcome (kind event) and every record as it stands after all of them (kind record).

    `records` is (knowledge_type, record_id, process_id of steps, status, version, is_stale, visibility, step_number). A
    step that a command adds is called step:<event_id>, and later commands may name it. An event tells the record it was
    about (an added step: that), the state before and after, and the step's number before and after; two steps whose
    numbers are exchanged keep theirs in the records. Commands without a record_id are not found.
    """
    steps = records.where("knowledge_type = 'process_step'").select("record_id", F.col("process_id").alias("of"))
    added = commands.where("action = 'add_process_step' and knowledge_type = 'process'").select(F.concat(F.lit("step:"), F.col("event_id").cast("string")).alias("record_id"), F.col("record_id").alias("of"))
    rows = checked(commands)
    theirs = rows.where("knowledge_type = 'process_step'").join(steps.unionByName(added).dropDuplicates(["record_id"]), "record_id", "left")
    rows = theirs.unionByName(rows.where("not knowledge_type <=> 'process_step'"), allowMissingColumns=True)
    family = F.concat_ws(":", F.when(F.col("knowledge_type") == "process_step", "process").otherwise(F.col("knowledge_type")), F.coalesce("of", "record_id"))
    rows = rows.select(family.alias("family"), F.lit(1).alias("kind"), "event_id", "knowledge_type", "record_id", "action", "expected_version", "visibility", "refusal", "fault", F.try_to_number(_said("step_number"), F.lit("999999999")).cast("int").alias("target"))
    mine = F.concat_ws(":", F.when(F.col("knowledge_type") == "process_step", "process").otherwise(F.col("knowledge_type")), F.coalesce("process_id", "record_id"))
    given = records.select(mine.alias("family"), F.lit(0).alias("kind"), "knowledge_type", "record_id", "process_id", "status", F.col("version").cast("int").alias("version"), "is_stale", "visibility", F.col("step_number").cast("int").alias("step_number"))
    both = given.unionByName(rows, allowMissingColumns=True)
    return both.repartition("family").sortWithinPartitions("family", "kind", "event_id").mapInArrow(_folded, _OUT)


def outcomes(told: DataFrame) -> DataFrame:
    """The events of folded()."""
    return told.where("kind = 'event'").drop("kind", "process_id")


def standing(told: DataFrame) -> DataFrame:
    """The records of folded()."""
    return told.where("kind = 'record'").select("knowledge_type", "record_id", "process_id", "status", "version", "is_stale", "visibility", "step_number")


def fields(records: DataFrame, commands: DataFrame, told: DataFrame) -> DataFrame:
    """(knowledge_type, record_id, fields, original): what applied edits made of the fields, and what was extracted.

    `records` has fields map<string,string> here. Of every field the last edit stands, trimmed, blank as null; `original`
    has the values that the first edit replaced, of the fields the record had. Added steps have the fields of their
    command. Step numbers are in standing().
    """
    done = outcomes(told).where("outcome = 'applied'").select("event_id", F.col("record_id").alias("about"), F.col("knowledge_type").alias("about_type"))
    edits = commands.where("action in ('edit_approve', 'add_process_step')").join(done, "event_id")
    allowed = reduce(lambda x, y: x | y, ((F.col("about_type") == k) & F.col("key").isin(*(f for f in fs if f != "step_number")) for k, fs in FIELDS.items()))
    each = edits.select("event_id", "action", F.col("about_type").alias("knowledge_type"), F.col("about").alias("record_id"), F.explode("patch").alias("key", "value"), "about_type")
    each = each.where(allowed).select("event_id", "action", "knowledge_type", "record_id", "key", F.nullif(F.trim("value"), F.lit("")).alias("value"))
    key = ["knowledge_type", "record_id"]
    last = each.groupBy(*key, "key").agg(F.max_by("value", "event_id").alias("value")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("changed"))
    # the first edit of a field the record had, with whatever else it set
    had = records.select(*key, F.explode_outer("fields").alias("key", "old")).where("key is not null")
    replaced = each.where("action = 'edit_approve' and key not in ('role_ids', 'resource_id')").join(had, [*key, "key"])
    first = replaced.groupBy(*key).agg(F.min("event_id").alias("event_id"))
    kept = replaced.join(first, [*key, "event_id"], "left_semi").groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "old")))).alias("original"))
    empty = F.create_map().cast("map<string,string>")
    whole = records.select(*key, F.col("fields").alias("was")).join(last, key, "full").join(kept, key, "left")
    merged = F.map_zip_with(F.coalesce("was", empty), F.coalesce("changed", empty), lambda k, a, b: F.when(F.map_contains_key(F.coalesce("changed", empty), k), b).otherwise(a))
    return whole.select(*key, merged.alias("fields"), "original")


def links(existing: DataFrame, commands: DataFrame, told: DataFrame) -> DataFrame:
    """(process_id, resource_id) that stand after all applied link_resource and unlink_resource commands."""
    done = outcomes(told).where("outcome = 'applied'").select("event_id")
    now = commands.where("action in ('link_resource', 'unlink_resource')").join(done, "event_id", "left_semi")
    now = now.select(F.col("record_id").alias("process_id"), F.col("patch")["resource_id"].alias("resource_id"), "event_id", (F.col("action") == "link_resource").alias("on"))
    was = existing.select("process_id", "resource_id", F.lit(-1).cast("long").alias("event_id"), F.lit(True).alias("on"))
    return was.unionByName(now).groupBy("process_id", "resource_id").agg(F.max_by("on", "event_id").alias("on")).where("on").drop("on")
