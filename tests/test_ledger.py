"""Commands on records and tickets, unit builders and incremental extraction against plain versions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarn.operators import builders, changes, chunking, evaluation, extraction, ledger

COMMAND = "record_id long, event_id long, action string, expected_version int, patch map<string,string>, reason string, actor_role string, at timestamp_ntz"
RECORD = "record_id long, version int, state string, fields map<string,string>"
AT = datetime(2024, 1, 1)


def _command(record, event, action, expected=None, patch=None, reason=None, role="admin"):
    return (record, event, action, expected, patch, reason, role, AT)


def _told(spark, records, commands, units=("u1",)):
    told = ledger.record_commands(spark.createDataFrame(records, RECORD), spark.createDataFrame(commands, COMMAND), spark.createDataFrame([(u,) for u in units], "unit_id string"))
    return told, {r.event_id: (r.outcome, r.version, r.state) for r in told.collect()}


def test_a_record_through_its_life(spark):
    records = [(1, 1, "proposed", {"record_type": "decision", "title": "a"}), (2, 1, "approved", {"record_type": "decision"})]
    steps = [
        _command(1, 1, "publish", 1, {"visibility": "public"}),
        _command(1, 2, "approve", 1),
        _command(1, 3, "approve", 2),
        _command(1, 4, "publish", 2, {"visibility": "secret"}),
        _command(1, 5, "publish", 2, {"visibility": "public"}),
        _command(1, 6, "edit", 2, {"title": "late"}),
        _command(1, 7, "edit", 3, {"title": " b ", "description": " "}),
        _command(1, 8, "edit", 4, {"colour": "red"}),
        _command(1, 9, "reject", 4, None, "  "),
        _command(1, 10, "attach_evidence", 4, {"retrieval_unit_id": "u9"}),
        _command(1, 11, "attach_evidence", 4, {"retrieval_unit_id": "u1"}),
        _command(1, 12, "supersede", 5, {"superseded_by_id": "1"}),
        _command(1, 13, "supersede", 5, {"superseded_by_id": "2"}),
        _command(1, 14, "unpublish", 6),
        _command(1, 15, "defer", 6),
        _command(1, 16, "approve", 7),
        _command(1, 17, "fly", 7),
        _command(1, 18, "detach_evidence", 7, {"evidence_id": "11"}),
        _command(3, 19, "edit", 1, {"title": "x"}),
        _command(3, 20, "create", None, {"record_type": "wish", "title": "x"}),
        _command(3, 21, "create", None, {"record_type": "action_item", "title": " x "}),
        _command(3, 22, "complete", 1),
        _command(3, 23, "create", None, {"record_type": "decision", "title": "x"}),
        _command(3, 24, "reopen", 2, None, None, "committee"),
        _command(None, 25, "approve", 1),
    ]
    random.Random(1).shuffle(steps)
    told, got = _told(spark, records, steps)
    outcomes = [got[i][0] for i in range(1, 26)]
    assert outcomes == [
        "not_publishable", "applied", "invalid_transition", "invalid_visibility", "applied", "concurrency_conflict", "applied", "validation_error", "validation_error",
        "evidence_not_found", "applied", "validation_error", "applied", "not_publishable", "applied", "invalid_transition", "invalid_transition", "applied",
        "not_found", "validation_error", "applied", "applied", "validation_error", "unauthorized", "not_found",
    ]
    rows = {r.record_id: r for r in ledger.standing(spark.createDataFrame(records, RECORD), told).collect()}
    assert (rows[1].version, rows[1].state) == (8, "needs_review" + ledger.PAST)
    assert rows[1].fields == {"record_type": "decision", "title": "b", "description": None, "visibility": "public", "superseded_by_id": "2"}
    assert rows[2].version == 1 and rows[3].fields["title"] == "x" and rows[3].fields["execution_status"] == "completed" and rows[3].fields["completed_at"]
    assert not ledger.evidence_links(told).count()


def test_a_hot_record_keeps_its_order(spark):
    rng = random.Random(3)
    steps = [_command(1, i, rng.choice(["approve", "defer", "edit"]), rng.choice([None, 1, 2, i // 9, i // 10]), {"title": str(i)}) for i in range(25_000)]
    rng.shuffle(steps)
    _, got = _told(spark, [(1, 1, "proposed", None)], steps)
    version, state = 1, "proposed"
    for c in sorted(steps, key=lambda c: c[1]):
        if c[3] == version and not (c[2] == "approve" and state == "approved"):
            version, state = version + 1, {"approve": "approved", "defer": "needs_review", "edit": state}[c[2]]
        assert got[c[1]][1:] == (version, state)


def test_tickets(spark):
    tickets = [(1, 1, "approved", {"visibility": "committee"}), (2, 1, "approved", {"visibility": "internal"}), (3, 1, "proposed", None)]
    officers = spark.createDataFrame([("o1", True), ("o2", True), ("o3", False)], "officer_id string, active boolean")
    steps = [
        _command(1, 1, "assign", 1, {"assignee_ids": '["o2","o1","o2"]'}, None, "committee"),
        _command(1, 2, "assign", 2, {"assignee_ids": '["o3"]'}),
        _command(1, 3, "assign", 2, {"assignee_ids": "o1"}),
        _command(1, 4, "assign", 2, {"assignee_ids": str(["o1"] * 21).replace("'", '"')}),
        _command(1, 5, "status", 2, {"execution_status": "completed"}),
        _command(1, 6, "status", 3, {"execution_status": "open"}),
        _command(1, 7, "update", 4, {"title": "t" * 301}),
        _command(1, 8, "update", 4, {"priority": None}),
        _command(2, 9, "status", 1, {"execution_status": "open"}, None, "committee"),
        _command(3, 10, "status", 1, {"execution_status": "open"}),
        _command(4, 11, "create", None, {"title": " new ", "assignee_ids": '["o1"]'}),
        _command(4, 12, "create", None, {"title": "again"}),
        _command(5, 13, "status", 1, {"execution_status": "open"}),
        _command(4, 14, "fold", 1),
    ]
    told = ledger.ticket_commands(spark.createDataFrame(tickets, RECORD), spark.createDataFrame(steps, COMMAND), officers)
    got = {r.event_id: r.outcome for r in told.collect()}
    bad, who = "validation_error", "unauthorized"
    assert [got[i] for i in range(1, 15)] == ["applied", bad, bad, bad, "applied", "applied", bad, bad, who, who, "applied", bad, "not_found", "invalid_transition"]
    rows = {r.record_id: r.fields for r in ledger.standing(spark.createDataFrame(tickets, RECORD), told).collect()}
    assert rows[1]["assignee_ids"] == '["o1","o2"]' and rows[1]["execution_status"] == "open" and rows[1]["completed_at"] is None
    assert rows[4]["title"] == "new" and rows[4]["priority"] == "medium" and rows[4]["assignee_ids"] == '["o1"]'


def test_no_commands_and_no_records(spark):
    told, got = _told(spark, [], [_command(1, 1, "approve", 1)])
    assert got == {1: ("not_found", 0, None)} and ledger.standing(spark.createDataFrame([], RECORD), told).count() == 0
    told, got = _told(spark, [(1, 1, "proposed", {"title": "a"})], [])
    assert not got and ledger.standing(spark.createDataFrame([(1, 1, "proposed", {"title": "a"})], RECORD), told).first().fields == {"title": "a"}


def test_maps_merge(spark):
    row = spark.range(1).select(ledger.merged(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', cast(null as string), 'c', '3')")).alias("m")).first()
    assert row.m == {"a": "1", "b": None, "c": "3"}


def test_index_units_are_the_chunks(spark):
    rows = spark.createDataFrame([(1, "c", "S", "d", "m@x", "\n\n".join(["word " * 200] * 9), AT, None, None, False), (2, "c", "T", "", "m@x", "", AT, None, None, True)], "id long, content_hash string, subject string, d string, sender_address string, body_text string, received_at timestamp_ntz, modified_at timestamp_ntz, web_link string, is_deleted boolean")
    meetings = spark.createDataFrame([(1, "M", AT, AT, False, False)], "meeting_id long, title string, started_at timestamp_ntz, source_updated_at timestamp_ntz, is_missing boolean, online boolean")
    artifacts = spark.createDataFrame([(7, 1, "transcript", "all", "ok", None, None, True), (8, 1, "transcript", "whole", "ok", None, None, True), (9, 1, "notes", "n", "ok", None, "r", False)], "artifact_id long, meeting_id long, artifact_type string, content string, review_status string, source_updated_at timestamp_ntz, source_reference string, is_current boolean")
    segments = spark.createDataFrame([(7, i, i * 1000, i * 1000 + 900, "A", "x" * 1000) for i in range(5)], "artifact_id long, seq int, start_ms long, end_ms long, speaker string, text string")
    records = builders.united(builders.of_mail(rows), builders.of_meetings(meetings, artifacts, segments))
    units = builders.index_units(records, builders.of_transcripts(meetings, artifacts, segments)).collect()
    mail = sorted((u.chunk_index, u.content) for u in units if u.source_type == "mail_message")
    assert [c for _, c in mail] == chunking.chunks_of("S\n\n" + "\n\n".join(["word " * 200] * 9)) and len(mail) > 1
    spoken = sorted((u.version_id, u.chunk_index, u.stable_key) for u in units if u.source_type == "meeting_transcript")
    assert spoken == [("7", i, f"meeting_transcript:1:7:{i}:0") for i in range(3)] + [("8", 0, "meeting_transcript:1:8:0")]
    assert len({u.unit_id for u in units}) == len(units)
    assert len({u.index_hash for u in units}) == len({(u.source_type, u.title, u.content, u.start_ms) for u in units})


def test_extraction_again(spark):
    schema = "article_id long, text string, content_hash string, last_hash string"
    work = extraction.due(spark.createDataFrame([(1, "ask a@x.org", "h1", "h1"), (2, "ask b@x.org", "h2", "h0"), (3, None, "h3", None), (4, "see https://x.org/form", "h4", None)], schema))
    assert {r.article_id: r.step for r in work.collect()} == {1: "skipped_unchanged", 2: "extract", 3: "extract", 4: "extract"}
    stored = spark.createDataFrame([(1, "contact", "h0", "{}", False), (2, "contact", "h0", "{}", False), (9, "contact", "h9", "{}", True)], "article_id long, kind string, source_content_hash string, found string, is_stale boolean")
    rules = {"contact": extraction.contacts, "resource": extraction.resources}
    once = extraction.refreshed(stored, work, rules)
    got = sorted((r.article_id, r.kind, r.source_content_hash, r.is_stale) for r in once.collect())
    assert got == [(1, "contact", "h0", False), (2, "contact", "h0", True), (2, "contact", "h2", False), (4, "resource", "h4", False), (9, "contact", "h9", True)]
    again = extraction.due(extraction.finished(work).drop("step"))
    assert not again.where("step = 'extract'").count()
    assert sorted(map(tuple, extraction.refreshed(once, again, rules).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, extraction.refreshed(once, extraction.due(work.drop("step"), force=True), rules).where("article_id = 2").collect())) == sorted(map(tuple, once.where("article_id = 2").collect()))


def test_reactions_merge(spark):
    seen = changes.reactions(spark.createDataFrame([(1, [(" ok ", ["a", "a", None]), (" ", ["b"])]), (2, None), (3, [("x", None)])], "message_id long, reactions array<struct<name string, users array<string>>>"))
    assert [tuple(r) for r in seen.collect()] == [(1, "ok", "a")]
    stored = spark.createDataFrame([(1, "ok", "a", AT, AT), (1, "no", "a", AT, AT)], "message_id long, name string, user_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    later = datetime(2024, 2, 1)
    got = {r.name: (r.first_seen_at, r.last_seen_at) for r in changes.merge_reactions(stored, seen, later).collect()}
    assert got == {"ok": (AT, later), "no": (AT, AT)}


@pytest.mark.parametrize("rows", [[], [("semantic", "q", "u9", 1)]])
def test_failures_name_every_strategy(spark, rows):
    gold = spark.createDataFrame([("q", ["u1", "u1"], ["u2"])], "query string, primary_ids array<string>, acceptable_ids array<string>")
    got = evaluation.failures(spark.createDataFrame(rows, "strategy string, query string, unit_id string, rank int"), gold).collect()
    assert len(got) == 6 and all(r.expected == ["u1"] and r.acceptable == ["u2"] for r in got)
    assert {r.strategy: r.returned for r in got}["semantic"] == [r[2] for r in rows]
