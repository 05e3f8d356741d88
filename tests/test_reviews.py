"""Review transactions: each action, refusals in their order, a process with its steps, what edits leave."""

from tarn.operators import reviews

RECORD = "knowledge_type string, record_id string, process_id string, status string, version int, is_stale boolean, visibility string, step_number int, fields map<string,string>"
COMMAND = "event_id long, knowledge_type string, record_id string, action string, expected_version int, patch map<string,string>, reason_code string, reason_note string, visibility string, actor_role string, actor_active boolean"


def record(kind="requirement", id="r", status="proposed", stale=True, seen="internal", number=None, process=None, version=1, **fields):
    return kind, id, process, status, version, stale, seen, number, fields


def command(n, action, expected=1, id="r", kind="requirement", patch=None, code=None, note=None, seen=None, role="admin", active=True):
    return n, kind, id, action, expected, patch, code, note, seen, role, active


def told(spark, records, commands):
    r, c = spark.createDataFrame(records, RECORD), spark.createDataFrame(commands, COMMAND)
    return r, c, reviews.folded(r.drop("fields"), c)


def outcomes(out):
    return {r.event_id: r.outcome for r in reviews.outcomes(out).collect()}


def test_any_state_takes_any_review(spark):
    leads = {"approve": "approved", "needs_review": "needs_review", "defer": "needs_review", "supersede": "superseded", "reject": "rejected"}
    pairs = [(state, action) for state in reviews.STATES for action in leads]
    records = [record(id=f"{state}:{action}", status=state) for state, action in pairs]
    _, _, out = told(spark, records, [command(n, action, id=f"{state}:{action}", note="why") for n, (state, action) in enumerate(pairs)])
    for e in reviews.outcomes(out).collect():
        state, action = pairs[e.event_id]
        assert (e.outcome, e.previous_status, e.status, e.version) == ("applied", state, leads[action], 2)
        assert e.is_stale == (action != "approve") and e.action == ("needs_review" if action == "defer" else action)


def test_refusals(spark):
    records = [record(), record(id="a", status="approved", stale=False), record(id="s", status="approved"), record("process", "p")]
    bad = [
        (command(1, "approve", active=False, role="member"), "inactive_profile"),
        (command(2, "approve", role="committee"), "unauthorized"),
        (command(3, "approve", expected=0), "validation_error"),
        (command(4, "approve", expected=None), "validation_error"),
        (command(5, "edit_approve", patch={"confidence": "1"}), "validation_error"),
        (command(6, "approve", kind="rumour"), "validation_error"),
        (command(7, "approve", id="nobody"), "record_not_found"),
        (command(8, "approve", kind="process"), "record_not_found"),
        (command(9, "approve", expected=2), "concurrency_conflict"),
        (command(10, "reject", note="  ", code=""), "validation_error"),
        (command(11, "edit_approve", patch={}), "validation_error"),
        (command(12, "edit_approve", patch={"requirement_text": "  "}), "validation_error"),
        (command(13, "publish", seen="member"), "stale_record"),
        (command(14, "publish", id="s", seen="member"), "stale_record"),
        (command(15, "publish", id="a", seen="all"), "invalid_visibility"),
        (command(16, "add_process_step", patch={"instruction": "do"}), "invalid_transition"),
        (command(17, "add_process_step", id="p", kind="process", patch={"instruction": " "}), "validation_error"),
        (command(18, "link_resource", id="p", kind="process", patch={}), "validation_error"),
        (command(19, "remove_process_step", id="p", kind="process"), "invalid_transition"),
        (command(20, "dance"), "invalid_transition"),
        (command(21, "approve", id=None), "record_not_found"),
    ]
    _, _, out = told(spark, records, [c for c, _ in bad])
    assert outcomes(out) == {c[0]: o for c, o in bad}
    assert all(r.version == 1 for r in reviews.standing(out).collect())


def test_publication(spark):
    _, _, out = told(spark, [record(status="approved", stale=False)], [command(1, "publish", seen="member"), command(2, "publish", 2, seen="internal"), command(3, "unpublish", 3)])
    assert [(r.action, r.visibility, r.version) for r in reviews.outcomes(out).orderBy("event_id").collect()] == [("publish", "member", 2), ("unpublish", "internal", 3), ("unpublish", "internal", 4)]


def test_a_process_and_its_steps(spark):
    records = [record("process", "p", stale=False, seen="member"), *(record("process_step", f"s{n}", process="p", number=n, instruction=f"step {n}") for n in (1, 2, 3)), record("process_step", "t1", process="q", number=2)]
    commands = [
        command(1, "add_process_step", 1, "p", "process", {"instruction": " last ", "title": ""}),
        command(2, "edit_approve", 1, "s1", "process_step", {"step_number": "3"}),  # exchanged with s3
        command(3, "edit_approve", 1, "step:1", "process_step", {"step_number": "1", "instruction": "first"}),  # with s3 again
        command(4, "remove_process_step", 1, "s2", "process_step"),
        command(5, "link_resource", 2, "p", "process", {"resource_id": "x"}),
        command(6, "link_resource", 3, "p", "process", {"resource_id": "y"}),
        command(7, "unlink_resource", 4, "p", "process", {"resource_id": "x"}),
        command(8, "edit_approve", 1, "s3", "process_step", {"step_number": "0"}),
        command(9, "edit_approve", 1, "s3", "process_step", {"step_number": "two"}),
        command(10, "edit_approve", 1, "t1", "process_step", {"step_number": "9"}),
        command(11, "add_process_step", 5, "p", "process", {"instruction": "more"}),
    ]
    r, c, out = told(spark, records, commands)
    assert [k for k, v in outcomes(out).items() if v != "applied"] == [8, 9]
    at = {x.record_id: (x.step_number, x.status, x.version) for x in reviews.standing(out).collect()}
    assert at["s1"] == (3, "approved", 2) and at["s3"] == (4, "proposed", 1) and at["step:1"] == (1, "approved", 2)
    assert at["s2"] == (2, "superseded", 2) and at["t1"] == (9, "approved", 2) and at["p"][2] == 6 and at["step:11"] == (5, "approved", 1)
    added = next(x for x in reviews.outcomes(out).collect() if x.event_id == 1)
    assert (added.knowledge_type, added.record_id, added.previous_status, added.visibility, added.is_stale) == ("process_step", "step:1", None, "member", False)
    had = spark.createDataFrame([("p", "z")], "process_id string, resource_id string")
    assert sorted(tuple(x) for x in reviews.links(had, c, out).collect()) == [("p", "y"), ("p", "z")]
    f = {x.record_id: (x.fields, x.original) for x in reviews.fields(r, c, out).collect()}
    assert f["step:1"] == ({"instruction": "first", "title": None}, None) and f["s1"][0]["instruction"] == "step 1"


def test_originals_are_kept_once(spark):
    records = [record(requirement_text="old", applies_to="all")]
    commands = [command(1, "edit_approve", 1, patch={"role_ids": '["x"]'}), command(2, "edit_approve", 2, patch={"requirement_text": " new ", "topic_id": "7"}), command(3, "edit_approve", 3, patch={"requirement_text": "newer", "applies_to": " "})]
    r, c, out = told(spark, records, commands)
    (row,) = reviews.fields(r, c, out).collect()
    assert row.fields == {"requirement_text": "newer", "applies_to": None, "topic_id": "7", "role_ids": '["x"]'}
    assert row.original == {"requirement_text": "old"}


def test_nothing(spark):
    _, _, out = told(spark, [], [])
    assert out.collect() == []
    _, _, out = told(spark, [], [command(1, "approve")])
    assert outcomes(out) == {1: "record_not_found"} and reviews.standing(out).collect() == []
