"""Guarded scans: roles, inactive profiles, tables without a policy, rows seen through another table."""


from tarn.functions.policies import POLICIES, Policy, Reader, guarded

RECORD = "record_id long, record_type string, visibility string, review_status string, is_current boolean"


def tables(spark):
    records = [(1, "action_item", "public", "approved", True), (2, "decision", "member", "approved", True), (3, "action_item", "committee", "approved", True), (4, "action_item", "committee", "proposed", True), (5, "action_item", "internal", "approved", True), (6, None, None, None, None)]
    made = {
        "operational_records": spark.createDataFrame(records, RECORD),
        "ticket_assignees": spark.createDataFrame([(k, "o") for k in (1, 1, 2, 3, 4, 5, 6, 9, None)], "ticket_id long, officer string"),
        "operational_review_events": spark.createDataFrame([(k,) for k in range(1, 7)], "record_id long"),
        "profiles": spark.createDataFrame([("me",), ("you",), (None,)], "auth_user_id string"),
        "secrets": spark.createDataFrame([(1,)], "id long"),
    }
    return made.__getitem__


def ids(df, column):
    return sorted(r[column] for r in df.collect())


def test_roles(spark):
    t = tables(spark)
    see = lambda role, name, column, **more: ids(guarded(name, Reader(role, **more), t), column)
    assert see("anon", "operational_records", "record_id") == []
    assert see("member", "operational_records", "record_id") == [1, 2] and see("committee", "operational_records", "record_id") == [1, 2, 3]
    assert see("admin", "operational_records", "record_id") == [1, 2, 3, 4, 5, 6]
    assert see("committee", "operational_records", "record_id", active=False) == []
    assert see("member", "profiles", "auth_user_id", user="me") == ["me"] and see("member", "profiles", "auth_user_id") == []
    assert see("admin", "secrets", "id") == []  # no policy, nothing to see


def test_seen_through_another_table(spark):
    t = tables(spark)
    see = lambda role, name, column: ids(guarded(name, Reader(role), t), column)
    assert see("member", "ticket_assignees", "ticket_id") == [1, 1] and see("committee", "ticket_assignees", "ticket_id") == [1, 1, 3]
    assert see("admin", "ticket_assignees", "ticket_id") == [1, 1, 3, 4, 5]  # also for an administrator only of records that are action items
    assert see("committee", "operational_review_events", "record_id") == [3] and see("admin", "operational_review_events", "record_id") == [1, 2, 3, 4, 5, 6]


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "records")
    tables(spark)("operational_records").write.parquet(path)
    plan = guarded("operational_records", Reader("member"), lambda name: spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(review_status,approved)" in plan.split("PushedFilters")[1]


def test_every_policy_names_known_tables():
    assert all(p.through is None or p.through[0] in POLICIES for ps in POLICIES.values() for p in ps)
    assert all(isinstance(p, Policy) for ps in POLICIES.values() for p in ps)
