"""Mail, notes, accounts, rosters, benchmark files and exports."""

import json

from pyspark.sql import functions as F

from tarn.operators import records


def test_mail(spark):
    rows = [
        ("1", "Desk@Uni.org", " Hi ", "<p>One</p><p>Two</p>", "HTML", "2024-01-02T10:00:00Z", None, "https://outlook.office.com/x"),
        ("2", "other@uni.org", "x", "b", "text", "2024-01-02T10:00:00Z", None, None),
        ("3", "desk@uni.org", None, "b" * 60_000, "text", "2024-01-02T10:00:00+01:00", "bad", "https://evil.org/outlook.office.com"),
        ("4", "desk@uni.org", "x", "b", "text", "2024-01-02T10:00:00", None, None),
        ("", "desk@uni.org", "x", "b", "text", "2024-01-02T10:00:00Z", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, address string, subject string, body string, content_type string, received string, modified string, link string")
    good, bad = records.mail_records(df, "desk@UNI.org")
    a, b = sorted(good.collect(), key=lambda r: r.id)
    assert (a.subject, a.body, a.web_link, a.body_truncated) == ("Hi", "One\nTwo", "https://outlook.office.com/x", False)
    assert (b.subject, len(b.body), b.web_link, b.body_truncated, b.received_at.hour) == ("(No subject)", 50_000, None, True, 9)
    assert {r.id: r.reason for r in bad.collect()} == {"2": "another sender", "4": "time of receipt without a zone or not valid", "": "no usable id"}


def test_notes(spark):
    m = spark.createDataFrame([(1, "10.0", "see https://docs.google.com/document/d/AbC/edit", None, False), (2, "9.0", "", '{"u": "https://docs.google.com/document/u/0/d/AbC"}', False), (3, "1.0", "https://docs.google.com/document/d/AbC", None, True)], "message_id int, ts string, text string, raw string, deleted boolean")
    assert [tuple(r) for r in records.linked_documents(m).collect()] == [("AbC", "9.0", 2)]
    t = spark.createDataFrame([("📝 Notes\n\nBudget talk\nx",), ("Notes",)], "c string").select(records.note_title(F.col("c")).alias("t"))
    assert [r.t for r in t.collect()] == ["Budget talk", "Notes"]
    s = spark.createDataFrame([("d", "old", False), ("d", "new", True), ("e", "x", True)], "document_id string, content_hash string, is_current boolean")
    i = spark.createDataFrame([("d", "old")], "document_id string, content_hash string")
    assert {tuple(r) for r in records.current_versions(s, i).collect()} == {("d", "old", True), ("d", "new", False), ("e", "x", True)}


def test_account_reviews(spark):
    a = spark.createDataFrame([(1, "admin", "approved", None, 1, True), (2, "member", None, None, 1, True), (3, "verified", "approved", None, 4, True), (4, "committee", "approved", 9, 1, True), (5, "member", None, None, 1, False)], "account_id int, role string, status string, officer_id int, version int, active boolean")
    q = [(1, 1, 2, "verify", 1), (2, 1, 2, "verify", 1), (3, 1, 3, "promote_committee", 3), (4, 1, 4, "demote_member", 1), (5, 1, 1, "demote_member", 1), (6, 2, 3, "promote_admin", 4), (7, 1, 5, "verify", 1), (8, 1, 3, "fly", 4), (9, 1, 77, "verify", 1), (10, 1, 3, "verify", 4)]
    r = spark.createDataFrame([(*x, None, None) for x in q], "request_id int, actor_id int, account_id int, action string, expected_version int, reason string, officer_id int")
    got = {x.request_id: x for x in records.reviewed_accounts(a, r).collect()}
    assert {k: v.outcome for k, v in got.items()} == {1: "done", 2: "account changed", 3: "account changed", 4: "done", 5: "own access", 6: "admin required", 7: "inactive account", 8: "unsupported action", 9: "no such account", 10: "not from this role"}
    assert (got[1].role, got[1].status, got[1].version) == ("verified", "approved", 2)
    assert (got[4].role, got[4].officer_id, got[4].version) == ("verified", None, 2)
    two = a.unionByName(spark.createDataFrame([(8, "admin", "approved", None, 1, True)], a.schema))
    r2 = spark.createDataFrame([(1, 8, 1, "demote_member", 1, None, None)], r.schema)
    assert records.reviewed_accounts(two, r2).first().outcome == "done"
    r3 = spark.createDataFrame([(1, 8, 1, "demote_member", 1, None, None), (2, 1, 8, "demote_member", 1, None, None)], r.schema)
    assert sorted(x.outcome for x in records.reviewed_accounts(two, r3).collect()) == ["done", "one administrator at a time"]
    assert records.reviewed_accounts(a.limit(0), r).where("outcome = 'done'").count() == 0


def test_rosters_links_and_files(spark, tmp_path):
    o = spark.createDataFrame([(1, "Ann Lee", "24", True), (2, "ann lee", "25", True), (3, "Bob", "25", False)], "officer_id int, name string, academic_year string, active boolean")
    n = spark.createDataFrame([(" ann LEE ", None), ("Ann Lee", "25"), ("Bob", None), (" ", None)], "name string, academic_year string")
    assert {(r.name.strip(), r.academic_year): (r.officer_id, r.outcome) for r in records.roster_matches(n, o).collect()} == {("ann LEE", None): (None, "several officers"), ("Ann Lee", "25"): (2, "matched"), ("Bob", None): (None, "no active officer"), ("", None): (None, "empty name")}
    m = spark.createDataFrame([(1, "HTTPS://A.org/x#1 and https://a.org/x. https://b.org")], "message_id int, text string")
    assert [(r.url, r.domain) for r in records.links_in_messages(m.withColumn("text", F.replace("text", F.lit("HTTPS"), F.lit("https")))).orderBy("url").collect()] == [("https://A.org/x#1", "a.org"), ("https://b.org", "b.org")]
    row = {"query": "q", "source_family": "f", "expected_retrieval_unit_ids": ["u"]}
    (tmp_path / "a.json").write_text(json.dumps([row, row]))
    (tmp_path / "b.json").write_text(json.dumps({"split": "dev", "queries": [row]}))
    assert records.benchmark_rows(spark, str(tmp_path / "a.json")).count() == 2
    assert records.benchmark_rows(spark, str(tmp_path / "b.json")).first().primary_ids == ["u"]
    records.write_report(m, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    x = spark.createDataFrame([(200, False), (429, False), (502, False), (None, True)], "code int, late boolean")
    assert [r.o for r in x.select(records.outcome_of(F.col("code"), F.col("late")).alias("o")).collect()] == ["posted", "rejected", "unknown", "unknown"]
