"""Change detection, queues, state folds, evaluation, files and streams."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions.access import Filters
from tarn.functions.text import parse_query
from tarn.operators import changes, chunking, evaluation, operations, retrieval
from tarn.sources import files
from tarn.sources.readers import RateLimited, RecordedPages, pages, with_retry
from tarn.streaming import jobs

NOW = datetime(2024, 2, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 9), st.sampled_from("abc"), max_size=8), st.dictionaries(st.integers(0, 9), st.sampled_from("abc"), max_size=8))
def test_a_diff_turns_old_into_new(spark, old, new):
    f = lambda d: spark.createDataFrame(list(d.items()), "k int, v string")
    got = {r.k: r for r in changes.snapshot_diff(f(old), f(new), "k", ["v"]).collect()}
    state = {k: v for k, v in old.items() if got[k].change_type != "missing"}
    state |= {k: new[k] for k, r in got.items() if r.change_type in ("created", "updated")}
    assert state == new and all((r.change_type == "unchanged") == (old.get(k) == new.get(k)) for k, r in got.items())


def test_missing_needs_a_complete_scan(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, gone boolean")
    new = spark.createDataFrame([(1, "a")], "k int, v string")
    kinds = lambda c: {r.k: r.change_type for r in changes.snapshot_diff(old, new, "k", ["v"], c, "gone").collect()}
    assert kinds(True) == {1: "restored", 2: "missing"} and kinds(False) == {1: "restored", 2: "unchanged"}


def test_merges(spark):
    r = lambda rows: spark.createDataFrame(rows, "m int, name string, user string, first_seen int")
    got = changes.merged_children(r([(1, "ok", "a", 5), (1, "no", "a", 5)]), r([(1, "ok", "a", 9), (1, "new", "b", 9)]), ["m", "name", "user"]).collect()
    assert {(x.name, x.first_seen) for x in got} == {("ok", 5), ("new", 9)}
    d = spark.createDataFrame([(1, "h1", "fine"), (2, "h2", None)], "k int, hash string, review string")
    i = spark.createDataFrame([(1, "h1", None), (3, "h3", "new")], "k int, hash string, review string")
    assert {(x.k, x.review) for x in changes.upsert_keeping(d, i, ["k", "hash"], ["review"]).collect()} == {(1, "fine"), (3, "new")}
    assert {x.k for x in changes.replaced_children(d, i, "k").collect()} == {1, 2, 3}
    t = spark.createDataFrame([("c", "9.000"), ("c", "11.000"), ("c", "10.000")], "c string, ts string")
    assert changes.latest_checkpoint(t, "c", "ts").first().ts == "11.000"
    assert {x.k for x in changes.orphans(d, i, "k", "k").collect()} == {2}


def test_index_rebuild(spark):
    s = lambda rows: spark.createDataFrame(rows, "stable_key string, index_hash string, is_current boolean")
    old = s([("doc:1", "a", True), ("doc:2", "b", True), ("art:1", "c", True)])
    new = s([("doc:1", "a", True), ("doc:3", "d", True)])
    got = {r.stable_key: r.change for r in chunking.index_diff(old, new, F.col("stable_key").startswith("doc:")).collect()}
    assert got == {"doc:1": "unchanged", "doc:2": "retired", "doc:3": "created"}
    assert {r.change for r in chunking.index_diff(old, old).collect()} == {"unchanged"}


def test_two_strikes(spark):
    state = spark.createDataFrame([(i, 0, None, False) for i in range(4)], "k int, misses int, last_checked timestamp_ntz, deleted boolean")
    seen = spark.createDataFrame([(0,)], "k int")
    a = changes.two_strikes(state, seen, "k", NOW)
    assert {r.k: (r.misses, r.deleted) for r in a.collect()} == {0: (0, False), **{i: (1, False) for i in (1, 2, 3)}}
    b = changes.two_strikes(a, seen, "k", NOW + timedelta(hours=1))
    assert {r.deleted for r in b.collect()} == {False}
    c = changes.two_strikes(b, seen.unionAll(spark.createDataFrame([(1,)], "k int")), "k", NOW + timedelta(hours=7))
    assert {r.k: r.deleted for r in c.collect()} == {0: False, 1: False, 2: True, 3: True}


def test_outbox_never_posts_twice(spark):
    box = spark.createDataFrame([(1, "t", "sending", 1, None, NOW - timedelta(hours=3)), (2, "t", "pending", 0, None, None), (3, "u", "pending", 0, None, None), (4, "v", "retry", 2, NOW + timedelta(hours=1), None)], "id long, ticket_id string, state string, attempts int, retry_at timestamp_ntz, claimed_at timestamp_ntz")
    assert [r.id for r in operations.claimable(box, NOW).collect()] == [1, 3]
    out = spark.createDataFrame([(1, "unknown"), (3, "posted")], "id long, outcome string")
    after = operations.settled(box, out, NOW)
    assert {r.id: r.state for r in after.collect()} == {1: "uncertain", 2: "pending", 3: "posted", 4: "retry"}
    assert operations.claimable(after, NOW).count() == 0  # an uncertain head blocks its line
    again = operations.settled(after, spark.createDataFrame([(3, "rejected")], "id long, outcome string"), NOW)
    assert {r.id: r.state for r in again.collect()}[3] == "posted"


def test_field_changes(spark):
    diff = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "x map<string,string>, y map<string,string>").select(operations.field_changes(F.col("x"), F.col("y")).alias("d")).first().d
    assert {k: (v.before, v.after) for k, v in diff.items()} == {"b": ("2", "3"), "c": (None, "4")}


def test_refresh_and_repost(spark):
    c = lambda *ts: spark.createDataFrame([(t,) for t in ts], "checked_at timestamp_ntz")
    due = lambda df, force=False: operations.refresh_due(df, NOW, force=force).first().due
    fresh = NOW - timedelta(hours=11)
    assert not due(c(fresh)) and due(c(fresh, NOW - timedelta(hours=12))) and due(c(fresh, None)) and due(c(fresh), True)
    t = spark.createDataFrame([(1, "open"), (2, "open"), (3, "closed"), (4, "open")], "ticket_id int, status string")
    old, new = str((NOW - timedelta(days=30)).timestamp()), str((NOW - timedelta(days=3)).timestamp())
    m = spark.createDataFrame([(1, old, False), (2, old, False), (2, new, False), (3, old, False), (4, old, True)], "ticket_id int, ts string, closed boolean")
    assert [r.ticket_id for r in operations.repost_eligible(t, m, NOW, NOW).collect()] == [1]
    assert operations.repost_eligible(t, m, NOW - timedelta(hours=3), NOW).count() == 0
    assert operations.numbered(spark.createDataFrame([(1, "ACTION-1200"), (2, None)], "k int, code string"), "code", ["k"]).where("k = 2").first().code == "ACTION-1201"


def gold(spark, *rows):
    return spark.createDataFrame(list(rows), "query string, primary_ids array<string>, acceptable_ids array<string>, category string")


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", f"x{i}", i) for i in range(1, 8)] + [("q", "alt", 8), ("r", "a", 1), ("r", "a", 2), ("r", "z", 3)], "query string, unit_id string, rank int")
    m = {r.query: r for r in evaluation.query_metrics(ranked, gold(spark, ("q", ["p"], ["alt"], "c"), ("r", ["a", "b"], None, None), ("none", ["a"], [], "c"))).collect()}
    assert (m["q"].hit_at_5, m["q"].hit_at_8, m["q"].recall_at_10, m["q"].mrr) == (0, 1, 1, 1 / 8)
    assert (m["r"].hit_at_1, m["r"].recall_at_5, m["none"].mrr) == (1, 0.5, 0)
    by = {r.category: r.queries for r in evaluation.averaged(spark.createDataFrame([tuple(x) for x in m.values()], evaluation.query_metrics(ranked, gold(spark)).schema), ["category"]).collect()}
    assert by == {"c": 2, "unknown": 1}
    s = evaluation.split(spark.createDataFrame([(f"q{i}", "f" if i < 18 else "g", None) for i in range(20)], "query string, source_family string, category string"), "seed")
    a = {r.query: r.split for r in s.collect()}
    assert a == {r.query: r.split for r in s.collect()} and 6 <= sum(v == "holdout" for v in a.values()) <= 8
    assert "holdout" in {a["q18"], a["q19"]}
    best = spark.createDataFrame([("a", 0.5, 0.5, 0.5, 9.0), ("b", 0.5, 0.5, 0.5, 1.0)], "strategy string, recall_at_10 double, hit_at_5 double, mrr double, median double")
    assert evaluation.best_strategy(best).first().strategy == "b"


def units(spark):
    rows = [("1", "article", "Budget plan", "the budget of the club", "approved"), ("2", "article", "Other", "a plan for the budget plan", "approved"), ("3", "operational_action", ".env", "budget", "proposed")]
    df = spark.createDataFrame(rows, "unit_id string, source_type string, title string, content string, review_status string")
    none = F.lit(None)
    return df.withColumns({"source_area": none.cast("string"), "topic": none.cast("string"), "channel": none.cast("string"), "author": none.cast("string"), "visibility": F.lit("public"), "authority": F.lit("governance"), "is_current": F.lit(True), "is_stale": F.lit(False), "is_deleted": F.lit(False), "occurred_at": none.cast("timestamp_ntz"), "source_updated_at": none.cast("timestamp_ntz"), "updated_at": none.cast("timestamp_ntz")})


def test_search(spark):
    u = units(spark)
    e = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0]), ("3", [float("nan"), 1.0])], "unit_id string, embedding array<double>")
    got = [r.unit_id for r in retrieval.search(u, None, "budget plan", scope="public").collect()]
    assert got == ["1", "2"]
    assert [r.unit_id for r in retrieval.search(u, e, "budget plan", [0.1, 1.0]).collect()] == ["2", "1"]
    assert [r.unit_id for r in retrieval.search(u, e, "BUDGET numbers", [0.1, 1.0]).collect()] == ["2", "1"]
    assert [r.unit_id for r in retrieval.search(u, e, "BUDGET", [0.1, 1.0]).collect()][0] == "1"  # rescued by its title
    assert [r.unit_id for r in retrieval.search(u, e, "x", [0.1, 1.0], mode="semantic", limit=1, offset=1).collect()] == ["1"]
    for bad in (dict(query=" "), dict(query="x", limit=51), dict(query="x", mode="?"), dict(query="x", mode="semantic")):
        with pytest.raises(retrieval.SearchError):
            retrieval.search(u, e, **bad)
    assert retrieval.matched(u, [parse_query('"of the" -plan')]).count() == 0
    assert u.where(Filters(source_types=("article",)).column()).count() == 2
    ok = evaluation.embedding_eligible(("article", "operational_action"))
    assert {r.unit_id for r in u.where(ok).collect()} == {"1", "2"}
    assert retrieval.clamp(None) == 20 and retrieval.clamp(0) == 1 and retrieval.clamp(99) == 50 and retrieval.over_fetch(5) == 30


def test_fusion_prefers_both_lists(spark):
    l = spark.createDataFrame([("q", "1", 1), ("q", "2", 2)], "query string, unit_id string, lexical_rank int")
    s = spark.createDataFrame([("q", "3", 1), ("q", "2", 2)], "query string, unit_id string, semantic_rank int")
    u = spark.createDataFrame([(i, None, False) for i in "123"], "unit_id string, authority string, is_current boolean")
    first = retrieval.fused(l, s, u).where("rank = 1").first()
    assert (first.unit_id, first.lexical_rank, first.semantic_rank) == ("2", 2, 2)


def test_files(spark, tmp_path):
    (tmp_path / "Area").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, data in {"Area/a.txt": "﻿Hi\r\nthere".encode(), "Area/~$tmp.docx": b"", ".hidden/x.txt": b"", "Area/bad.docx": b"no zip", "Area/p.html": b"<p>a</p><script>x</script>b", "Area/z.zip": b"", "Area/w.txt": b"caf\xe9"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "Area/m.eml").write_bytes(b"Subject: S\r\nFrom: a@b.c\r\nContent-Type: text/plain\r\n\r\nbody\r\n")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "Area/d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "Area/s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="T"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="inlineStr"><is><t>k</t></is></c><c><v>3</v></c></row></sheetData></worksheet>')
    listing = files.listed(spark, str(tmp_path), excluded_globs=("*.zip",))
    got = {r.name: r for r in files.documents(spark, str(tmp_path), listing).collect()}
    assert set(got) == {"a.txt", "bad.docx", "p.html", "w.txt", "m.eml", "d.docx", "s.xlsx"}
    assert {n: (r.status, r.text) for n, r in got.items() if n not in ("bad.docx", "m.eml")} == {"a.txt": ("extracted", "Hi\nthere"), "p.html": ("extracted", "a\nb"), "w.txt": ("extracted", "café"), "d.docx": ("extracted", "One\nx | y"), "s.xlsx": ("extracted", "--- Sheet: T ---\nk\t3")}
    assert got["bad.docx"].status == "failed" and got["m.eml"].text == "Subject: S\nFrom: a@b.c\n\nbody" and got["a.txt"].area == "area"
    assert files.listed(spark, str(tmp_path), area="other").count() == 0
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_recorded_pages_of_any_length_are_read_whole(spark, tmp_path):
    (tmp_path / "C1").mkdir()
    page = lambda a, n, **more: json.dumps({"messages": [{"ts": f"{i:04}", "user": "a", "text": "x"} for i in range(a, a + n)], **more})
    (tmp_path / "C1/first.json").write_text(page(0, 350, response_metadata={"next_cursor": "n2"}))
    (tmp_path / "C1/n2.json").write_text(page(350, 201))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedPages)
    df = spark.read.format("recorded_pages").option("entities", "C1").load(str(tmp_path))
    assert sorted(r.ts for r in df.collect()) == [f"{i:04}" for i in range(551)]


def test_recorded_pages(spark, tmp_path):
    (tmp_path / "C1").mkdir()
    (tmp_path / "C1/first.json").write_text(json.dumps({"messages": [{"ts": "1", "user": "a", "text": "x"}], "response_metadata": {"next_cursor": "n2"}}))
    (tmp_path / "C1/n2.json").write_text(json.dumps({"messages": [{"ts": "2", "user": "b", "text": "y"}]}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedPages)
    df = spark.read.format("recorded_pages").option("entities", "C1").load(str(tmp_path))
    assert [(r.ts, r.sender) for r in df.orderBy("ts").collect()] == [("1", "a"), ("2", "b")]
    assert [r.text for r in df.where("ts >= '2'").collect()] == ["y"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RateLimited
        return "ok"

    assert with_retry(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(RuntimeError):
        list(pages(lambda c: {"next_cursor": "more"}, most_pages=3))


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "bounced").otherwise("sent").alias("status"))
    e.repartition(5).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, user_id long, ts timestamp_ntz, status string"
    state = jobs.StateTable(spark, str(tmp_path / "state"), "user_id long, status string, ts timestamp_ntz")
    stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, 1)
    jobs.fold(stream, state, jobs.latest_status_step("user_id", "status", "ts"), str(tmp_path / "check")).awaitTermination()
    key = lambda df: sorted((r.user_id, r.status, r.ts) for r in df.collect())
    assert key(state.read()) == key(operations.latest_status(e, "user_id", "status", "ts"))
    jobs.counts_by_window(stream, "ts", "status", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start().processAllAvailable()
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
    s = stream.select("user_id", (F.col("status") != "bounced").alias("seen"))
    q = jobs.miss_counter(s, "user_id").writeStream.format("memory").queryName("m").outputMode("update").start()
    q.processAllAvailable()
    assert spark.table("m").select("user_id").distinct().count() == e.select("user_id").distinct().count()
    for x in spark.streams.active:
        x.stop()


def test_sheets_are_named_by_relation():
    import io
    import zipfile

    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="Second" r:id="b"/><sheet name="First" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for i in (1, 2):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet><sheetData><row><c><v>{i}</v></c></row></sheetData></worksheet>")
    assert files.text_of("xlsx", book.getvalue())[1] == "--- Sheet: Second ---\n2\n--- Sheet: First ---\n1"
