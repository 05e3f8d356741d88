"""Chunks, identities, text and time expressions, extraction rules."""

import hashlib
import uuid
from datetime import date, datetime

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import access, identity, scalar, text
from tarn.operators import chunking, extraction
from tarn.operators.chunking import chunks_of


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_chunks():
    long = "Heading\n\n" + "word " * 900
    assert chunks_of(long) == chunks_of(long) and all(len(c) <= 2400 for c in chunks_of(long))
    assert chunks_of(None) == chunks_of(" \n ") == []
    assert chunks_of("a\n\nb") == ["a\n\nb"]
    two = chunks_of("x" * 1500 + "\n\n" + "y" * 1500)
    assert two[1].startswith("x" * 220 + "\n\n") and len(two) == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), max_size=12), st.integers(20, 60), st.integers(0, 10))
def test_chunks_keep_all_words(paragraphs, most, overlap):
    source = "\n\n".join(paragraphs)
    chunks = chunks_of(source, most, overlap)
    assert all(c == c.strip() and 0 < len(c) <= most + overlap + 2 for c in chunks)
    letters = lambda s: "".join(s.split())
    assert len(letters("".join(chunks))) >= len(letters(source))


def test_identities(spark):
    assert one(spark, identity.uuid5(F.col("n")), n="some name é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "some name é"))
    assert one(spark, identity.stable_key(F.lit("document"), F.lit(7), F.lit(None), F.lit(0))) == "document:7:-:0"
    want = hashlib.sha256("a\x1f\x1fb".encode()).hexdigest()
    assert one(spark, identity.fingerprint(F.lit("a"), F.lit(None), F.lit("b"))) == want
    a = spark.createDataFrame([(1, "v1", "T", "body"), (1, "v2", "T", "body")], "record_id int, version_id string, title string, content string")
    ids = [r.unit_id for r in chunking.make_units(a, F.lit("document")).collect()]
    assert len(set(ids)) == 2 and ids == [r.unit_id for r in chunking.make_units(a, F.lit("document")).collect()]


def test_text_expressions(spark):
    assert one(spark, text.tokens(F.lit("Ab-c_d é9"))) == ["ab", "c_d", "é9"]
    assert one(spark, text.emails(F.lit("To A.B@c.org, a.b@C.org; x@y"))) == ["a.b@c.org"]
    assert one(spark, text.canonical_url(F.lit("HTTPS://Ex.Org/Path?q=A#f"))) == "https://ex.org/Path?q=A"
    assert one(spark, text.unwrapped(F.lit("![pic](u) [a](b)\r\nc"))) == "pic a (b)\nc"
    assert one(spark, text.named_list(F.array(*map(F.lit, "abc")))) == "a, b, and c"
    assert one(spark, text.normal_path(F.lit("\\A\\b.TXT/"))) == "a/b.txt"
    assert one(spark, text.unescaped(text.escaped(F.lit("<a & b>")))) == "<a & b>"
    assert "@​channel" in one(spark, text.neutral_mentions(F.lit("hi @channel")))
    assert one(spark, F.lit("50% off").like(text.like_pattern("50%"))) and not one(spark, F.lit("50x off").like(text.like_pattern("50%")))
    pieces = one(spark, text.sections(10)(F.lit("one two three four")))
    assert "".join(pieces).replace(" ", "") == "onetwothreefour" and all(len(p) <= 10 for p in pieces)
    spans = one(spark, text.sentence_spans(F.lit("One. Two\nthree")))
    assert [(s.text, s.start, s.end) for s in spans] == [("One.", 0, 4), ("Two", 4, 8), ("three", 9, 14)]
    assert one(spark, text.sentences(F.lit("One. Two\nthree"))) == ["One.", "Two", "three"]


def test_query_syntax():
    q = text.parse_query('alpha "two words" or beta -gamma -"d e"')
    assert q.groups == ((("alpha",),), (("two", "words"), ("beta",))) and q.none == (("gamma",), ("d", "e"))
    assert text.parse_query('"" - or').groups == ()


def test_times(spark):
    at = lambda s, y=None: one(spark, scalar.parsed_time(F.lit(s), y))
    assert at("Tue, 11 Aug, 2026 at 10:00 AM") == datetime(2026, 8, 11, 10)
    assert at("2026-08-11T10:00:00Z") == datetime(2026, 8, 11, 10) and at("soon") is None
    assert at("Tue, 11 Aug at 10:00 AM", 2026) == datetime(2026, 8, 11, 10)
    day = lambda s: one(spark, scalar.human_date(F.lit(s)))
    assert day("15th August 2026") == day("August 15, 2026") == day("15/8/2026") == date(2026, 8, 15)
    assert day("15 August") is None and day("31/2/2026") is None
    assert one(spark, scalar.clock(F.lit(3_723_000))) == "01:02:03"
    assert one(spark, scalar.epoch_time(F.lit("1700000000.5"))) == datetime(2023, 11, 14, 22, 13, 20, 500000)
    assert one(spark, scalar.backoff_seconds(F.lit(0))) == 30 and one(spark, scalar.backoff_seconds(F.lit(20))) == 3600
    assert abs(one(spark, scalar.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 0.5**0.5) < 1e-12
    assert not one(spark, scalar.usable(F.array(F.lit(float("nan"))))) and one(spark, scalar.usable(F.array(F.lit(1.0)), 1))


def rules(spark, f, body):
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    return f(df).collect()


def test_extraction(spark):
    r = rules(spark, extraction.timing_rules, "Submit at least 5 working days in advance.")
    assert [(x.kind, x.days, x.working_days, x.on_date) for x in r] == [("relative_notice", 5, True, None)]
    r = rules(spark, extraction.timing_rules, "Applications close on 15 August 2026. The deadline is 3 March. Repeated every September before the start of term.")
    kinds = {(x.kind, x.on_date) for x in r}
    assert kinds == {("absolute_date", date(2026, 8, 15)), ("date_window", None), ("recurring_window", None), ("seasonal_term", None)}
    r = rules(spark, extraction.obligations, "You must submit the form. You need to keep a record. You must submit the form. Nothing.")
    assert [(x.requirement_type, x.mandatory) for x in sorted(r, key=lambda x: x.n)] == [("required_form", True), ("documentation_requirement", False)]
    r = rules(spark, extraction.steps, "1. Open\n2) Fill\nStep 3: Send\n2. Again")
    assert sorted((x.step, x.instruction) for x in r) == [(1, "Open"), (2, "Fill"), (3, "Send")]
    assert rules(spark, extraction.steps, "1. Only one") == []
    links = {x.url: x for x in rules(spark, lambda d: extraction.resources(d, systems=(("books\\.example", "Books"),)), "[Claim form](https://a.org/x). https://a.org/x https://books.example/p https://a.org/f.pdf; [m](mailto:a@b.c)")}
    assert {u: (x.resource_type, x.system) for u, x in links.items()} == {"https://a.org/x": ("form", None), "https://books.example/p": ("system", "Books"), "https://a.org/f.pdf": ("download", None)}
    assert [x.email for x in rules(spark, extraction.contacts, "Write to Help@Ex.org.\nor not")] == ["help@ex.org"]


def test_classification_and_tickets(spark):
    a = spark.createDataFrame([("Claims", None, "FINANCES", "budget"), ("Nothing", None, None, "plain")], "title string, category string, folder string, text string")
    x, y = sorted(extraction.classified(a).collect(), key=lambda r: r.title)
    assert x.relevance in ("high", "critical") and "treasurer" in x.roles and "finance" in x.topics
    assert (y.relevance, y.topics, y.roles) == ("low", ["other"], [])
    assert one(spark, extraction.at_least(F.lit("high"), "medium")) and not one(spark, extraction.at_least(F.lit("low"), "medium"))
    body = "ACTION-007 — Book &amp; pay\nPeople Assigned: ann and Bob\nDue: Friday\nPriority: High\nStatus: In progress\nText"
    m = spark.createDataFrame([(1, body, []), (2, body.replace("ann and Bob", "All Committee"), ["white_check_mark"]), (3, "no ticket", [])], "message_id long, text string, reactions array<string>")
    officers = spark.createDataFrame([(10, "Ann Lee"), (11, "Bob Ray"), (12, "Cy Dee")], "officer_id long, name string")
    t = {r.message_id: r for r in extraction.parsed_tickets(m, officers).collect()}
    assert (t[1].code, t[1].title, t[1].priority, t[1].status, t[1].officer_ids) == ("ACTION-007", "Book & pay", "high", "in_progress", [10, 11])
    assert t[2].status == "completed" and t[2].assign_all and set(t) == {1, 2}


def test_access(spark):
    rows = [(s, v, r, st_, d, c) for s in ("article", "document") for v in ("public", "member", "committee", "internal") for r in ("approved", "proposed", None) for st_ in (False, True) for d in (False, True) for c in (True, False)]
    df = spark.createDataFrame(rows, "source_type string, visibility string, review_status string, is_stale boolean, is_deleted boolean, is_current boolean")
    for scope, levels in (("public", 1), ("member", 2), ("verified", 2), ("committee", 3)):
        assert df.where(access.visible(scope)).count() == levels * 2
    assert df.where(access.visible("admin")).count() == len(rows) and df.where(access.visible_public()).count() == 1
    assert one(spark, access.role_at_least(F.lit("committee"), "verified")) and not one(spark, access.role_at_least(F.lit("member"), "verified"))
    ok = lambda e, a=None, x=None: one(spark, access.access_granted(F.lit(e), ("uni.org",), F.lit(a).cast("boolean"), F.lit(x).cast("timestamp"), datetime(2024, 1, 1)))
    assert ok("A@Uni.org") and not ok("a@uni.org.evil") and not ok("a@b@uni.org") and ok("x@y.z", True) and not ok("x@y.z", True, datetime(2023, 1, 1))


def test_chunks_leave_a_batch_a_few_at_a_time():
    texts = ["one\n\ntwo", None, "", "x" * 250, "a b " * 60, "last"]
    batch = pa.RecordBatch.from_pydict({"record_id": list("abcdef"), "content": texts})
    want = [(r, n, c) for r, t in zip("abcdef", texts) for n, c in enumerate(chunking.chunks_of(t, 100, 10))]
    parts = list(chunking.chunked([batch, batch.slice(0, 0)], 100, 10, 150))
    assert [tuple(r.values()) for b in parts for r in b.to_pylist()] == want
    assert len(parts) > 3 and all(sum(map(len, b.column(2).to_pylist())) <= 150 + 112 for b in parts)
