"""The kept lexical index against a search that reads every text: builds, refreshes, plans."""

import tempfile
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import lexindex, retrieval
from tarn.operators.lexindex import LexicalIndex

SCHEMA = "unit_id string, source_type string, title string, content string, source_area string, topic string, channel string, author string, visibility string, review_status string, authority string, is_current boolean, is_stale boolean, is_deleted boolean, occurred_at timestamp_ntz, source_updated_at timestamp_ntz, updated_at timestamp_ntz"
QUERIES = ["red fox", '"red fox"', "red or blue", "fox -blue", "rare", "common rare", "nowhere", "quiet"]


def unit(i, title, content, current=True):
    return (f"u{i:03}", "article", title, content, None, "t", None, None, "public", "approved", "governance", current, False, False, None, None, None)


def rows(changed=False):
    out = [unit(i, f"Common title {i}", " ".join(("red fox" if i % 3 else "red hen fox", "blue" * (i % 4 == 0), f"word{i}", "common " * (i % 5)))) for i in range(60)]
    out += [unit(100, "Rare thing", "rare common"), unit(101, None, None), unit(102, "", "", False)]
    if changed:
        out = [r for r in out if r[0] not in ("u003", "u100")]
        out[0] = unit(0, "Quiet now", "nothing of the kind")
        out.append(unit(200, "New red", "fox rare"))
    return out


@pytest.fixture
def index(spark):
    return LexicalIndex.build(spark.createDataFrame(rows(), SCHEMA), "file://" + tempfile.mkdtemp(prefix="spark-"))


def answers(df):
    return sorted((r.query, r.unit_id, round(r.density, 9)) for r in df.collect())


def parsed():
    return [text.parse_query(q) for q in QUERIES]


def test_same_as_reading_every_text(spark, index):
    units = spark.createDataFrame(rows(), SCHEMA)
    assert answers(index.matched(parsed())) == answers(retrieval.matched(units, parsed()))
    want = [tuple(r) for r in retrieval.lexical(units, parsed(), "public", limit=5).select("query", "unit_id", "score", "lexical_rank").orderBy("query", "lexical_rank").collect()]
    got = [tuple(r) for r in index.search(parsed(), "public", limit=5).select("query", "unit_id", "score", "lexical_rank").orderBy("query", "lexical_rank").collect()]
    assert got == want and len(got) > 15


def test_refresh(spark, index):
    units = spark.createDataFrame(rows(changed=True), SCHEMA)
    changes = {r.unit_id: r.change for r in index.refresh(units).collect() if r.change != "unchanged"}
    assert changes == {"u000": "updated", "u003": "retired", "u100": "retired", "u200": "created"}
    assert index.postings.where("gen = 1").select("unit_id").distinct().count() == 2  # only what changed was read into postings
    again = LexicalIndex(spark, index.path)
    assert answers(again.matched(parsed())) == answers(retrieval.matched(units, parsed()))
    assert {r.change for r in again.refresh(units).collect()} == {"unchanged"}
    assert answers(again.matched(parsed())) == answers(retrieval.matched(units, parsed()))


def test_rare_words_first(spark, index, monkeypatch):
    units = spark.createDataFrame(rows(), SCHEMA)
    queries = [text.parse_query("common rare"), text.parse_query("rare -blue")]
    plan = index.matched(queries)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan
    assert answers(index.matched(queries)) == answers(retrieval.matched(units, queries))
    monkeypatch.setattr(lexindex, "SELECTIVE", 1000)
    assert "LeftSemi" not in index.matched(queries)._jdf.queryExecution().toString()


def test_only_the_words_folders_are_read(spark, index):
    looked = index.lookup(["red"])
    plan = looked._jdf.queryExecution().executedPlan().toString()
    files = {f for f in looked.inputFiles()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) > 1  # of the whole table
    read = looked.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("bucket=")[1].split("/")[0] for r in read} == {str(zlib.crc32(b"red") % lexindex.BUCKETS)}
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_dictionary(spark, index):
    count = {r.term: r.documents for r in index.terms.collect()}
    assert count["rare"] == 1 and count["red"] == 60 and count["common"] == 61


def test_rank_sums_round_as_the_sql_does(spark):
    hits = """select 'a' as query, i as unit_id, 1 - i / cast(10000 as double) as density from {0}
    union all select 'b', case when i = 65 then 5060 else i + 10000 end, 1 - i / cast(10000 as double) from {0}"""
    want = duckdb.sql(f"""with hits as ({hits.format("range(1, 5061) t(i)")}),
    r as (select query, unit_id, row_number() over (partition by query order by round(density, 6) desc, unit_id) as r from hits)
    select unit_id, round(sum(1.0::double / (60 + r)), 9), min(r), count(*) from r group by unit_id""").fetchall()
    got = retrieval.rank_sums(spark.sql(hits.format("(select id as i from range(1, 5061))")))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    assert {x[0]: x[1] for x in want}[5060] == 0.008195312  # 1/125 + 1/5120, which is 0.0081953125


def test_empty(spark):
    empty = LexicalIndex.build(spark.createDataFrame([], SCHEMA), "file://" + tempfile.mkdtemp(prefix="spark-"))
    assert empty.matched(parsed()).collect() == []
    assert [r.change for r in empty.refresh(spark.createDataFrame([unit(1, "red fox", "x")], SCHEMA)).collect()] == ["created"]
    assert {r.query for r in empty.matched(parsed()).collect()} == {"red fox", '"red fox"', "red or blue", "fox -blue"}


def test_postings_a_few_tokens_at_a_time():
    said = [["a"] * 3 + ["b"], [], ["c", "a"], ["b"] * 20, ["a", "b"], []]
    batch = pa.RecordBatch.from_pydict({"unit_id": [f"u{i}" for i in range(6)], "n": pa.array([1, 0, 2, 0, 0, 0], pa.int32()), "m": pa.array([2, 0, 2, 0, 1, 0], pa.int32()), "tokens": pa.array(said, pa.list_(pa.string()))})
    whole = [r for b in retrieval.by_term([batch]) for r in b.to_pylist()]
    parts = list(retrieval.by_term([batch, batch.slice(0, 0), batch.slice(1, 1)], 6))
    assert [r for b in parts for r in b.to_pylist()] == whole
    assert [sum(len(x) for x in b.column(2).to_pylist()) for b in parts] == [6, 20, 2]  # one unit has more
    weights = {("u0", "a"): [1.0, 0.4, 0.2], ("u0", "b"): [0.2], ("u2", "c"): [1.0], ("u2", "a"): [1.0], ("u3", "b"): [0.2] * 20, ("u4", "a"): [0.4], ("u4", "b"): [0.2]}
    assert {(r["unit_id"], r["term"]): [s["weight"] for s in r["spots"]] for r in whole} == weights
    assert [s["pos"] for r in whole if (r["unit_id"], r["term"]) == ("u0", "a") for s in r["spots"]] == [0, 1, 2]


def test_a_build_reads_the_texts_once_for_postings(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(content):
        read.add(1)
        return content

    units = spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumn("content", seen.asNondeterministic()("content"))
    LexicalIndex.build(units, "file://" + tempfile.mkdtemp(prefix="spark-"))
    assert read.value == 2 * len(rows())  # postings, and the units' own rows with their hashes
