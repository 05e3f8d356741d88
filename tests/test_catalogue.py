"""Every registered query with SQL against DuckDB on the smallest data, and the rest for rows."""

import re

import duckdb
import pytest

from tarn.plans import operations
from tarn.plans.catalogue import CATALOGUE

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, duck, name):
    run, sql = CATALOGUE[name]
    df = run(spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    if sql is None:
        assert got or name in ("thread_none",)
        return
    res = duck.sql(sql)
    at = [res.columns.index(c) for c in columns]
    assert sorted(res.columns) == columns
    assert got == sorted(repr([row[i] for i in at]) for row in res.fetchall())


def _executed(spark, name):
    return CATALOGUE[name][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def _columns_read(plan):
    """The sets of columns that the scans of a plan read."""
    return [set(re.findall(r"(\w+):", read)) for read in re.findall(r"ReadSchema: struct<([^<>]*)>", plan)]


@pytest.mark.parametrize("name", ["lexical_search", "web_search_syntax"])
def test_searches_read_postings_and_no_text(spark, name):
    plan = _executed(spark, name)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan
    assert not any({"text", "content"} & read for read in _columns_read(plan))


def test_scans_read_what_is_asked_for(spark):
    assert _columns_read(_executed(spark, "oldest_checkpoint_due")) == [{"ts", "event_type"}]
    assert "partial_" in _executed(spark, "delivery_health")


def test_gold_ids_are_ranked_before_they_are_gathered(spark):
    assert "WindowGroupLimit" in operations._gold(spark, FOLDER)._jdf.queryExecution().toString()
