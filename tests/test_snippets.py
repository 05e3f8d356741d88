"""Fragments against all windows tried, neighbours against all vectors, JSON texts."""

import random

from pyspark.sql import functions as F

from tarn.functions import documents, snippets
from tarn.operators import retrieval


def all_windows(spots, most, taken):
    places = [p for p, _ in spots]
    out = []
    for a in places:
        for b in places:
            if a <= b < a + most and not any(a <= hi and lo <= b for lo, hi in taken):
                inside = [t for p, t in spots if a <= p <= b]
                out.append(((len(set(inside)), len(inside), a - b, -a), (a, b)))
    return max(out)[1] if out else None


def test_windows_are_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        spots = sorted((p, rng.choice("xyz")) for p in rng.sample(range(60), rng.randint(1, 12)))
        most, taken = rng.randint(1, 20), []
        for _ in range(2):
            w = all_windows(spots, most, taken)
            if w:
                taken.append(w)
        assert snippets.windows(spots, most, 2) == sorted(taken)


def test_fragments():
    words = [f"w{k}" for k in range(200)]
    words[20], words[25], words[120] = "Fox,", "red", "(red)"
    text = "\n".join(words)
    out = snippets.marked(text, frozenset({"red", "fox"}))
    first, second = out.split(snippets.BETWEEN)
    assert "<mark>Fox,</mark> w21 w22 w23 w24 <mark>red</mark>" in first and "<mark>(red)</mark>" in second
    assert len(first.split()) == len(second.split()) == 15
    assert snippets.marked("no such word " * 10, frozenset({"red"})).split() == ("no such word " * 5).split()
    assert snippets.marked(None, frozenset({"red"})) == "" and snippets.marked("red", frozenset({"red"})) == "<mark>red</mark>"
    near = snippets.marked("red " * 300, frozenset({"red"}))
    assert [len(x.split()) for x in near.split(snippets.BETWEEN)] == [50, 50]


def test_snippet_column(spark):
    df = spark.createDataFrame([("the fox",), (None,)], "t string")
    assert [r[0] for r in df.select(snippets.snippet(["FOX"])("t")).collect()] == ["the <mark>fox</mark>", ""]


def test_neighbours_are_those_of_all_vectors(spark):
    rng = random.Random(2)
    vectors = [(f"u{k:03}", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(200)]
    odd = [("o1", None), ("o2", []), ("o3", [0.0] * 4), ("o4", [float("nan")] * 4), ("o5", [1.0] * 3), ("o6", [1.0, None, 1.0, 1.0])]
    emb = spark.createDataFrame(vectors + odd, "unit_id string, embedding array<double>").repartition(5)
    units = spark.createDataFrame([(u, True) for u, _ in vectors + odd], "unit_id string, is_current boolean")
    asked = [("a", [1.0, 2.0, 0.0, -1.0]), ("b", [0.0, 0.0, 0.0, 0.0]), ("c", [1.0, 1.0, 1.0])]
    got = {(r.query, r.unit_id, r.similarity, r.semantic_rank) for r in retrieval.semantic(units, emb, asked, limit=7).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = set()
    for name, q in asked:
        rows = [(-round(sum(a * b for a, b in zip(v, q)) / (norm(v) * norm(q)), 6), u) for u, v in vectors + odd[4:5] if len(v) == len(q) and norm(v) and norm(q)]
        want |= {(name, u, -s, k + 1) for k, (s, u) in enumerate(sorted(rows)[:7])}
    assert got == want and len(got) == 8


def test_json(spark):
    df = spark.createDataFrame([('{"a": {"b": [1]}, "c": null}',), ("[1]",), ("nonsense",), (None,), ("3",)], "t string")
    assert [r[0] for r in df.select(documents.kind(documents.parsed(F.col("t")))).collect()] == ["object", "array", None, None, "number"]
    assert sorted(tuple(r) for r in documents.exploded(df, "t").collect()) == [("a", "object", '{"b":[1]}'), ("c", "null", "null")]
    put = df.select(documents.with_value(F.col("t"), ("a", "d"), F.lit("true")).alias("p")).collect()
    assert [r.p for r in put] == ['{"c":null,"a":{"b":[1],"d":true}}'] + ['{"a":{"d":true}}'] * 4


def test_a_deep_path_parses_once(spark):
    df = spark.createDataFrame([('{"z": 1, "a": {"b": {"c": {"x": null, "d": 0}}}}',), ('{"a": [1]}',), ("{broken",), (None,)], "t string")
    put = df.select(documents.with_value(F.col("t"), ("a", "b", "c", "d", "e"), F.lit('[1,{"f":2}]')).alias("p"))
    made = '{"a":{"b":{"c":{"d":{"e":[1,{"f":2}]}}}}}'
    assert [r.p for r in put.collect()] == ['{"z":1,"a":{"b":{"c":{"d":{"e":[1,{"f":2}]},"x":null}}}}', made, made, made]
    plan = put._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") <= 2 and "from_json" not in plan and len(plan) < 20_000
