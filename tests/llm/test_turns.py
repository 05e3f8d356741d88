"""Repair of conversations against all edits tried one by one, and against SQL on long and odd conversations."""

import hashlib
import random
import re
from functools import reduce
from itertools import product as every

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, part long, at string, kind int, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def by_trial(rows):
    """(cost, audit, lines) of the best of all edits with up to two insertions in a place; rows are (role, text, fault)."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant"}
    for put in every(gaps, repeat=len(rows) + 1):
        for edit in every("KUAD", repeat=len(rows)):
            cost, audit, left = 5 * len(put[0]), "I" * len(put[0]), [(names[x], "") for x in put[0]]
            for (role, text, fault), e, more in zip(rows, edit, put[1:]):
                if fault in ("blank", "duplicate") and e != "D":
                    break
                cost += {"K": 0, "D": 2}.get(e, 1) + (5 if fault == "truncated" and e != "D" else 0) + 5 * len(more)
                audit += {"U": "R", "A": "R"}.get(e, e) + "I" * len(more)
                left += [] if e == "D" else [(names.get(e.lower(), role) if e != "K" else role, text)]
                left += [(names[x], "") for x in more]
            else:
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in left)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, [f"{r}:{t}" for r, t in left]
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def test_every_edit_tried(spark):
    rng, rows, want = random.Random(4), [], {}
    for c in range(40):
        turns_of = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", " \n", "c!", "d? \t"])) for _ in range(rng.randint(1, 3))]
        rows += [(c, k, *t) for k, t in enumerate(turns_of)]
        want[c] = by_trial(faults(turns_of))
    repair = turns.Repair(frame(spark, rows))
    lines = {c: [] for c in want}
    for r in repair.rows.orderBy("conv_id", "part", "at", "sub").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    got = {r.conv_id: (r.cost, r.audit, lines[r.conv_id]) for r in repair.summary.collect()}
    assert got == want
    hashes = {r.conv_id: r.sha256 for r in repair.hashes.collect()}
    assert all(hashes[c] == hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items() if x)


def test_product_is_associative():
    rng = random.Random(5)
    ms = [turns._TURNS[rng.choice(list(turns._TURNS))] for _ in range(300)]
    kinds = {id(m): k for k, m in turns._TURNS.items()}
    one = reduce(turns.product, ms)
    assert turns.multiplied(kinds[id(m)] for m in ms) == one
    parts = [reduce(turns.product, ms[i : i + 37]) for i in range(0, 300, 37)]
    assert reduce(turns.product, parts) == one
    k = min((one[0][k], k) for k in turns.ENDS if one[0][k])[1]
    ways = turns.chosen(parts, 0, k)
    assert ways[0][0] == 0 and ways[-1][1] == k and all(a[1] == b[0] for a, b in zip(ways, ways[1:]))
    assert "".join(p[i][j][1] for p, (i, j) in zip(parts, ways)) == one[0][k][1]


def conversations():
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Hello there.", "yes", None, "", " \n\t", "Is it? ", "No!\n", "é." * 3, "long words " * 3000]
    rows = []
    for c in [*range(30), None]:
        for k in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([k, k, k, None, k - 1, 3 * k]), rng.choice(roles[: 3 if rng.random() < 0.8 else 6]), rng.choice(texts)))
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (101, 5, "user", "b"), (101, 5, "user", "b")]
    rows += [(200, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else rng.choice(roles), f"turn {k % 400}" + rng.choice([".", "", "!"])) for k in range(1500)]
    return rows


@pytest.mark.parametrize("fan,partitions", [(16, 4), (2, 23)])
def test_against_sql(spark, monkeypatch, fan, partitions):
    """Long conversations over many partitions, null and equal turns, null roles, texts and ids."""
    monkeypatch.setattr(turns, "FAN", fan)
    rows = conversations()
    df = frame(spark, rows).repartition(7)
    duck = duckdb.connect()
    duck.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    duck.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    res = duck.sql(turns.oracle_sql())
    want = {r[0]: dict(zip(res.columns, r)) for r in res.fetchall()}
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.conv_id: r.asDict() for r in turns.repaired(df).collect()}
        if partitions > 4:
            pieces = turns.Repair(df).pieces.groupBy("conv_id").count()
            assert pieces.agg(F.max("count")).first()[0] > 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_empty(spark):
    assert turns.repaired(frame(spark, [])).collect() == []
