"""The Merkle manifest against a plain tree, odd rows included."""

import hashlib
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, part long, at long, kind int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(leaves):
    """(root, the path of each leaf) of a tree of runs of three."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, siblings, folded root, verified of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], said(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    root, above = plain([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (i, leaf, r), path in zip(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1]):
            text = r[4]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = said((*r[:4], text))
            for a, b in (*path, *up):
                now = h(a, now, b)
            out.append((i, leaf, trees[s][0], root, "".join(a + b for a, b in (*path, *up)), now, now == root))
    return out


def documents(n):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"line {i}\nand more" if i % 4 else "one line") for i in range(n)]
    odd = [(900_000, None, None, None, None), (900_001, None, "en", 0, ""), (None, "s0", "en", 3, "a\nb"), (None, None, None, None, None), (5, "s5", "en", 5, "line 5\nand more"), (5, "s5", "en", 5, "other"), (900_002, "é", "fr", 9, "long \n" * 40000), (900_003, "", "en", 1, "lone\n"), (900_004, "Z", "en", 1, "x")]
    return rows + odd


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")), "folded_root", "verified").collect())


@pytest.mark.parametrize("block,n", [(6, 900), (1, 400)])
def test_proofs_are_those_of_a_plain_tree(spark, monkeypatch, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = documents(n)
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA)
    assert got(merkle.manifest(docs)) == Counter(plain_manifest(rows))


def test_any_rows_and_names(spark):
    rows = [(k, "g" if k % 2 else None, f"{k:064x}", k, "a", "b") for k in range(50)]
    df = spark.createDataFrame(rows, "at long, `part` string, leaf string, `a.b` long, subroot string, root string")
    out = merkle.proved(df, "part", "at")
    assert sorted(out.columns) == sorted(["at", "part", "leaf", "a.b", "subroot", "root", "proof"])
    assert out.where(merkle.folded(F.col("proof"), F.col("leaf")) != F.col("root")).count() == 0
    assert out.select("root").distinct().count() == 1 and out.count() == 50


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none).collect() == []
    one = spark.createDataFrame([(1, "s", "en", 2, "hi", "x", "y", 1, 2, 3)], SCHEMA)
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof == [] and r.verified


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 199), st.integers(1, 4))
def test_pieces_fold_to_the_same_root(n, cut, top):
    cut = min(cut, n)
    leaves = [f"{k:064x}" for k in range(n)]
    end = merkle.depth(n)
    left = [*merkle.climbed(((0, k, leaves[k]) for k in range(cut)), n, min(top, end)), *merkle.climbed(((0, k, leaves[k]) for k in range(cut, n)), n, min(top, end))]
    left.sort(key=lambda x: x[1] * 3 ** x[0])
    ((level, i, root),) = merkle.climbed(iter(left), n, end)
    want, ways = plain(leaves)
    assert (level, i, root) == (end, 0, want)
    assert merkle.paths([(0, k, x) for k, x in enumerate(leaves)], n, (end, 0), []) == ways


def test_query(spark):
    df = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert 0 < df.where("verified").count() < df.count()
