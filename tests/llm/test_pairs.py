"""Near-duplicates, substring and suffix-array dedup and top-k against plain versions, odd rows included."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tarn.llm import simhash, substrings, suffix_dedup, suffixes, topk
from tarn.llm.common import components

SCHEMA = "doc_id long, text string, lang string, fp string, sha string, first long, key long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 1, 2) for i, t in rows], SCHEMA)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["w%d" % rng.randint(0, 400) for _ in range(3000)]
    passage = " ".join(words[:70])
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(0, 160))]
        if i % 5 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        rows.append((i, " ".join(body)))
    for i in range(10):  # near and exact copies
        w = rows[i * 3][1].split()
        rows.append((n + 2 * i, " ".join(w)))
        if w:
            w[rng.randrange(len(w))] = "edit"
        rows.append((n + 2 * i + 1, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "  \n"), (903, "a"), (904, "a b"), (905, "ab " * 400), (906, "é" * 900), (None, passage), (7, rows[7][1]), (950, "x" * 30000)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    rows = texts()
    out = simhash.near_duplicates(frame(spark, rows)).collect()
    fp = {(i, plain_fingerprint(t)) for i, t in rows}
    ids = sorted({i for i, _ in fp if i is not None})
    named = [x for x in fp if x[0] is not None]
    links = [(a, b) for a, x in named for b, y in named if a < b and (x ^ y).bit_count() <= 2]
    want = closed(links, ids)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{plain_fingerprint(t):016x}") for i, t in rows)


@pytest.mark.parametrize("most,distance", [(0, 2), (3, 2), (1000, 2), (0, 1), (1000, 1), (0, 0)])
def test_hot_buckets_lose_no_link(spark, most, distance):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(25)} | set(base)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(x), i) for i, x in enumerate(sorted(fps))]
    reps = spark.createDataFrame(rows, "fp long, rep long")
    got = {r.node: r.component for r in components(simhash.links(reps, distance, most)).collect()}
    order = sorted(fps)
    links = [(i, j) for i in range(len(order)) for j in range(i) if (order[i] ^ order[j]).bit_count() <= distance]
    want = closed(links, range(len(order)))
    assert {i: got.get(i, i) for i in range(len(order))} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (None, 3), (900, 901)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def plain_windows(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [50, 20])
def test_substrings(spark, window):
    rows = texts(3)
    out = substrings.removed(frame(spark, rows), window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == plain_windows(rows, window)


def test_two_texts_under_one_id(spark):
    a, b = " ".join(f"u{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, a + " tail")]
    out = substrings.removed(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == plain_windows(rows, 50)


def plain_bytes(rows, size):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, d in data:
        if i is not None:
            count.update(d[j : j + size] for j in range(len(d) - size + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for j in range(len(d) - size + 1):
            if i is not None and count[d[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        spans = sum(1 for j in range(len(d)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return Counter(out)


def test_strings_in_memory_as_on_disk(tmp_path):
    from collections import Counter

    rng = np.random.default_rng(5)
    for size in (64, 70, 400):
        words = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(1, 2 * size, 6)]
        pieces = [p for p in (b" ".join(words[k] for k in rng.integers(0, 6, 8)) for _ in range(12)) if len(p) >= size]
        met = Counter(p[a : a + size] for p in pieces for a in range(len(p) - size + 1))
        found = {}
        for most_bytes in (1 << 19, 100):
            shard = suffix_dedup._Shard(str(tmp_path))
            for k, p in enumerate(pieces):
                shard.add(p, (0, k, 0, len(p) - size + 1))
            found[most_bytes] = {row[1]: runs for row, runs in shard.repeats(size, 64, most_bytes, str(tmp_path))}
        assert found[1 << 19] == found[100]
        for k, p in enumerate(pieces):
            runs = found[100].get(k, [])
            mine = {a for x, y in zip(runs[::2], runs[1::2]) for a in range(x, y)}
            assert mine == {a for a in range(len(p) - size + 1) if met[p[a : a + size]] > 1}
        data = b"\0".join(pieces)
        starts = np.zeros(len(data), bool)
        starts[: len(data) - size + 1] = True
        order, same = suffixes.ordered(data, starts, size)
        strings = [data[a : a + size] for a in order.tolist()]
        assert strings == sorted(strings) and same.tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(len(strings))]


@pytest.mark.parametrize("options", [{}, {"most_alike": 1}, {"batch": 64, "most_bytes": 100, "shard_bytes": 2000}, {"most_alike": 2, "levels": 1}])
def test_suffix_dedup(spark, options):
    rows = [(i, t if t is None or len(t) < 3000 else t[:1500]) for i, t in texts(4, 30)] + [(970, "y" * 900), (971, "ab" * 700), (972, "y" * 401)]
    out = suffix_dedup.removed(frame(spark, rows), **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == plain_bytes(rows, 400)


def test_suffix_dedup_of_long_runs(spark):
    """Tens of thousands of equal bytes, twice with different ends: all of it goes but the ends that are unlike."""
    rows = [(1, "x" * 30000), (2, "x" * 20001 + "é"), (3, "q" + "ab" * 9000), (4, "z" * 399)]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed(frame(spark, rows)).collect()}
    assert out == {1: (30000, 30000, 1), 2: (20003, 20001, 1), 3: (18001, 18000, 1), 4: (399, 0, 0)}


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(120):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 150))
        if trial % 3 == 0:
            t = np.repeat(t, rng.integers(1, 40, len(t)))[:300]
        if trial % 5 == 0:
            t = np.tile(t[:20], 6)
        x = t.tolist()
        want = sorted(range(len(x)), key=lambda i: x[i:])
        alike = [0]
        for p, q in zip(want, want[1:]):
            alike.append(next((i for i, (a, b) in enumerate(zip(x[p:], x[q:])) if a != b), min(len(x) - p, len(x) - q)))
        for batch, most_bytes in ((1 << 20, 1 << 26), (8, 64), (30, 100)):  # the small ones are on disk throughout
            for most in (50, 1000):
                order, prefixes = suffixes.suffix_array(t, most, batch, most_bytes)
                assert order.tolist() == want and prefixes.tolist() == [min(n, most) for n in alike]


def plain_topk(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            good[i] = max(good.get(i, q), q)
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i in good:
        if i % every == 0:
            best = sorted((-dot(good[i], v), j) for j, v in good.items() if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "block_queries": 3, "enough": 1}])
def test_topk(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (50, rows[50][1]), (350, None), (400, [None] * 16), (450, [float("nan")] * 16), (451, [float("inf")] * 16), (None, rows[1][1]), (500, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, block int, part int")
    out = topk.search(df, every=10, **options).collect()
    assert {tuple(r) for r in out} == plain_topk(rows, 10, 5)


@pytest.mark.parametrize("scale", [30.0, 1e3, 1e6])
def test_topk_scores_are_exact_at_any_scale(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, (scale * rng.normal(size=32)).tolist()) for i in range(400)]
    rows += [(i + 1000, rows[i % 7][1]) for i in range(200)]  # ties in plenty
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    out = {tuple(r) for r in topk.search(df, every=10, block_rows=90, enough=8).collect()}
    want = set()
    for i in (j for j in ints if j % 10 == 0):
        best = sorted((-sum(x * y for x, y in zip(ints[i], v)), j) for j, v in ints.items() if j != i)[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert out == want


def test_topk_refuses_what_a_long_cannot_hold(spark):
    df = spark.createDataFrame([(i, [1e9] * 4) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit a long"):
        topk.search(df).collect()


def test_topk_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (3, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 3, -131072)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert substrings.removed(none).count() == 0
    assert suffix_dedup.removed(none).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
