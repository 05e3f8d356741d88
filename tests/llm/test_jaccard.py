"""The Jaccard join against all pairs compared, odd rows and crowded buckets included."""

import random
from collections import Counter

import numpy as np
import pytest

from tarn.llm import jaccard, queries

SCHEMA = "doc_id long, text string, node long, size string, low int, bucket long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(rows, percent=90):
    """(doc_id, size, component) of every row by comparing all pairs of sets."""
    sets = sorted({plain_set(t) for _, t in rows}, key=sorted)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(i)] = find(j)
    least = {}
    at = {s: find(i) for i, s in enumerate(sets)}
    for i, t in rows:
        if i is not None:
            least[at[plain_set(t)]] = min(i, least.get(at[plain_set(t)], i))
    return Counter((i, len(plain_set(t)), least.get(at[plain_set(t)]) if plain_set(t) else i) for i, t in rows)


def texts(seed, n=40, copies=8, words=(9, 240)):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = ["w%d" % rng.randint(0, 3000) for _ in range(rng.randint(*words))]
        rows.append(base)
        for _ in range(rng.randint(0, copies)):
            w = list(rng.choice([base, rows[-1]]))
            for _ in range(rng.choice([1, 1, 2, 3, len(w) // 40 + 1])):
                k = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k] = "e%d" % rng.randint(0, 9999)
                elif rng.random() < 0.5:
                    del w[k]
                else:
                    w.append("e%d" % rng.randint(0, 9999))
            rows.append(w)
    out = [(3 * i + 1, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(out)
    return out


ODD = [(9000, None), (9001, ""), (9002, " \n "), (9003, "One"), (9004, "one"), (9005, "a b"), (9006, "a  B"), (None, "a b c d e f g h i j k l"), (9007, "A b c d e f g h i j k l"), (9008, "a b c d e f g h i j k l m"), (9009, "x y z " * 20000), (7, "again"), (7, "again"), (7, "other text")]


@pytest.mark.parametrize("most,block", [(48, 1024), (2, 3)])
def test_components_are_those_of_all_pairs(spark, most, block):
    rows = texts(1) + ODD
    out = jaccard.similar(frame(spark, rows), most_in_bucket=most, block=block)
    assert Counter(tuple(r) for r in out.collect()) == plain(rows)


def test_one_group_of_near_copies(spark):
    rng = random.Random(3)
    base = ["w%d" % rng.randint(0, 3000) for _ in range(150)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = "e%d" % rng.randint(0, 99999)
        rows.append((i, " ".join(w)))
    want = plain(rows)
    assert 5 < len({c for _, _, c in want}) < 215
    out = jaccard.similar(frame(spark, rows), most_in_bucket=20, block=50)
    assert Counter(tuple(r) for r in out.collect()) == want


@pytest.mark.parametrize("percent", [80, 95])
def test_other_similarities(spark, percent):
    rows = texts(2, n=25)
    out = jaccard.similar(frame(spark, rows), percent=percent)
    assert Counter(tuple(r) for r in out.collect()) == plain(rows, percent)


@pytest.mark.parametrize("n", [0, 1000, 10**9])
def test_every_similar_pair_shares_a_bucket(n):
    """Whatever the costs say: sets at the very edge of the similarity, in one band and across two."""
    rng = np.random.default_rng(4)
    for size in [*range(9, 60), 100, 121, 122, 250, 500, 2000]:
        for _ in range(4):
            bands = jaccard.Bands(90, dict.fromkeys(range(jaccard.BANDS), n))
            x = rng.integers(0, 2**64, size, np.uint64)
            more = int(rng.integers(0, size // 9 + 1))
            y = np.concatenate((x, rng.integers(0, 2**64, more, np.uint64)))
            gone = 0
            while 100 * (size - gone - 1) >= 90 * len(y):
                gone += 1
            y = np.unique(y[gone:])
            x = np.unique(x)
            shared = len(np.intersect1d(x, y))
            assert 100 * shared >= 90 * (len(x) + len(y) - shared)
            (kx, nx), (ky, ny) = jaccard.filed(x, bands), jaccard.filed(y, bands)
            small, large = ((kx, nx), (ky, ny)) if len(x) <= len(y) else ((ky, ny), (kx, nx))
            assert np.intersect1d(small[0][: small[1]], large[0]).size


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 500, 300).astype(np.uint64)) for _ in range(2))
        bits = np.bitwise_count((jaccard.parity(x) ^ jaccard.parity(y)).view(np.uint64)).sum()
        assert bits <= len(np.setxor1d(x, y))


def test_empty(spark):
    assert jaccard.similar(frame(spark, [])).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_ngram_jaccard_join(spark, folder).collect()) == plain(rows)
