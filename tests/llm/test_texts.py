"""Per-document operators and the pipeline against plain versions, odd rows included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import ctw, decontaminate, mixing, pieces, pii, quality, simhash, suffix_dedup

ODD = [(900, None), (901, ""), (902, " \n "), (None, "a b c"), (3, "again"), (3, "again"), (950, "long word " * 30000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", 1, "x", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, p long")


# Personal data


def plain_base(text):
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in rules.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()ab%é", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_field_adds_what_rules_miss():
    w = pii.fitted()
    text = "cards 4465758382889437 4465758382889437 and call (743) 555-3824 or ann(at)mail(dot)org, not 1234567812345678 nor 2024-01-15 10"
    base = pii.base_spans(text)
    added = {(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, base, w)}
    assert base == []
    assert added == {("card", "4465758382889437"), ("phone", "(743) 555-3824"), ("email", "ann(at)mail(dot)org")}


def test_viterbi_is_the_best_segmentation():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        segs = [(i, j, "x", rng.uniform(-1, 2)) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]

        def best(i):
            if i == n:
                return 0.0
            return max([best(i + 1), *(x + best(j) for a, j, _, x in segs if a == i)])

        score = {(i, j): x for i, j, _, x in segs}
        got = sum(score[i, j] for i, j, _ in pii.viterbi(n, segs))
        assert math.isclose(got, best(0), abs_tol=1e-9)


def test_field_held_out():
    w, hit, made, want = pii.fitted(), 0, 0, 0
    rng = random.Random(99)
    for _ in range(150):
        text, gold = pii._made_up(rng)
        parts, segs = pii.lattice(text)
        got = {(parts[i][0], parts[j - 1][1], k) for i, j, k in pii.viterbi(len(parts), [(i, j, k, sum(w.get(f, 0) for f in (*fs, f"{k}:bias"))) for i, j, k, fs in segs])}
        hit, made, want = hit + len(got & set(gold)), made + len(got), want + len(gold)
    assert hit / made > 0.93 and hit / want > 0.9


HAND_MADE = [
    ("Reach Dana at dana.k (at) harbor (dot) org before Friday.", [("email", "dana.k (at) harbor (dot) org")]),
    ("write to lee[at]mail.net or call 212-555-0143 today", [("email", "lee[at]mail.net"), ("phone", "212-555-0143")]),
    ("Office: (415) 555-2671, room 12", [("phone", "(415) 555-2671")]),
    ("Invoice 2024-03-15 for 1,299.00 due 2024-04-15", []),
    ("version 10.4.300.2 was built from 1.2.3", []),
    ("tracking number 1234567890123 shipped 14 May", []),
    ("Call 212 555 0143 and ask for Lee", [("phone", "212 555 0143")]),
    ("the meeting is at 10:30 on 4 July 2026", []),
    ("isbn 978-3-16-148410-0 and pages 100-199", []),
    ("order 55501 of 9 items, 12 boxes, 2 pallets", []),
    ("she said (at) least 3 people came", []),
    ("mobile (020) 7946-0018 or mail jo.b[at]corp.co.uk please", [("phone", "(020) 7946-0018"), ("email", "jo.b[at]corp.co.uk")]),
    ("coordinates 51.5074 and 0.1278, altitude 35", []),
    ("phone 303-555-0188, fax 303-555-0189", [("phone", "303-555-0188"), ("phone", "303-555-0189")]),
    ("scores 12 14 15 16 18 19 21 23", []),
    ("contact sam(at)uni(dot)edu", [("email", "sam(at)uni(dot)edu")]),
]


def test_field_on_sequences_written_by_hand():
    """Sentences that the generator did not make: what the field adds to the base spans."""
    w, made, hit, want = pii.fitted(), 0, 0, 0
    for text, gold in HAND_MADE:
        got = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(text, pii.base_spans(text), w)]
        made, want, hit = made + len(got), want + len(gold), hit + len(set(got) & set(gold))
    assert want == 10 and hit / max(1, made) >= 0.8 and hit / want >= 0.8, (made, want, hit)


LABELS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma omega delta nu xi omicron".split()


@pytest.mark.parametrize("address", [
    "bob[at]" + ".".join(LABELS[:10]) + ".org",
    "bob (at) " + " (dot) ".join(LABELS) + " (dot) org",
    ".".join(LABELS * 3) + "[at]mail.org",
    ".".join(LABELS * 3) + "[at]" + ".".join(LABELS * 20) + ".org",
    "_bob." + "-".join(LABELS * 2) + " [at] host.org",
], ids=["dots", "spelled", "long local part", "both long", "underscore"])
def test_pii_long_addresses_are_whole(spark, address):
    w = pii.fitted()
    for text in (f"please write to {address} about it", address, f"a {address}, b {address} 12 c"):
        found = [text[s:e] for s, k, e in pii.added_spans(text, pii.base_spans(text), w)]
        assert found == [address] * text.count(address)
    row = pii.redacted(frame(spark, [(1, f"write to {address} now")])).first()
    assert row.text == "write to [EMAIL] now"


def test_pii_very_long_words():
    w = pii.fitted()
    text = "a1." * 60_000 + "[at]" + "b." * 60_000 + "org"
    assert [(s, e) for s, _, e in pii.added_spans(text, [], w)] == [(0, len(text))]


def test_pii_rows(spark):
    rows = [(1, "x a.b@c.de y 10.0.0.1 +1 (743) 555-3824"), (2, "é 4465758382889437"), *ODD]
    out = pii.found(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        spans = plain_base(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert by[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [by[i].n_email, by[i].n_ip, by[i].n_card, by[i].n_phone] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        assert set(joined.split(",")) <= set(by[i].spans.split(","))
    red = {r.doc_id: r.text for r in pii.redacted(frame(spark, rows)).collect()}
    assert red[1] == "x [EMAIL] y [IP] [PHONE]" and red[2] == "é [CARD]" and red[900] is None and red[3] == "again"


# Quality


def test_quality_learns_and_leaves_held_out_labels_alone(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["sun", "rain", "wind", "sea", "hill"]) for _ in range(30)) + "."
    bad = lambda: " ".join(rng.choice(["SUN!!", "BUY$$$", "win%%%"]) for _ in range(30))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + ODD
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)]
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels] + [(None, 1, 0), (901, None, 0)]
    schema = "doc_id long, quality int, toxic int"
    a = {(r.doc_id, r.score): r for r in quality.scored(frame(spark, rows), spark.createDataFrame(labels, schema)).collect()}
    b = {(r.doc_id, r.score): r for r in quality.scored(frame(spark, rows), spark.createDataFrame(flip, schema)).collect()}
    assert a.keys() == b.keys() and len(a) >= len(rows) - 1
    for r in a.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 400 and r.doc_id != 3:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == int(r.doc_id % 4 != 0)
    none = quality.scored(frame(spark, []), spark.createDataFrame([], schema))
    assert none.count() == 0
    assert {r.score for r in quality.scored(frame(spark, rows), spark.createDataFrame([], schema)).collect()} == {0.5}


def plain_ftrl(rows, alpha, beta, l1, l2, order):
    """The published update, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for k in order:
        (slots, x), y = rows[k]
        pairs = [*zip(slots.tolist(), map(float, x)), (1 << quality.BITS, 1.0)]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            w = weight(i)
            z[i] += g - sigma * w
            n[i] += g * g
    return {i: weight(i) for i in z}


def test_updates_are_the_published_ones():
    rng = random.Random(5)
    rows = [(quality.features(" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12)))), rng.randint(0, 1)) for _ in range(40)]
    shuffled = np.random.default_rng(7)
    order = [k for _ in range(3) for k in shuffled.permutation(len(rows))]
    got, want = quality.ftrl(rows, 2.0, 1.0, 0.1, 0.001, 3), plain_ftrl(rows, 2.0, 1.0, 0.1, 0.001, order)
    assert all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-12) for i, w in want.items())
    assert set(np.flatnonzero(got)) == {i for i, w in want.items() if w}


# Token counts


def plain_count(vocabulary, word):
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocabulary), None)
        n, i = (n + 1, j) if j else (n + len(word[i].encode()), i + 1)
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abcé", min_size=1, max_size=6), max_size=12), st.lists(st.text(alphabet="abcdé▁", max_size=14), max_size=8))
def test_automaton_is_greedy_longest_match(vocabulary, words):
    a = pieces.Automaton(sorted(vocabulary))
    for w in words:
        assert a.count(w) == plain_count(vocabulary, w)


def test_token_counts(spark):
    vocabulary = ["▁a", "▁again", "▁ag", "ain", "▁lo", "ng", "▁", "w", "ord", "b"]
    rows = [(1, "again long"), (2, "zéa"), *ODD]
    out = pieces.token_counts(frame(spark, rows), vocabulary).collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").split()), sum(plain_count(set(vocabulary), "▁" + w) for w in (t or "").split()), len((t or "").encode())) for i, t in rows)
    assert Counter(map(tuple, out)) == want
    assert pieces.token_counts(frame(spark, []), vocabulary).count() == 0


# Language model


def test_base_scores(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("W%d" % int(rng.expovariate(0.05)) for _ in range(rng.randint(0, 60)))) for i in range(150)] + ODD
    for most in (1 << 17, 3):
        out = ctw.scored(frame(spark, rows), most_common=most).collect()
        count = Counter()
        toks = lambda t: [*(t or "").encode().lower().split(), None]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        for i, t in rows:
            if not held(i):
                count.update(toks(t))
        n, v = sum(count.values()), len(count)
        want = defaultdict(list)
        for i, t in rows:
            want[i].append((held(i), len(toks(t)), sum(count[w] > 0 for w in toks(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks(t))))
        assert len(out) == len(rows)
        for r in out:
            got = (r.held_out, r.n_tokens, r.n_known, r.train_tokens)
            assert any(got == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) for w in want[r.doc_id])
            assert r.score < 0


def plain_ctw(texts, data, depth):
    """log2 probability of the decisions of `data` by the recursive definition, counts frozen."""
    counts = defaultdict(lambda: [0, 0])

    def decisions(text):
        b = text + bytes([ctw.END])
        c = bytes(depth) + b
        for i, byte in enumerate(b):
            near = tuple(c[i + depth - 1 - d] for d in range(depth))
            for k in range(8):
                yield (1 << k) | (byte >> (8 - k)), near, byte >> (7 - k) & 1

    for t in texts:
        for node, near, bit in decisions(t):
            for d in range(depth + 1):
                counts[node, near[:d]][bit] += 1
    kids = defaultdict(set)
    for node, path in counts:
        if path:
            kids[node, path[:-1]].add(path)
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    memo = {}

    def weighted(node, path):
        if (node, path) not in memo:
            e = kt(counts[node, path])
            memo[node, path] = e if len(path) == depth else np.logaddexp(e, sum(weighted(node, p) for p in kids[node, path])) - math.log(2)
        return memo[node, path]

    total = 0.0
    for node, near, bit in decisions(data):
        p = None
        for d in range(depth, -1, -1):
            path = near[:d]
            n = counts.get((node, path), [0, 0])
            one = (n[1] + 0.5) / (sum(n) + 1)
            if d == depth:
                p = one
            else:
                stop = math.exp(kt(n) - math.log(2) - weighted(node, path)) if (node, path) in counts else 0.5
                p = stop * one + (1 - stop) * p
        total += math.log2(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("most,bucket", [(1 << 22, 1 << 19), (40, 60)])
def test_tree_weights_are_the_recursion(spark, most, bucket, monkeypatch):
    """All pairs with the executors, or nearly all by the join, in one bucket or many: the same scores."""
    whole = ctw.fit
    monkeypatch.setattr(ctw, "fit", lambda rows, **o: whole(rows, bucket_pairs=bucket, **o))
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("Abca bc.é") for _ in range(rng.randint(0, 40)))) for i in range(14)] + [(900, None), (901, ""), (None, "abc"), (20, "zzz ü"), (20, "zzz ü")]
    out = ctw.scored(frame(spark, rows), most_pairs=most, depth=3).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [(t or "").encode().lower() for i, t in rows if not held(i)]
    want = Counter((i, round(plain_ctw(train, (t or "").encode().lower(), 3) * math.log10(2), 3)) for i, t in rows)
    assert any(r.held_out for r in out) and Counter((r.doc_id, round(r.score, 3)) for r in out) == want


def test_chances_of_all_bytes_sum_to_one():
    text = ctw.codes(b"the cat sat on the mat. " * 5)
    seen, n = np.unique(text, return_counts=True)
    for context in (seen[3] >> 8, seen[20] >> 8, 0x7A7A7A7A7A, 0x6174000000):
        code = np.unique(np.concatenate((seen, (context << 8) | np.arange(256))))
        count = np.zeros(len(code), np.int64)
        count[np.searchsorted(code, seen)] = n
        found = ctw.logs(code, count, ctw.prior(ctw.tops(code, count)))
        assert math.isclose((10 ** found[(code >> 8) == context]).sum(), 1, rel_tol=1e-9)


def test_the_tree_beats_the_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = ctw.scored(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_scoring_nothing(spark):
    assert ctw.scored(frame(spark, [])).count() == 0


# Decontamination


def test_edits_against_a_table():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(0, 12))]
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.edits(np.array(a), np.array(b, np.int64)) == min(row)


@pytest.mark.parametrize("length", [(5, 7), (8, 11), (12, 30), (31, 80)])
def test_leaks_with_a_fifth_of_the_words_changed(spark, length):
    """Recall against an exact matcher: every item is planted with edits in 20 % of its words, 240 times."""
    rng = random.Random(length[0])
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 7)))
    items = [(k, [word() for _ in range(rng.randint(*length))]) for k in range(24)]
    docs = []
    for i in range(240):
        w = list(items[i % 24][1])
        for at in rng.sample(range(len(w)), int(0.2 * len(w))):
            w[at] = word()
        body = [word() for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + w + body[at:])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")

    def nearest(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = {(i, k): e for i, t in docs for k, w in [items[i % 24]] if (e := nearest(w, t.split())) <= int(0.2 * len(w))}
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.matches(frame(spark, docs), bench).collect()}
    assert len(want) == 240 and all(got[p] == want.get(p, got[p]) for p in got)
    assert len(want.keys() & got.keys()) >= 0.95 * 240
    assert all(nearest(items[k][1], docs[i][1].split()) <= int(0.2 * len(items[k][1])) for i, k in got.keys() - want.keys())


def test_too_few_walks_is_an_error():
    far = [np.arange(1, 13)]
    with pytest.raises(ValueError, match="walks find"):
        decontaminate.repetitions(far, 12, 0.95, 0.999)


def test_short_items_word_for_word(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "one two three four five six"), (2, "alpha gamma"), (3, "solo")], "item_id long, text string")
    docs = [(1, "x Alpha, beta y"), (2, "alpha x beta"), (3, "a one two three four five six"), (4, "q q one two three four five six"), (5, None), (6, "alpha gamma " * 40000)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, docs), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 2), (6, 2)}


def test_contaminated_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(14, 60)))) for k in range(60)]
    docs, want = [], set()
    for i in range(300):
        body = [word() for _ in range(rng.randint(0, 90))]
        if i % 2:
            k, text = items[i % 60]
            w = text.split()
            for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1]))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
            body[len(body) // 2 : len(body) // 2] = w
            want.add((i, k))
        docs.append((i, " ".join(body)))
    extra = [*ODD[:3], ODD[6], (None, items[0][1]), (1, docs[1][1])]
    bench = spark.createDataFrame([*items, (100, None), (101, ""), (102, "too short")], "item_id long, text string")
    out = decontaminate.matches(frame(spark, docs + extra), bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    exact = {(i, k) for i, t in docs for k, x in items if f" {x} " in f" {t} "}
    assert exact <= got and (None, 0) in got and len(out) == len(got)
    assert got - {(None, 0)} <= want and len(want - got) <= 0.05 * len(want)
    kept = decontaminate.clean(frame(spark, docs + extra), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs + extra} - {i for i, _ in got if i is not None}
    assert kept.columns == frame(spark, []).columns
    assert decontaminate.matches(frame(spark, []), bench).count() == 0
    assert decontaminate.matches(frame(spark, docs), bench.limit(0)).count() == 0


# Mixing


def test_fitted_chances_meet_every_target(spark):
    rng = random.Random(9)
    cells = [(s, l, t, rng.randint(1, 500)) for s in "abcd" for l in ("en", "fr") for t in "xyz"]
    df = spark.createDataFrame([*cells, ("e", "en", "x", 0)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 1, "b": 1, "c": 2, "d": 4, "e": 9}, "lang": 0.5, "topic": 1.0}
    targets["source"].pop("e")
    out = {(r.source, r.lang, r.topic): r.p for r in mixing.calibrated(df, targets, rounds=30).collect()}
    kept = {k: out[k[:3]] * k[3] for k in cells}
    total, tokens = sum(kept.values()), sum(k[3] for k in cells)
    share = lambda d, x: sum(v for k, v in kept.items() if k[d] == x) / total
    raw = lambda d, x: sum(k[3] for k in cells if k[d] == x) / tokens
    for x, w in targets["source"].items():
        assert math.isclose(share(0, x), w / 8, rel_tol=1e-3)
    for x in ("en", "fr"):
        assert math.isclose(share(1, x), raw(1, x) ** 0.5 / sum(raw(1, y) ** 0.5 for y in ("en", "fr")), rel_tol=1e-3)
    for x in "xyz":
        assert math.isclose(share(2, x), raw(2, x), rel_tol=1e-3)
    assert max(out.values()) <= 1 + 1e-9 and total <= 0.5 * tokens * (1 + 1e-9)


def test_a_tiny_source_leaves_the_budget_met(spark):
    rng = random.Random(11)
    cells = [(s, l, t, rng.randint(1000, 50000)) for s in "abcd" for l in ("en", "fr", "de") for t in "xyz"] + [("tiny", "en", "x", 200), ("e", "en", "x", 0)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    out = {(r.source, r.lang, r.topic): r for r in mixing.filled(df).collect()}
    tokens = sum(c[3] for c in cells)
    kept = {c[:3]: out[c[:3]].p * c[3] for c in cells if c[3]}
    assert math.isclose(sum(kept.values()), 0.5 * tokens, rel_tol=1e-6)
    assert all(0 <= r.p <= 1 for r in out.values()) and out["tiny", "en", "x"].p > 0.99
    assert out["tiny", "en", "x"].reach_source == 200 < out["tiny", "en", "x"].goal_source
    for k, d in enumerate(mixing.DIMS):
        assert math.isclose(sum({c[k]: r[f"reach_{d}"] for c, r in out.items()}.values()), 0.5 * tokens, rel_tol=1e-6)
        for x in {c[k] for c in kept}:
            reach = next(r[f"reach_{d}"] for c, r in out.items() if c[k] == x)
            assert math.isclose(sum(v for c, v in kept.items() if c[k] == x), reach, rel_tol=0.02)
    old = {(r.source, r.lang, r.topic): r.p for r in mixing.calibrated(df).collect()}
    assert sum(old[c] * n for c, n in ((c[:3], c[3]) for c in cells if c[3])) < 0.4 * tokens
    none = mixing.filled(df, {"source": {"tiny": 1.0}, "lang": 0.7, "topic": 0.8}).collect()
    assert sum(r.p for r in none) == 1


def test_mixing_rows(spark):
    rows = [(i, "w " * (i % 40)) for i in range(500)] + ODD
    topics = spark.createDataFrame([(i, str(i % 3)) for i in range(0, 400)] + [(5, "9"), (None, "1")], "id long, topic string")
    df = frame(spark, rows)
    out = mixing.chances(df, topics).collect()
    assert len(out) == len(rows) and {r.topic for r in out} == {"0", "1", "2", "(none)"}
    odd = df.withColumns({"_source": F.lit("s"), "row": F.lit(1), "tokens": F.lit("t"), "topic": F.lit("u"), "id": F.lit(2), "p_kept": F.lit(0.5)})
    sample = mixing.sampled(odd, topics)
    assert sample.columns == [*odd.columns]
    assert {(r["_source"], r["row"], r["tokens"], r["topic"], r["id"]) for r in sample.collect()} == {("s", 1, "t", "u", 2)}
    kept = mixing.sampled(df, topics)
    assert kept.columns == [*df.columns, "p_kept"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert mixing.chances(frame(spark, []), topics).count() == 0 and mixing.sampled(frame(spark, []), topics).count() == 0


# The pipeline


def test_pipeline_is_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        if k < 4:
            assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before.count()
    run = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([*((i, t, None, None, None) for i, t in ODD), (None, None, None, None, None), (4, "again and again and again", "en", "s", 3)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf).collect()
        stage(spark, docs, sf).collect()
    left = corpus_pipeline.near_dedup(spark, docs, sf)
    assert Counter(r.doc_id for r in left.collect()) == Counter([900, 3, None, None, 4, 950])


def test_near_dedup_reads_five_word_shingles(spark):
    rng = random.Random(4)
    body = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    jaccard = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    rows, copies, apart = [], [], []
    for i in range(60):
        w = body(200)
        for k, edits in enumerate((3, 4, 10)):
            c = list(w)
            for at in rng.sample(range(195), edits):
                c[at] = "edit"
            rows.append((1000 * (k + 1) + i, " ".join(c)))
            (copies if jaccard(w, c) >= 0.8 else apart).append(rows[-1][0])
        rows.append((i, " ".join(w)))
    rows += [(5000, " ".join(body(50))), (5000, " ".join(body(50))), (5000, rows[3][1])]
    left = [r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()]
    assert len(copies) > 100 and len(apart) > 50
    assert len(set(copies) & set(left)) <= 0.02 * len(copies)
    assert set(range(60)) <= set(left) and left.count(5000) == 2  # two texts under one id stay, its copy of another goes


@pytest.mark.parametrize("most", [1, 4, 32])
def test_large_buckets_lose_no_component(spark, most):
    """Hundreds of near copies in a few groups, buckets of any size: the components of an exact all-pairs comparison."""
    rng = random.Random(6)
    sets = {}
    for i in range(5):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for j in range(30):
            w = list(base)
            for at in rng.sample(range(115), rng.randint(0, 5)):
                w[at] = f"e{rng.randrange(9)}"
            sets[100 * i + j] = w
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in sets.items()}
    links = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    root = {k: k for k in grams}
    for _ in grams:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    out = simhash.similar(frame(spark, [(k, " ".join(w)) for k, w in sets.items()]), most_in_bucket=most, leaders=2).collect()
    got = defaultdict(set)
    for r in out:
        got[r.component_id].add(r.doc_id)
    want = defaultdict(set)
    for k, r in root.items():
        want[r].add(k)
    assert len(links) > 300 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_sketches_rule_out_what_cannot_be_similar():
    """Sketches differ in no more bits than the sets in hashes, and near copies well below 0.8 are no pairs of a bucket."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (0, 5, 10, 30, 40, 50)]
    rows = []
    for i, h in enumerate(sets):
        lanes = np.packbits(simhash.long_fingerprint(h)[:128], bitorder="little").view(np.int64)
        rows.append([7, i, len(h), *lanes.tolist(), *simhash.parity(h).tolist()])
    for g, x in zip(sets, rows):
        for h, y in zip(sets, rows):
            assert sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x[5:], y[5:])) <= len(np.setxor1d(g, h))
    rows = np.array([[1, 99, 1, *[0] * 6], *rows, [9, 98, 1, *[0] * 6]], np.int64).T
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["bucket", "node", "size", *simhash.SKETCH])
    pairs = {(r["node"], r["other"]) for b in simhash.settled([batch], 0.8, 100, 100) for r in b.to_pylist() if r["bucket"] is None}
    similar = {(i, j) for i in range(6) for j in range(i + 1, 6) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert {(0, 1), (0, 2), (1, 2)} <= similar <= pairs
    assert not pairs & {(0, 4), (0, 5), (1, 5), (2, 5)}  # similarities of 0.6 and less


def test_anchors_are_the_least_hashes_of_strings():
    h = np.random.default_rng(1).integers(0, 40, 300).astype(np.uint64)
    for width in (1, 2, 7, 64, 300):
        least, anchors, met = suffix_dedup.anchored(h, width)
        assert least.tolist() == [min(h[i : i + width]) for i in range(301 - width)]
        places = {j for i in range(301 - width) for j in range(i, i + width) if h[j] == least[i]}
        assert dict(zip(anchors.tolist(), met.tolist())) == Counter(h[j].item() for j in places)


def test_near_dedup_deals_the_texts_once(spark):
    out = corpus_pipeline.near_dedup(spark, frame(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (None, "x y"), (None, "x y")]), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 2 and "LeftSemi" not in plan and "Union" not in plan  # the other is of ids alone
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "x y"), (0, "x y"), (1, "a b c"), (3, "")]


@pytest.mark.parametrize("name", ["op9_token_counts", "op3_pii"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
