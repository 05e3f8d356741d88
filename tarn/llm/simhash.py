"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance."""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, stored

BITS, BLOCKS, WIDTH = 64, 4, 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a whole text's word shingles, as a signed long; 0 without words."""
    w = (text or "").encode().lower().split()
    n = max(1, len(w) - words + 1)
    if not w:
        return 0
    if len(w) <= words:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    else:
        parts = zip(*(w[i:] for i in range(words)))
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row. Null text: no words, so 0."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(reps: DataFrame, distance: int = 2, most_in_bucket: int = 32) -> DataFrame:
    """(u, v) between representatives of `reps` (fp distinct, rep) whose fingerprints differ in `distance` (0-2) bits or fewer.

    Fingerprints are cut into four blocks; two that differ in at most two bits agree on two whole blocks, so each is
    filed under its six pairs of blocks and pairs from a bucket are verified. In a bucket with more than
    `most_in_bucket` fingerprints, pairs would grow with its square: its fingerprints file themselves under every value
    one bit away instead (two differ in at most two bits exactly if they share such a value) and link to that value's
    smallest holder. Nothing is dropped either way.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance is 0, 1 or 2")
    block = lambda i: F.shiftrightunsigned("fp", i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
    keys = [
        F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j))
        for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    filed = reps.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    filed = stored(filed.join(sizes, "key"), "filed")
    a, b = (filed.where(F.col("n") <= most_in_bucket).select("key", F.col("fp").alias(f"fp_{s}"), F.col("rep").alias(s)) for s in "uv")
    near = F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= distance
    cold = a.join(b, "key").where((F.col("u") < F.col("v")) & near).select("u", "v")

    hot = filed.where(F.col("n") > most_in_bucket).select("fp", "rep").distinct()
    flips = [F.lit(0).cast("long")] + [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)]
    balls = hot.select("rep", "fp", F.explode(F.array(*flips)).alias("flip"))
    balls = balls.select("rep", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    firsts = balls.groupBy("near").agg(F.min(F.struct("rep", "fp")).alias("first"), F.count("*").alias("n")).where("n > 1")
    star = balls.join(firsts, "near").where(F.col("rep") != F.col("first.rep"))
    if distance == 2:
        star = star.select(F.col("first.rep").alias("u"), F.col("rep").alias("v"))
    else:  # a ball of radius one also joins fingerprints two bits apart: keep its centre's links alone
        centre = balls.where("near = fp").select("near", F.col("rep").alias("u"))
        star = balls.join(centre, "near").where("rep <> u").select("u", F.col("rep").alias("v")).where(F.lit(distance == 1))
    return cold.unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null or empty texts have fingerprint zero and link like any other. Repeated rows give repeated rows. A row without
    an id gets a fingerprint and the component of its equals, but names no component and passes on no link.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    reps = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    found = components(links(reps, distance))
    named = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SHINGLE, LANES = 5, 16  # words a shingle, 64-bit lanes a long fingerprint
HAMMING, PARITY = ("a", "b"), ("p0", "p1", "p2", "p3")  # kept of a text: the first lanes, and the words of its parity sketch
SKETCH = HAMMING + PARITY
FAR = 34  # of the lanes' 128 bits: at a Jaccard similarity of 0.8 the mean is 19 and the deviation 4, for strangers 64 and 6


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's word shingles, ascending; a text with fewer words has one, one without words none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = zip(*(w[i:] for i in range(words))) if len(w) > words else [w]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(42)), np.uint64))


def long_fingerprint(h: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """SimHash bits (64 a lane) of a set of shingle hashes; every lane hashes the shingles anew."""
    ones = np.zeros(64 * lanes, np.int64)
    odd = (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for at in range(0, len(h), 255):  # sums of 255 rows fit a byte
        x = h[at : at + 255, None] * odd
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * ones > len(h)


def parity(h: np.ndarray) -> np.ndarray:
    """The parity sketch of a set of hashes: whether an odd number of them falls on each bit, as signed longs.

    Two sets differ in at least as many hashes as their sketches in bits, so many bits rule a pair out for certain.
    """
    bits = 64 * len(PARITY)
    at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def drawn_bits(n: int, similarity: float = 0.8, recall: float = 0.97) -> np.ndarray:
    """(keys, bits): which bits of the long fingerprint make up each key, for `n` texts.

    A key has as many bits as leave some 32 to 64 strangers in a bucket, which are told apart where the bucket lies, and
    there are as many keys as let a pair of the given Jaccard similarity share one with the chance `recall`.
    """
    bits = min(40, max(8, int(np.ceil(np.log2(max(n, 2)))) - 6))
    same = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    keys = int(np.ceil(np.log(1 - recall) / np.log1p(-(same**bits))))
    rng = np.random.default_rng(5)
    return np.array([rng.permutation(64 * LANES)[:bits] for _ in range(keys)])


def settled(batches, similarity: float, most_in_bucket: int, most_pairs: int):
    """Pairs of the buckets that lie whole in this range of (bucket, node, size, SKETCH), sorted; rows of the other buckets.

    A bucket is left open (its rows go out as they came) if it is the range's first or last, and may go on in the next,
    if it has over `most_in_bucket` rows, or if over `most_pairs` pairs a row pass the cheap tests.
    """
    names = ["bucket", "node", "other", "size", *SKETCH]

    def out(rows, other=None):
        columns = [*rows[:2], None, *rows[2:]] if other is None else [None, rows, other, *[None] * (len(names) - 3)]
        none = pa.nulls(rows.shape[-1], pa.int64())
        return pa.RecordBatch.from_arrays([none if c is None else pa.array(c, pa.int64()) for c in columns], names)

    def differ(words, i, j):
        return sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in words)

    rest, first, crowded = np.zeros((3 + len(SKETCH), 0), np.int64), None, None
    for b in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        if not rows.shape[1]:
            continue
        first = rows[0, 0] if first is None else first
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
        if rows.shape[1] - cuts[-1] > most_in_bucket:
            crowded = rows[0, -1]
        going_on = rows[0, cuts[-1]] != crowded
        ends = cuts[1:] if going_on else np.append(cuts[1:], rows.shape[1])
        left, u, v = [], [], []
        for lo, hi in zip(cuts, ends):
            bucket, node, size, *sketch = rows[:, lo:hi]
            if bucket[0] == first or bucket[0] == crowded or hi - lo > most_in_bucket:
                left.append(rows[:, lo:hi])
            elif hi - lo > 1:
                i, j = pairs_of(int(hi - lo))
                close = np.flatnonzero(differ(sketch[: len(HAMMING)], i, j) <= FAR)
                i, j = i[close], j[close]
                alike = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
                alike &= (1 + similarity) * differ(sketch[len(HAMMING) :], i, j) <= (1 - similarity) * (size[i] + size[j]) + 1e-9
                if alike.sum() > most_pairs * (hi - lo):
                    left.append(rows[:, lo:hi])
                else:
                    u.append(node[i[alike]])
                    v.append(node[j[alike]])
        rest = rows[:, cuts[-1] :] if going_on else rows[:, :0]
        if left:
            yield out(np.concatenate(left, axis=1))
        if u:
            u, v = np.concatenate(u), np.concatenate(v)
            yield out(np.minimum(u, v), np.maximum(u, v))
    if rest.shape[1]:
        yield out(rest)


@lru_cache(maxsize=256)
def pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all pairs of n rows."""
    return np.triu_indices(n, 1)


def possible(one, other, similarity: float) -> Column:
    """Whether sizes and parity sketches allow two sets to be similar; `one` and `other` give the columns of each by name."""
    sizes = one("size") + other("size")
    alike = F.least(one("size"), other("size")) >= similarity * F.greatest(one("size"), other("size"))
    return alike & ((1 + similarity) * differing(one, other, PARITY) <= (1 - similarity) * sizes + 1e-9)


def differing(one, other, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(one(c).bitwiseXOR(other(c))) for c in words))


def central(rows: DataFrame, n: int) -> DataFrame:
    """(bucket, leaders): of each bucket of (bucket, node, size, SKETCH) the `n` rows nearest to the majority of its first lanes."""
    bit = lambda i: F.shiftrightunsigned("a", i).bitwiseAND(F.lit(1).cast("long"))
    ones = rows.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(bit(i)).alias(f"b{i}") for i in range(BITS)))
    most = [F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(BITS)]
    ones = ones.select("bucket", reduce(lambda x, y: x.bitwiseOR(y), most).alias("centre"))
    leader = F.struct("node", "size", *SKETCH).alias("leader")
    away = rows.join(ones, "bucket").select("bucket", "node", leader, F.bit_count(F.col("a").bitwiseXOR(F.col("centre"))).alias("away"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("away", "node"))
    return away.withColumn("nth", nth).where(F.col("nth") <= n).groupBy("bucket").agg(F.collect_list("leader").alias("leaders"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, most_in_bucket: int = 1024, leaders: int = 4, most_pairs: int = 4) -> DataFrame:
    """(doc_id, text_hash, component_id): the different texts under each id, in components of similar shingle sets.

    Texts whose long fingerprints share a key are in one bucket. The rows of all buckets are dealt by range, so a bucket
    of any size is split where it must be, and the pairs of a bucket that lies whole in a task, with few close pairs, are
    read off there. In the others, which near copies by the hundred make, every member's similarity to `leaders` near the
    bucket's majority is measured first; what that links is one component, and only pairs of different components are
    left to compare, those of the bucket's largest component with the rest of it, each pair only in the first of the
    crowded buckets that both are in. 1 - Jaccard is a metric, so two whose
    similarities to a leader differ by more than 1 - `similarity` cannot be similar and are not compared, nor are two of
    which one has too many shingles that no other such member has, nor any two (a leader included) whose parity sketches
    prove that they differ in too many. Candidates no
    more than FAR of 128 bits apart are decided by the exact Jaccard similarity of their five-word shingles. text_hash is xxhash64 of the text; texts
    with the same shingles, or both without words, are always in one component. Rows without an id are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    drawn = drawn_bits(rows.count(), similarity)

    def prints(batches):
        power = np.int64(1) << np.arange(drawn.shape[1], dtype=np.int64)
        for b in batches:
            node, size, keys, sketch = [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text)
                bits = long_fingerprint(h)
                node.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                size.append(len(h))
                keys.append(bits[drawn] @ power if len(h) else [])
                sketch.append(np.concatenate([np.packbits(bits[: 64 * len(HAMMING)], bitorder="little").view(np.int64), parity(h)]))
            words = np.array(sketch, np.int64).reshape(-1, len(SKETCH)).T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), *map(pa.array, words), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "node", "size", *SKETCH, "keys"])

    def sets(batches):
        for b in batches:
            h = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], ["node", "set"])

    longs = ", ".join(f"{c} long" for c in SKETCH)
    found = stored(rows.mapInArrow(prints, f"doc_id long, text_hash long, node long, size long, {longs}, keys array<long>"), "prints")
    named = found.select("doc_id", "text_hash", "node").distinct()
    once = found.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("size", *SKETCH, "keys")))
    bucket = F.shiftleft(F.col("nth").cast("long"), 40).bitwiseOR(F.col("key"))
    filed = once.select("node", "size", *SKETCH, F.posexplode("keys").alias("nth", "key")).select(bucket.alias("bucket"), "node", "size", *SKETCH)

    def near(u: DataFrame, v: DataFrame, more: Column, last: Column) -> DataFrame:
        """(node_u, node_v) of a bucket's u and v that pass the tests, `last` after the cheap ones; the smaller node first."""
        u, v = (x.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in x.columns if c != "bucket")) for x, s in ((u, "u"), (v, "v")))
        one, other = (lambda c: F.col(f"{c}_u")), (lambda c: F.col(f"{c}_v"))
        pairs = u.join(v, "bucket").where(more & (differing(one, other, HAMMING) <= FAR) & possible(one, other, similarity) & last)
        return pairs.select(F.least("node_u", "node_v").alias("node_u"), F.greatest("node_u", "node_v").alias("node_v"))

    dealt = filed.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")
    dealt = stored(dealt.mapInArrow(lambda b: settled(b, similarity, most_in_bucket, most_pairs), f"bucket long, node long, other long, size long, {longs}"), "buckets")
    hot = dealt.where("bucket is not null").select("bucket", "node", "size", *SKETCH)
    cold = dealt.where("bucket is null").select(F.col("node").alias("node_u"), F.col("other").alias("node_v"))
    first = stored(central(hot, leaders), "leaders")
    led = hot.join(first, "bucket").select("bucket", "node", "size", *SKETCH, F.posexplode("leaders").alias("nth", "leader"))
    may = possible(F.col, lambda c: F.col(f"leader.{c}"), similarity).alias("may")
    led = led.select("bucket", "nth", "node", F.least("node", "leader.node").alias("node_u"), F.greatest("node", "leader.node").alias("node_v"), may)
    led = stored(led, "led")
    candidates = cold.unionByName(led.where("may and node_u <> node_v").select("node_u", "node_v"))
    candidates = stored(candidates.distinct(), "candidates")

    asked = candidates.select(F.col("node_u").alias("node")).union(candidates.select("node_v")).union(hot.select("node")).distinct()
    at = found.join(asked, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    at = stored(at.select("node", "at.*"), "asked")
    texts = rows.join(at, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("node", "text")  # one a node
    held = stored(texts.mapInArrow(sets, "node long, set array<long>"), "sets")

    def measured(pairs: DataFrame) -> DataFrame:
        """(u, v, alike): the exact similarity of each pair of nodes."""
        both_sets = pairs.join(held.select(F.col("node").alias("node_u"), F.col("set").alias("s")), "node_u")
        both_sets = both_sets.join(held.select(F.col("node").alias("node_v"), F.col("set").alias("t")), "node_v")
        both = F.size(F.array_intersect("s", "t"))
        return stored(both_sets.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), (both / (F.size("s") + F.size("t") - both)).alias("alike")), "measured")

    known = measured(candidates)
    links = known.where(F.col("alike") >= similarity).select("u", "v")
    if not hot.isEmpty():
        linked = components(links)
        alike = F.when(F.col("node_u") == F.col("node_v"), 1.0).otherwise(F.col("alike"))  # null where the sketches forbid a link
        to_leader = led.join(known.withColumnsRenamed({"u": "node_u", "v": "node_v"}), ["node_u", "node_v"], "left")
        to_leader = to_leader.groupBy("bucket", "node").agg(*(F.max(F.when(F.col("nth") == i, alike)).alias(f"to{i}") for i in range(leaders)))
        grams = held.join(hot.select("node").distinct(), "node", "left_semi").select("node", F.explode("set").alias("gram"))
        alone = grams.groupBy("gram").agg(F.count("*").alias("n"), F.any_value("node").alias("node")).where("n = 1")
        own = stored(alone.groupBy("node").agg(F.count("*").alias("own")), "own-shingles")
        filed_in = hot.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # one a key at most
        members = hot.join(to_leader, ["bucket", "node"]).join(own, "node", "left").join(linked, "node", "left").join(filed_in, "node")
        members = members.withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
        members = stored(members.withColumn("component", F.coalesce("component", "node")), "members")
        sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        members = stored(members.join(sizes, "bucket").withColumn("aside", F.col("component") != F.col("largest")).drop("largest"), "sides")
        rest = members.where("aside")
        apart = (F.col("component_u") != F.col("component_v")) & (~F.col("aside_v") | (F.col("node_u") < F.col("node_v")))
        apart &= F.least("shared_u", "shared_v") * (1 + similarity) >= similarity * (F.col("size_u") + F.col("size_v")) - 1e-9
        for i in range(leaders):
            apart &= F.coalesce(F.abs(F.col(f"to{i}_u") - F.col(f"to{i}_v")) <= 1 - similarity + 1e-9, F.lit(True))
        first_met = F.array_min(F.array_intersect("buckets_u", "buckets_v")) == F.col("bucket")
        more = near(rest, members, apart, first_met).join(candidates, ["node_u", "node_v"], "left_anti")
        more = measured(stored(more, "candidates-apart"))
        links = links.unionByName(more.where(F.col("alike") >= similarity).select("u", "v"))
    linked = components(links).withColumnRenamed("component", "component_id")
    return named.join(linked, "node", "left").select("doc_id", "text_hash", F.coalesce("component_id", "node").alias("component_id"))
