"""Components of documents whose sets of word shingles have a Jaccard similarity of 0.9 or more, with no link lost.

The universe of shingles is hashed into segments, more of them in a higher band of set sizes. Two sets of a band that
differ in at most H shingles agree on one of H + 1 segments; a segment that is also filed with each one of its shingles
left out (its one-deletion neighbourhood) does the work of two. How many such segments a band has is decided by cost,
and a small set leaves out its emptiest segments. What meets in a bucket is bounded by a parity sketch, then verified on
the whole sets.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, records, stored
from .simhash import shingles
from .windows import mixed

FIRST, RATIO, BANDS = 9, 1.5, 64  # a band's sizes are FIRST * RATIO^k and up; sizes under FIRST have no partner but equals
PARITY = 8  # 64-bit words of the parity sketch
WORDS = 3


class Bands:
    """Sizes of the bands, and each one's segments: `deleted` of them with their one-deletion neighbourhoods.

    `counts` says about how many sets each band holds; it decides costs, not results.
    """

    def __init__(self, percent: int, counts: dict[int, int]):
        self.percent, self.low, self.high, self.segments, self.deleted = percent, [], [], [], []
        low = self.first = -(-percent // (100 - percent)) if percent < 100 else 1 << 40
        while len(self.low) < BANDS and low < 1 << 40:
            high = max(low, int(low * RATIO))
            self.low.append(low)
            self.high.append(high)
            m, r = self._cheapest(self.differ(high), (low + high) / 2, counts.get(len(self.low) - 1, 0))
            self.segments.append(m)
            self.deleted.append(r)
            low = high + 1

    def differ(self, size: int) -> int:
        """How many shingles a set of this size and a larger one may differ in."""
        return size * (100 - self.percent) // self.percent

    def _cheapest(self, most: int, size: float, n: int) -> tuple[int, int]:
        """(segments, those with deletions) that cost least: rows filed for a set, and strangers met in empty segments."""
        best = None
        for r in range(min((most + 1) // 2, 8) + 1):
            m = most + 1 - r
            each = size / m
            none, one = exp(-each), each * exp(-each)
            cost = m + r * each + n / 2 * ((m - r) * none**2 + r * (none + one) ** 2)
            if best is None or cost < best[0]:
                best = cost, m, r
        return best[1:]

    def of(self, size: int) -> list[int]:
        """The bands where a set is filed: its own first, then lower ones that may hold a smaller partner."""
        own = int(np.searchsorted(self.high, size))
        return [b for b in range(own, -1, -1) if 100 * self.high[b] >= self.percent * size] if size >= self.first else []


def parity(h: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of hashes falls on each: two sets differ in at least as many hashes as their bits."""
    odd = np.bincount((mixed(h ^ np.uint64(0xA5A5A5A5)) >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def filed(h: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], int]:
    """(keys, n): the buckets of a set of hashes; in the first n it may be the smaller of a pair.

    As the smaller one it needs only as many segments as it may differ in, and one more: the fullest are taken.
    """
    low: list[np.ndarray] = []
    rest: list[np.ndarray] = []
    spread, value = mixed(h), mixed(h * np.uint64(3))
    for nth, b in enumerate(bands.of(len(h))):
        m, r = bands.segments[b], bands.deleted[b]
        segment = ((spread >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        counts = np.bincount(segment, minlength=m)
        ends = np.cumsum(counts)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[order])))
        sums = total[ends] - total[ends - counts]
        name = (np.uint64(b) << np.uint64(40)) + np.arange(m, dtype=np.uint64) * np.uint64(2)
        whole = mixed(sums + mixed(name))
        spare = (m + r) - (bands.differ(len(h)) + 1) if nth == 0 else 0
        used = np.ones(m, bool) if nth == 0 else np.zeros(m, bool)
        if spare > 0:  # a segment with deletions counts twice
            for s in np.argsort(counts, kind="stable"):
                worth = 2 if s < r else 1
                if worth <= spare:
                    used[s], spare = False, spare - worth
                if not spare:
                    break
        low.append(whole[used])
        rest.append(whole[~used])
        for s in range(r):
            inside = value[order][ends[s] - counts[s] : ends[s]]
            (low if used[s] else rest).append(mixed(sums[s] - inside + mixed(name[s : s + 1])))
    first = np.unique(np.concatenate(low)) if low else np.zeros(0, np.uint64)
    second = np.setdiff1d(np.concatenate(rest), first) if rest else np.zeros(0, np.uint64)
    return np.concatenate((first, second)).view(np.int64), len(first)


def fits(size_u, size_v, low_u, low_v, percent: int):
    """Whether sizes allow a link, and the smaller of the two is filed as such (of equal sizes: either)."""
    smaller = np.where(size_u < size_v, low_u, np.where(size_u > size_v, low_v, low_u | low_v))
    return smaller & (100 * np.minimum(size_u, size_v) >= percent * np.maximum(size_u, size_v))


def met(batches, percent: int, most: int):
    """Pairs (node, other) of buckets that lie whole in this range of (bucket, node, size), sorted; rows of the others.

    size is twice the size, and one if the set may be the smaller. A bucket with over `most` rows, or one at an end of the
    range that may go on in the next, is left open: its rows go out as they came.
    """
    names = ["bucket", "node", "other", "size"]

    def out(bucket, node, other, size):
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([none if c is None else pa.array(c, pa.int64()) for c in (bucket, node, other, size)], names)

    rest, first, crowded = np.zeros((3, 0), np.int64), None, None
    for b in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        n = rows.shape[1]
        if not n:
            continue
        first = rows[0, 0] if first is None else first
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [n]])
        if n - cuts[-2] > most:
            crowded = rows[0, -1]
        end = n if rows[0, -1] == crowded else cuts[-2]
        rest, rows = rows[:, end:], rows[:, :end]
        sizes = np.diff(cuts)
        run = np.repeat(sizes, sizes)[:end]
        opened = (run > most) | (rows[0] == first)
        if crowded is not None:
            opened |= rows[0] == crowded
        if opened.any():
            yield out(rows[0, opened], rows[1, opened], None, rows[2, opened])
        bucket, node, size = rows[:, ~opened & (run > 1)]
        for step in range(1, most):
            at = np.flatnonzero(bucket[:-step] == bucket[step:]) if len(bucket) > step else np.zeros(0, np.int64)
            if not len(at):
                break
            a, c = size[at], size[at + step]
            at = at[fits(a >> 1, c >> 1, (a & 1) > 0, (c & 1) > 0, percent)]
            u, v = node[at], node[at + step]
            yield out(None, np.minimum(u, v), np.maximum(u, v), None)
    if rest.shape[1]:
        yield out(rest[0], rest[1], None, rest[2])


def apart(batches, percent: int):
    """Pairs (u, v) of different components in each (bucket, i, j) of rows sorted by them, that sizes and sketches allow."""
    held, key = [], None

    def pairs(rows):
        node, size, component = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        sketch = np.array([r[6] for r in rows], np.int64)
        for i in range(len(rows) - 1):
            low, sizes = (size[i + 1 :] & 1) > 0, size[i + 1 :] >> 1
            ok = fits(np.full(len(low), size[i] >> 1), sizes, np.full(len(low), (size[i] & 1) > 0), low, percent) & (component[i + 1 :] != component[i])
            at = np.flatnonzero(ok)
            differ = np.bitwise_count((sketch[i + 1 :][at] ^ sketch[i]).view(np.uint64)).sum(1, dtype=np.int64)
            at = at[(100 + percent) * differ <= (100 - percent) * (sizes[at] + (size[i] >> 1))] + i + 1
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[at])), pa.array(np.maximum(node[i], node[at]))], ["u", "v"])

    for row in records(batches):
        if row[:3] != key:
            yield from pairs(held)
            held, key = [], row[:3]
        held.append(row)
    yield from pairs(held)


def similar(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", most_in_bucket: int = 48, block: int = 1024) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links).

    A document's set is that of its different three-word shingles (A-Z lower-cased; fewer words: the whole sequence; none:
    empty). Two link if 100 * shared >= `percent` * all; empty sets link with nothing. Shingles are told apart by 64-bit
    hashes. Equal sets are one node; a bucket with over `most_in_bucket` sets is not paired off: its sets are first
    compared with one leader, and then only with sets that are still in another component, `block` by `block`, by size
    and sketch where they lie. Likewise of the pairs from small buckets each set's likeliest is verified first, then
    those across components. Repeated rows give repeated rows; two texts under one id are nodes of their own; a row
    without an id has the component of its equals, but names none. Very long texts are read whole.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    size = F.greatest(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")) - WORDS + 1, F.lit(1))
    bands = Bands(percent, {})
    nth = F.when(size >= bands.first, (F.log(size / bands.first) / F.log(F.lit(RATIO))).cast("int"))
    counts = {r.band: r.n for r in rows.groupBy(nth.alias("band")).agg(F.count("*").alias("n")).collect() if r.band is not None}
    bands = Bands(percent, counts)

    def prints(batches):
        for b in batches:
            node, size, sketch, keys, low = [], [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text, WORDS)
                node.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                size.append(len(h))
                sketch.append(parity(h))
                k, n = filed(h, bands)
                keys.append(k)
                low.append(n)
            longs = pa.list_(pa.int64())
            columns = [b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, longs), pa.array(keys, longs), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "sketch", "keys", "low"])

    def sets(batches):
        for b in batches:
            h = [shingles(t, WORDS).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], ["node", "set"])

    found = stored(rows.mapInArrow(prints, "doc_id long, text_hash long, node long, size long, sketch array<long>, keys array<long>, low long"), "shingled")
    once = found.where(F.size("keys") > 0).groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("size", "low", "keys")))
    nodes = found.select("node", "size", "sketch")

    rated = 2 * F.col("size") + (F.col("nth") < F.col("low")).cast("long")
    dealt = once.select("node", "size", "low", F.posexplode("keys").alias("nth", "bucket")).select("bucket", "node", rated.alias("size"))
    dealt = dealt.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")
    dealt = stored(dealt.mapInArrow(lambda b: met(b, percent, most_in_bucket), "bucket long, node long, other long, size long"), "met")
    cold = stored(dealt.where("bucket is null").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), "cold")
    hot = dealt.where("bucket is not null").select("bucket", "node", "size")

    asked = cold.select(F.col("u").alias("node")).union(cold.select("v")).union(hot.select("node")).distinct()
    asked = stored(found.join(asked, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.any_value("size").alias("n"), F.any_value("sketch").alias("sketch")), "asked")
    spots = asked.select("node", "at.*")
    known = rows.where("doc_id is not null").unionByName(rows.where("doc_id is null"))
    same = (known.doc_id.eqNullSafe(spots.doc_id)) & (known.text_hash == spots.text_hash)
    held = stored(known.join(spots, same).dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node long, set array<long>"), "sets")

    def bounded(pairs: DataFrame) -> DataFrame:
        """(u, v, away) of the pairs that sizes and sketches allow to link; away grows with the differing bits."""
        for s in "uv":
            pairs = pairs.join(asked.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")), s)
        bits = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
        both = F.col("n_u") + F.col("n_v")
        fit = (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & ((100 + percent) * bits <= (100 - percent) * both)
        return pairs.where(fit).select("u", "v", (bits / both).alias("away"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("u", "v").join(held.withColumnsRenamed({"node": "u", "set": "s"}), "u").join(held.withColumnsRenamed({"node": "v", "set": "t"}), "v")
        shared = F.size(F.array_intersect("s", "t"))
        return stored(both.where(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).select("u", "v"), "links")

    likely = stored(bounded(cold), "likely")
    ends = likely.select(F.col("u").alias("node"), "u", "v", "away").unionByName(likely.select(F.col("v").alias("node"), "u", "v", "away"))
    nearest = ends.groupBy("node").agg(F.min(F.struct("away", "u", "v")).alias("pair")).select("pair.u", "pair.v")
    weights = hot.groupBy("node").agg(F.count("*").alias("weight"))
    leaders = hot.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("leader"))
    led = hot.join(leaders, "bucket").select(F.least("node", "leader.node").alias("u"), F.greatest("node", "leader.node").alias("v")).where("u <> v").distinct()
    first = stored(nearest.unionByName(bounded(led).select("u", "v")).distinct(), "first")
    links = verified(first)

    linked = stored(components(links), "linked")
    of = lambda s: linked.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}"))
    across = likely.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    across = across.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")
    members = hot.join(linked, "node", "left").join(asked.select("node", "sketch"), "node")
    members = stored(members.select("bucket", "node", "size", F.coalesce("component", "node").alias("component"), "sketch"), "members")
    per = members.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket")
    per = per.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    parted = members.join(per.where("n > n_main"), "bucket").withColumn("rest", F.col("component") != F.col("main"))
    rests, mains = (F.ceil(F.col(c) / block).cast("int") for c in ("n_rest", "n_main"))
    parted = parted.withColumn("n_rest", F.col("n") - F.col("n_main"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), rests).otherwise(mains)).cast("int")
    with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda j: F.struct(F.least(F.col("mine"), j).alias("i"), F.greatest(F.col("mine"), j).alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), mains - 1), lambda j: F.struct(F.col("mine").alias("i"), (rests + j).alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), rests - 1), lambda i: F.struct(i.alias("i"), (rests + F.col("mine")).alias("j")))
    spots = F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(from_main)
    parted = parted.withColumn("mine", mine).select("bucket", F.explode(spots).alias("spot"), "node", "size", "component", "sketch").select("bucket", "spot.*", "node", "size", "component", "sketch")
    parted = parted.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = parted.mapInArrow(lambda b: apart(b, percent), "u long, v long").unionByName(across).distinct()
    more = stored(more.join(first, ["u", "v"], "left_anti"), "more")
    linked = components(links.unionByName(verified(more)))

    ids = found.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = stored(ids, "ids")
    names = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = ids.join(names, "component").select("node", "component_id")
    out = found.where("size > 0").join(named, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return out.unionByName(found.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))
