"""Language-model scores: context-tree weighting over binary-decomposed bytes, beside an add-one word model.

A byte is eight binary decisions, each with a context tree of its own over the whole bytes before it. Every node holds
a Krichevsky-Trofimov estimate; Pw = (Pe + product of the children's Pw) / 2 weighs all depths, and a text is scored
with the mixture that the training counts leave behind. The tree is a table of (context, byte) pairs, one row for each
pair that occurs anywhere, worked on in buckets of contexts that end in the same two bytes; only its top, the nodes of
the nearest byte, comes together, and that has 256 rows at most.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DEPTH = 5  # bytes of context
END = 255  # closes a text; never part of UTF-8


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def codes(data: bytes, depth: int = DEPTH) -> np.ndarray:
    """A number for each byte of a text and its end: the bytes before it, the nearest highest (0 before the start), then it."""
    b = np.append(np.frombuffer(data, np.uint8), END).astype(np.int64)
    out = b.copy()
    for d in range(1, depth + 1):
        out[d:] |= b[:-d] << np.int64(8 * (depth + 1 - d))
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: six steps of the recurrence, then Stirling's series."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for _ in range(6):
        low = np.where(x < 7, low * x, low)
        x = np.where(x < 7, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - np.log(low)


def _block(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The log of the KT estimate of a block of decisions."""
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - _lgamma(zero + one + 1) - 1.1447298858494002  # log pi


class _Bit:
    """One of the eight decisions for all pairs: its nodes at every depth from `top` to `depth`, children next to each other."""

    def __init__(self, code: np.ndarray, n: np.ndarray, k: int, depth: int, top: int):
        byte, context = code & 255, code >> 8
        self.node = (1 << k) | (byte >> (8 - k))
        filed = ((byte >> (8 - k)) << (8 * depth)) | context  # what was decided before, then the context
        self.order = np.argsort(filed, kind="stable")
        filed, bit = filed[self.order], (byte[self.order] >> (7 - k)) & 1
        one, zero = n[self.order] * bit, n[self.order] * (1 - bit)
        self.starts, self.blocks, self.means, self.weighted = {}, {}, {}, {}
        for d in range(depth, top - 1, -1):
            at = filed >> (8 * (depth - d))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
            n1, n0 = np.add.reduceat(one, starts), np.add.reduceat(zero, starts)
            block = _block(n0, n1)
            if d == depth:
                self.weighted[d] = block
            else:
                product = np.add.reduceat(self.weighted[d + 1], np.searchsorted(self.starts[d + 1], starts))
                self.weighted[d] = np.logaddexp(block, product) - np.log(2)
            self.starts[d], self.blocks[d], self.means[d] = starts, block, (n1 + 0.5) / (n0 + n1 + 1)
        self.bit, self.depth, self.top = bit, depth, top

    def chances(self, gathered: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The chance of the bit each pair has, in the pairs' order; from what the depths above `top` have given and left."""
        gathered, left = gathered[self.order], left[self.order]
        for d in range(self.top, self.depth + 1):
            times = np.diff(np.append(self.starts[d], len(self.order)))
            stop = np.exp(self.blocks[d] - np.log(2) - self.weighted[d]) if d < self.depth else np.ones(len(times))
            gathered = gathered + left * np.repeat(stop * self.means[d], times)
            left = left * np.repeat(1 - stop, times)
        out = np.empty(len(self.order))
        out[self.order] = np.where(self.bit == 1, gathered, 1 - gathered)
        return out


def tops(code: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> dict[int, np.ndarray]:
    """For each nearest byte: its 256 byte counts, then the sum over its children of log Pw at the 255 decisions."""
    nearest = (code >> (8 * depth)).astype(np.int64)
    names, of = np.unique(nearest, return_inverse=True)
    out = np.zeros((len(names), 256 + 255))
    np.add.at(out, (of, code & 255), n)
    for k in range(8):
        b = _Bit(code, n, k, depth, 2)
        first = b.order[b.starts[2]]
        np.add.at(out, (of[first], 255 + b.node[first]), b.weighted[2])
    return dict(zip(names.tolist(), out))


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From byte counts (rows, 256): the log of the KT block estimate and its next-bit-is-1 chance at each of 255 decisions."""
    heap = np.zeros((len(counts), 512))
    heap[:, 256:] = counts
    for level in range(7, -1, -1):
        lo = 1 << level
        heap[:, lo : 2 * lo] = heap[:, 2 * lo : 4 * lo].reshape(len(counts), lo, 2).sum(2)
    zero, one = heap[:, 2::2], heap[:, 3::2]
    return _block(zero, one), (one + 0.5) / (zero + one + 1)


def prior(sums: dict[int, np.ndarray]) -> np.ndarray:
    """(256, 2, 256): for each nearest byte and decision, the chance that depths 0 and 1 give, and the weight they leave."""
    names = sorted(sums)
    rows = np.array([sums[x] for x in names]).reshape(-1, 511)
    block, mean = _decisions(rows[:, :256])
    weighted = np.logaddexp(block, rows[:, 256:]) - np.log(2)
    root, root_mean = _decisions(rows[:, :256].sum(0, keepdims=True))
    root_stop = np.exp(root - np.logaddexp(root, weighted.sum(0)))
    out = np.zeros((256, 2, 256))
    out[:, 0, 1:] = root_stop * root_mean + (1 - root_stop) * 0.25  # a nearest byte never seen: its node would stop half the time
    out[:, 1, 1:] = (1 - root_stop) * 0.5
    stop = np.exp(block - np.log(2) - weighted)
    out[names, 0, 1:] = root_stop * root_mean + (1 - root_stop) * stop * mean
    out[names, 1, 1:] = (1 - root_stop) * (1 - stop)
    return out


def logs(code: np.ndarray, n: np.ndarray, above: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 of the chance of each pair's byte after its context; `n` is how often training has the pair, 0 for never."""
    out, nearest = np.zeros(len(code)), (code >> (8 * depth)).astype(np.int64)
    for k in range(8):
        b = _Bit(code, n, k, depth, 2)
        out += np.log10(b.chances(above[nearest, 0, b.node], above[nearest, 1, b.node]))
    return out


def pairs(rows: DataFrame, text_col: str = "text", train_col: str = "train", depth: int = DEPTH) -> DataFrame:
    """(code, n, everywhere): every (context, byte) of all texts, how often training has it and how often all have it."""

    def count(batches):
        for batch in batches:
            parts, size = [], 0
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append((codes(lowered(text), depth) << np.int64(1)) | np.int64(train))
                size += len(parts[-1])
                if size > 1 << 22:
                    yield summed(parts)
                    parts, size = [], 0
            if parts:
                yield summed(parts)

    def summed(parts):
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code >> 1), pa.array(np.where(code & 1, n, 0)), pa.array(n)], ["code", "n", "everywhere"])

    counts = rows.select(F.col(text_col).cast("string"), train_col).mapInArrow(count, "code long, n long, everywhere long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))


def fit(rows: DataFrame, text_col: str = "text", train_col: str = "train", depth: int = DEPTH, bucket_pairs: int = 1 << 19) -> DataFrame:
    """(code, log10p, everywhere): the log10 chance of every (context, byte) that any text has, learnt from training texts.

    Nothing is left out or merged, so the tree grows with the input. Pairs are worked on in buckets of about
    `bucket_pairs`, whole two-byte contexts in each; what the buckets know of the 256 nearest bytes is summed in
    between and goes back to all of them.
    """
    counted = stored(pairs(rows, text_col, train_col, depth), "pairs")
    buckets = max(1, -(-counted.count() // bucket_pairs))
    two = F.shiftright("code", 8 * (depth - 1))
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64(two), F.lit(buckets)).cast("int"))

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        found = tops(pdf["code"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), depth)
        return pd.DataFrame([(k, v.tobytes()) for k, v in found.items()], columns=["nearest", "sums"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pd.DataFrame({"nearest": pdf["nearest"].iloc[:1], "sums": [total.tobytes()]})

    sums = dealt.groupBy("bucket").applyInPandas(top, "nearest int, sums binary").groupBy("nearest").applyInPandas(together, "nearest int, sums binary")
    above = rows.sparkSession.sparkContext.broadcast(prior({r.nearest: np.frombuffer(r.sums) for r in sums.collect()}))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        found = logs(pdf["code"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), above.value, depth)
        return pd.DataFrame({"code": pdf["code"], "log10p": found.astype(np.float32), "everywhere": pdf["everywhere"]})

    return stored(dealt.groupBy("bucket").applyInPandas(score, "code long, log10p float, everywhere long"), "tree")


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each lower-cased word occurs in `train`."""

    def count(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(lowered(text).split())
                if len(seen) > 1 << 18:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    def rows(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

    counts = train.select(F.col(text_col).cast("string")).mapInArrow(count, "word binary, c long")
    return counts.groupBy("word").agg(F.sum("c").alias("c"))


def in_training(id_col: str) -> Column:
    """crc32 of the id as text, mod 7, is not 2; a row without id counts as training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _frequent(counts: DataFrame, column: str, most: int, steps: int = 8) -> tuple[Column, DataFrame]:
    """The condition for the most frequent rows, at most `most` of them, and these rows; by eighths of a power of two."""
    power = F.floor(F.log2(column) * steps)
    sizes = counts.groupBy(power.alias("q")).agg(F.count("*").alias("rows")).toPandas().sort_values("q", ascending=False)
    fits = sizes[sizes["rows"].cumsum() <= most]
    common = power >= (int(fits["q"].min()) if len(fits) else 1 << 40)
    return common, counts.where(common)


class _Table:
    """Code -> log10 chance for the frequent pairs, as two sorted arrays."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        order = np.argsort(code)
        self.code, self.value = code[order], value[order]

    def look_up(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each code, 0 where there is none, and whether there is one. Asked in order, for the cache's sake."""
        order = np.argsort(asked)
        at = np.minimum(np.searchsorted(self.code, asked[order]), max(0, len(self.code) - 1))
        found, value = np.zeros(len(asked), bool), np.zeros(len(asked))
        if len(self.code):
            found[order] = self.code[at] == asked[order]
            value[order] = self.value[at]
        return np.where(found, value, 0.0), found


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_common: int = 1 << 17, most_pairs: int = 1 << 21, depth: int = DEPTH) -> DataFrame:
    """A row a document: held_out, n_tokens, n_known, train_tokens, base_score and the model's score (log10).

    Both models read the whole text, however long, with A-Z lower-cased; a null text counts as empty (one end token).
    The counts of at most `most_common` frequent words and the chances of at most `most_pairs` frequent (context, byte)
    pairs, 12 bytes each, go to every executor; rarer ones are looked up by a join, in all documents. Repeated rows
    give repeated results and, in training, count as often as they occur. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("train", in_training("doc_id"))
    train = rows.where("train")
    tree = fit(rows, depth=depth)
    near, frequent = _frequent(tree, "everywhere", most_pairs)
    frequent = frequent.select("code", "log10p").toArrow()  # not rows: 12 bytes a pair on the driver
    model = spark.sparkContext.broadcast(_Table(frequent["code"].to_numpy(), frequent["log10p"].to_numpy()))
    del frequent
    counts = stored(word_counts(train), "words")
    all_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n_train, distinct = all_words.n + ends, all_words.v + (ends > 0)
    common, frequent = _frequent(counts, "c", most_common)
    frequent = frequent.toArrow()
    known = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), np.log10(frequent["c"].to_numpy() + 1.0).tolist())))

    def score(batches):
        words_, table = known.value, model.value
        end = float(np.log10(ends + 1.0))
        types = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("far", pa.list_(pa.int64()))]

        def settle(held):
            out = {k: [] for k, _ in types}
            code = [codes(data, depth) for _, data in held]
            cuts = np.cumsum([0, *map(len, code)])
            code = np.concatenate(code)
            value, found = table.look_up(code)
            for i, (doc_id, data) in enumerate(held):
                a, b = cuts[i], cuts[i + 1]
                split = data.split()
                logs_ = [words_.get(w) for w in split]
                rare = [w for w, x in zip(split, logs_) if x is None]
                row = (doc_id, len(split) + 1, len(split) - len(rare) + (ends > 0), sum(x for x in logs_ if x is not None) + end, float(value[a:b].sum()), rare, code[a:b][~found[a:b]])
                for (k, _), x in zip(types, row):
                    out[k].append(x)
            return pa.RecordBatch.from_pydict(out, schema=pa.schema(types))

        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, lowered(text)))
                size += len(held[-1][1])
                if size > 1 << 20:
                    yield settle(held)
                    held, size = [], 0
            if held:
                yield settle(held)

    first = rows.select("doc_id", "text").mapInArrow(score, "doc_id long, n_tokens long, n_known long, logs double, score double, rare array<binary>, far array<long>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = first.select("row", F.explode("rare").alias("word")).join(counts.where(~common), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    far = first.select("row", F.explode("far").alias("code")).join(tree.where(~near).select("code", "log10p"), "code")
    far = far.groupBy("row").agg(F.sum(F.col("log10p").cast("double")).alias("beyond"))
    total = float(np.log10(n_train + distinct + 1.0))
    out = first.drop("rare", "far").join(rare, "row", "left").join(far, "row", "left")
    return out.select(
        "doc_id",
        (~in_training("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + F.coalesce("beyond", F.lit(0.0))).alias("score"),
    )
