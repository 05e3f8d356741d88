"""Benchmark decontamination: CGK random walks turn edit distance into Hamming distance, bit sampling finds candidates,
an exact edit distance decides.

A walk reads a sequence of words: at step j it writes down the word it stands at, and a random bit of (j, word) says
whether it moves on. Two sequences a few edits apart soon read the same words at the same steps again, so a few sampled
steps agree with a fair chance; enough repetitions with walks of their own reach the target recall.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = 3  # sampled steps of a walk
SIZES = (5, 6, 12, 24)  # words in a window; an item is read in the largest that leaves room for the windows' stride
MOST_WALKS = 512
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def stride(size: int) -> int:
    return 1 if size < 6 else size // 3


def size_for(n: int) -> int | None:
    """The window size an item of n words is read in; None for those that are matched word for word."""
    return max((s for s in SIZES if s + stride(s) <= n), default=SIZES[0] if n >= SIZES[0] else None)


class Walks:
    """The repeated walks of one window size: for each, bits by step and word, and the sampled steps."""

    def __init__(self, size: int, repetitions: int, seed: int = 5):
        rng = np.random.default_rng([seed, size])
        steps = 2 * size - 2  # half of all steps move on, so this reads about `size` words
        self.size = size
        self.bits = rng.integers(0, 2, (repetitions, steps, 1024), np.int64)
        self.steps = np.sort(np.stack([rng.permutation(steps)[:SAMPLES] for _ in range(repetitions)]), axis=1)

    def sampled(self, r: int, ids: np.ndarray, starts: np.ndarray, alive=None, low=None) -> tuple[np.ndarray, np.ndarray]:
        """Which of `starts` are left and the hash of their sampled words. `alive(k, hash)` may give up some after
        sample k; unknown words (0) never agree with anything. `ids` has enough zeros at its end; `low` is ids & 1023."""
        low = ids & 1023 if low is None else low
        which, at = np.arange(len(starts)), starts.copy()
        h = np.zeros(len(starts), np.uint64)
        last = 0
        for k, step in enumerate(self.steps[r].tolist()):
            for j in range(last, step):
                at += self.bits[r, j].take(low.take(at))
            last = step
            word = ids.take(at)
            h = (h + word.astype(np.uint64) + np.uint64(1)) * _MIX[k]
            h ^= h >> np.uint64(29)
            ok = word > 0
            if alive is not None:
                ok &= alive(k, h)
            which, at, h = which[ok], at[ok], h[ok]
            if not len(which):
                break
        return which, h


def repetitions(items: list[np.ndarray], size: int, rate: float, recall: float, trials: int = 200, walks: int = 48, seed: int = 3) -> int:
    """The fewest walks that find an item with edits at `rate` of its words with chance `recall`, by trial on the items.

    Raises where MOST_WALKS would not do.
    """
    rng = np.random.default_rng([seed, size])
    drawn = Walks(size, walks, seed)
    sides = ([], [])
    for _ in range(trials):
        a, b = items[rng.integers(len(items))], []
        for w in a.tolist():
            roll = rng.random() / max(rate, 1e-9)
            fresh = int(rng.integers(1 << 20, 1 << 21))
            b += [] if roll < 1 / 3 else [fresh] if roll < 2 / 3 else [w, fresh] if roll < 1 else [w]
        sides[0].append((a, range(max(1, len(a) - size + 1))))
        sides[1].append((np.array(b, np.int64), range(int(rng.integers(0, stride(size))), max(1, len(b)), stride(size))))
    flat = []
    for side in sides:
        held, parts, starts, of = 0, [], [], []
        for i, (x, offsets) in enumerate(side):
            starts += [held + o for o in offsets]
            of += [i] * len(offsets)
            parts += [x, np.zeros(4 * size, np.int64)]
            held += len(x) + 4 * size
        flat.append((np.concatenate(parts), np.array(starts), np.array(of, np.uint64)))
    hits = np.zeros(trials)
    for r in range(walks):
        (p, h), (q, g) = (drawn.sampled(r, x, starts) for x, starts, _ in flat)
        both = np.intersect1d(h * _MIX[0] + flat[0][2][p], g * _MIX[0] + flat[1][2][q])
        met = np.isin(g * _MIX[0] + flat[1][2][q], both)
        hits[np.unique(flat[1][2][q[met]]).astype(np.int64)] += 1
    chance = hits / walks
    for n in range(1, MOST_WALKS + 1):
        if (1 - (1 - chance) ** n).mean() >= recall:
            return n
    raise ValueError(f"{MOST_WALKS} walks find items read in {size} words with chance {(1 - (1 - chance) ** MOST_WALKS).mean():.3f}, not {recall}")


class Index:
    """All windows of the benchmark's items, filed under the sampled words of each walk."""

    def __init__(self, names: list[int], texts: list[str], rate: float, recall: float):
        split = [words(t) for t in texts]
        self.short: dict[int, dict[tuple, list[int]]] = {}  # by length, by words: the items too short for a window
        for name, s in zip(names, split):
            if s and not size_for(len(s)):
                self.short.setdefault(len(s), {}).setdefault(tuple(s), []).append(name)
        keep = [i for i, w in enumerate(split) if size_for(len(w))]
        self.names, self.rate = [names[i] for i in keep], rate
        split = [split[i] for i in keep]
        self.vocabulary: dict[str, int] = {}
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in s], np.int64) for s in split]
        self.ids, self.lengths = ids, [len(s) for s in split]
        self.tables = {}
        for size in SIZES:
            mine = [i for i, s in enumerate(split) if size_for(len(s)) == size]
            if not mine:
                continue
            walks = Walks(size, repetitions([ids[i] for i in mine], size, rate, recall))
            parts, starts, of, off, held = [], [], [], [], 0
            for i in mine:
                for o in range(max(1, len(ids[i]) - size + 1)):
                    starts.append(held + o)
                    of.append(i)
                    off.append(o)
                parts += [ids[i], np.zeros(4 * size, np.int64)]
                held += len(ids[i]) + 4 * size
            flat, starts, of, off = np.concatenate(parts), np.array(starts), np.array(of), np.array(off)
            filed = []
            for r in range(len(walks.steps)):
                firsts = [np.empty(0, np.uint64)] * SAMPLES
                seen = lambda k, h, firsts=firsts: firsts.__setitem__(k, np.unique(h)) or True
                which, h = walks.sampled(r, flat, starts, seen)
                order = np.argsort(h, kind="stable")
                filed.append((firsts, h[order], of[which][order], off[which][order]))
            self.tables[size] = (walks, filed)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """(window start, item, offset of the window in the item) of every agreement in a sequence of word ids."""
        out = []
        padded = np.concatenate((ids, np.zeros(4 * SIZES[-1], np.int64)))
        low = padded & 1023
        for size, (walks, filed) in self.tables.items():
            starts = np.arange(0, len(ids), stride(size))
            for r, (firsts, h, of, off) in enumerate(filed):
                which, g = walks.sampled(r, padded, starts, lambda k, x, f=firsts: _among(x, f[k]), low)
                a, b = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
                n = b - a
                at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                out.append(np.stack([np.repeat(starts[which], n), of[at], off[at]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def edits(item: np.ndarray, stretch: np.ndarray) -> int:
    """The edit distance, in words, of `item` to the nearest run of `stretch`."""
    at = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)  # a run may begin anywhere
    for i, w in enumerate(item.tolist()):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (stretch != w), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.2, recall: float = 0.95, most_item_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_edits, n_words): documents with a stretch within rate * n_words edits of a benchmark item.

    Texts are compared as sequences of lower-case words. Every `stride` words of the whole text a window is tried
    against all windows of all items; what agrees in the sampled words, and has enough of the item's words around it to
    be that near at all, is settled by the exact edit distance, in words, of the whole item to that stretch. `recall` is
    for edits in `rate` of an item's words; an item that stands there word for word is always found. Null texts and
    items match nothing; items under five words match word for word only. Texts of any length are read whole, a stretch
    of windows at a time. Repeated rows, and texts repeated under one item_id, give one result; a row without an id
    gives one under null. Items go to the executors in groups of at most about `most_item_bytes`, one pass over the
    documents for each group. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    groups = -(-size // most_item_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], "doc_id long, item_id long, n_edits int, n_words int")
    for g in range(groups):
        pdf = items.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).toPandas().sort_values(["item_id", "item"])
        index = Index([None if pd.isna(x) else int(x) for x in pdf["item_id"]], pdf["item"].tolist(), rate, recall)
        if index.names or index.short:
            found = found.unionByName(rows.mapInArrow(_searcher(spark.sparkContext.broadcast(index)), found.schema))
    return found.groupBy("doc_id", "item_id").agg(F.min("n_edits").alias("n_edits"), F.min("n_words").alias("n_words"))


def _searcher(shipped, most_words: int = 1 << 17):
    def search(batches):
        index = shipped.value
        known = index.vocabulary.get
        gap = 4 * SIZES[-1]

        def settle(held):
            """held: (doc_id, words). Their ids in one sequence, a gap of unknown words before and after each."""
            ids, firsts, at = [np.zeros(gap, np.int64)], [], gap
            for _, w in held:
                firsts.append(at)
                ids += [np.fromiter(map(known, w, repeat(0)), np.int64, len(w)), np.zeros(gap, np.int64)]
                at += len(w) + gap
            ids, firsts = np.concatenate(ids), np.array(firsts)
            hits = index.candidates(ids)
            hits = np.unique(np.stack([hits[:, 1], (hits[:, 0] - hits[:, 2]) // 4], axis=1), axis=0)  # item, about where it begins
            cuts = np.searchsorted(hits[:, 0], np.arange(len(index.names) + 1))
            rows, is_in, base = [], np.zeros(len(index.vocabulary) + 1, bool), len(index.vocabulary) + 1
            for item, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a == b:
                    continue
                mine, n = index.ids[item], index.lengths[item]
                most = int(index.rate * n)
                begin = np.maximum(4 * hits[a:b, 1] - most, 0)
                span = n + 2 * most + 4
                is_in[mine] = True
                near = np.zeros(len(begin), bool)
                for x in range(0, len(begin), 4096):
                    part = begin[x : x + 4096, None] + np.arange(span)
                    near[x : x + 4096] = is_in[ids[np.minimum(part, len(ids) - 1)]].sum(1) >= n - most
                is_in[mine] = False
                begin, pairs = begin[near], np.unique(mine[:-1] * base + mine[1:])  # an edit spoils two pairs of words at most
                part = np.minimum(begin[:, None] + np.arange(span), len(ids) - 1)
                near = _among(ids[part[:, :-1]] * base + ids[part[:, 1:]], pairs).sum(1) >= n - 1 - 2 * most
                best: dict[int, int] = {}
                for x in begin[near].tolist():
                    doc = max(0, int(np.searchsorted(firsts, x + span // 2, "right")) - 1)
                    if best.get(doc) != 0:
                        e = edits(mine, ids[max(x, firsts[doc]) : min(x + span, firsts[doc] + len(held[doc][1]))])
                        if e <= most:
                            best[doc] = min(e, best.get(doc, e))
                rows += [(held[doc][0], index.names[item], e, n) for doc, e in best.items()]
            for n, short in index.short.items():
                for doc_id, w in held:
                    seen = {x for x in zip(*(w[k:] for k in range(n)))} & short.keys()
                    rows += [(doc_id, item, 0, n) for x in seen for item in short[x]]
            types = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_edits", pa.int32()), ("n_words", pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.append((doc_id, words(text)))
                    size += len(held[-1][1]) + gap
                    if size > most_words:
                        yield settle(held)
                        held, size = [], 0
        if held:
            yield settle(held)

    return search


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, whose id matches() does not name; rows without an id stay."""
    bad = matches(docs, benchmark, id_col, **options).select(F.col("doc_id").alias("_leaked")).where("_leaked is not null").distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad["_leaked"], "left_anti")
