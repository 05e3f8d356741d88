"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .windows import chosen, covered, slide, window_hashes, word_ids

EMPTY = hashlib.sha256(b"").hexdigest()


def _joined(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").split())


def lengths(window: int, least: int = 7) -> list[int]:
    """The levels below `window`, ascending: each is half of the next (rounded up), down to `least` or fewer words."""
    out = []
    while window > least:
        window = (window + 1) // 2
        out.append(window)
    return out[::-1]


def _level(ids: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of a level start that stand for a document, and their hashes: every full window holds one."""
    h = window_hashes(ids, length)
    at = chosen(h, window - length + 1)
    return at.astype(np.int32), h[at].view(np.int64)


def _spans(alive: np.ndarray) -> np.ndarray:
    """Ends of the runs of true: from, to, from, to, ..."""
    return np.flatnonzero(np.diff(np.concatenate(([0], alive.astype(np.int8), [0])))).astype(np.int32)


def _inside(spans: np.ndarray, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int8)
    steps[spans[::2]] += 1
    steps[spans[1::2]] -= 1
    return np.cumsum(steps[:n]) > 0


def _least(p: np.ndarray, h: np.ndarray, n: int, width: int) -> np.ndarray:
    """The smallest of the hashes `h` at places `p` in each of n full windows; all ones where there is none."""
    at = np.full(n + width - 1, ~np.uint64(0))
    at[p] = h
    return slide(at, width, np.minimum)


def _narrowed(window: int, length: int, later: list[int]):
    """mapInArrow: full windows are given up that a window of this level stands for which no other document has, with
    what later levels would have counted in them; documents without any left go."""

    def run(batches):
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            out = {name: [] for name in batch.schema.names if name not in ("met", f"p{length}", f"h{length}")}
            for i in range(batch.num_rows):
                value = lambda name: cols[name][i].values.to_numpy()  # noqa: B023, E731
                n, p = cols["n_words"][i].as_py() - window + 1, value(f"p{length}")
                h, met = value(f"h{length}").view(np.uint64), np.isin(p, value("met"))
                alive = _inside(value("spans"), n) & (_least(p, h, n, window - length + 1) == _least(p[met], h[met], n, window - length + 1))
                if not alive.any():
                    continue
                held = covered(np.flatnonzero(alive), window, n + window - 1)
                for x in ("doc_id", "sha", "n_words"):
                    out[x].append(cols[x][i].as_py())
                out["spans"].append(_spans(alive))
                for x in later:
                    at = value(f"p{x}")
                    here = held[at] & held[at + x - 1]
                    out[f"p{x}"].append(at[here])
                    out[f"h{x}"].append(value(f"h{x}")[here])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([f for f in batch.schema if f.name in out]))

    return run


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, kept_sha256, without the words of windows that a smaller doc_id has.

    Level by level, from 7 words to 13, 25 and 50: at each length a document is represented by windows chosen by
    smallest hash: one stands for a full window, and it is the same wherever that full window stands. What a single
    document has at one length rules out the full windows it stands for, so only windows inside stretches that repeat
    are counted at twice the length, and documents with none left go. The full windows of the stretches that remain are
    hashed (96 bits) and the smallest document of each is found by a partial aggregate; the join back to the documents
    reads it from a table of its own, so Spark can split a window that a third of all documents share. A document that
    is word for word another one is wholly covered and goes no further than its digest.

    Null or short texts lose nothing. Repeated rows are judged alike; two texts under one id never remove each other's
    words. A row without an id loses nothing and removes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    levels = lengths(window)
    arrays = [(f"{c}{x}", t) for x in levels for c, t in (("p", pa.int32()), ("h", pa.int64()))]

    def summary(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_words": [], "sha": [], **{name: [] for name, _ in arrays}}
            for text in batch.column(1).to_pylist():
                data = _joined(text)
                ids, _ = word_ids(data)
                out["n_words"].append(len(ids))
                out["sha"].append(hashlib.sha256(data).hexdigest())
                for x in levels:
                    p, h = _level(ids, x, window) if len(ids) >= window else (None, None)
                    out[f"p{x}"].append(p)
                    out[f"h{x}"].append(h)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), *((name, pa.list_(t)) for name, t in arrays)]))

    typed = ", ".join(f"{name} array<{'int' if t == pa.int32() else 'long'}>" for name, t in arrays)
    all_docs = stored(rows.mapInArrow(summary, f"doc_id long, n_words long, sha string{', ' if typed else ''}{typed}"), "summaries")
    long_enough = all_docs.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    firsts = stored(long_enough.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "firsts")
    # joined by the id as well, so copies by the thousand are no single key
    alive = long_enough.join(firsts.select("sha", F.col("first").alias("doc_id")), ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"])
    alive = alive.withColumn("spans", F.array(F.lit(0), (F.col("n_words") - window + 1).cast("int")))
    for k, x in enumerate(levels):
        each = alive.select("doc_id", "sha", F.explode(F.arrays_zip(F.col(f"p{x}").alias("p"), F.col(f"h{x}").alias("h"))).alias("w")).select("doc_id", "sha", "w.p", "w.h")
        often = stored(each.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), f"repeated-{x}")
        met = each.join(often, "h").groupBy("doc_id", "sha").agg(F.collect_list("p").alias("met"))
        typed = ", ".join(["doc_id long, sha string, n_words long, spans array<int>", *(f"p{y} array<int>, h{y} array<long>" for y in levels[k + 1 :])])
        kept = [f"{c}{y}" for y in levels[k + 1 :] for c in "ph"]
        narrowed = alive.join(met, ["doc_id", "sha"]).select("doc_id", "sha", "n_words", "spans", *kept, f"p{x}", f"h{x}", "met")
        alive = stored(narrowed.mapInArrow(_narrowed(window, x, levels[k + 1 :]), typed), f"alive-{x}")
    texts = stored(rows.join(alive.select("doc_id", "sha", "spans"), "doc_id"), "candidates")

    def full(batches):
        for batch in batches:
            h, g, ids_, shas, at = [], [], [], [], []
            for doc_id, text, sha, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = _joined(text)
                if hashlib.sha256(data).hexdigest() != sha:  # another text under the same id
                    continue
                ids, _ = word_ids(data)
                near = np.flatnonzero(_inside(spans.values.to_numpy(), len(ids) - window + 1))
                h.append(window_hashes(ids, window).view(np.int64)[near])
                g.append((window_hashes(ids, window, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)[near])
                at.append(near.astype(np.int32))
                ids_.append(np.full(len(near), doc_id, np.int64))
                shas.append(np.full(len(near), int(sha[:15], 16), np.int64))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, g, ids_, shas, at)], ["h", "g", "doc_id", "key", "start"])

    windows = texts.select("doc_id", "text", "sha", "spans").mapInArrow(full, "h long, g int, doc_id long, key long, start int")
    windows = stored(windows, "windows")
    least = windows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    starts = windows.join(stored(least, "first-holders"), ["h", "g"]).where("first < doc_id").groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"))

    def keep(batches):
        for batch in batches:
            out = {"doc_id": [], "sha": [], "n_removed": [], "kept": []}
            for doc_id, text, sha, key, at in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                data = _joined(text)
                if int(sha[:15], 16) != key or hashlib.sha256(data).hexdigest() != sha:
                    continue
                words = data.split()
                gone = covered(at.values.to_numpy().astype(np.int64), window, len(words))
                out["doc_id"].append(doc_id)
                out["sha"].append(sha)
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    cut = texts.join(starts, "doc_id").select("doc_id", "text", "sha", "key", "starts").mapInArrow(keep, "doc_id long, sha string, n_removed long, kept string")
    cut = cut.groupBy("doc_id", "sha").agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept"))
    copies = firsts.where("copies > 1").select("sha", "first")
    out = all_docs.select("doc_id", "n_words", "sha").join(copies, "sha", "left").join(cut, ["doc_id", "sha"], "left")
    copy = F.col("first") < F.col("doc_id")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
