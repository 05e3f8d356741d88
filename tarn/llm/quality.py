"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Token -> hash, kept for tokens seen lately."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))
        return h


_hashes = _Hashes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of a whole text: slots, and the roots of their counts over the vector's length.

    Tokens are words and runs of punctuation, case kept. No tokens: no features.
    """
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    slots = np.concatenate((h * MIX[0], h[:-1] * MIX[1] + h[1:] * MIX[0])) >> np.uint64(64 - BITS)
    slots, counts = np.unique(slots.astype(np.int64), return_counts=True)
    return slots.astype(np.int32), np.sqrt(counts / counts.sum()).astype(np.float32)


def ftrl(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], alpha: float, beta: float, l1: float, l2: float, passes: int, seed: int = 7) -> np.ndarray:
    """Weights after `passes` over the rows in shuffled orders; the last slot is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            (slots, x), y = rows[k]
            i, v = np.append(slots, 1 << BITS), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange((1 << BITS) + 1))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 8192, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.001, passes: int = 4) -> np.ndarray:
    """Weights learnt from labelled rows whose crc32(id) mod 5 is not 0.

    At most about `most_rows` labelled rows are used, chosen by a hash of their id; they train in one task, so this
    bound is what keeps that task's memory. Rows without id, label or document teach nothing; a null text counts as
    empty; without any rows all weights are 0. What comes to the driver is one number a non-zero slot, 2**18 at most.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.where(fold("id") != 0).distinct()
    share = min(1.0, most_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "y", "text"], na_position="first")
        w = ftrl([(features(t), y) for t, y in zip(pdf["text"], pdf["y"])], alpha, beta, l1, l2, passes)
        i = np.flatnonzero(w)
        return pd.DataFrame({"i": i, "w": w[i]})

    rows = text.join(marked, "id").groupBy(F.lit(0).alias("one")).applyInPandas(fit, "i long, w double").toPandas()
    out = np.zeros((1 << BITS) + 1)
    out[rows["i"].to_numpy(np.int64)] = rows["w"]
    return out


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; 0 marks the rows that are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def scorer(docs: DataFrame, weights: np.ndarray):
    """A pandas UDF text -> score. The weights it carries have a fixed size (2**18 + 1 doubles)."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shipped.value
        sums = [float(w[s] @ x + w[-1]) for s, x in map(features, texts)]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))))

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from `least` on) of every row; null and empty texts get the bias's score.

    Repeated rows give repeated results; a row without id counts as not held out and is scored like any other. Texts of
    any length are read whole. No labels: every score is 0.5. Other columns are not read, whatever their names.
    """
    score = scorer(docs, train(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col).cast("string")).alias("score"))
    return rows.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that score `least` or more."""
    score = scorer(docs, train(docs, labels, id_col, text_col))
    return docs.where(score(F.col(text_col).cast("string")) >= least)
