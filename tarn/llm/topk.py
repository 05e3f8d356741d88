"""Exact top-k inner products: an impact-ordered index, worked through segment by segment until a proof lets it stop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

LEVELS = 8  # quantised impacts


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component as a double; vectors null, or with a null or
    non-finite component, are left out, and so are rows without an id."""
    ids = F.col(id_col).cast("long").alias("vec_id")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(ids, v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def segments(rows: DataFrame, block_rows: int = 8192, block_cells: int = 1 << 21) -> DataFrame:
    """The index: (block, impact, ids, dims, vals), all three packed arrays, one row for the postings of an impact.

    Vectors are dealt into blocks by a hash of their id, `block_rows` or `block_cells` components in each at most. A
    posting's impact is its eighth of the block's largest absolute component, 7 for the largest; its row lists the
    postings by dimension. Row -1 is the forward file (ids, vals: the vectors), row -2 holds, for each impact and
    vector, the length of what lies below that impact (what a proof needs).
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // max(1, min(block_rows, block_cells // max(1, size)))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        size = max(map(len, pdf["v"]), default=0)
        v = np.zeros((len(pdf), size), np.int64)
        for i, x in enumerate(pdf["v"]):
            v[i, : len(x)] = x
        away = np.abs(v.astype(float))
        impact = np.minimum(away * LEVELS / max(1.0, away.max(initial=0)), LEVELS - 1).astype(np.int8)
        left = np.stack([np.sqrt((np.where(impact < level, away, 0) ** 2).sum(1)) for level in range(LEVELS)])
        ids, block = pdf["vec_id"].to_numpy(np.int64), int(pdf["block"].iloc[0])
        out = [(block, -1, ids.tobytes(), b"", v.tobytes()), (block, -2, b"", b"", left.tobytes())]
        for level in range(LEVELS - 1, -1, -1):
            d, at = np.nonzero((impact == level).T & (v != 0).T)
            out.append((block, level, at.astype(np.int32).tobytes(), d.astype(np.int32).tobytes(), v[at, d].tobytes()))
        return pd.DataFrame(out, columns=["block", "impact", "ids", "dims", "vals"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(build, "block int, impact int, ids binary, dims binary, vals binary")


def _search(index: pd.DataFrame, asked: pd.DataFrame, k: int, enough: int, cells: int = 1 << 22) -> pd.DataFrame:
    """The k best of a block for each asked query: (query_id, vec_id, score). Sums are whole numbers throughout."""
    columns = ["query_id", "vec_id", "score"]
    if not len(index) or not len(asked):
        return pd.DataFrame({c: [] for c in columns})
    packed = {row.impact: row for row in index.itertuples(index=False)}
    ids = np.frombuffer(packed[-1].ids, np.int64)
    n = len(ids)
    forward = np.frombuffer(packed[-1].vals, np.int64).reshape(n, -1)
    left = np.frombuffer(packed[-2].vals).reshape(LEVELS, n)
    size = forward.shape[1]
    q = np.zeros((len(asked), size), np.int64)
    for i, x in enumerate(asked["v"]):
        q[i, : min(size, len(x))] = x[:size]
    qid = asked["vec_id"].to_numpy(np.int64)
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    most = float(np.sqrt((forward.astype(float) ** 2).sum(1)).max(initial=0)) * float(length.max(initial=0))  # no sum, nor part of one, is larger
    if most >= 2.0**62:
        raise ValueError("an inner product may not fit a long")
    exact = np.float64 if most < 2.0**52 else np.int64  # doubles add whole numbers of this size without rounding
    slack = most * 2.0**-50 + 1  # and no bound below is off by more
    own = np.searchsorted(ids, qid)
    own = np.where((own < n) & (ids[np.minimum(own, n - 1)] == qid), own, -1)
    out = []

    def settle(which, sums, level):
        """Rescore, for these queries, every vector that may be among the k best; give back the queries with too many."""
        part = sums.astype(np.float64)
        mine = own[which]
        part[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        open_ = left[level] * length[which, None] * (1 + 1e-9) + slack if level else 0.0  # how far a sum may still move
        low = part - open_
        bar = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(which), -np.inf)
        may = (part + open_ >= bar[:, None]) & (part > -np.inf)
        few = (may.sum(1) <= enough) | (level == 0)
        for j in np.flatnonzero(few):
            at = np.flatnonzero(may[j])
            if level == 0 and exact is np.float64 and len(at) > k:  # the sums are the scores: ties beyond the k-th are larger ids
                above = at[part[j, at] > bar[j]]
                at = np.concatenate((above, at[part[j, at] == bar[j]][: k - len(above)]))
            score = forward[at] @ q[which[j]]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), qid[which[j]]), ids[at[best]], score[best]))
        return ~few

    for first in range(0, len(qid), max(1, cells // n)):
        which = np.arange(first, min(len(qid), first + max(1, cells // n)))
        sums = np.zeros((len(which), n), exact)
        for level in range(LEVELS - 1, -1, -1):
            at, d = (np.frombuffer(getattr(packed[level], c), np.int32) for c in ("ids", "dims"))
            if len(at):
                segment = np.zeros((size, n), exact)
                segment[d, at] = np.frombuffer(packed[level].vals, np.int64)
                sums += q[which].astype(exact) @ segment
            if level in (4, 2, 1, 0):  # looking for a proof costs a pass over the sums
                more = settle(which, sums, level)
                which, sums = which[more], sums[more]
            if not len(which):
                break
    if not out:
        return pd.DataFrame({c: [] for c in columns})
    return pd.DataFrame(dict(zip(columns, (np.concatenate(x) for x in zip(*out)))))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 8192, block_queries: int = 8192, enough: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id `every` divides, the k largest inner products.

    Candidates are all other vectors; ties go to the smaller id; with fewer than k others, all of them. A block of
    vectors meets a block of queries in one task: posting segments are added up in order of falling impact, a segment
    is unpacked when its turn comes, and a query stops when its bound (sum so far, give or take the product of lengths
    not yet seen) leaves at most `enough` vectors that may be among its k best, which are then rescored. Sums and
    scores are whole numbers and exact; a table whose products may pass 2^62 is refused. Queries are copied to every
    block of vectors; the index is copied only where there are more than `block_queries` queries, once for each so many.
    A shorter vector counts as filled with zeros; rows repeated under one id are one vector (the largest).
    """
    rows = stored(integers(vectors, id_col, vector_col).groupBy("vec_id").agg(F.max("v").alias("v")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    query_blocks = max(1, -(-asked.count() // block_queries))
    index = stored(segments(rows, block_rows), "segments")
    blocks = 1 + (index.agg(F.max("block")).first()[0] or 0)
    postings = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = postings.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(lambda a, b: _search(a, b, k, enough), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
