"""Lexical, vector and fused retrieval over units, for many queries in one job."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, text
from ..functions.access import Filters, event_time, visible

# Boosts of the lexical score by authority, and of the fused score.
AUTHORITY_WEIGHTS = {"approved_operational": 0.35, "article_source": 0.20, "governance": 0.20, "committee_record": 0.10, "meeting_transcript": 0.08, "meeting_summary": 0.03}
TITLE_EQUAL, TITLE_HOLDS, CURRENT = 2.0, 0.35, 0.15
RRF_K = 60
FUSED_AUTHORITY, FUSED_CURRENT = {"approved_operational": 0.012, "article_source": 0.008, "governance": 0.008}, 0.004
FIELD_WEIGHTS = {"title": 1.0, "context": 0.4, "content": 0.2}
TOKENS_AT_ONCE = 1 << 17


def authority_weight(column: str = "authority", weights: dict = AUTHORITY_WEIGHTS) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out


def clamp(limit: int | None, default: int = 20, most: int = 50) -> int:
    return min(max(default if limit is None else limit, 1), most)


def over_fetch(limit: int) -> int:
    return min(max(limit * 3, 30), 100)


def _literal(q: text.Query) -> Column:
    words = F.lit(list(q.words)) if q.words else F.array().cast("array<string>")
    phrase = lambda t: F.lit(list(t))
    groups = F.array(*(F.array(*map(phrase, g)) for g in q.groups)) if q.groups else F.array().cast("array<array<array<string>>>")
    none = F.array(*map(phrase, q.none)) if q.none else F.array().cast("array<array<string>>")
    every = sorted({w for t in q.none for w in t} | set(q.words))
    return F.struct(F.lit(q.text).alias("query"), groups.alias("groups"), none.alias("none"), words.alias("words"), F.lit(every).alias("terms"))


def _fields(units: DataFrame) -> dict[str, Column]:
    context = F.concat_ws(" ", *(F.col(c) for c in ("source_area", "topic", "channel", "author") if c in units.columns))
    return {"title": F.col("title"), "context": context, "content": F.col("content")}


def tagged_tokens(units: DataFrame) -> Column:
    """array<struct<pos, term, weight>>: the tokens of title, context (area, topic, channel, author) and content in turn."""
    tagging = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight"))
    tagged = F.flatten(F.array(*(F.transform(text.tokens(c), tagging(FIELD_WEIGHTS[n])) for n, c in _fields(units).items())))
    return F.transform(tagged, lambda t, i: F.struct(i.alias("pos"), t["term"].alias("term"), t["weight"].alias("weight")))


def posted(units: DataFrame) -> DataFrame:
    """(unit_id, term, spots array<struct<pos, weight>>): each unit's tokens by term, grouped where the unit lies."""
    rows = units.select(F.col("unit_id").cast("string").alias("unit_id"), *(text.tokens(c).alias(n) for n, c in _fields(units).items()))
    rows = rows.select("unit_id", F.size("title").alias("n"), (F.size("title") + F.size("context")).alias("m"), F.concat("title", "context", "content").alias("tokens"))
    return rows.mapInArrow(lambda b: by_term(b), "unit_id string, term string, spots array<struct<pos: int, weight: double>>")


def by_term(batches, most: int = TOKENS_AT_ONCE):
    """posted(), from batches of (unit_id, n, m, tokens).

    However many units a batch has, the arrays made of it hold `most` tokens, or one unit's if those are more.
    """
    weights = [FIELD_WEIGHTS[n] for n in ("title", "context", "content")]
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            past = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            part, start = b.slice(start, past - start), past
            lists = part.column(3)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            tokens = lists.flatten().dictionary_encode()
            if not len(tokens):
                continue
            unit = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n, m = (part.column(k).to_numpy()[unit] for k in (1, 2))
            weight = np.select([pos < n, pos < m], weights[:2], weights[2])
            code = tokens.indices.to_numpy()
            key = unit * len(tokens.dictionary) + code
            order = np.argsort(key, kind="stable")  # places stay in order
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            spots = pa.StructArray.from_arrays([pa.array(pos[order], pa.int32()), pa.array(weight[order])], ["pos", "weight"])
            spots = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), spots)
            at = order[first]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(unit[at])), tokens.dictionary.take(pa.array(code[at])), spots], ["unit_id", "term", "spots"])


def asked(rows: DataFrame, queries: list[text.Query]) -> DataFrame:
    """(unit_id, query, groups, none, words, terms, hits) from (unit_id, _all): each query's own hits, if there are any."""
    rows = rows.select("unit_id", "_all", F.explode(F.array(*map(_literal, queries))).alias("q")).select("unit_id", "_all", "q.*")
    hits = F.filter("_all", lambda h: F.array_contains("terms", h["term"]))
    return rows.withColumn("hits", hits).drop("_all").where(F.size("hits") > 0)


def occurrences(units: DataFrame, queries: list[text.Query]) -> DataFrame:
    """(unit_id, query, groups, none, words, terms, hits): each query's words in every unit that has any of them.

    The queries are a list of the caller's, so they travel in the plan: a unit's tokens are cut down to the words that
    any query names while the row is read, and nothing is joined or shuffled. For units searched more than once keep an
    index (lexindex).
    """
    queries = [q for q in queries if q.words or q.none]
    if not queries:
        raise ValueError("no query has a word")
    every = sorted({w for q in queries for w in (*q.words, *(x for t in q.none for x in t))})
    rows = units.select("unit_id", F.filter(tagged_tokens(units), lambda h: h["term"].isin(*every)).alias("_all")).where(F.size("_all") > 0)
    return asked(rows, queries)


def _holds(hits: Column, terms: Column) -> Column:
    """Whether the terms stand in a row among the hits."""
    at = lambda k: F.transform(F.filter(hits, lambda h: h["term"] == F.element_at(terms, k + 1)), lambda h: h["pos"] - k)
    first = F.transform(F.filter(hits, lambda h: h["term"] == terms[0]), lambda h: h["pos"])
    rest = F.sequence(F.lit(1), F.size(terms) - 1)
    chain = F.aggregate(F.when(F.size(terms) > 1, rest).otherwise(F.array().cast("array<int>")), first, lambda acc, k: F.array_intersect(acc, at(k)))
    return F.size(chain) > 0


def cover_density(hits: Column, words: Column) -> Column:
    """Sum over the shortest stretches that hold all words of (mean field weight of the words / length), as r / (r + 1).

    One pass over the hits in order: the last place of each word is kept, and a stretch ends wherever the earliest of
    them moves on.
    """
    blank = F.transform(words, lambda w: F.struct(F.lit(-1).alias("pos"), F.lit(0.0).alias("weight")))
    start = F.struct(blank.alias("last"), F.lit(-1).alias("a"), F.lit(0.0).alias("r"))

    def step(acc, h):
        last = F.transform(words, lambda w, i: F.when(w == h["term"], F.struct(h["pos"].alias("pos"), h["weight"].alias("weight"))).otherwise(acc["last"][i]))
        return F.struct(last.alias("last"), acc["a"].alias("a"), acc["r"].alias("r"), h["pos"].alias("b"))

    def gain(s):
        a = F.array_min(F.transform(s["last"], lambda x: x["pos"]))
        mean = F.aggregate(s["last"], F.lit(0.0), lambda t, x: t + x["weight"]) / F.size(s["last"])
        more = F.when((a >= 0) & (a != s["a"]), mean / (s["b"] - a + 1)).otherwise(0.0)
        return F.struct(s["last"].alias("last"), F.greatest(a, s["a"]).alias("a"), (s["r"] + more).alias("r"))

    # step and gain as one: a let-binding by transform over a single-element array keeps `last` from being built twice
    r = F.aggregate(hits, start, lambda acc, h: F.transform(F.array(step(acc, h)), gain)[0], lambda acc: acc["r"])
    return r / (r + 1)


def matched(units: DataFrame, queries: list[text.Query]) -> DataFrame:
    """(query, unit_id, density) of the units that answer a query: every group met, nothing unwanted."""
    return answered(occurrences(units, queries))


def answered(found: DataFrame) -> DataFrame:
    """matched(), from the rows of asked()."""
    hits = F.col("hits")
    all_groups = F.forall("groups", lambda g: F.exists(g, lambda t: _holds(hits, t)))
    unwanted = F.exists("none", lambda t: _holds(hits, t))
    wanted_hits = F.filter(hits, lambda h: F.array_contains(F.col("words"), h["term"]))
    present = F.array_intersect(F.col("words"), F.transform(hits, lambda h: h["term"]))
    out = found.where(all_groups & ~unwanted)
    return out.select("query", "unit_id", cover_density(wanted_hits, present).alias("density"))


def lexical(units: DataFrame, queries: list[text.Query], scope: str = "admin", filters: Filters = Filters(), limit: int = 20, now: datetime | None = None, chat_days: float = 365.0) -> DataFrame:
    """Ranked units by cover density, title, authority, currency (and, with `now`, the recency of chat messages)."""
    rows = units.where(filters.column() & visible(scope))
    return scored(matched(rows, queries), rows, limit, now, chat_days)


def scored(found: DataFrame, rows: DataFrame, limit: int = 20, now: datetime | None = None, chat_days: float = 365.0) -> DataFrame:
    """lexical()'s ranking of `found` (query, unit_id, density) among `rows`, the units that may be shown."""
    found = found.join(rows, "unit_id")
    title, query = F.lower("title"), F.lower("query")
    score = (
        F.col("density")
        + F.when(title == query, TITLE_EQUAL).otherwise(0.0)
        + F.when(F.contains(title, query), TITLE_HOLDS).otherwise(0.0)
        + authority_weight()
        + F.when(F.col("is_current"), CURRENT).otherwise(0.0)
    )
    if now is not None:
        score = score + F.when(F.col("source_type") == "slack_message", scalar.recency(event_time(), now, chat_days, 0.05)).otherwise(0.0)
    ranked = found.withColumn("score", F.round(score, 6))
    by = Window.partitionBy("query").orderBy(F.desc("score"), event_time().desc_nulls_first(), "unit_id")
    return ranked.withColumn("lexical_rank", F.row_number().over(by)).where(F.col("lexical_rank") <= limit)


def substring_search(units: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Units whose title or content holds the text, case aside; title hits first. % and _ mean themselves."""
    p = text.like_pattern(query)
    in_title, in_content = F.col("title").ilike(p), F.col("content").ilike(p)
    score = F.when(in_title, 2).otherwise(0) + F.when(in_content, 1).otherwise(0)
    return units.where(in_title | in_content).withColumn("score", score).orderBy(F.desc("score"), "unit_id").limit(limit)


def semantic(units: DataFrame, embeddings: DataFrame, queries: list[tuple[str, list[float]]], scope: str = "admin", filters: Filters = Filters(), limit: int = 20, floor: float | None = None) -> DataFrame:
    """The most similar units for each query vector, exactly: (query, unit_id, similarity, semantic_rank) and unit columns.

    `queries` is the caller's list of (name, vector) and goes to the tasks. Each batch of vectors is multiplied with all
    of them at once, and a task hands on its own best of each query, so neither rows times queries nor more than
    `limit` (and ties) a task and query are ever rows. Vectors and queries that are not finite take no part.
    """
    asked = [(n, [float(x) for x in v]) for n, v in queries if v and all(abs(float(x)) < float("inf") for x in v)]
    if not asked:
        raise ValueError("no query has a usable vector")
    rows = units.where(filters.column() & visible(scope))
    usable = embeddings.where(scalar.usable(F.col("embedding"))).select("unit_id", F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = usable.join(rows.select("unit_id"), "unit_id")
    near = vectors.mapInArrow(lambda b: nearest(b, asked, limit), f"query string, unit_id {dict(units.dtypes)['unit_id']}, similarity double")
    near = near.withColumn("similarity", F.round("similarity", 6))
    if floor is not None:
        near = near.where(F.col("similarity") >= floor)
    by = Window.partitionBy("query").orderBy(F.desc("similarity"), "unit_id")
    ranked = near.withColumn("semantic_rank", F.row_number().over(by)).where(F.col("semantic_rank") <= limit)
    return ranked.join(rows, "unit_id")


def nearest(batches, asked: list[tuple[str, list[float]]], limit: int):
    """(query, unit_id, cosine) of a task's candidates among (unit_id, vector): its best `limit` of each query, and all so
    near the last of them that rounding to six digits could put them before it.

    A batch is multiplied with all queries of its length at once; a query's candidates are cut back after each batch.
    """
    by_length: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(asked):
        by_length.setdefault(len(v), []).append(i)
    best = [(np.zeros(0), []) for _ in asked]
    kind = None
    for b in batches:
        kind = b.column(0).type
        lengths = pc.list_value_length(b.column(1))
        for n, which in by_length.items():
            fits = pc.fill_null(pc.equal(lengths, n), False)
            ids = b.column(0).filter(fits)
            if not n or not len(ids):
                continue
            rows = b.column(1).filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            wanted = np.array([asked[i][1] for i in which])
            with np.errstate(invalid="ignore", divide="ignore"):
                cosines = rows @ wanted.T / (np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(wanted, axis=1))
            for i, column in zip(which, cosines.T):
                at = np.flatnonzero(np.isfinite(column))
                if len(best[i][0]) >= limit:
                    at = at[column[at] >= np.partition(best[i][0], -limit)[-limit] - 2e-6]
                found = np.concatenate((best[i][0], column[at]))
                names = [*best[i][1], *ids.take(pa.array(at)).to_pylist()]
                if len(found) > limit:
                    keep = np.flatnonzero(found >= np.partition(found, -limit)[-limit] - 2e-6)
                    found, names = found[keep], [names[k] for k in keep]
                best[i] = found, names
    for (name, _), (found, names) in zip(asked, best):
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(names)), pa.array(names, kind), pa.array(found)], ["query", "unit_id", "similarity"])


def fused(lexical_rows: DataFrame, semantic_rows: DataFrame, units: DataFrame, limit: int = 20, semantic_weight: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists: (query, unit_id, lexical_rank, semantic_rank, score, rank)."""
    both = lexical_rows.select("query", "unit_id", "lexical_rank").join(semantic_rows.select("query", "unit_id", "semantic_rank"), ["query", "unit_id"], "full")
    rrf = F.coalesce(1.0 / (RRF_K + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(semantic_weight / (RRF_K + F.col("semantic_rank")), F.lit(0.0))
    boost = authority_weight(weights=FUSED_AUTHORITY) + F.when(F.col("is_current"), FUSED_CURRENT).otherwise(0.0)
    rows = both.join(units.select("unit_id", "authority", "is_current"), "unit_id").withColumn("score", F.round(rrf + boost, 9))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "unit_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("query", "unit_id", "lexical_rank", "semantic_rank", "score", "rank")


_IDENTIFIER = "\\b[A-Z][A-Z0-9_/-]+\\b"
_FILE = "(?i)(https?://|\\b[\\w.-]+\\.(docx|xlsx|pdf|csv|md|html)\\b)"


def rescued(lexical_rows: DataFrame, semantic_rows: DataFrame, limit: int = 20) -> DataFrame:
    """The semantic list, led by lexical hits whose title names what the query names: (query, unit_id, rescued, rank).

    Only queries with an upper-case identifier (I and OK aside), an address or a file name rescue anything.
    """
    names = F.filter(F.regexp_extract_all(F.col("query"), F.lit(_IDENTIFIER), 0), lambda w: ~w.isin("I", "OK"))
    title, query = F.lower("title"), F.lower("query")
    open_ = (F.size(names) > 0) | F.col("query").rlike(_FILE)
    hit = F.contains(title, query) | F.exists(names, lambda w: F.contains(title, F.lower(w)))
    first = lexical_rows.where(open_ & hit).select("query", "unit_id", F.lit(0).alias("part"), F.col("lexical_rank").alias("at"))
    then = semantic_rows.select("query", "unit_id", F.lit(1).alias("part"), F.col("semantic_rank").alias("at"))
    both = first.unionByName(then).groupBy("query", "unit_id").agg(F.min(F.struct("part", "at")).alias("p"))
    by = Window.partitionBy("query").orderBy("p.part", "p.at", "unit_id")
    out = both.select("query", "unit_id", (F.col("p.part") == 0).alias("rescued"), F.row_number().over(by).alias("rank"))
    return out.where(F.col("rank") <= limit)


def rank_sums(lexical_hits: DataFrame) -> DataFrame:
    """(unit_id, lexical_score, best_rank, matched_queries): each query's ranks by density, six digits of it, summed per unit."""
    hits = lexical_hits.withColumn("density", scalar.rounded(F.col("density"), 6))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("density"), "unit_id")))
    score = scalar.rounded(F.sum(1.0 / (RRF_K + F.col("r"))), 9)
    return ranked.groupBy("unit_id").agg(score.alias("lexical_score"), F.min("r").alias("best_rank"), F.count("*").alias("matched_queries"))


def multi_query(units: DataFrame, lexical_hits: DataFrame, semantic_pool: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Several phrasings of one question: their rank lists summed, then fused with one vector pool.

    `lexical_hits` is (query, unit_id, density), `semantic_pool` (unit_id, similarity) already cut by floor and size.
    """
    by_query = Window.partitionBy("query").orderBy(F.desc("density"), "unit_id")
    ranked = lexical_hits.withColumn("r", F.row_number().over(by_query))
    words = ranked.groupBy("unit_id").agg(F.sum(1.0 / (RRF_K + F.col("r"))).alias("lexical_score"), F.max("density").alias("best_density"), F.min("r").alias("best_lexical_rank"), F.count("*").alias("matched_queries"))
    pool = semantic_pool.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "unit_id")))  # the pool is cut to size before
    both = words.join(pool, "unit_id", "full").join(units.select("unit_id", "authority", event_time().alias("at")), "unit_id")
    zero = F.lit(0.0)
    score = scalar.rounded(F.coalesce("lexical_score", zero) + F.coalesce(1.0 / (RRF_K + F.col("semantic_rank")), zero), 9)
    out = both.select(
        "unit_id",
        F.coalesce("similarity", zero).alias("similarity"),
        F.coalesce("best_lexical_rank", F.lit(2147483647)).alias("best_lexical_rank"),
        "semantic_rank",
        F.coalesce("matched_queries", F.lit(0)).alias("matched_queries"),
        score.alias("fused_score"),
        authority_weight().alias("authority_weight"),
        "at",
    )
    order = [F.desc("fused_score"), F.desc("authority_weight"), F.col("at").desc_nulls_first(), F.asc("unit_id")]
    return out.orderBy(*order).offset(max(0, offset)).limit(clamp(limit)).drop("at")


def requested(queries: DataFrame) -> DataFrame:
    """Distinct lower-case trimmed phrasings of an array column `queries`, blanks dropped."""
    return queries.select(F.explode("queries").alias("q")).select(F.lower(F.trim("q")).alias("query")).where("query <> ''").distinct()


def phrasings(queries: list[str]) -> list[str]:
    """requested() for the caller's own list."""
    return list(dict.fromkeys(q for q in (q.strip().lower() for q in queries) if q))


def dominant_model(embeddings: DataFrame, fallback: tuple[str, str, str, int]) -> DataFrame:
    """The model with most vectors, its dimension and how many units have one; the fallback row where there are none."""
    keys = ["provider", "model", "model_version", "dimension"]
    best = embeddings.groupBy(*keys).agg(F.count("*").alias("embedded")).orderBy(F.desc("embedded"), *keys).limit(1)
    default = embeddings.sparkSession.createDataFrame([(*fallback, 0)], "provider string, model string, model_version string, dimension int, embedded long")
    return best.unionByName(default).orderBy(F.desc("embedded")).limit(1)


def context_package(ranked: DataFrame) -> DataFrame:
    """A row a query: how many results, kinds of source, top score, gap to the second, exact word match, quality label."""
    n, top = F.count("*"), F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return ranked.groupBy("query").agg(
        n.alias("result_count"),
        F.countDistinct("source_type").alias("source_family_count"),
        top.alias("top_score"),
        F.round(top - second, 9).alias("rank_gap"),
        F.bool_or((F.col("lexical_rank") == 1) & F.col("semantic_rank").isNull()).alias("exact_lexical_match"),
        F.when(n == 1, "limited").otherwise("normal").alias("retrieval_quality"),
    )


class SearchError(ValueError):
    """A search that cannot be run as asked."""


def search(units: DataFrame, embeddings: DataFrame | None, query: str, vector: list[float] | None = None, scope: str = "admin", filters: Filters = Filters(), limit: int = 20, offset: int = 0, mode: str = "hybrid") -> DataFrame:
    """One query in lexical, semantic or hybrid mode (semantic first, exact names rescued); without a vector, lexical."""
    query = query.strip()
    if not query:
        raise SearchError("query must not be empty")
    if not 1 <= limit <= 50 or offset < 0:
        raise SearchError("limit must be 1 to 50 and offset 0 or more")
    if mode not in ("lexical", "semantic", "hybrid"):
        raise SearchError("mode must be lexical, semantic or hybrid")
    if mode == "semantic" and (vector is None or embeddings is None):
        raise SearchError("semantic mode needs a query vector and embeddings")
    most = over_fetch(limit)
    words = lexical(units, [text.parse_query(query)], scope, filters, most)
    if mode == "lexical" or vector is None or embeddings is None:
        out = words.withColumn("rank", F.col("lexical_rank"))
    else:
        near = semantic(units, embeddings, [(query, vector)], scope, filters, most)
        out = near.withColumn("rank", F.col("semantic_rank")) if mode == "semantic" else rescued(words, near, most)
    return out.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).orderBy("rank")


