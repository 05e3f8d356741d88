"""Retrieval quality: ranks, metrics, breakdowns, benchmark checks, splits, embedding coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import retrieval

CUTS = (1, 3, 5, 8, 10)
UUID = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def query_metrics(ranked: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """A row a gold query (and strategy): hit_at_k, mrr, recall_at_5, recall_at_10.

    `ranked` is (*keys, unit_id, rank), `gold` (query, primary_ids, acceptable_ids, ...). A unit counts once, at its
    best rank. Where alternatives are accepted, recall is met by any one of them; else it is the share found.
    """
    best = ranked.groupBy(*keys, "unit_id").agg(F.min("rank").alias("rank"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "unit_id")))
    lists = best.where("rank <= 100").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))).alias("found"))
    rows = gold.join(lists, "query", "left")
    alternatives = F.coalesce("acceptable_ids", F.array().cast("array<string>"))
    accepted = F.array_union("primary_ids", alternatives)
    found = F.coalesce("found", F.array().cast("array<struct<rank:int,unit_id:string>>"))
    first = F.array_min(F.transform(F.filter(found, lambda f: F.array_contains(accepted, f["unit_id"])), lambda f: f["rank"]))

    def recall(k: int) -> Column:
        top = F.transform(F.filter(found, lambda f: f["rank"] <= k), lambda f: f["unit_id"])
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(top, F.col("primary_ids"))), F.size(F.array_distinct("primary_ids"))), F.lit(0.0))
        return F.when(F.size(alternatives) > 0, F.arrays_overlap(top, accepted).cast("double")).otherwise(share)

    out = {f"hit_at_{k}": F.coalesce(first <= k, F.lit(False)).cast("double") for k in CUTS}
    out |= {"mrr": F.coalesce(1.0 / first, F.lit(0.0)), "recall_at_5": recall(5), "recall_at_10": recall(10)}
    return rows.withColumns(out).drop("found")


def averaged(metrics: DataFrame, by: list[str]) -> DataFrame:
    names = [*(f"hit_at_{k}" for k in CUTS), "mrr", "recall_at_5", "recall_at_10"]
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by]
    return metrics.groupBy(*groups).agg(F.count("*").alias("queries"), *(F.round(F.avg(n), 4).alias(n) for n in names))


def parent_key(columns: list[str]) -> Column:
    """What a unit is a part of: its kind, and its record (documents), parent, address or record, the first that is given."""
    have = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit(None).cast("string")
    record = F.coalesce(have("source_record_id"), F.concat(F.lit("unit:"), F.col("unit_id").cast("string")))
    part_of = F.when(F.col("source_type") == "document", record).otherwise(F.coalesce(have("source_parent_id"), have("source_url"), record))
    return F.struct(F.col("source_type").alias("kind"), part_of.alias("key"))


def parent_cap(ranked: DataFrame, most: int = 2) -> DataFrame:
    """At most `most` results of one parent_key() for a query, order kept."""
    nth = F.row_number().over(Window.partitionBy("query", parent_key(ranked.columns)).orderBy("rank"))
    kept = ranked.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))


STRATEGIES = ("weighted_fts", "semantic", "rrf_equal", "rrf_semantic_2", "semantic_primary_exact", "semantic_primary_exact_dedup")


def strategies(lexical_rows: DataFrame, semantic_rows: DataFrame, units: DataFrame, limit: int = 100) -> DataFrame:
    """(strategy, query, unit_id, rank) of the six ways to rank the same two lists, in one table."""
    by = lambda rows, rank: rows.select("query", "unit_id", F.col(rank).alias("rank"))
    exact = by(retrieval.rescued(lexical_rows, semantic_rows, limit), "rank")
    described = exact.join(units.select("unit_id", *(c for c in ("source_type", "source_record_id", "source_parent_id", "source_url") if c in units.columns)), "unit_id")
    ways = (
        by(lexical_rows, "lexical_rank"),
        by(semantic_rows, "semantic_rank"),
        by(retrieval.fused(lexical_rows, semantic_rows, units, limit), "rank"),
        by(retrieval.fused(lexical_rows, semantic_rows, units, limit, semantic_weight=2.0), "rank"),
        exact,
        by(parent_cap(described), "rank"),
    )
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("strategy"), "*") for name, rows in zip(STRATEGIES, ways)))


def evaluated(ranked: DataFrame, gold: DataFrame, names: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """query_metrics() for every gold query and strategy; a strategy that returns nothing for a query scores zero."""
    both = gold.withColumn("strategy", F.explode(F.array(*map(F.lit, names))))
    key = F.concat_ws("\u001f", "strategy", "query")
    rows = query_metrics(ranked.withColumn("query", key), both.withColumn("query", key))
    return rows.withColumn("query", F.substring_index("query", "\u001f", -1))


def failures(ranked: DataFrame, gold: DataFrame, names: tuple[str, ...] = STRATEGIES, top: int = 5) -> DataFrame:
    """(strategy, query, expected, acceptable, returned) where none of the first `top` units is accepted."""
    first = ranked.where(F.col("rank") <= top).groupBy("strategy", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))).alias("_f"))
    empty = F.array().cast("array<string>")
    alternatives = F.coalesce("acceptable_ids", empty)
    rows = gold.withColumn("strategy", F.explode(F.array(*map(F.lit, names)))).join(first, ["strategy", "query"], "left")
    returned = F.coalesce(F.transform("_f", lambda f: f["unit_id"]), empty)
    rows = rows.where(~F.arrays_overlap(returned, F.array_union("primary_ids", alternatives)))
    return rows.select("strategy", "query", F.array_sort(F.array_distinct("primary_ids")).alias("expected"), F.array_sort(F.array_except(alternatives, "primary_ids")).alias("acceptable"), returned.alias("returned"))


def labelled(units: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(term, unit_id) that best stands for each term: its own title, then a title that holds it, then the longest text.

    A term stands for units that hold it in title or text; equals fall to the smaller id.
    """
    held = lambda t: F.contains(F.lower("title"), F.lower(t)) | F.contains(F.lower("content"), F.lower(t))
    rows = units.select("unit_id", F.lower("title").alias("named"), F.length("content").alias("n"), F.explode(F.filter(F.array(*map(F.lit, terms)), held)).alias("term"))
    low = F.lower("term")
    worst = F.struct((F.col("named") != low).cast("int").alias("other"), (~F.contains("named", low)).cast("int").alias("elsewhere"), (-F.col("n")).alias("shorter"), F.col("unit_id").alias("id"))
    return rows.groupBy("term").agg(F.min(worst).alias("best")).select("term", F.col("best.id").alias("unit_id"))


def latencies(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and the 95th percentile by the index rule sorted[int(0.95 n) - 1], never interpolated."""
    at = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    placed = rows.withColumns({"_at": F.row_number().over(at), "_n": n})
    p95 = F.max(F.when(F.col("_at") == F.greatest(F.floor(F.col("_n") * 0.95), F.lit(1)), F.col(value)))
    return placed.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), p95.alias("p95"))


def best_strategy(averages: DataFrame, latency: str = "median") -> DataFrame:
    """The strategy with the best recall@10, then hit@5, then mrr, then the lowest latency."""
    order = F.struct("recall_at_10", "hit_at_5", "mrr", (-F.col(latency)).alias("speed"))
    return averages.agg(F.max_by("strategy", order).alias("strategy"))


def split(rows: DataFrame, seed: str, holdout: float = 0.30, groups: tuple[str, ...] = ("source_family", "category")) -> DataFrame:
    """`rows` with split = dev or holdout: the first `holdout` share by hash, then one more of each group left out.

    A group with two rows or more that has none in the holdout gives its first by hash.
    """
    key = F.sha2(F.concat_ws("|", F.lit(seed), "query", *(F.coalesce(F.col(g), F.lit("")) for g in groups)), 256)
    rows = rows.withColumn("_h", key)
    nth = F.row_number().over(Window.orderBy("_h", "query"))  # a benchmark: a list people have reviewed
    total = F.count("*").over(Window.partitionBy())
    out = rows.withColumn("_out", nth <= F.greatest(F.lit(1), F.round(total * holdout)))
    for g in groups:
        value = F.coalesce(F.col(g), F.lit("unknown"))
        whole = Window.partitionBy(value)
        first = F.row_number().over(whole.orderBy("_h", "query")) == 1
        missing = (F.count("*").over(whole) >= 2) & ~F.bool_or("_out").over(whole)
        out = out.withColumn("_out", F.col("_out") | (missing & first))
    return out.withColumn("split", F.when(F.col("_out"), "holdout").otherwise("dev")).drop("_h", "_out")


def benchmark_errors(rows: DataFrame) -> DataFrame:
    """(row_id, error): empty or repeated queries, no or repeated or malformed ids."""
    q = F.lower(F.trim(F.coalesce("query", F.lit(""))))
    nth = F.row_number().over(Window.partitionBy(q).orderBy("row_id"))
    ids = F.concat(F.coalesce("primary_ids", F.array()), F.coalesce("acceptable_ids", F.array()))
    checks = F.array(
        F.when(q == "", F.lit("query is empty")),
        F.when((q != "") & (F.col("_nth") > 1), F.lit("duplicate query")),
        F.when(F.size(F.coalesce("primary_ids", F.array())) == 0, F.lit("no expected id")),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("duplicate id")),
        F.when(F.exists(ids, lambda i: ~F.coalesce(i.rlike(UUID), F.lit(False))), F.lit("invalid id")),
    )
    return rows.withColumn("_nth", nth).select("row_id", F.explode(F.array_compact(checks)).alias("error"))


def target_status(targets: DataFrame, units: DataFrame, embedded: DataFrame, eligible: Column) -> DataFrame:
    """(query, unit_id, status): what can be expected of each gold target."""
    rows = targets.join(units, "unit_id", "left").join(embedded.select("unit_id", F.lit(True).alias("_e")).distinct(), "unit_id", "left")
    status = (
        F.when(F.col("source_type").isNull(), "MISSING")
        .when(~F.col("is_current") | F.col("is_deleted"), "NOT_CURRENT")
        .when(~eligible, "EXCLUDED_BY_POLICY")
        .when(F.col("_e").isNull(), "NOT_EMBEDDED")
        .otherwise("EVALUABLE")
    )
    return rows.select("query", "unit_id", status.alias("status"))


def in_scope(targets: DataFrame, units: DataFrame, allowed: Column) -> DataFrame:
    """Queries all of whose targets satisfy the predicate."""
    rows = targets.join(units, "unit_id", "left")
    return rows.groupBy("query").agg(F.bool_and(F.coalesce(allowed, F.lit(False))).alias("ok")).where("ok").select("query")


SENSITIVE = "(?i)(^|[/\\\\])(\\.env(\\..*)?|.*\\.(pem|key|p12|pfx)|id_(rsa|dsa|ecdsa|ed25519)|.*(password|secret|credential|token).*)$"


def embedding_eligible(source_types: tuple[str, ...], areas: tuple[str, ...] = (), channels: tuple[str, ...] = ()) -> Column:
    """Whether a unit may be sent to an embedding model: listed type, current, not blank, no sensitive name, and the
    type's own rule (operational records approved, documents of listed areas, chat of listed channels)."""
    kind = F.col("source_type")
    own = (
        F.when(kind.startswith("operational_"), F.col("review_status").eqNullSafe("approved"))
        .when(kind == "document", F.lower(F.coalesce("source_area", F.lit(""))).isin(*areas) if areas else F.lit(False))
        .when(kind == "slack_message", F.coalesce("channel", F.lit("")).isin(*channels) if channels else F.lit(False))
        .otherwise(F.lit(True))
    )
    live = F.col("is_current") & ~F.col("is_stale") & ~F.col("is_deleted") & (F.trim(F.coalesce("content", F.lit(""))) != "")
    return kind.isin(*source_types) & live & ~F.coalesce(F.col("title").rlike(SENSITIVE), F.lit(False)) & own


def embedding_input() -> Column:
    """The text that is embedded: labelled fields without ids, then the content."""
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Source type: "), "source_type"), part("Area", "source_area"), part("Topic", "topic"), part("Channel", "channel"), F.concat(F.lit("Content:\n"), F.trim("content")))


def coverage(units: DataFrame, embeddings: DataFrame, eligible: Column, model: str) -> DataFrame:
    """(source_area, source_type, status, units): excluded, missing, stale (another text embedded), other_model or embedded."""
    e = embeddings.select("unit_id", F.col("model").alias("_m"), F.col("input_hash").alias("_h"))
    per = e.groupBy("unit_id").agg(F.max(F.when(F.col("_m") == model, F.col("_h"))).alias("_h"), F.bool_or(F.col("_m") != model).alias("_other"))
    rows = units.join(per, "unit_id", "left")
    status = (
        F.when(~eligible, "excluded")
        .when(F.col("_h").isNull(), F.when(F.col("_other"), "other_model").otherwise("missing"))
        .when(F.col("_h") != F.sha2(embedding_input(), 256), "stale")
        .otherwise("embedded")
    )
    return rows.groupBy("source_area", "source_type", status.alias("status")).agg(F.count("*").alias("units"))


def worklist(units: DataFrame, embeddings: DataFrame, eligible: Column, model: str) -> DataFrame:
    """(unit_id, input_hash, tokens): eligible units whose present text the model has not embedded."""
    from ..functions.scalar import token_estimate

    rows = units.where(eligible).select("unit_id", F.sha2(embedding_input(), 256).alias("input_hash"), token_estimate(embedding_input()).alias("tokens"))
    return rows.join(embeddings.where(F.col("model") == model).select("unit_id", "input_hash"), ["unit_id", "input_hash"], "left_anti")
