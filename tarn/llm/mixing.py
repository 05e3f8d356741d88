"""Mixing sources to target weights: iterative proportional fitting, then sampling by the calibrated chances.

Everything here is DataFrame expressions. Documents are summed into cells (source, language, topic) once; fitting works
on the cells, of which there are as many as combinations of categories.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored

WORD = "[^\\x20\\x09-\\x0D]+"
NONE = "(none)"
#: A number: each category's share of the tokens to that power. A dict: the weight of each category, others none.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
DIMS = ("source", "lang", "topic")


def attributes(docs: DataFrame, topics: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A row a document: row (all its columns, untouched), source, lang, topic (null: "(none)") and tokens (words of the whole text)."""
    known = topics.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("topic").alias("topic"))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), named(source_col).alias("source"), named(lang_col).alias("lang"), tokens.alias("tokens"))
    return rows.join(known, "id", "left").withColumn("topic", named("topic"))


def calibrated(cells: DataFrame, targets: dict = TARGETS, rounds: int = 12, budget: float = 0.5) -> DataFrame:
    """(source, lang, topic, p): sampling chances whose expected token sums meet the target share of every category.

    `cells` has source, lang, topic, tokens. Each round scales the cells' weights to the source, language and topic
    targets in turn. p is the weight over the tokens, at the highest scale that asks for no more than `budget` of all
    tokens and for no chance above 1, so nothing is clipped. Cells without tokens get 0.
    """
    one = cells.repartition(1)  # cells only: every window below then runs without another exchange
    whole, of = Window.partitionBy(), {d: Window.partitionBy(d) for d in DIMS}
    share = {d: F.sum("tokens").over(of[d]) / F.sum("tokens").over(whole) for d in DIMS}

    def wish(d: str) -> Column:
        t = targets[d]
        if isinstance(t, dict):
            table = F.create_map(*chain.from_iterable((F.lit(str(k)), F.lit(float(v))) for k, v in t.items()))
            return F.coalesce(table[F.col(d)], F.lit(0.0))
        return F.pow(F.col(f"share_{d}"), F.lit(float(t)))

    now = one.where("tokens > 0").withColumns({f"share_{d}": share[d] for d in DIMS})
    now = now.withColumns({f"wish_{d}": wish(d) for d in DIMS})
    part = {d: F.col("tokens") / F.sum("tokens").over(of[d]) for d in DIMS}
    now = now.withColumns({f"goal_{d}": F.col(f"wish_{d}") / F.sum(F.col(f"wish_{d}") * part[d]).over(whole) for d in DIMS})
    now = now.select(*DIMS, "tokens", *(f"goal_{d}" for d in DIMS), F.col("tokens").cast("double").alias("w"))
    for r in range(rounds):
        for d in DIMS:
            total = F.sum("w").over(of[d])
            now = now.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"goal_{d}") / total).otherwise(0.0))
        if r % 3 == 2:
            now = cut(now)
    now = now.withColumn("f", F.col("w") / F.sum("w").over(whole) * F.sum("tokens").over(whole) / F.col("tokens"))
    scale = F.least(F.lit(float(budget)), 1 / F.max("f").over(whole))
    return now.select(*DIMS, F.least(F.lit(1.0), F.coalesce(scale * F.col("f"), F.lit(0.0))).alias("p"))


def _level(have: Column, ask: Column, total: Column) -> Column:
    """The factor by which `ask` grows until the sum of least(have, factor * ask) is `total`; null where all of it is less.

    Rows are filled whole in order of have / ask; those that ask for nothing get nothing. The factor stands in the row
    where filling stops, smaller ones in rows after it: take the maximum.
    """
    ratio, have = F.try_divide(have, ask), F.when(ask > 0, have).otherwise(0.0)
    ordered = Window.partitionBy().orderBy(ratio, *DIMS)
    before, onward = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    factor = F.try_divide(total - F.coalesce(F.sum(have).over(before), F.lit(0.0)), F.sum(ask).over(onward))
    return F.when((ask > 0) & (factor <= ratio * (1 + 1e-12)), factor)


def filled(cells: DataFrame, targets: dict = TARGETS, rounds: int = 12, budget: float = 0.5) -> DataFrame:
    """(source, lang, topic, p, goal_<dimension>, reach_<dimension>): chances that meet the token budget, whatever the targets.

    A category that has fewer tokens than its target share of the budget is taken whole, and what it lacks goes to the
    others of its dimension in proportion; so reach_* (tokens) is what goal_* (tokens) comes down or up to. Cells are
    fitted to the reaches with chances of at most 1, and then all that are below 1 rise or fall together until the
    budget is met. Only categories of weight 0 can keep it from being met.
    """
    whole = Window.partitionBy()
    now = cells.where("tokens > 0").repartition(1).select(*DIMS, F.col("tokens").cast("double").alias("tokens"))
    now = now.withColumn("asked", F.lit(float(budget)) * F.sum("tokens").over(whole))
    for d in DIMS:
        of, t = Window.partitionBy(d), targets[d]
        now = now.withColumn("have", F.sum("tokens").over(of)).withColumn("nth", F.row_number().over(of.orderBy(*DIMS)))
        if isinstance(t, dict):
            table = F.create_map(*chain.from_iterable((F.lit(str(k)), F.lit(float(v))) for k, v in t.items()))
            wish = F.coalesce(table[F.col(d)], F.lit(0.0))
        else:
            wish = F.pow(F.col("have") / F.sum("tokens").over(whole), F.lit(float(t)))
        now = now.withColumn("wish", wish).withColumn("one", F.when(F.col("nth") == 1, F.col("wish")).otherwise(0.0))
        now = now.withColumn(f"goal_{d}", F.coalesce(F.try_divide(F.col("asked") * F.col("wish"), F.sum("one").over(whole)), F.lit(0.0)))
        first = F.when(F.col("nth") == 1, 1.0).otherwise(0.0)  # a category counts once, in its first cell
        now = now.withColumns({"h": F.col("have") * first, "g": F.col(f"goal_{d}") * first})
        now = now.withColumn("level", _level(F.col("h"), F.col("g"), F.col("asked")))
        level = F.max("level").over(whole)
        reach = F.when(F.col("wish") <= 0, 0.0).when(level.isNull(), F.col("have")).otherwise(F.least("have", level * F.col(f"goal_{d}")))
        now = cut(now.withColumn(f"reach_{d}", reach).drop("have", "nth", "wish", "one", "h", "g", "level"))
    now = now.withColumn("w", F.col("tokens") * F.lit(float(budget)))
    for r in range(rounds):
        for d in DIMS:
            total = F.sum("w").over(Window.partitionBy(d))
            now = now.withColumn("w", F.when(total > 0, F.least("tokens", F.col("w") * F.col(f"reach_{d}") / total)).otherwise(0.0))
        if r % 3 == 2:
            now = cut(now)
    now = now.withColumn("level", F.max(_level(F.col("tokens"), F.col("w"), F.col("asked"))).over(whole))
    p = F.when(F.col("w") <= 0, 0.0).when(F.col("level").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("level") * F.col("w") / F.col("tokens")))
    return now.select(*DIMS, p.alias("p"), *(f"goal_{d}" for d in DIMS), *(f"reach_{d}" for d in DIMS))


def draw(id_col: str, seed: str = "mix") -> Column:
    """A number in [0, 1) that follows from the id: 32 bits of its MD5 with the seed."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def chances(docs: DataFrame, topics: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Every document with doc_id, source, lang, topic, n_tokens, its chance p (6 decimals) and whether it is kept.

    `topics` is (id, topic); with several for an id the smallest counts. Null categories are one category, "(none)".
    Repeated rows share one draw, as do rows without an id; documents without words in a cell without words go.
    """
    rows = attributes(docs.select(id_col, "text", "source", "lang"), topics, id_col)
    rows = stored(rows.select(F.col("id").alias("doc_id"), *DIMS, F.col("tokens").alias("n_tokens")), "attributes")
    cells = rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    out = rows.join(calibrated(cells, **options), list(DIMS), "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return out.select("doc_id", *DIMS, "n_tokens", F.round("p", 6).alias("p"), (draw("doc_id") < F.col("p")).alias("kept"))


def sampled(docs: DataFrame, topics: DataFrame, id_col: str = "doc_id", fit=calibrated, **options) -> DataFrame:
    """The sampled rows of `docs`, all columns, with their chance `p_kept` (in place of a column of that name); `fit` is
    calibrated or filled. Null categories, repeated rows and rows without an id are as in chances()."""
    rows = attributes(docs, topics, id_col)
    cells = rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    p = fit(cells, **options).select(*DIMS, "p")
    out = rows.join(p, list(DIMS), "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    kept = out.where(draw("id") < F.col("p"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "p_kept"), F.col("p").alias("p_kept"))


def oracle_sql(targets: dict = TARGETS, rounds: int = 12, budget: float = 0.5) -> str:
    """chances() of documents with the embeddings' labels as topics, for DuckDB (powers of shares as targets)."""
    steps = []
    name = "w0"
    for r in range(rounds):
        for d in DIMS:
            new = f"w{len(steps) + 1}"
            steps.append(f"{new} as materialized (select * replace (case when sum(w) over (partition by {d}) > 0 then w * goal_{d} / sum(w) over (partition by {d}) else 0.0 end as w) from {name})")
            name = new
    goals = ", ".join(f"wish_{d} / sum(wish_{d} * tokens / sum_{d}) over () as goal_{d}" for d in DIMS)
    sums = ", ".join(f"sum(tokens) over (partition by {d})::double as sum_{d}" for d in DIMS)
    wishes = ", ".join(f"pow(sum_{d} / sum(tokens) over (), {float(targets[d])}) as wish_{d}" for d in DIMS)
    return f"""
with topics as (select vec_id, min(label)::varchar as topic from embeddings group by vec_id),
a as materialized (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, coalesce(topic, '{NONE}') as topic,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens
  from documents left join topics on vec_id = doc_id),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens from a group by all having sum(n_tokens) > 0),
s as (select *, {sums} from cells),
t as (select *, {wishes} from s),
w0 as materialized (select *, {goals}, tokens as w from t),
{", ".join(steps)},
f as (select source, lang, topic, w / sum(w) over () * sum(tokens) over () / tokens as f from {name}),
p as (select source, lang, topic, least(1.0, least({float(budget)}, 1 / max(f) over ()) * f) as p from f)
select doc_id, source, lang, topic, n_tokens, round(coalesce(p, 0.0), 6) as p,
  ('0x' || substr(md5(doc_id::varchar || ':mix'), 1, 8))::bigint / 4294967296.0 < coalesce(p, 0.0) as kept
from a left join p using (source, lang, topic)"""
