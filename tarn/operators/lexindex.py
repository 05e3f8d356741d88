"""A kept lexical index: postings by term, a dictionary, and the units without their text, in generations.

postings (bucket, term, gen, unit_id, spots) lie in one folder a bucket of terms and are sorted by term inside, so a
search reads the folders of its words and, of those, the row groups that hold them. A refresh writes the postings of new
and changed units alone, as a generation of their own; what a unit said before stays on disk until the index is built
anew, but no longer joins its row in units, which names the generation that counts.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import chunking, retrieval

BUCKETS = 64
SHARES = 8  # a bucket's postings are dealt over so many tasks by unit, as one frequent word can be most of them
SELECTIVE = 4  # the rarest words are looked up first if the others have over this many times their postings
POSTINGS = "term string, unit_id string, spots array<struct<pos: int, weight: double>>, gen int, bucket int"
TERMS = "term string, documents long, bucket int"
#: What a search needs of a unit besides its words.
SHOWN = ("unit_id", "source_type", "source_record_id", "source_parent_id", "source_version_id", "title", "source_area", "topic", "channel", "author", "visibility", "review_status", "authority", "is_current", "is_stale", "is_deleted", "occurred_at", "source_updated_at", "updated_at")


class LexicalIndex:
    """An index under `path`, which must be in a store that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, units: DataFrame, path: str) -> LexicalIndex:
        """Index all `units`; unit_id is their key. Null texts have no words; an empty table makes an empty index."""
        index = cls(units.sparkSession, path)
        index._write(units.select(*index._kept(units), F.lit(0).alias("gen")), units, 0)
        return index

    @property
    def generation(self) -> int:
        return self.spark.read.parquet(f"{self.path}/generations").agg(F.max("gen")).first()[0]

    @property
    def units(self) -> DataFrame:
        """The indexed units as of the last refresh: SHOWN columns, index_hash and gen."""
        return self.spark.read.parquet(f"{self.path}/units/{self.generation}")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        """(term, documents): how many units a term stands in. Counts of changed units' earlier words stay until a build."""
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/terms").groupBy("bucket", "term").agg(F.sum("documents").alias("documents"))

    @staticmethod
    def _kept(units: DataFrame) -> list:
        hash_ = F.sha2(F.concat_ws("\x01", *(F.coalesce(c, F.lit("")) for c in ("title", "source_area", "topic", "channel", "author", "content") if c in units.columns)), 256)
        return [c for c in SHOWN if c in units.columns] + [hash_.alias("index_hash")]

    def _write(self, kept: DataFrame, changed: DataFrame, gen: int) -> None:
        """One generation: the postings of `changed`, the dictionary of these, all of `kept`; it counts once it is named."""
        posted = retrieval.posted(changed).withColumn("bucket", (F.crc32("term") % BUCKETS).cast("int"))
        # dealt by hash: ranges would be drawn from a first pass over all texts
        posted = posted.withColumn("gen", F.lit(gen)).repartition("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(SHARES))).sortWithinPartitions("bucket", "term", "unit_id")
        posted.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        mine = self.postings.where(F.col("gen") == gen)
        counts = mine.groupBy("bucket", "term").agg(F.count("*").alias("documents")).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
        counts.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/terms")
        kept.write.mode("overwrite").parquet(f"{self.path}/units/{gen}")
        self.spark.createDataFrame([(gen,)], "gen int").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def refresh(self, units: DataFrame) -> DataFrame:
        """Bring the index up to date with `units`; what changed, as (unit_id, change)."""
        old, gen = self.units, self.generation + 1
        now = units.select(*self._kept(units))
        key = lambda df: df.select(F.col("unit_id").alias("stable_key"), "index_hash", F.lit(True).alias("is_current"))
        path = f"{self.path}/changes/{gen}"
        chunking.index_diff(key(old), key(now)).withColumnRenamed("stable_key", "unit_id").write.mode("overwrite").parquet(path)
        changes = self.spark.read.parquet(path)
        new = changes.where(F.col("change").isin("created", "updated")).select("unit_id")
        at = old.select("unit_id", F.col("gen").alias("_gen")).join(new, "unit_id", "left_anti")
        kept = now.join(at, "unit_id", "left").withColumn("gen", F.coalesce("_gen", F.lit(gen))).drop("_gen")
        self._write(kept, units.join(new, "unit_id", "left_semi"), gen)
        return changes

    def lookup(self, words: list[str]) -> DataFrame:
        """The postings of some words: the folders of their buckets, filtered by term in the scan."""
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        return self.postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words))

    def documents(self, words: list[str]) -> dict[str, int]:
        """In how many units each word stands; as many rows come to the driver as words were asked for."""
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        rows = self.terms.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words)).collect()
        return {**dict.fromkeys(words, 0), **{r.term: r.documents for r in rows}}

    def matched(self, queries: list[text.Query], rows: DataFrame | None = None) -> DataFrame:
        """(query, unit_id, density) of the units among `rows` (all) that answer a query, as retrieval.matched() has them.

        A query needs one of the words of each of its groups. If the group with the fewest postings is much rarer than
        the other words, those are looked up only in the units that have it.
        """
        queries = [q for q in queries if q.words or q.none]
        if not queries:
            raise ValueError("no query has a word")
        every = sorted({w for q in queries for w in (*q.words, *(x for t in q.none for x in t))})
        df = self.documents(every)
        rarest = [min(([t[0] for t in g] for g in q.groups), key=lambda ws: sum(df[w] for w in ws)) if q.groups else list(every) for q in queries]
        rare = sorted({w for ws in rarest for w in ws})
        live = (self.units if rows is None else rows).select("unit_id", "gen")
        hits = self.lookup(every).select("unit_id", "gen", F.transform("spots", lambda s: F.struct(s["pos"].alias("pos"), F.col("term").alias("term"), s["weight"].alias("weight"))).alias("spots"))
        if sum(df[w] for w in every) > (1 + SELECTIVE) * sum(df[w] for w in rare):
            hits = hits.join(self.lookup(rare).select("unit_id", "gen").distinct(), ["unit_id", "gen"], "left_semi")
        all_ = F.array_sort(F.flatten(F.collect_list("spots"))).alias("_all")
        found = hits.join(live, ["unit_id", "gen"]).groupBy("unit_id").agg(all_)
        return retrieval.answered(retrieval.asked(found, queries))

    def search(self, queries: list[text.Query], scope: str = "admin", filters=retrieval.Filters(), **more) -> DataFrame:
        """retrieval.lexical() over the kept postings; no text is read."""
        rows = self.units.where(filters.column() & retrieval.visible(scope))
        return retrieval.scored(self.matched(queries, rows), rows, **more)

