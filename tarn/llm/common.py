"""What the training-data operators share: reading tables, shared-folder tables, components of a link table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where it is unset (tests).

    On a cluster a folder made here would be one machine's own, so there the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage is cut and any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` sorted over all partitions by `order`, stored, with each row's partition (part) and place in it (at)."""
    place = F.monotonically_increasing_id()  # of a sorted partition: its number above, the place in it in the lower 33 bits
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", place)
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    return stored(rows, name)


def records(batches) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a batch in memory at a time."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small DataFrame."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of `links` (u, v longs): one row (node, component) for every linked node.

    The component is its smallest node. Large-star and small-star rounds alternate until the links stop changing; a
    node's neighbours are only ever reduced by min() and joined, never gathered. Null ends and self-links are dropped.
    """
    now = (
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now, seen = cut(now), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == seen or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = (state.n, state.x)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")
