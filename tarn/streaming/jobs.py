"""The same operators on streams: status folds, two-strike state, outbox batches and watermarked windows.

State that a query needs again is a table of its own (one folder a batch), swapped whole by foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes, operations


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100, glob: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, so many a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(folder)


def counts_by_window(events: DataFrame, at: str, by: str, window: str = "5 minutes", late: str = "7 days") -> DataFrame:
    """(start, by, n): events a window; what comes later than `late` is left out, the look-back of a high-water mark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def once_each(events: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Events without the repeats of a key inside the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark([key])


class StateTable:
    """A small versioned table: each write is a folder of its own, the newest complete one is the state."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(done(f"{self.folder}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """The newest state, or the newest from before a batch: a batch that runs twice starts from the same one."""
        versions = [v for v in self._versions() if before is None or v < before]
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{versions[-1]}")

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}")


def fold(stream: DataFrame, state: StateTable, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs all that is there through `step(state, batch) -> state`, once for each batch whatever fails in between."""

    def run(batch: DataFrame, epoch: int) -> None:
        state.write(step(state.read(before=epoch), batch), epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status_step(key: str, status: str, at: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The newest status of each key, late and repeated events and all."""
    return lambda state, batch: operations.latest_status(state.unionByName(batch.select(*state.columns)), key, status, at)


def outbox_step(now: datetime) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The outbox after a batch of outcomes (id, outcome)."""
    return lambda state, batch: operations.settled(state, batch.select("id", "outcome").dropDuplicates(["id"]), now).select(*state.columns)


def two_strike_step(key: str, now: datetime) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Two-strike state after a look; keys seen for the first time start at no misses."""

    def step(state: DataFrame, batch: DataFrame) -> DataFrame:
        fresh = batch.select(key).distinct().join(state.select(key), key, "left_anti")
        fresh = fresh.select(key, F.lit(0).alias("misses"), F.lit(now).cast("timestamp_ntz").alias("last_checked"), F.lit(False).alias("deleted"))
        return changes.two_strikes(state.unionByName(fresh.select(*state.columns)), batch, key, now).select(*state.columns)

    return step


def miss_counter(sightings: DataFrame, key: str, strikes: int = 2) -> DataFrame:
    """(key, misses, deleted) on each change: a stream of (key, seen boolean) with the count kept as keyed state."""

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        misses = state.get[0] if state.exists else 0
        for pdf in batches:
            for seen in pdf["seen"]:
                misses = 0 if seen else misses + 1
        state.update((misses,))
        yield pd.DataFrame({key: [keys[0]], "misses": [misses], "deleted": [misses >= strikes]})

    kind = dict(sightings.dtypes)[key]
    return sightings.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, misses long, deleted boolean", "misses long", "update", "NoTimeout")
