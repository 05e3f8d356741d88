"""Timers on streams: quiet paths across a restart, reminders against the batch version, wake-ups on commit."""

import tempfile
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.operators import operations
from tarn.streaming import jobs, timers

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    settings = {"spark.sql.streaming.stateStore.providerClass": timers.ROCKSDB, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def started(df, out, checkpoint, **trigger):
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def wait_for(spark, out, schema, n, seconds=120):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.read.schema(schema).parquet(out).collect()
        if len(rows) >= n:
            return rows
        time.sleep(0.5)
    return spark.read.schema(schema).parquet(out).collect()


def test_two_writes_in_the_wait_are_one_and_a_restart_keeps_the_timer(rocks):
    looks, out, checkpoint = folder(), folder(), folder()
    schema = "path string, size long, modified timestamp"

    def look(*rows):
        rocks.createDataFrame([(p, s, T0 + timedelta(seconds=m)) for p, s, m in rows], schema).coalesce(1).write.mode("append").parquet(looks)

    def run():
        # not availableNow: with timers by the clock such a query would wait for all of them
        return started(timers.quiet_paths(jobs.file_stream(rocks, looks, schema), timedelta(seconds=25)), out, checkpoint, processingTime="500 milliseconds")

    def taken(query, n):
        end = time.time() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) < n and time.time() < end:
            time.sleep(0.3)

    look(("a", 1, 0), ("b", 5, 0))
    query = run()
    taken(query, 2)
    look(("a", 2, 1), ("b", 5, 0))  # a was written again inside the wait, b only looked at again
    taken(query, 4)
    query.stop()
    assert rocks.read.schema(schema).parquet(out).count() == 0
    query = run()  # a restart: the timers are still there
    try:
        rows = wait_for(rocks, out, schema, 2)
    finally:
        query.stop()
    assert sorted((r.path, r.size) for r in rows) == [("a", 2), ("b", 5)]


class Handle:
    """State and timers of one key in memory, for the processor alone."""

    class Value:
        def __init__(self):
            self.now = None

        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, value):
            self.now = value

        def clear(self):
            self.now = None

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return self.Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_a_change_sets_the_timer_anew():
    path, handle = timers._Quiet(1000), Handle()
    path.init(handle)
    look = lambda ms, size, second: list(path.handleInputRows(("a",), iter([pd.DataFrame({"size": [size], "modified": [pd.Timestamp(T0 + timedelta(seconds=second))]})]), Clock(ms)))
    look(0, 1, 0)
    look(400, 1, 0)  # nothing new
    assert handle.timers == {1000}
    look(900, 2, 1)
    assert handle.timers == {1900}
    (told,) = path.handleExpiredTimer(("a",), Clock(1900), None)
    assert told.values.tolist()[0][:2] == ["a", 2]
    handle.timers.clear()
    look(5000, 2, 1)  # told already
    assert not handle.timers
    look(6000, 2, 2)
    assert handle.timers == {7000}


def test_reminders_are_those_of_the_batch(rocks):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "ticket_id long, version long, at timestamp"
    rows = [(1, 1, at(0)), (1, 1, at(30)), (2, 1, at(5)), (2, 2, at(60)), (3, 2, at(40)), (3, 1, at(50)), (4, 1, at(10)), (4, 2, at(20)), (4, 3, at(25))]
    source, out, checkpoint = folder(), folder(), folder()
    told = "ticket_id long, version long, due_at timestamp"
    rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: timers.reminders(jobs.file_stream(rocks, source, schema))
    started(stream(), out, checkpoint, availableNow=True).awaitTermination()
    rocks.createDataFrame([(9, 1, at(3600))], schema).coalesce(1).write.mode("append").parquet(source)  # time goes by
    started(stream(), out, checkpoint, availableNow=True).awaitTermination()
    rocks.createDataFrame([(9, 1, at(3601))], schema).coalesce(1).write.mode("append").parquet(source)
    started(stream(), out, checkpoint, availableNow=True).awaitTermination()
    got = {(r.ticket_id, r.due_at) for r in rocks.read.schema(told).parquet(out).collect()}
    batch = operations.reminder_jobs(rocks.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp_ntz")), at(3600))
    assert got == {(r.ticket_id, r.due_at) for r in batch.where("due").collect()} and len(got) == 4


def test_one_wake_up_a_commit(spark):
    schema = "id long, state string"
    source = folder()
    outbox, wakeups = jobs.StateTable(spark, folder() + "/o", schema), jobs.StateTable(spark, folder() + "/w", "batch long, pending long")
    checkpoint = folder()
    stream = lambda: jobs.file_stream(spark, source, schema, files_per_trigger=1)
    for rows in ([(1, "pending"), (2, "pending")], [(3, "posted")], [(2, "pending"), (4, "retry")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        timers.committed(stream(), outbox, wakeups, checkpoint).awaitTermination()
    assert sorted((r.id, r.state) for r in outbox.read().collect()) == [(1, "pending"), (2, "pending"), (3, "posted"), (4, "retry")]
    assert sorted((r.batch, r.pending) for r in wakeups.read().collect()) == [(0, 2), (2, 1)]
