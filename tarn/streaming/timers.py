"""Keyed timers on streams: paths that have been quiet for a while, reminders by event time, wake-ups on commit.

These need the RocksDB state store (spark.sql.streaming.stateStore.providerClass); state and timers are in the query's
checkpoint, so a restart keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import StateTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Quiet(StatefulProcessor):
    """The last state of a path, and one timer, which every change of it sets anew."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "size long, modified timestamp, due long")
        self.told = handle.getValueState("told", "size long, modified timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(rows)
        last = seen.sort_values(["modified", "size"]).iloc[-1]
        now = int(last["size"]), last["modified"].to_pydatetime()
        before = self.pending.get()[:2] if self.pending.exists() else self.told.get() if self.told.exists() else None
        if before is not None and (before[0], pd.Timestamp(before[1])) == (now[0], pd.Timestamp(now[1])):
            return iter(())  # the same look at the same file
        if self.pending.exists():
            self.handle.deleteTimer(self.pending.get()[2])
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        self.handle.registerTimer(due)
        self.pending.update((*now, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, modified, _ = self.pending.get()
        self.pending.clear()
        self.told.update((size, modified))
        yield pd.DataFrame({"path": [key[0]], "size": [size], "modified": [modified]})

    def close(self) -> None:
        pass


def quiet_paths(sightings: DataFrame, quiet: timedelta) -> DataFrame:
    """(path, size, modified) of each path once it has not changed for `quiet`: a stream of (path, size, modified) looks.

    Every change starts the wait again, so two writes inside it give one row; a path is told again only after another
    change. A look that shows nothing new does nothing.
    """
    rows = sightings.select("path", F.col("size").cast("long").alias("size"), F.col("modified").cast("timestamp").alias("modified"))
    wait = max(1, int(quiet.total_seconds() * 1000))
    return rows.groupBy("path").transformWithStateInPandas(_Quiet(wait), "path string, size long, modified timestamp", "Append", "ProcessingTime")


class _Reminder(StatefulProcessor):
    """The newest version of a ticket, when it was first assigned, and a timer for that; a newer version's replaces it."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "version long, due long, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(rows)
        version = int(seen["version"].max())
        first = seen.loc[seen["version"] == version, "at"].min()
        due = int(first.timestamp() * 1000) + self.wait_ms
        if self.waiting.exists():
            old, was_due, fired = self.waiting.get()
            if version < old or (version == old and (due >= was_due or fired)):
                return iter(())
            if not fired:
                self.handle.deleteTimer(was_due)
        self.handle.registerTimer(due)
        self.waiting.update((version, due, False))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, due, _ = self.waiting.get()
        self.waiting.update((version, due, True))
        yield pd.DataFrame({"ticket_id": [key[0]], "version": [version], "due_at": [pd.Timestamp(due, unit="ms", tz="UTC")]})

    def close(self) -> None:
        pass


def reminders(assignments: DataFrame, delay: timedelta = timedelta(minutes=2), late: str = "0 seconds") -> DataFrame:
    """(ticket_id, version, due_at) once the watermark has passed a ticket's first assignment by `delay`.

    The stream is (ticket_id, version, at). A newer version cancels the timer of an older one that has not fired; one
    that comes after it has fired is reminded of in its turn. This is operations.reminder_jobs() as time goes by.
    """
    kind = dict(assignments.dtypes)["ticket_id"]
    rows = assignments.select("ticket_id", F.col("version").cast("long").alias("version"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    wait = int(delay.total_seconds() * 1000)
    return rows.groupBy("ticket_id").transformWithStateInPandas(_Reminder(wait), f"ticket_id {kind}, version long, due_at timestamp", "Append", "EventTime")


def committed(stream: DataFrame, outbox: StateTable, wakeups: StateTable, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to the outbox; a batch that leaves something to send is followed by one wake-up row.

    The wake-up (batch long, pending long) is written after the outbox, so whoever it wakes finds the rows; a batch that
    runs again writes both again under its own number, and nobody is woken twice. An empty batch wakes nobody.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        before = outbox.read(before=epoch)
        fresh = batch.select(*before.columns).join(before.select("id"), "id", "left_anti").dropDuplicates(["id"])
        outbox.write(before.unionByName(fresh), epoch)
        told = wakeups.read(before=epoch)
        new = fresh.where(F.col("state").isin("pending", "retry")).agg(F.count("*").alias("pending")).where("pending > 0")
        wakeups.write(told.unionByName(new.select(F.lit(epoch).cast("long").alias("batch"), "pending")), epoch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
