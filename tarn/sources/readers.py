"""Paged chat and mail exports as Spark data sources; pages are recorded files, nothing is fetched or posted."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition


class RateLimited(Exception):
    """The other side asks to wait."""


def with_retry(call, tries: int = 4, first_wait: float = 1.0, sleep=time.sleep, jitter=random.random):
    """call(), again after growing waits while it is rate-limited."""
    for i in range(tries):
        try:
            return call()
        except RateLimited:
            if i == tries - 1:
                raise
            sleep(first_wait * 2**i + jitter())


def pages(fetch, most_pages: int | None = None) -> Iterator[dict]:
    """Follows cursors from fetch(cursor) -> page; more than `most_pages` is an error, so no mark is moved past a gap."""
    cursor, n = None, 0
    while True:
        page = with_retry(lambda: fetch(cursor))
        n += 1
        if most_pages is not None and n > most_pages:
            raise RuntimeError(f"more than {most_pages} pages")
        yield page
        cursor = (page.get("response_metadata") or {}).get("next_cursor") or page.get("next_cursor")
        if not cursor:
            return


class _Part(InputPartition):
    def __init__(self, entity: str):
        self.entity = entity


class _PagedReader(DataSourceReader):
    """A partition an entity (channel or mailbox). `>=` on the time and `=` on the sender are handed to the export; both
    are applied again to what comes back."""

    def __init__(self, options: dict, fields: list[str]):
        self.path, self.entities, self.fields = options["path"], options["entities"].split(","), fields
        self.most = int(options["most_pages"]) if "most_pages" in options else None
        self.since, self.sender, self.after = None, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute[0] == "ts":
                self.since = f.value
            elif isinstance(f, GreaterThan) and f.attribute[0] == "ts":
                self.after = f.value
            elif isinstance(f, EqualTo) and f.attribute[0] == "sender":
                self.sender = f.value
            yield f  # kept above the scan as well

    def partitions(self):
        return [_Part(e) for e in self.entities]

    def read(self, partition):
        def fetch(cursor):
            with open(f"{self.path}/{partition.entity}/{cursor or 'first'}.json", encoding="utf-8") as f:
                page = json.load(f)
            if page.get("error") == "ratelimited":
                raise RateLimited
            return page

        for page in pages(fetch, self.most):
            for m in page.get("messages", ()):
                row = {"entity": partition.entity, "ts": m.get("ts"), "sender": m.get("user") or m.get("sender"), "text": m.get("text"), "raw": json.dumps(m, sort_keys=True)}
                if (self.since is None or (row["ts"] or "") >= self.since) and (self.after is None or (row["ts"] or "") > self.after) and (self.sender is None or row["sender"] == self.sender):
                    yield tuple(row[k] for k in self.fields)


class RecordedPages(DataSource):
    """spark.read.format("recorded_pages").option("entities", "C1,C2").load(folder): messages of recorded pages.

    The folder must be open to the executors as files (a mounted share). Filters are handed down where
    spark.sql.python.filterPushdown.enabled is true, which Spark asks for of every Python source that takes them.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "entity string, ts string, sender string, text string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options, [f.name for f in schema.fields])
