"""Listing of folder trees as a data source: files, what was left out, errors, and whether the listing is complete.

The folders must be mounted where the executors run. Each directory under a root is a partition, so a large tree is
walked by many tasks; contents are never read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names that are never listed.
HIDDEN = (".*", "~$*", "thumbs.db", "desktop.ini")
SCHEMA = "root string, kind string, relative string, norm_path string, area string, name string, size long, modified timestamp, error_type string, message string"


def normal(path: str) -> str:
    """Lower case, forward slashes, none at the ends."""
    return path.replace("\\", "/").strip("/").casefold()


class Part(InputPartition):
    def __init__(self, root: str, relative: str, deep: bool, error: OSError | None = None):
        self.root, self.relative, self.deep = root, relative, deep
        self.error = error and (type(error).__name__, str(error))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        several = lambda name: tuple(normal(x) for x in options.get(name, "").split("\n") if x.strip())
        self.roots = [r for r in options.get("path", "").split("\n") if r]
        self.directories, self.globs, self.includes = several("excludedDirectories"), several("excludedGlobs"), several("includes")
        self.area = normal(options["area"]) if options.get("area") else None

    def partitions(self) -> list[Part]:
        """For each root its own files, and one partition for each directory in it."""
        parts = []
        for root in self.roots:
            try:
                with os.scandir(root) as entries:
                    names = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
            except OSError as error:
                parts.append(Part(root, "", False, error))
                continue
            parts.append(Part(root, "", False))
            parts += [Part(root, n, True) for n in names if self.area in (None, normal(n))]
        return parts

    def left_out(self, relative: str, directory: bool) -> bool:
        name, path = os.path.basename(relative).casefold(), normal(relative)
        if any(fnmatch(name, p) for p in HIDDEN):
            return True
        if directory:
            return name in self.directories or any(path == d or path.startswith(f"{d}/") for d in self.directories)
        return any(fnmatch(name, g) or fnmatch(path, g) for g in self.globs)

    def wanted(self, path: str) -> bool:
        return not self.includes or any(fnmatch(path, g) or path.startswith(g.rstrip("*")) for g in self.includes)

    def read(self, part: Part) -> Iterator[tuple]:
        def row(kind, relative, size=None, modified=None, error=(None, None)):
            path = normal(relative)
            return part.root, kind, relative, path, path.split("/")[0] if "/" in path else None, os.path.basename(path), size, modified, *error

        if part.error:
            yield row("error", part.relative, error=part.error)
            return
        waiting = [part.relative]
        while waiting:
            at = waiting.pop()
            if at and self.left_out(at, True):
                yield row("excluded", at)
                continue
            try:
                with os.scandir(os.path.join(part.root, at)) as entries:
                    found = sorted(entries, key=lambda e: e.name.casefold())
            except OSError as error:
                yield row("error", at, error=(type(error).__name__, str(error)))
                continue
            for entry in found:
                relative = f"{at}/{entry.name}".strip("/")
                if entry.is_dir(follow_symlinks=False):
                    if part.deep:
                        waiting.append(relative)
                elif self.area and not at:
                    continue  # a root's own files are in no area
                elif self.left_out(relative, False):
                    yield row("excluded", relative)
                elif self.wanted(normal(relative)):
                    try:
                        stat = entry.stat()
                    except OSError as error:
                        yield row("error", relative, error=(type(error).__name__, str(error)))
                    else:
                        yield row("file", relative, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc))


class ListingSource(DataSource):
    """format "listing": options path, excludedDirectories, excludedGlobs, includes (one a line) and area."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader({k: self.options[k] for k in ("path", "excludedDirectories", "excludedGlobs", "includes", "area") if k in self.options})


def listing(spark: SparkSession, *roots: str, excluded_directories: tuple[str, ...] = (), excluded_globs: tuple[str, ...] = (), includes: tuple[str, ...] = (), area: str | None = None) -> DataFrame:
    """SCHEMA rows of kind file, excluded or error for everything under the roots.

    Patterns are those of fnmatch ([..] too), on names and on paths, case aside; an include without a pattern is a
    prefix. A directory that cannot be read, or a file that cannot be looked at, is an error row and stops nothing.
    """
    spark.dataSource.register(ListingSource)
    read = spark.read.format("listing").option("path", "\n".join(roots))
    for name, values in (("excludedDirectories", excluded_directories), ("excludedGlobs", excluded_globs), ("includes", includes)):
        read = read.option(name, "\n".join(values))
    return (read.option("area", area) if area else read).load()


def summary(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(root, files, excluded, errors, complete): a root is complete if nothing failed and no limit cut it short."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    out = rows.groupBy("root").agg(count("file").alias("files"), count("excluded").alias("excluded"), count("error").alias("errors"))
    whole = F.col("errors") == 0
    return out.withColumn("complete", whole if limit is None else whole & (F.col("files") < limit))
