"""Paragraph-aware chunks of long texts, transcript groups, and the units made of them."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import identity, scalar

CHARS_AT_ONCE = 1 << 20


def _packed(paragraphs: list[str], most: int, overlap: int) -> Iterator[str]:
    """As many paragraphs a chunk as fit; every chunk after the first opens with the end of the one before it."""
    ends = list(accumulate(len(p) + 2 for p in paragraphs))
    first, opening = 0, ""
    while first < len(paragraphs):
        done = ends[first - 1] if first else 0
        past = max(first + 1, bisect_right(ends, done + most + 2 - len(opening)))
        chunk = opening + "\n\n".join(paragraphs[first:past])
        yield chunk
        tail = chunk[-overlap:].strip() if overlap else ""
        first, opening = past, tail and f"{tail}\n\n"


def _windows(paragraph: str, most: int, overlap: int) -> Iterator[str]:
    """Overlapping stretches of one long paragraph, each up to the last blank in its second half if it has one there."""
    least = most // 2 + 1
    at_blank = f".{{{least},{most - 1}}}(?= )|" if least < most else ""
    stretch = re.compile(f"(?s){at_blank}.{{{most}}}")
    at = 0
    while at + most < len(paragraph):
        stop = stretch.match(paragraph, at).end()
        yield paragraph[at:stop].strip()
        at = max(stop - overlap, at + 1)
    yield paragraph[at:].strip()


def chunks_of(text: str | None, most: int = 2400, overlap: int = 220) -> list[str]:
    """Paragraphs (between blank lines) in chunks of about `most` characters.

    Runs of shorter paragraphs are packed, longer ones are cut by themselves. With the end of its predecessor in front
    a chunk may reach most + overlap + 2.
    """
    lines = (line.rstrip() for line in (text or "").replace("\r\n", "\n").splitlines())
    paragraphs = [p for p in (part.strip() for part in "\n".join(lines).strip().split("\n\n")) if p]
    chunks: list[str] = []
    for long, run in groupby(paragraphs, lambda p: len(p) > most):
        chunks += (c for p in run for c in _windows(p, most, overlap)) if long else _packed(list(run), most, overlap)
    return [c for c in chunks if c]


def pieces(records: DataFrame, most: int = 2400, overlap: int = 220) -> DataFrame:
    """A row a chunk of `records`: their columns, chunk_index and, in content's place at the end, the chunk.

    The packing carries state from paragraph to paragraph, which expressions cannot.
    """
    others = [c for c in records.columns if c != "content"]
    fields = [*(records.schema[c] for c in others), T.StructField("chunk_index", T.IntegerType()), T.StructField("content", T.StringType())]
    return records.select(*others, "content").mapInArrow(lambda b: chunked(b, most, overlap), T.StructType(fields))


def chunked(batches, most: int, overlap: int, at_once: int = CHARS_AT_ONCE):
    """pieces(), from batches whose last column is content.

    However many texts a batch has, one is taken out of it at a time, and chunks go on once they have `at_once` characters.
    """
    for b in batches:
        names = [*b.schema.names[:-1], "chunk_index", "content"]
        texts = b.column(b.num_columns - 1)
        rows, numbers, out, size = [], [], [], 0

        def made():
            columns = [c.take(pa.array(rows, pa.int32())) for c in b.columns[:-1]]
            return pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32()), pa.array(out, pa.string())], names)

        for i in range(len(texts)):
            for n, chunk in enumerate(chunks_of(texts[i].as_py(), most, overlap)):
                rows.append(i)
                numbers.append(n)
                out.append(chunk)
                size += len(chunk)
                if size >= at_once:
                    yield made()
                    rows, numbers, out, size = [], [], [], 0
        if rows:
            yield made()


def make_units(records: DataFrame, source_type: Column, most: int = 2400, overlap: int = 220) -> DataFrame:
    """A row a chunk of `records` (record_id, version_id, title, content, other columns), with key, id and hashes."""
    extra = [c for c in records.columns if c not in ("record_id", "version_id", "title", "content")]
    rows = pieces(records.select("record_id", "version_id", "title", *extra, "content"), most, overlap).withColumn("source_type", source_type)
    rows = rows.withColumn("stable_key", identity.stable_key(F.col("source_type"), F.col("record_id"), F.col("version_id"), F.col("chunk_index")))
    hashed = {c: F.col(c) for c in sorted({"title", "content", "source_type", *extra})}
    return rows.withColumns({"unit_id": identity.unit_id(F.col("stable_key")), "content_hash": identity.content_hash(F.col("content")), "index_hash": identity.json_hash(**hashed)})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _group_numbers(sizes: pd.Series, most: pd.Series) -> pd.Series:
    """For each array of line lengths the group of each line: a group ends before the line that would overfill it."""

    def numbers(lengths, limit):
        out, held = [], None
        for n in lengths:
            if held is None or held + 1 + n > limit:
                out.append(out[-1] + 1 if out else 0)
                held = n
            else:
                out.append(out[-1])
                held += 1 + n
        return out

    return pd.Series([numbers(s, m) for s, m in zip(sizes, most)], dtype=object)


def transcript_groups(segments: DataFrame, most: int = 2400) -> DataFrame:
    """(artifact_id, group, start_ms, end_ms, content): segments of a transcript in order of seq, joined up to `most` characters.

    `segments` is (artifact_id, seq, start_ms, end_ms, speaker, text). A line has its time and speaker where they are
    known; blank lines stay. A group begins with its first known start and ends with its last line's end, or start where
    that has none. Where a group ends follows from the lengths of
    the lines alone, so these are all that is folded, an artifact at a time.
    """
    mark = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit("["), scalar.clock(F.col("start_ms")), F.lit("] "))).otherwise("")
    said = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.col("speaker"), F.lit(": "))).otherwise("")
    line = F.concat(mark, said, F.coalesce("text", F.lit("")))
    item = F.struct("seq", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), line.alias("line"))
    ordered = segments.groupBy("artifact_id").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    sizes = F.transform("lines", lambda x: F.length(x["line"]))
    zipped = ordered.withColumn("g", _group_numbers(sizes, F.lit(most)))
    each = zipped.select("artifact_id", F.posexplode(F.arrays_zip("g", "lines")).alias("n", "z")).select("artifact_id", "n", F.col("z.g").alias("group"), "z.lines.*")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    start = F.min_by("start_ms", F.when(F.col("start_ms").isNotNull(), F.col("n")))
    end = F.max_by(F.coalesce(F.nullif("end_ms", F.lit(0)), "start_ms"), "n")
    return each.groupBy("artifact_id", "group").agg(start.alias("start_ms"), end.alias("end_ms"), content.alias("content"))


def index_diff(old: DataFrame, new: DataFrame, scope: Column | None = None) -> DataFrame:
    """(stable_key, change): created, updated, unchanged or retired, by index hash; keys outside `scope` never retire.

    `old` is the stored index (stable_key, index_hash, is_current, ...), `new` the rebuilt one.
    """
    before = old.where(scope) if scope is not None else old
    before = before.select("stable_key", F.col("index_hash").alias("_old"), F.col("is_current").alias("_current"))
    both = before.join(new.select("stable_key", F.col("index_hash").alias("_new")), "stable_key", "full")
    change = (
        F.when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), F.when(F.col("_current"), "retired"))
        .when((F.col("_old") != F.col("_new")) | ~F.col("_current"), "updated")
        .otherwise("unchanged")
    )
    return both.select("stable_key", change.alias("change")).where("change is not null")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
