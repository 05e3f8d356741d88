"""Suffix-array dedup: byte strings that stand twice anywhere in the corpus, by the suffix arrays of shards."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .suffixes import Scratch, ordered, suffix_array, wanted_only
from .windows import byte_window_hashes, chosen, mixed, slide

EMPTY = hashlib.sha256(b"").hexdigest()
ANCHOR = 64  # bytes
MOST_STARTS = 4096  # strings in a snippet
IN_MEMORY = 4  # up to so many times `most_bytes`, pieces are sorted in memory


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def anchored(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, anchors, met): each string's anchor among the window hashes, the different ones, at how many places each is."""
    least = slide(h, width, np.minimum)
    return least, *np.unique(h[chosen(h, width, least)], return_counts=True)


class _Anchored:
    """All strings of `size` bytes of `data`, as runs of starts (a, b) that share an anchor at every given level.

    A string's anchor is the smallest hash of its 64-byte windows, so equal strings have equal anchors; each level
    hashes the windows anew. `of` names each run's anchors; only runs whose anchors the text has twice (`own`) can hold the same string twice themselves.
    """

    def __init__(self, data: bytes, size: int, levels: tuple[int, ...] = (0,), known: np.ndarray | None = None):
        """With `known`, strings whose anchor of the first level is not among these are left out."""
        windows = byte_window_hashes(data, ANCHOR)
        width = size - ANCHOR + 1
        key, own, change, alive = np.uint64(0), True, False, None
        for level in levels:
            h = mixed(windows + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) if level else windows
            least, anchors, met = anchored(h, width)
            if alive is None:
                alive = np.ones(len(least), bool) if known is None else np.isin(least, known.view(np.uint64))
            change = change | (np.diff(least) != 0)
            key = least if len(levels) == 1 else mixed(key + least)
            twice = anchors[met > 1]
            own = own & np.isin(least, twice) if len(twice) else np.zeros(len(least), bool)
        a = np.concatenate(([0], np.flatnonzero(change) + 1))
        b = np.append(a[1:], len(least))
        if (long := np.flatnonzero(b - a > MOST_STARTS)).size:
            a = np.unique(np.concatenate([a, *(np.arange(a[i], b[i], MOST_STARTS) for i in long)]))
            b = np.append(a[1:], len(least))
        here = alive[a]
        self.a, self.b = a[here], b[here]
        self.of, self.own = key[self.a].view(np.int64), own[self.a]


class _Shard:
    """The pieces of one shard as they come in: bytes to a file, places and keys in memory (a sixteenth of the bytes)."""

    def __init__(self, folder: str):
        self.file = tempfile.TemporaryFile(dir=folder)
        self.sizes, self.rows, self.bytes = [], [], 0

    def add(self, piece: bytes, row: tuple) -> None:
        self.file.write(piece + b"\0")
        self.sizes.append(len(piece))
        self.rows.append(row)
        self.bytes += len(piece) + 1

    def symbols(self, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' bytes plus one, 0 behind each piece, and where the pieces end."""
        sizes = np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes + 1) - 1
        t = scratch.array(int(ends[-1]) + 1, np.int16)
        self.file.seek(0)
        for a, b in scratch.steps(len(t)):
            t[a:b] = np.frombuffer(self.file.read(b - a), np.uint8).astype(np.int16) + 1
        self.file.close()
        for a, b in scratch.steps(len(ends)):
            t[ends[a:b]] = 0
        return t, ends

    def repeats(self, size: int, batch: int, most_bytes: int, folder: str) -> Iterator[tuple[tuple, list[int]]]:
        """Of each piece, the runs of starts (from, to, from, to, ...) of strings that the shard has twice."""
        many = np.array([r[-1] for r in self.rows], np.int64)  # strings that start in each piece
        if self.bytes <= IN_MEMORY * most_bytes:
            twice, starts = self._twice(size, many)
        else:
            twice, starts = self._twice_on_disk(size, many, Scratch(folder, batch, most_bytes))
        for row, a, n in zip(self.rows, starts.tolist(), many.tolist()):
            found = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(twice[a : a + n]).astype(np.int8), [0]))))
            if len(found):
                yield row, found.tolist()

    def _twice(self, size: int, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places start a string that the shard has twice, and where the pieces start."""
        sizes = np.array(self.sizes, np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        self.file.seek(0)
        data = self.file.read()
        self.file.close()
        steps = np.zeros(len(data) + 1, np.int8)
        steps[starts] = 1
        steps[starts + many] -= 1
        pos, same = ordered(data, np.cumsum(steps[:-1]) > 0, size)
        twice = np.zeros(len(data), bool)
        twice[pos[same]] = True
        twice[pos[:-1][same[1:]]] = True
        return twice, starts

    def _twice_on_disk(self, size: int, many: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
        """_twice() of a shard of any size, by external induced sorting."""
        t, ends = self.symbols(scratch)
        starts = np.concatenate(([0], ends[:-1] + 1))
        order, prefixes = suffix_array(t, size, scratch.batch, scratch.most_bytes, scratch.folder)

        def is_start(pos):
            piece = np.searchsorted(ends, pos)
            return pos - starts[piece] < many[piece]

        twice, before = scratch.array(len(t), bool), None
        for pos, shared in wanted_only(order, prefixes, is_start, scratch):
            same = shared >= size
            twice[pos[same]] = True
            twice[pos[:-1][same[1:]]] = True
            if same[0] and before is not None:
                twice[before] = True
            before = int(pos[-1])
        return twice, starts


def _sorted_shards(size: int, batch: int, most_bytes: int):
    """mapInArrow over rows in order of shard: (anchor, digest, runs) of the pieces that hold a repeated string."""
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def finished(shard: _Shard, folder: str):
        out = [(r[0], r[1], [x + r[2] for x in found]) for r, found in shard.repeats(size, batch, most_bytes, folder)]
        return pa.RecordBatch.from_pydict({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, schema=schema)

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:  # the task's own scratch, nothing others read
            now, shard = None, None
            for rows in batches:
                for number, anchor, digest, at, n, piece in zip(*(rows.column(c).to_pylist() for c in ("shard", "anchor", "digest", "from", "n", "piece"))):
                    # equal strings have equal anchors, so a shard may be sorted in parts between two anchors
                    if shard is None or number != now[0] or anchor != now[1] and shard.bytes >= most_bytes // 2:
                        if shard:
                            yield finished(shard, folder)
                        shard = _Shard(folder)
                    now = number, anchor
                    shard.add(piece, (anchor, digest, at, n))
            if shard:
                yield finished(shard, folder)

    return run


def _finer(size: int, level: int):
    """mapInArrow: pieces of crowded anchors cut again, at the anchors of another level; a key is the way there."""

    def run(batches):
        for rows in batches:
            out = {f.name: [] for f in PIECES}
            for key, anchor, digest, at, piece in zip(*(rows.column(c).to_pylist() for c in ("key", "anchor", "digest", "from", "piece"))):
                x = _Anchored(piece, size, (level,))
                keys = mixed(x.of.view(np.uint64) + np.int64(key).view(np.uint64)).view(np.int64)
                for a, b, k, own in zip(x.a.tolist(), x.b.tolist(), keys.tolist(), x.own.tolist()):
                    for name, value in zip(out, (k, anchor, digest, at + a, b - a, own, piece[a : b - 1 + size])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=PIECES)

    return run


PIECES = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("from", pa.int32()), ("n", pa.int32()), ("own", pa.bool_()), ("piece", pa.binary())])
PIECES_DDL = "key long, anchor long, digest long, from int, n int, own boolean, piece binary"


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, shard_bytes: int = 2 << 20, most_alike: int = 1 << 12, levels: int = 8, batch: int = 1 << 17, most_bytes: int = 1 << 19) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, without bytes of strings that stand twice.

    1. Copies of a whole text lose all of it if `size` bytes long; one of them stands for the rest from here on.
    2. Every string of `size` bytes has an anchor (see _Anchored). Strings whose anchor is met once in the corpus go.
       Those left get a second one, by another hash, and are known by both from here on.
    3. Neighbouring strings with the same anchors make a snippet; equal snippets are counted by digest and what is in
       two places is repeated. Only anchors with different snippets are left: one copy of each snippet goes to its
       anchors' shard, whose suffix array and common prefixes name the repeated strings. A shard is sorted in parts of
       whole anchors, of half `most_bytes` and more: by prefix doubling in memory up to 4 times `most_bytes`, beyond by
       external induced sorting, which takes some thirty times the bytes in tuples and arrays, on disk beyond
       `most_bytes` each; so what one anchor has can be as large as the disk holds.
    4. The snippets of an anchor with over `most_alike` of them are first cut again at the anchors of another hash,
       level by level, which tells the strings of one common passage apart by what surrounds it; what is alone then
       goes. After `levels` what is still crowded is sorted as one shard.

    Null texts are empty. Very long texts and long runs of one byte are cut into snippets like any other. Repeated rows
    are copies, as any equal texts. A row without an id takes no part: it loses nothing and removes nothing. Two texts
    under one id are two documents. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def summary(batches):
        for batch_ in batches:
            out = {"doc_id": batch_.column(0), "n_bytes": [], "sha": [], "anchors": []}
            for text in batch_.column(1).to_pylist():
                data = _bytes(text)
                out["n_bytes"].append(len(data))
                out["sha"].append(hashlib.sha256(data).hexdigest())
                anchors = None
                if len(data) >= size:
                    _, found, met = anchored(byte_window_hashes(data, ANCHOR), size - ANCHOR + 1)
                    anchors = np.repeat(found.view(np.int64), np.minimum(met, 2))
                out["anchors"].append(anchors)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))]))

    all_docs = stored(rows.mapInArrow(summary, "doc_id long, n_bytes long, sha string, anchors array<long>"), "summaries")
    long_enough = all_docs.where(F.col("anchors").isNotNull() & F.col("doc_id").isNotNull())
    firsts = stored(long_enough.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "firsts")
    # joined by the id as well, so copies by the thousand are no single key
    ours = long_enough.join(firsts.select("sha", F.col("first").alias("doc_id")), ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"])
    anchors = stored(ours.select("doc_id", "sha", F.explode("anchors").alias("anchor")), "anchors")
    often = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    candidates = anchors.join(often, "anchor").groupBy("doc_id", "sha").agg(F.collect_set("anchor").alias("anchors"))
    texts = stored(rows.join(candidates, "doc_id"), "candidates")

    def own(doc_id, text, sha):
        """The bytes of a text, unless it is another one under the same id."""
        data = _bytes(text)
        return data if hashlib.sha256(data).hexdigest() == sha else None

    def snippets(batches):
        for batch_ in batches:
            parts = []
            for doc_id, text, sha, kept in zip(*(batch_.column(i).to_pylist() for i in range(3)), batch_.column(3)):
                if (data := own(doc_id, text, sha)) is None:
                    continue
                x = _Anchored(data, size, (0, 1), kept.values.to_numpy())
                a, b, h, twice = x.a, x.b, x.of, x.own
                digests = [xxhash.xxh3_64_intdigest(data[x : y - 1 + size]) for x, y in zip(a.tolist(), b.tolist())]
                n = len(a)
                parts.append((h, np.array(digests, np.uint64).view(np.int64), np.full(n, doc_id, np.int64), np.full(n, int(sha[:15], 16), np.int64), a.astype(np.int32), (b - a).astype(np.int32), twice))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["anchor", "digest", "doc_id", "key", "start", "n", "own"])

    places = texts.select("doc_id", "text", "sha", "anchors").mapInArrow(snippets, "anchor long, digest long, doc_id long, key long, start int, n int, own boolean")
    places = stored(places.dropDuplicates(["doc_id", "key", "start"]), "places")
    distinct = places.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "start", "n", "own")).alias("at"))
    distinct = stored(distinct.select("anchor", "digest", "copies", "at.*"), "snippets")
    alike = distinct.groupBy("anchor").agg(F.count("*").alias("alike"), F.min("copies").alias("fewest"), F.bool_or(F.col("own") & (F.col("copies") == 1)).alias("inner"))
    alike = stored(alike.where("alike > 1 and fewest = 1 or inner").select("anchor", "alike"), "alike")
    mixed_ = distinct.join(alike, "anchor")
    wanted = mixed_.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "digest", "start", "n", "own", "alike")).alias("wanted"))

    def pieces(batches):
        names = ("anchor", "digest", "n", "own", "alike", "piece")
        types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())

        def gathered(parts, out):
            columns = [np.concatenate(x) for x in zip(*parts)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns, types), pa.array(out, pa.binary())], list(names))

        for batch_ in batches:
            parts, out, size_ = [], [], 0
            offsets, fields = batch_.column(4).offsets.to_numpy(), batch_.column(4).values
            cols = [fields.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "digest", "n", "own", "alike", "start")]
            for i, (doc_id, text, sha, key) in enumerate(zip(*(batch_.column(i).to_pylist() for i in range(4)))):
                if int(sha[:15], 16) != key or (data := own(doc_id, text, sha)) is None:
                    continue
                *kept, start = (c[offsets[i] : offsets[i + 1]] for c in cols)
                parts.append(kept)
                out += [data[x : x + n - 1 + size] for x, n in zip(start.tolist(), kept[2].tolist())]
                size_ += int(kept[2].sum()) + size * len(start)
                if size_ > 1 << 23:
                    yield gathered(parts, out)
                    parts, out, size_ = [], [], 0
            if parts:
                yield gathered(parts, out)

    fetched = texts.join(wanted, "doc_id").select("doc_id", "text", "sha", "key", "wanted")
    fetched = stored(fetched.mapInArrow(pieces, "anchor long, digest long, n int, own boolean, alike long, piece binary"), "pieces")
    now = fetched.select(F.col("anchor").alias("key"), "anchor", "digest", F.lit(0).alias("from"), "n", "own", "piece", "alike")
    ready, crowded = [], F.col("alike") > most_alike
    for level in range(2, levels + 2):
        if now.where(crowded).isEmpty():
            break
        ready.append(now.where(~crowded))
        finer = stored(now.where(crowded).select("key", "anchor", "digest", "from", "piece").mapInArrow(_finer(size, level), PIECES_DDL), f"finer-{level}")
        met = stored(finer.groupBy("key").agg(F.count("*").alias("alike"), F.bool_or("own").alias("inner")).where("alike > 1 or inner").drop("inner"), f"alike-{level}")
        now = finer.join(met, "key")
    ready = [x.select("key", "anchor", "digest", "from", "n", "piece") for x in (*ready, now)]
    pieces_ = ready[0]
    for x in ready[1:]:
        pieces_ = pieces_.unionByName(x)
    total = pieces_.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = pieces_.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).drop("key")
    dealt = dealt.repartition(int(min(shards, 1 << 16)), "shard").sortWithinPartitions("shard", "anchor", "digest", "from")
    found = dealt.mapInArrow(_sorted_shards(size, batch, most_bytes), "anchor long, digest long, runs array<int>")
    sorted_ = found.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    whole = distinct.where("copies > 1").select("anchor", "digest", F.array(F.lit(0), F.col("n")).alias("runs"))
    single = distinct.where("copies = 1").select("anchor", "digest")
    runs = whole.unionByName(sorted_.join(single, ["anchor", "digest"], "left_semi"))
    spans = places.join(runs, ["anchor", "digest"]).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "runs")).alias("spans"))

    def keep(batches):
        for batch_ in batches:
            out = {"doc_id": [], "sha": [], "n_removed": [], "n_spans": [], "kept": []}
            offsets, fields = batch_.column(4).offsets.to_numpy(), batch_.column(4).values
            starts, runs = fields.field("start").to_numpy(), fields.field("runs")
            cuts, ends = runs.offsets.to_numpy(), runs.values.to_numpy()
            for i, (doc_id, text, sha, key) in enumerate(zip(*(batch_.column(i).to_pylist() for i in range(4)))):
                if int(sha[:15], 16) != key or (data := own(doc_id, text, sha)) is None:
                    continue
                mine = cuts[offsets[i] : offsets[i + 1] + 1]
                begin = np.repeat(starts[offsets[i] : offsets[i + 1]].astype(np.int64), np.diff(mine) // 2)
                pairs = ends[mine[0] : mine[-1]].reshape(-1, 2) + begin[:, None]
                steps = np.zeros(len(data) + 1, np.int64)
                np.add.at(steps, pairs[:, 0], 1)
                np.add.at(steps, pairs[:, 1] - 1 + size, -1)
                gone = np.cumsum(steps[:-1]) > 0
                out["doc_id"].append(doc_id)
                out["sha"].append(sha)
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum()))
                out["kept"].append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())]))

    cut = texts.join(spans, "doc_id").select("doc_id", "text", "sha", "key", "spans")
    cut = cut.mapInArrow(keep, "doc_id long, sha string, n_removed long, n_spans long, kept string")
    cut = cut.groupBy("doc_id", "sha").agg(*(F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept")))
    copies = firsts.where("copies > 1").select("sha", "copies")
    out = all_docs.select("doc_id", "n_bytes", "sha").join(copies, "sha", "left").join(cut, ["doc_id", "sha"], "left")
    copy = F.col("copies").isNotNull() & F.col("doc_id").isNotNull()
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).when(F.col("doc_id").isNull(), zero).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).when(F.col("doc_id").isNull(), F.col("sha")).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
