"""A Merkle manifest of a dataset: one tree a group, one tree over the groups' roots, a proof for every row.

Rows are range-sorted by group and key and numbered by partition; counts by (group, partition) give each partition's
offset in its group. A task folds the aligned subtrees that lie whole in its partition, at most 3^LOCAL leaves each; the
ragged nodes left at its borders meet by coordinate, a block of 3^BLOCK a time, until one node a group remains. Paths
come down the same way, so a row's proof is its own subtree's siblings followed by the path of that subtree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import ranged, records, stored

ARITY = 3
LOCAL = 9  # levels of a subtree folded in one go: 19,683 leaves are in memory at most
BLOCK = 6  # levels a round of the upper tree
PATH = "array<struct<before: string, after: string>>"


def leaf(*columns: Column) -> Column:
    """The hash of a row's values: each is '-' if null, else its count of UTF-8 bytes, a colon and itself as text."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), "")


def digest(kids: list[str]) -> str:
    return sha256("".join(kids).encode()).hexdigest()


def count(n: int, level: int) -> int:
    """How many nodes a group of n leaves has at a level."""
    return -(-n // ARITY**level)


def depth(n: int) -> int:
    level = 0
    while count(n, level) > 1:
        level += 1
    return level


def climbed(nodes: Iterator[tuple[int, int, str]], n: int, top: int) -> Iterator[tuple[int, int, str]]:
    """The nodes left when all whole runs of `nodes` (level, index, hash; adjoining, in order) are folded up to level `top`."""
    waiting: list[list[tuple[int, str]]] = [[] for _ in range(top + 1)]
    ragged = []
    for level, i, h in nodes:
        while True:
            if level >= top:
                ragged.append((level, i, h))
                break
            run = waiting[level]
            run.append((i, h))
            if i % ARITY < ARITY - 1 and i < count(n, level) - 1:
                break
            waiting[level] = []
            if run[0][0] % ARITY:  # the run's first ones are another task's
                ragged += [(level, *x) for x in run]
                break
            level, i, h = level + 1, i // ARITY, digest([x for _, x in run])
    yield from ragged
    yield from ((level, *x) for level, run in enumerate(waiting) for x in run)


def paths(nodes: list[tuple[int, int, str]], n: int, top: tuple[int, int], rest: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The path of each of `nodes`, all that lie under the node `top` (level, index), whose own path is `rest`."""
    at: dict[tuple[int, int], str] = {(level, i): h for level, i, h in nodes}
    steps: dict[tuple[int, int], tuple[str, str]] = {}
    by_level: list[list[int]] = [[] for _ in range(top[0] + 1)]
    for level, i, _ in nodes:
        by_level[level].append(i)
    for level in range(top[0]):
        for p in sorted({i // ARITY for i in by_level[level]}):
            kids = [at[level, i] for i in range(ARITY * p, min(ARITY * p + ARITY, count(n, level)))]
            for k in range(len(kids)):
                steps[level, ARITY * p + k] = "".join(kids[:k]), "".join(kids[k + 1 :])
            at[level + 1, p] = digest(kids)
            by_level[level + 1].append(p)
    known = {top: rest}

    def path(node: tuple[int, int]) -> list[tuple[str, str]]:
        if node not in known:
            known[node] = [steps[node], *path((node[0] + 1, node[1] // ARITY))]
        return known[node]

    return [path((level, i)) for level, i, _ in nodes]


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples; structs are given as tuples in the order of their fields."""
    held: list[tuple] = []

    def out():
        columns = list(zip(*held))
        made = []
        for values, f in zip(columns, schema):
            if pa.types.is_list(f.type):
                values = [None if v is None else [dict(zip(("before", "after"), x)) for x in v] for v in values]
            made.append(pa.array(values, f.type))
        held.clear()
        return pa.RecordBatch.from_arrays(made, schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
    if held:
        yield out()


_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_NODE = [("group", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("level", pa.int64()), ("i", pa.int64()), ("h", pa.string())]
NODE = "group string, part long, at long, n long, level long, i long, h string"


def _subtrees(batches):
    """Ragged nodes of the pieces of a partition: each piece comes as a header (offset, n) and its leaves in order."""

    def out():
        head, leaves = None, []

        def done():
            if head:
                group, part, at, offset, n = head
                for level, i, h in climbed(((0, offset + k, x) for k, x in enumerate(leaves)), n, min(LOCAL, depth(n))):
                    yield group, part, at + i * ARITY**level - offset, n, level, i, h

        for part, at, kind, group, offset, n, h in records(batches):
            if kind == 0:
                yield from done()
                head, leaves = (group, part, at, offset, n), []
            else:
                leaves.append(h)
                if (head[3] + len(leaves)) % ARITY**LOCAL == 0:  # no subtree goes beyond here
                    yield from done()
                    head, leaves = (head[0], part, at + 1, head[3] + len(leaves), head[4]), []
        yield from done()

    yield from batched(out(), pa.schema(_NODE))


def _blocks(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """(group, block) and the rows of each block, from rows sorted by them."""
    for key, rows in groupby(records(batches), key=lambda r: r[:2]):
        yield key, list(rows)


def _raised(top: int):
    """The node of level `top` (or the group's last) over each block."""

    def run(batches):
        def out():
            for (group, _), rows in _blocks(batches):
                n = rows[0][2]
                (node,) = climbed((r[3:6] for r in rows), n, min(top, depth(n)))
                yield group, None, None, n, *node

        yield from batched(out(), pa.schema(_NODE))

    return run


def _lowered(batches):
    """The path of every node of each block; the node over the block comes first, with its own path."""

    def out():
        for (group, _), (head, *nodes) in _blocks(batches):
            n, subroot = head[2], head[9]
            rest = [(x["before"], x["after"]) for x in head[8]]
            found = paths([r[3:6] for r in nodes], n, (head[3], head[4]), rest)
            for r, path in zip(nodes, found):
                yield group, *r[6:8], n, *r[3:6], path, subroot

    yield from batched(out(), pa.schema([*_NODE, ("path", _PATH), ("subroot", pa.string())]))


def _proofs(batches):
    """The rows with their proofs: a subtree comes as its path and then its leaves in order."""

    def finished(rows: pa.Table):
        kinds = rows["kind"].to_pylist()
        heads = [k for k, kind in enumerate(kinds) if kind == 0]
        found, subroots = [], []
        for lo, hi in zip(heads, [*heads[1:], len(kinds)]):
            level, i, n, subroot, rest = (rows[c][lo].as_py() for c in ("level", "i", "n", "subroot", "path"))
            nodes = [(0, i * ARITY**level + k, h) for k, h in enumerate(rows["h"].slice(lo + 1, hi - lo - 1).to_pylist())]
            found += paths(nodes, n, (level, i), [(x["before"], x["after"]) for x in rest])
            subroots += [subroot] * len(nodes)
        leaves = rows.filter(pc.equal(rows["kind"], 1)).combine_chunks()
        for at in range(0, len(leaves), 1024):
            part = leaves.slice(at, 1024).select(["row", "h"]).combine_chunks().to_batches()[0]
            proof = pa.array([[{"before": a, "after": b} for a, b in x] for x in found[at : at + 1024]], _PATH)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(subroots[at : at + 1024], pa.string()), proof], ["row", "leaf", "subroot", "proof"])

    held = []
    for b in batches:
        heads = pc.indices_nonzero(pc.equal(b["kind"], 0)).to_pylist()
        if heads:
            held.append(b.slice(0, heads[-1]))
            yield from finished(pa.Table.from_batches(held))
            held = [b.slice(heads[-1])]
        else:
            held.append(b)
    if held:
        yield from finished(pa.Table.from_batches(held))


class Tree:
    """The trees over (group, key, leaf, row), one a group: climbed when made; paths come down when asked for."""

    def __init__(self, leaves: DataFrame, name: str):
        rows = ranged(leaves, name, "group", "key", "leaf")
        pieces = rows.groupBy("group", "part").agg(F.min("at").alias("at"), F.count("*").alias("n"))
        whole = Window.partitionBy("group")
        before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offset = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
        pieces = pieces.select("part", "at", F.lit(0).alias("kind"), "group", offset, F.sum("n").over(whole).alias("n"), F.lit(None).cast("string").alias("h"))
        none = F.lit(None).cast("long")
        shown = rows.select("part", "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("group"), none.alias("offset"), none.alias("n"), F.col("leaf").alias("h"))
        dealt = pieces.unionByName(shown).repartition("part").sortWithinPartitions("part", "at", "kind")
        self.rows, self.ragged = rows, stored(dealt.mapInArrow(_subtrees, NODE), f"{name}-ragged")
        most = self.ragged.agg(F.max("n")).first()[0] or 0
        self.tops = list(range(BLOCK, depth(most) + BLOCK + 1, BLOCK))
        self.held, below = [], self.ragged.where("false")
        for top in self.tops:
            level = F.col("level")
            here = self.ragged.where((level < top) & (level >= top - BLOCK)).unionByName(below)
            block = (F.col("i") / F.pow(F.lit(ARITY), top - level)).cast("long")
            here = here.withColumn("block", F.when(level < top, block))
            self.held.append(here)
            first = F.col("i") * F.pow(F.lit(ARITY), level)
            dealt = here.repartition("group", "block").sortWithinPartitions("group", "block", first)
            below = stored(dealt.select("group", "block", "n", "level", "i", "h").mapInArrow(_raised(top), NODE), f"{name}-upper")
        self.roots = below.select("group", "n", "level", "i", F.col("h").alias("subroot"))

    def proofs(self, name: str, roots: DataFrame) -> DataFrame:
        """(row, leaf, subroot, proof) of all leaves; `roots` are self.roots, each with the path from it on."""
        down, found = roots, []
        for here in reversed(self.held):
            none = F.lit(None).cast("long")
            heads = down.select("group", F.col("i").alias("block"), "n", "level", "i", F.lit(None).cast("string").alias("h"), none.alias("part"), none.alias("at"), "path", "subroot")
            nodes = here.select("group", "block", "n", "level", "i", "h", "part", "at", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
            first = F.col("i") * F.pow(F.lit(ARITY), F.col("level"))
            dealt = heads.unionByName(nodes).repartition("group", "block").sortWithinPartitions("group", "block", F.col("path").isNull(), first)
            done = stored(dealt.mapInArrow(_lowered, f"{NODE}, path {PATH}, subroot string"), f"{name}-paths")
            found.append(done.where("part is not null"))
            down = done.where("part is null")
        tails = reduce(DataFrame.unionByName, found).withColumn("kind", F.lit(0)).withColumn("row", F.lit(None).cast(self.rows.schema["row"].dataType))
        leaves = self.rows.select("part", "at", F.lit(1).alias("kind"), F.col("leaf").alias("h"), "row")
        dealt = tails.unionByName(leaves, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "at", "kind")
        shape = StructType([self.rows.schema["row"], *StructType.fromDDL(f"leaf string, subroot string, proof {PATH}").fields])
        return dealt.select("kind", "level", "i", "n", "h", "path", "subroot", "row").mapInArrow(_proofs, shape)


def proved(leaves: DataFrame, group: str = "group", key: str = "key") -> DataFrame:
    """`leaves` (group and key of any sortable type, leaf string, other columns) with subroot, root and proof.

    Within a group, leaves ascend by key (null first), equal keys by leaf; every three consecutive nodes (the last run:
    fewer, even one) become the hash of their concatenation until one, the subroot, is left. Subroots ordered by group
    as text (null first) make the root in the same way. `proof` is an array of (before, after), one a level: the
    siblings' hashes, joined; folded() gives the root back. Repeated rows are leaves of their own. No leaves: no rows.
    Columns of any name pass, but those named subroot, root and proof are replaced.
    """
    kept = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "proof")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    trees = Tree(leaves.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{key}`").alias("key"), "leaf", row), "leaves")
    above = trees.roots.select(F.lit(None).cast("string").alias("group"), F.col("group").alias("key"), F.col("subroot").alias("leaf"), F.struct("group", "n", "level", "i").alias("row"))
    over = Tree(above, "groups")
    root = over.roots.first()
    roots = over.proofs("groups", over.roots.withColumn("path", F.array().cast(PATH)))
    roots = roots.select("row.*", F.col("leaf").alias("subroot"), F.col("proof").alias("path"))
    out = trees.proofs("leaves", roots)
    return out.select("row.*", "subroot", F.lit(root.subroot if root else None).cast("string").alias("root"), "proof")


def manifest(docs: DataFrame) -> DataFrame:
    """The proofs of documents (doc_id, source, lang, n_chars, text), checked against a copy in which some texts changed.

    leaf is of the five columns as they are. Where 2 divides the unsigned crc32 of doc_id in decimal, the copy's text
    has lost its newlines; a null id is not among them, a null text stays null. folded_root is what the copy's leaf and
    the original proof give; verified says whether it is the root. Repeated rows are leaves of their own; very long
    texts are hashed where they lie and never shuffled.
    """
    text = F.col("text").cast("string")
    changed = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    said = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*said, text).alias("leaf"), leaf(*said, changed).alias("copy"))
    out = proved(stored(leaves, "manifest"), "source", "doc_id")
    out = out.withColumn("folded_root", folded(F.col("proof"), F.col("copy")))
    return out.select("doc_id", "source", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The rows of op11 in DuckDB: both trees by recursion, then every leaf's way up; crc32 is worked out bit by bit."""
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_concat([ascii(c)::bigint], [0::bigint, 0, 0, 0, 0, 0, 0, 0])[:8]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)))"
    said = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(said, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    tree = """
{t}(g, level, i, h, n) as (
  select g, 0, i, h, count(*) over (partition by g) from {leaves}
  union all
  select g, level + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from {t} where n > 1 group by g, level, i // 3, n),
{t}_steps as (select g, level, i,
  coalesce(string_agg(h, '') over (partition by g, level, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as a,
  coalesce(string_agg(h, '') over (partition by g, level, i // 3 order by i rows between 1 following and unbounded following), '') as b
  from {t} where n > 1),
{t}_up(g, first, level, i, before, path, copy) as (
  select g, i, 0, i, '', '', copy from {leaves}
  union all
  select u.g, u.first, u.level + 1, u.i // 3, '', path || a || b, case when copy is null then null else sha256(a || copy || b) end
  from {t}_up u join {t}_steps s on s.g is not distinct from u.g and s.level = u.level and s.i = u.i),
{t}_all as (select g, first, path, copy from {t}_up qualify level = max(level) over (partition by g, first)),
{t}_root as (select g, h from {t} where n = 1)"""
    return f"""
with recursive rows as (select *, {leaf('text')} as h, {leaf("(case when " + crc + " % 2 = 0 then replace(text, chr(10), '') else text end)")} as copy from documents),
leaves as (select source as g, doc_id, h, copy, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i from rows),
{tree.format(t='t', leaves='leaves')},
tops as (select null::varchar as g, g as source, h, null::varchar as copy, row_number() over (order by g nulls first) - 1 as i from t_root),
{tree.format(t='s', leaves='tops')},
folds(source, first, copy, level, i) as (
  select l.g, l.first, l.copy, 0, o.i from t_all l join tops o on o.source is not distinct from l.g
  union all
  select f.source, f.first, sha256(a || copy || b), f.level + 1, f.i // 3 from folds f join s_steps s on s.level = f.level and s.i = f.i),
folded as (select source, first, copy from folds qualify level = max(level) over (partition by source, first))
select l.doc_id, l.h as leaf, o.h as subroot, r.h as root, sha256(u.path || w.path) as proof_sha256, f.copy as folded_root, f.copy = r.h as verified
from leaves l
join t_all u on u.g is not distinct from l.g and u.first = l.i
join tops o on o.source is not distinct from l.g
join s_all w on w.first = o.i
join folded f on f.source is not distinct from l.g and f.first = l.i
cross join s_root r"""
