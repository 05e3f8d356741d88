"""Repair of conversation structure: the cheapest edits that make a conversation's roles legal, by a min-plus matrix scan.

The roles a conversation has read so far are one of four states: none, system, user, assistant. A turn is a 4x4 matrix
of (cost, audit) from state to state, insertions before and after it included; the product takes the least cost, and of
equal costs the least audit, so it is associative. Turns are sorted over all partitions; a task multiplies those of a
conversation in its partition, products meet by rounds of FAN until one a conversation is left, and the states chosen
come down the same tree, so each task edits its own turns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranged, records, stored

SPACE = " \t\n\x0b\x0c\r"
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}  # initial: state -> state
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAN, CHUNK = 16, 64

Matrix = list[list[tuple[int, str] | None]]

#: Insertions alone: a user turn wherever one may stand, then an assistant's.
CLOSURE: Matrix = [
    [(0, ""), None, (INSERT, "I"), (2 * INSERT, "II")],
    [None, (0, ""), (INSERT, "I"), (2 * INSERT, "II")],
    [None, None, (0, ""), (INSERT, "I")],
    [None, None, (INSERT, "I"), (0, "")],
]


def product(a: Matrix, b: Matrix) -> Matrix:
    """a, then b: from each state to each, the least cost, then the least audit."""
    out: Matrix = []
    for row in a:
        ways: list[tuple[int, str] | None] = [None] * STATES
        for first, onward in zip(row, b):
            if first is not None:
                for k, then in enumerate(onward):
                    if then is not None:
                        cost = first[0] + then[0]
                        if ways[k] is None or (cost, first[1] + then[1]) < ways[k]:
                            ways[k] = cost, first[1] + then[1]
        out.append(ways)
    return out


def turn(initial: str, doomed: bool, truncated: bool) -> Matrix:
    """The edits of one turn: keep, give another role, delete; a doomed (blank or repeated) one is deleted."""
    one: Matrix = [[(DELETE, "D") if i == k else None for k in range(STATES)] for i in range(STATES)]
    if not doomed:
        more = TRUNCATED if truncated else 0
        choices = [(r, REROLE + more, "R") for r in "ua"] + [(initial, more, "K")]
        for role, cost, letter in choices:
            for i, k in AFTER.get(role, {}).items():
                if one[i][k] is None or (cost, letter) < one[i][k]:
                    one[i][k] = cost, letter
    return product(product(CLOSURE, one), CLOSURE)


_TURNS = {(r, doomed, cut): turn(r, doomed, cut) for r in ("s", "u", "a", "") for doomed in (False, True) for cut in (False, True)}


def multiplied(turns: Iterable[tuple[str, bool, bool]]) -> Matrix:
    """The product of many turns: CHUNK at a time, then pairs of equal length, so that audits are copied log n times."""
    stack: list[tuple[int, Matrix]] = []

    def push(m: Matrix) -> None:
        size = 1
        while stack and stack[-1][0] == size:
            m, size = product(stack.pop()[1], m), 2 * size
        stack.append((size, m))

    held, n = None, 0
    for initial, doomed, cut in turns:
        m = _TURNS[initial if initial in AFTER else "", doomed, cut]
        held, n = (m if held is None else product(held, m)), n + 1
        if n == CHUNK:
            push(held)
            held, n = None, 0
    parts = [m for _, m in stack] + ([held] if held else [])
    return reduce(product, parts) if parts else CLOSURE


def chosen(parts: list[Matrix], i: int, k: int) -> list[tuple[int, int]]:
    """The states between which each of `parts` leads on the best way from i to k."""
    best: list[Matrix] = [parts[0]]
    for m in parts[1:]:
        best.append(product(best[-1], m))
    out = []
    for p in range(len(parts) - 1, 0, -1):
        _, mid = min(((x[0] + y[0], x[1] + y[1]), j) for j in range(STATES) if (x := best[p - 1][i][j]) and (y := parts[p][j][k]))
        out.append((mid, k))
        k = mid
    return [(i, k), *reversed(out)]


def edited(state: int, audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(row or None, role, text) of the turns that `audit` leaves of `rows` (role and text last), from a state on."""
    for letter in audit:
        row = next(rows) if letter != "I" else None
        if letter == "D":
            continue
        role, text = row[-2:] if row else ("", "")
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = AFTER[role[:1]][state]
        yield row, role, text


MATRIX = "costs array<long>, audits array<string>"
_MATRIX = [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]


def _flat(m: Matrix) -> tuple[list, list]:
    flat = [x for row in m for x in row]
    return [x and x[0] for x in flat], [x and x[1] for x in flat]


def _square(costs: list, audits: list) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return [flat[i : i + STATES] for i in range(0, STATES * STATES, STATES)]


def _batches(rows: Iterator[tuple], fields: list[tuple], size: int = 512):
    schema, held = pa.schema(fields), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


PIECE = f"conv_id long, part long, at long, blank long, duplicate long, truncated long, illegal long, initial string, last_initial string, first_turn long, last_turn long, turns long, {MATRIX}"
LEGAL = ("su", "ua", "au")


def _pieces(batches):
    """One row for each conversation in a partition; a row's first occurrence comes as a marker before it."""
    fields = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in PIECE.split(", ")[:12]] + _MATRIX

    def numbered():
        spot = None
        for part, at, kind, *row in records(batches):
            if kind == 0:
                spot = part, at
            else:
                yield part, at, spot != (part, at), *row

    def out():
        for (part, _), rows in groupby(numbered(), key=lambda r: (r[0], r[3])):
            rows = list(rows)
            judged, counts, turns, illegal, before = [], [0, 0, 0], [], 0, None
            for _, _, repeated, _, number, initial, blank, cut in rows:
                fault = 0 if blank else 1 if repeated else 2 if cut else None
                if fault is not None:
                    counts[fault] += 1
                judged.append((initial, fault in (0, 1), fault == 2))
                if number is not None and turns[-1:] != [number]:
                    turns.append(number)
                illegal += before is not None and before + initial not in LEGAL
                before = initial
            ends = (turns[0], turns[-1]) if turns else (None, None)
            yield rows[0][3], part, rows[0][1], *counts, illegal, rows[0][5], before, *ends, len(turns), *_flat(multiplied(judged))

    yield from _batches(out(), fields)


def _merged(batches):
    """The product of the matrices of each (conversation, node above), which come in order."""

    def out():
        for (conv, up), rows in groupby(records(batches), key=lambda r: r[:2]):
            yield conv, up, *_flat(reduce(product, (_square(*r[2:]) for r in rows)))

    yield from _batches(out(), [("conv_id", pa.int64()), ("node", pa.int64()), *_MATRIX])


def _split(batches):
    """The states of each node below from those of the node above, which comes first."""

    def out():
        for (conv, _), (head, *rows) in ((k, list(g)) for k, g in groupby(records(batches), key=lambda r: r[:2])):
            for r, (i, k) in zip(rows, chosen([_square(*r[5:]) for r in rows], head[2], head[3])):
                yield conv, r[4], i, k

    yield from _batches(out(), [("conv_id", pa.int64()), ("node", pa.int64()), ("i", pa.int64()), ("k", pa.int64())])


def _edits(batches):
    """The turns that are left, in order: a piece comes as its state and audit, then its turns."""
    fields = [("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("sub", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]

    def out():
        rows = records(batches)
        for part, at, _, conv, state, audit, *_ in rows:  # the piece's turns are taken inside
            for sub, (row, role, text) in enumerate(edited(state, audit, rows)):
                yield conv, part, at, sub, row and row[6], role, text

    yield from _batches(out(), fields)


def _hashed(batches):
    """The hash of each conversation's `role:text` lines, from rows in order; one text in memory at a time."""

    def out():
        for conv, rows in groupby(records(batches), key=lambda r: r[0]):
            h = sha256()
            for n, (_, role, text) in enumerate(rows):
                h.update(f"{chr(10) * (n > 0)}{role}:{text}".encode())
            yield conv, h.hexdigest()

    yield from _batches(out(), [("conv_id", pa.int64()), ("sha256", pa.string())])


class Repair:
    """The repair of `turns` (conv_id long, turn long, role, text; null role and text: one space).

    A conversation's turns go by turn (null first), equal ones by role and text. A turn's first fault counts: blank (no
    character but white space), duplicate (role and text stood earlier in the conversation), truncated (its last
    character but white space is none of . ! ?). Keeping a turn costs 0, another role 1, deleting it 2 (blank and
    duplicate ones must go), an inserted empty turn 5; a truncated turn that stays costs 5 more. The roles' initials
    must read (s?(ua)+)?; of the cheapest edits those whose letters (K, R, D, I) are least in ASCII are taken. A null
    conv_id is a conversation like any other. An empty table gives empty results. Very long conversations are spread
    over partitions by range; very long texts pass as they are, a batch in memory at a time.

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. rows: what is left or put in, conv_id,
    part, at, sub (the order), turn (null where inserted), role, text.
    """

    def __init__(self, turns: DataFrame):
        self.turns = ranged(
            turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))),
            "turns", "conv_id", "turn", "role", "text",
        )
        key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
        firsts = self.turns.groupBy("conv_id", key.alias("key")).agg(F.min(F.struct("part", "at")).alias("first"))
        end = F.rtrim(F.col("text"), F.lit(SPACE))
        light = self.turns.select("part", "at", F.lit(1).alias("kind"), "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (F.ltrim(end, F.lit(SPACE)) == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        both = light.unionByName(firsts.select("first.*", F.lit(0).alias("kind")), allowMissingColumns=True)
        dealt = both.repartition("part").sortWithinPartitions("part", "at", "kind")
        self.pieces = stored(dealt.mapInArrow(_pieces, PIECE), "pieces")
        self.choices = stored(self._chosen(), "choices")

    def _chosen(self) -> DataFrame:
        """(conv_id, part, at, i, audit): the state in which each piece begins and the edits of its turns."""
        order = Window.partitionBy("conv_id").orderBy("part")
        nodes = self.pieces.select("conv_id", "part", "at", "costs", "audits", (F.row_number().over(order) - 1).cast("long").alias("node"))
        level = stored(nodes.withColumn("of", F.count("*").over(Window.partitionBy("conv_id"))), "level")
        pieces, levels = level, []
        single = level.where("of = 1")
        level = level.where("of > 1").select("conv_id", "node", "costs", "audits")
        most = pieces.agg(F.max("of")).first()[0] or 1
        while most > 1:
            levels.append(level)
            up = level.select("conv_id", (F.col("node") / FAN).cast("long").alias("up"), "costs", "audits", "node")
            dealt = up.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "node")
            level = stored(dealt.drop("node").mapInArrow(_merged, f"conv_id long, node long, {MATRIX}"), "level")
            most = -(-most // FAN)
        top = single.select("conv_id", "node", "costs", "audits").unionByName(level)
        ends = [F.when(F.col("costs")[k].isNotNull(), F.struct(F.col("costs")[k].alias("cost"), F.col("audits")[k].alias("audit"), F.lit(k).cast("long").alias("k"))) for k in ENDS]
        self.ends = stored(top.select("conv_id", "node", F.least(*ends).alias("end")), "ends")
        down = self.ends.select("conv_id", "node", F.lit(START).cast("long").alias("i"), F.col("end.k").alias("k"))
        for below in reversed(levels):
            heads = down.select("conv_id", F.col("node").alias("up"), "i", "k", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<long>").alias("costs"), F.lit(None).cast("array<string>").alias("audits"))
            none = F.lit(None).cast("long")
            nodes = below.select("conv_id", (F.col("node") / FAN).cast("long").alias("up"), none.alias("i"), none.alias("k"), "node", "costs", "audits")
            heads = heads.join(below.select("conv_id").distinct().withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
            dealt = heads.unionByName(nodes).repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "node")
            found = dealt.mapInArrow(_split, "conv_id long, node long, i long, k long")
            kept = down.join(below.select("conv_id").distinct().withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
            down = stored(kept.unionByName(found), "states")
        down = down.withColumnsRenamed({"conv_id": "c", "node": "nth"})
        with_states = pieces.join(down, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("nth")))
        return with_states.select("conv_id", "part", "at", "i", F.element_at("audits", (F.col("i") * STATES + F.col("k") + 1).cast("int")).alias("audit"))

    @property
    def summary(self) -> DataFrame:
        order = Window.partitionBy("conv_id").orderBy("part")
        before, last = F.lag("last_initial").over(order), F.last("last_turn", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        across = (before.isNotNull() & ~F.concat(before, F.col("initial")).isin(*LEGAL)).cast("long")
        counted = self.pieces.withColumn("across", across).withColumn("again", F.coalesce((last == F.col("first_turn")).cast("long"), F.lit(0)))
        of = counted.groupBy("conv_id").agg(
            F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns") - F.col("again")), F.lit(0)).alias("gaps"),
            *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
            F.sum(F.col("illegal") + F.col("across")).alias("illegal"),
        )
        ends = self.ends.select(F.col("conv_id").alias("c"), F.col("end.cost").alias("cost"), F.col("end.audit").alias("audit"))
        return of.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    @property
    def rows(self) -> DataFrame:
        heads = self.choices.select("part", "at", F.lit(0).alias("kind"), "conv_id", "i", "audit")
        turns = self.turns.select("part", "at", F.lit(1).alias("kind"), "turn", "role", "text")
        dealt = heads.unionByName(turns, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "at", "kind")
        return dealt.select("part", "at", "kind", "conv_id", "i", "audit", "turn", "role", "text").mapInArrow(_edits, "conv_id long, part long, at long, sub long, turn long, role string, text string")

    @property
    def hashes(self) -> DataFrame:
        """(conv_id, sha256) of the repaired conversations; such a hash can only be taken in order, so each is one task's, in a stream."""
        dealt = self.rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at", "sub")
        return dealt.select("conv_id", "role", "text").mapInArrow(_hashed, "conv_id long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults put in by crc32(`conv_id:turn`) % 20, nulls as one space there and in role and text.

    0 drops the turn, 1 empties its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes its role user.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said[2].alias("role"), said[3].alias("text"), (F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20).alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: what the damage of damaged() did to it, and its repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the `role:text` lines). A
    conversation of which no turn is left has zeros, an empty audit and the hash of an empty text.
    """
    repair = Repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), repair.summary, repair.hashes.withColumnRenamed("sha256", "repaired_sha256")]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    of = both.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")))
    return of.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The rows of op12 in DuckDB: the four states' least (cost, audit) turn by turn, then the edits read off again."""
    said = {c: f"coalesce({c}::varchar, ' ')" for c in ("conv_id", "turn", "role", "text")}
    key = f"({said['conv_id']} || ':' || {said['turn']})"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({key}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)))"
    way = lambda state, cost, letter: f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}')"
    never = "struct_pack(c := 1000000000, a := '')"
    least = lambda *ways: f"least({', '.join(ways)})"
    only = lambda when, then: f"case when {when} then {then} else {never} end"
    keeps = lambda initial: f"ok and initial = '{initial}'"
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with recursive hurt as (select conv_id, turn, {said['role']} as role, {said['text']} as text, {crc} % 20 as fault from conversations),
kept as (select conv_id, turn, case when fault = 4 then 'user' else role end as role,
  case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case when fault = 3 then 2 else 1 end)) as copy from hurt where fault <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from kept),
seen as (select *, rtrim(text, {space}) as said, row_number() over (partition by conv_id, role, text order by i) > 1 as again, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) as before from numbered),
faulty as (select *, case when said = '' then 'blank' when again then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
rows as (select *, fault not in ('blank', 'duplicate') as ok, case when fault = 'truncated' then 5 else 0 end as more from faulty),
steps(conv_id, i, n, s, y, u, a) as (
  select conv_id, 0::bigint, count(*), struct_pack(c := 0, a := ''), {never}, struct_pack(c := 5, a := 'I'), struct_pack(c := 10, a := 'II') from rows group by conv_id
  union all
  select conv_id, i, n, s, y, {least('u', way('s', 5, 'I'), way('y', 5, 'I'), way('a', 5, 'I'))}, {least('a', way('u', 5, 'I'), way('s', 10, 'II'), way('y', 10, 'II'))} from (
    select r.conv_id, r.i, n, {way('s', 2, 'D')} as s,
      {least(way('y', 2, 'D'), only(keeps('s'), way('s', 'more', 'K')))} as y,
      {least(way('u', 2, 'D'), *(only(keeps('u'), way(x, 'more', 'K')) for x in 'sya'), *(only('ok', way(x, '(1 + more)', 'R')) for x in 'sya'))} as u,
      {least(way('a', 2, 'D'), only(keeps('a'), way('u', 'more', 'K')), only('ok', way('u', '(1 + more)', 'R')))} as a
    from steps t join rows r on r.conv_id is not distinct from t.conv_id and r.i = t.i + 1)),
best as (select conv_id, least(s, a) as e from steps where i = n),
edits(conv_id, audit, spot, i, state, said) as (
  select conv_id, e.a, 0, 0::bigint, 's', null::varchar from best
  union all
  select conv_id, audit, spot, i, case when letter = 'D' then state when letter = 'K' then case initial when 's' then 'y' else initial end when state = 'u' then 'a' else 'u' end,
    case when letter = 'D' then said else coalesce(said || chr(10), '') || case letter when 'K' then role || ':' || text else case when state = 'u' then 'assistant' else 'user' end || ':' || case when letter = 'R' then text else '' end end end
  from (select t.conv_id, audit, spot + 1 as spot, t.i + (audit[spot + 1] <> 'I')::int as i, state, t.said, audit[spot + 1] as letter, r.role, r.text, r.initial
    from edits t left join rows r on r.conv_id is not distinct from t.conv_id and r.i = t.i + 1 and audit[spot + 1] <> 'I' where spot < len(audit))),
done as (select conv_id, said from edits where spot = len(audit)),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from rows group by conv_id)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join counts c on c.conv_id is not distinct from i.conv_id
left join best b on b.conv_id is not distinct from i.conv_id
left join done d on d.conv_id is not distinct from i.conv_id"""
