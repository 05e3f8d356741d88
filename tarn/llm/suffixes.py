"""Suffix arrays with common prefixes by external induced sorting: recursion over LMS names, queues and arrays on disk.

Induction pops suffixes in order of their first symbol and pushes what stands before them. The priority queue holds
tuples (suffix, rank of its successor) by range of first symbol: a push goes to the range of its symbol, in memory or
in that range's file, and comes back in order, as pushes come in order of the successors. The common prefix of two
neighbours is one more than the least over the ranks between their successors, so it is carried along, through every
level of the recursion. Whatever is as long as the sequence (symbols, types, names, the order, the prefixes) is an
array in a file once it exceeds `most_bytes`, worked through in steps of `batch`; in memory are one batch, the queue's
buffer, a count a different symbol and the least prefix of every 128 ranks.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np


class Scratch:
    """Where arrays and queues live: in memory up to `most_bytes` each, in files of the task's own folder beyond."""

    def __init__(self, folder: str, batch: int = 1 << 18, most_bytes: int = 1 << 22):
        self.folder, self.batch, self.most_bytes = folder, batch, most_bytes

    def places(self, n: int, of: int) -> np.ndarray:
        """An array for n places in a sequence of length `of`."""
        return self.array(n, np.int32 if of < 1 << 31 else np.int64)

    def name(self) -> str:
        return os.path.join(self.folder, uuid.uuid4().hex)

    def array(self, n: int, dtype) -> np.ndarray:
        dtype = np.dtype(dtype)
        if n * dtype.itemsize <= self.most_bytes:
            return np.zeros(n, dtype)
        path = self.name()
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)  # the file goes with the array
        return np.asarray(out)  # a plain view: memmap's own indexing is slow

    def steps(self, n: int) -> Iterator[tuple[int, int]]:
        return ((a, min(n, a + self.batch)) for a in range(0, n, self.batch))


class Queue:
    """Tuples (suffix, rank of its successor), first in, first out for each priority; buffers over `most_bytes` go to files."""

    def __init__(self, priorities: int, scratch: Scratch):
        self.held: dict[int, list[np.ndarray]] = {}
        self.size, self.scratch, self.files = 0, scratch, {}

    def push(self, at: int, items: np.ndarray) -> None:
        self.held.setdefault(at, []).append(items)
        self.size += items.nbytes
        if self.size > self.scratch.most_bytes:
            for key, parts in self.held.items():
                if key not in self.files:
                    self.files[key] = self.scratch.name()
                with open(self.files[key], "ab") as f:
                    for x in parts:
                        f.write(np.ascontiguousarray(x).tobytes())
            self.held, self.size = {}, 0

    def few(self, at: int, most: int = 256) -> np.ndarray | None:
        """All tuples of a priority if they are few and in memory; else None, and they stay."""
        if at in self.files or sum(map(len, self.held[at])) > most:
            return None
        return np.concatenate(list(self.pop(at)))

    def pop(self, at: int) -> Iterator[np.ndarray]:
        """All tuples of a priority, a batch at a time."""
        parts = self.held.pop(at, [])
        self.size -= sum(x.nbytes for x in parts)
        if at in self.files:
            path = self.files.pop(at)
            with open(path, "rb") as f:
                while len(x := np.fromfile(f, np.int64, 2 * self.scratch.batch)):
                    yield x.reshape(-1, 2)
            os.unlink(path)
        if parts:
            x = np.concatenate(parts)
            for a in range(0, len(x), self.scratch.batch):
                yield x[a : a + self.scratch.batch]


class Prefixes:
    """Common prefixes of neighbours by rank, appended in order, and the least of them between two ranks."""

    BLOCK = 128

    def __init__(self, n: int, scratch: Scratch):
        self.values = scratch.array(n, np.uint16)
        self.before, self.after = scratch.array(n, np.uint16), scratch.array(n, np.uint16)  # least from the block's start, to its end
        self.least = np.zeros(-(-n // self.BLOCK), np.uint16)
        self.tables: list[np.ndarray] = []
        self.n = 0

    def append(self, x: np.ndarray) -> None:
        first = self.n // self.BLOCK
        self.values[self.n : self.n + len(x)] = x
        self.n += len(x)
        a = first * self.BLOCK
        part = np.full(-(-(self.n - a) // self.BLOCK) * self.BLOCK, 65535, np.uint16)
        part[: self.n - a] = self.values[a : self.n]
        part = part.reshape(-1, self.BLOCK)
        self.before[a : self.n] = np.minimum.accumulate(part, axis=1).ravel()[: self.n - a]
        self.after[a : self.n] = np.minimum.accumulate(part[:, ::-1], axis=1)[:, ::-1].ravel()[: self.n - a]
        self.least[first : first + len(part)] = part.min(1)
        self.tables = []

    def along(self, ranks: np.ndarray) -> np.ndarray:
        """The least between each rank and the next (ranks ascend): read through where they stand close together."""
        if len(ranks) < 2:
            return np.empty(0, np.uint16)
        low, high = int(ranks[0]) + 1, int(ranks[-1]) + 1
        if high - low > 96 * len(ranks):
            return self.between(ranks[:-1] + 1, ranks[1:])
        return np.minimum.reduceat(self.values[low:high], ranks[:-1] + 1 - low)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of ranks a to b, both included, for each pair (a <= b)."""
        p, q = a // self.BLOCK, b // self.BLOCK
        out = np.minimum(self.after[a], self.before[b])
        same = np.flatnonzero(p == q)
        if len(same):
            at, end = a[same], b[same]
            least = self.values[at]
            while len(at):
                at = at + 1
                on = at <= end
                same_, at, end = np.flatnonzero(on), at[on], end[on]
                if not len(at):
                    break
                if len(same_) < len(least):
                    out[same[~on]] = least[~on]
                    same, least = same[on], least[on]
                least = np.minimum(least, self.values[at])
            out[same] = least
        far = np.flatnonzero(q - p > 1)
        if len(far):
            if not self.tables:
                self.tables = sparse(self.least[: -(-self.n // self.BLOCK)])
            out[far] = np.minimum(out[far], least_in(self.tables, p[far] + 1, q[far] - 1))
        return out


def sparse(x: np.ndarray) -> list[np.ndarray]:
    """The least of every run of 1, 2, 4, ..."""
    out = [x]
    while 2 * (step := 1 << (len(out) - 1)) <= len(x):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


def least_in(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    out = np.empty(len(a), tables[0].dtype)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(tables[k][a[at]], tables[k][b[at] - (1 << k) + 1])
    return out


def matching(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols `t` has alike from a and from b on, up to `most`, for each pair."""
    out, n = np.zeros(len(a), np.int64), len(t)
    which = np.flatnonzero(np.maximum(a, b) < n)
    for k in range(most):
        if not len(which):
            break
        which = which[t[a[which] + k] == t[b[which] + k]]
        out[which] = k + 1
        which = which[np.maximum(a[which], b[which]) + k + 1 < n]
    return out


class _Symbols:
    """How often each symbol is wanted, and which of them stand alone: the frequent ones and those that form long runs."""

    def __init__(self, t: np.ndarray, target: np.ndarray, seeds: np.ndarray, scratch: Scratch):
        self.top = 1 + max(int(t[a:b].max()) for a, b in scratch.steps(len(t)))
        self.seeds = np.zeros(self.top + 1, np.int64)
        counts, alone = np.zeros(self.top, np.int64), np.zeros(self.top, bool)
        for a, b in scratch.steps(len(seeds)):
            s, n = np.unique(t[np.asarray(seeds[a:b])], return_counts=True)
            self.seeds[s + 1] += n
        for a, b in scratch.steps(len(t)):
            part = np.asarray(t[a:b])
            s, n = np.unique(part[np.asarray(target[a:b])], return_counts=True)
            counts[s] += n
            ends = np.flatnonzero(np.append(np.diff(part) != 0, True))
            alone[part[ends[np.diff(np.append(-1, ends)) > 8]]] = True
        counts += self.seeds[1:]
        self.seeds = np.cumsum(self.seeds)
        alone |= counts > scratch.batch // 4
        cut = np.flatnonzero(alone)
        step = np.cumsum(np.where(alone, 0, counts)) // max(1, scratch.batch)
        firsts = np.unique(np.concatenate(([0], cut, cut + 1, np.flatnonzero(np.diff(step)) + 1)))
        self.firsts = firsts[firsts < self.top]
        self.ends = np.append(self.firsts[1:], self.top)
        self.place = np.repeat(np.arange(len(self.firsts), dtype=np.int32), self.ends - self.firsts)


def _induce(t: np.ndarray, target: np.ndarray, seeds: np.ndarray, seed_prefixes: np.ndarray, first: int, most: int, scratch: Scratch) -> tuple[np.ndarray, Prefixes]:
    """Seeds and targets in order, with common prefixes up to `most`. A target's symbol is never below its successor's;
    seeds come in order and stand after targets of the same symbol; `first` (or -1) is pushed before all others."""
    symbols = _Symbols(t, target, seeds, scratch)
    total = len(seeds) + sum(int(np.count_nonzero(target[a:b])) for a, b in scratch.steps(len(t)))
    out, prefixes = scratch.places(total, len(t)), Prefixes(total, scratch)
    queue = Queue(len(symbols.firsts), scratch)
    if first >= 0:
        queue.push(int(symbols.place[t[first]]), np.array([[first, -1]], np.int64))

    def before(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether what stands before each suffix is a target, and its symbol."""
        ok = pos > 0
        at = pos - ok
        return ok & target[at], np.asarray(t[at])

    def emit(pos: np.ndarray, values: np.ndarray, leave: np.ndarray, symbol: np.ndarray) -> None:
        """Next in order; the marked ones push what stands before them."""
        base = prefixes.n
        out[base : base + len(pos)] = pos
        prefixes.append(np.minimum(values, most).astype(np.uint16))
        at = np.flatnonzero(leave)
        to = symbols.place[symbol[at]]
        by = np.argsort(to, kind="stable")
        at, to = at[by], to[by]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(to)) + 1):
            if len(part):
                queue.push(int(to[part[0]]), np.stack((pos[at[part]] - 1, base + at[part]), axis=1))

    for r, (low, high) in enumerate(zip(symbols.firsts.tolist(), symbols.ends.tolist())):
        mine = range(int(symbols.seeds[low]), int(symbols.seeds[high]))
        if high - low == 1:
            last = _alone(t, low, queue, r, prefixes, before, emit)
            for a in range(mine.start, mine.stop, scratch.batch):
                pos = np.asarray(seeds[a : min(mine.stop, a + scratch.batch)]).astype(np.int64)
                values = np.asarray(seed_prefixes[a : a + len(pos)]).astype(np.int64)
                if a == mine.start:
                    values[0] = 0 if last is None else matching(t, np.array([last]), pos[:1], most)[0]
                emit(pos, values, *before(pos))
        else:
            _together(t, low, high, list(queue.pop(r)), np.asarray(seeds[mine.start : mine.stop]).astype(np.int64), np.asarray(seed_prefixes[mine.start : mine.stop]), most, prefixes, before, emit)
    return out, prefixes


def _runs_on(t, symbol: int, pos: np.ndarray, values: np.ndarray, run: int, before, emit) -> int:
    """A few targets and all that they push into their own range, run by run of growing length: each next one has those
    that go on, in the same order, and one more symbol in common."""
    reach, active = np.zeros(len(pos), np.int64), np.arange(len(pos))
    while len(active):
        at = pos[active] - reach[active] - 1
        active = active[(at >= 0) & (t[np.maximum(at, 0)] == symbol)]
        reach[active] += 1
    ends = pos - reach
    ok, s = before(ends)
    all_pos, all_values, leave, symbols, now = [], [], [], [], None
    for g in range(int(reach.max()) + 1):
        if now is None or (stopped == g - 1).any():  # noqa: F821
            now = np.flatnonzero(reach >= g)
            stopped = reach[now]
            shared = np.append(0, np.minimum.reduceat(values[: now[-1] + 1], now[:-1] + 1)) if len(now) > 1 else np.zeros(1, np.int64)
        here = shared + g
        here[0] = run + g - 1 if g else values[0]
        all_pos.append(pos[now] - g)
        all_values.append(here)
        leave.append(ok[now] & (stopped == g))
        symbols.append(s[now])
    out = np.concatenate(all_pos)
    emit(out, np.concatenate(all_values), np.concatenate(leave), np.concatenate(symbols))
    return int(out[-1])


def _alone(t, symbol: int, queue: Queue, r: int, prefixes: Prefixes, before, emit) -> int | None:
    """The targets of one symbol: those whose successor has another symbol, then what these pushed into the range
    themselves (a run longer by one), and so on. Gives back the last one."""
    last, run, successor = None, 0, 0
    while r in queue.held or r in queue.files:
        run, fresh = run + 1, True
        if (few := queue.few(r)) is not None:
            pos, after = few.T
            values = np.append(run - 1, 1 + prefixes.along(after).astype(np.int64))
            return _runs_on(t, symbol, pos, values, run, before, emit)
        for items in queue.pop(r):
            pos, after = items.T
            values = np.empty(len(pos), np.int64)
            values[1:] = 1 + prefixes.along(after).astype(np.int64)
            # between runs of different length only the shorter run is shared
            values[0] = (run - 1 if last is not None else 0) if fresh else 1 + int(prefixes.between(np.array([successor + 1]), after[:1])[0])
            ok, s = before(pos)
            emit(pos, values, ok, s)
            last, successor, fresh = int(pos[-1]), int(after[-1]), False
    return last


def _together(t, low: int, high: int, parts: list[np.ndarray], mine: np.ndarray, mine_prefixes: np.ndarray, most: int, prefixes: Prefixes, before, emit) -> None:
    """All suffixes of a range of symbols at once, also those whose successor is in the range: ordered by passes over
    the successors' ranks, their common prefixes by passes over the successors' prefixes."""
    come = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    n_come, n = len(come), len(come) + len(mine)
    if not n:
        return
    levels, successors, outside, symbols, held = [], [], [], [], 0
    edge = np.concatenate((come[:, 0], mine))
    while len(edge):
        ok, s = before(edge)
        stay = ok & (s < high)
        levels.append(edge)
        outside.append(ok & ~stay)
        symbols.append(s)
        at = np.flatnonzero(stay)
        successors.append(at + held)
        held += len(edge)
        edge = edge[at] - 1
    after, pos = np.concatenate(successors), np.concatenate(levels)
    first_symbol = np.asarray(t[pos]).astype(np.int64)
    base = (first_symbol - low) << 34
    base[n_come:n] |= 1 << 33
    base[:n] |= np.arange(n)
    base[n:] |= 1 << 32
    rank, key = None, base
    while True:
        order = np.argsort(key)
        new = np.empty(held, np.int64)
        new[order] = np.arange(held)
        if not len(after) or (rank is not None and np.array_equal(new, rank)):
            break
        rank, key = new, base.copy()
        key[n:] |= rank[after]
    start = prefixes.n
    follows = np.concatenate((come[:, 1], np.full(len(mine), -1), start + new[after]))[order]  # ranks of the successors
    seed = np.zeros(held, bool)
    seed[n_come:n] = True
    seed, of, popped = seed[order], first_symbol[order], pos[order]
    values, alike = np.zeros(held, np.int64), np.append(False, of[1:] == of[:-1])
    at = np.flatnonzero(seed & np.append(False, seed[:-1]) & alike)
    values[at] = mine_prefixes[(order[at] - n_come)]
    at = np.flatnonzero(seed & ~np.append(False, seed[:-1]) & alike)
    values[at] = matching(t, popped[at - 1], popped[at], most)
    at = np.flatnonzero(~seed & alike)
    a, b = follows[at - 1] + 1, follows[at]
    known = np.full(len(at), 65535, np.int64)
    old = np.flatnonzero(a < start)
    known[old] = prefixes.between(a[old], np.minimum(b[old], start - 1))
    inner = np.flatnonzero(b >= start)
    values[at] = np.minimum(1 + known, most)
    a, b = np.maximum(a[inner], start) - start, b[inner] - start
    while len(inner):
        new_values = np.minimum(1 + np.minimum(known[inner], least_in(sparse(values), a, b)), most)
        if np.array_equal(new_values, values[at[inner]]):
            break
        values[at[inner]] = new_values
    emit(popped, values, np.concatenate(outside)[order], np.concatenate(symbols)[order])


def _types(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Which suffixes are smaller than the suffix after them."""
    n = len(t)
    small = scratch.array(n, bool)
    later, symbol = False, -1
    for a, b in reversed(list(scratch.steps(n))):
        part = np.asarray(t[a:b]).astype(np.int64)
        following = np.append(part[1:], symbol)
        at = np.minimum.accumulate(np.where(part != following, np.arange(len(part)), len(part))[::-1])[::-1]
        up = np.append(part < following, later)
        small[a:b] = up[at]
        later, symbol = bool(small[a]), int(part[0])
    return small


def _lms(small: np.ndarray, scratch: Scratch) -> np.ndarray:
    starts = [a + np.flatnonzero(np.asarray(small[a:b]) & ~np.asarray(small[a - 1 : b - 1] if a else np.append(True, small[: b - 1]))) for a, b in scratch.steps(len(small))]
    out, at = scratch.places(sum(map(len, starts)), len(small)), 0
    for x in starts:
        out[at : at + len(x)] = x
        at += len(x)
    return out


def _ranks(t, small, lms, next_lms, bits: int) -> np.ndarray:
    """Ranks of some LMS substrings, equal ones alike, from packed (symbol, type) pairs, a word of pairs at a time."""
    each, length = max(1, 63 // bits), next_lms - lms + 1
    rank, active, offset = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(active):
        w = _word(t, small, lms[active], length[active], offset, each, bits)
        order = np.lexsort((w, rank[active])) if offset else np.argsort(w)
        r, w = rank[active][order], w[order]
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new_part = new_group | np.concatenate(([True], w[1:] != w[:-1]))
        at = np.arange(len(active))
        part = np.maximum.accumulate(np.where(new_part, at, 0))
        group = np.maximum.accumulate(np.where(new_group, at, 0))
        ids = active[order]
        rank[ids] = r + part - group
        size = np.diff(np.append(np.flatnonzero(new_part), len(active)))
        offset += each
        more = np.repeat(size > 1, size) & (length[ids] > offset)
        active = ids[np.isin(part, np.unique(part[more]))] if more.any() else ids[:0]
    return np.unique(rank, return_inverse=True)[1]


def _word(t, small, start, length, offset: int, each: int, bits: int) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    for k in range(offset, offset + each):
        out <<= np.uint64(bits)
        ok = np.flatnonzero(k < length)
        at = start[ok] + k
        out[ok] |= np.asarray(t[at]).astype(np.uint64) * np.uint64(2) + small[at] + np.uint64(1)
    return out


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, top: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The rank of every LMS substring and how many there are: dealt out to files by first word, ranked a file at a time."""
    m, bits = len(lms), (2 * top + 2).bit_length()
    each = max(1, 63 // bits)
    following = lambda a, b: np.append(lms[a + 1 : b + 1], len(t) - 1)[: b - a].astype(np.int64)

    def first_words(a, b):
        x = np.asarray(lms[a:b]).astype(np.int64)
        return _word(t, small, x, following(a, b) - x + 1, 0, each, bits)

    parts = max(1, -(-m // scratch.batch))
    names = scratch.places(m, len(t))
    if parts == 1:
        names[:] = _ranks(t, small, np.asarray(lms).astype(np.int64), following(0, m), bits)
        return names, int(names.max()) + 1
    rng = np.random.default_rng(1)
    drawn = np.sort(np.concatenate([rng.choice(first_words(a, b), 64) for a, b in scratch.steps(m)]))
    edges = np.unique(drawn[:: max(1, len(drawn) // (2 * parts))][1:])
    files = Queue(len(edges) + 1, scratch)
    for a, b in scratch.steps(m):
        to = np.searchsorted(edges, first_words(a, b), "right")
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            files.push(int(to[part[0]]), np.stack((a + part, following(a, b)[part]), axis=1))
    used = 0
    for k in range(len(edges) + 1):
        if got := list(files.pop(k)):
            which, after = np.concatenate(got).T
            found = _ranks(t, small, np.asarray(lms[which]).astype(np.int64), after, bits)
            names[which] = used + found
            used += int(found.max()) + 1
    return names, used


def _sorted_lms(t, small, lms, top: int, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order, with common prefixes in symbols of `t`: from their names, or the names' suffixes."""
    m = len(lms)
    names, used = _names(t, small, lms, top, scratch)
    if used == m:
        order, alike = scratch.places(m, m), None
        for a, b in scratch.steps(m):
            order[names[a:b]] = np.arange(a, b)
    else:
        order, alike = _suffixes(names, used - 1, most, scratch)
    starts, values = scratch.places(m, len(t)), scratch.array(m, np.uint16)
    for a, b in scratch.steps(m):
        mine = np.asarray(order[a:b]).astype(np.int64)
        starts[a:b] = lms[mine]
        left = np.append(order[a - 1] if a else mine[0], mine[:-1])
        same = np.zeros(b - a, np.int64) if alike is None else np.asarray(alike[a:b]).astype(np.int64)
        ended = np.maximum(left, mine) + same >= m  # one of them has no more names: its last one reaches the end
        at = np.minimum(np.stack((left, mine)) + same, m - 1)
        p, q = np.where(ended, len(t), lms[at[0]]), np.where(ended, len(t), lms[at[1]])
        shared = np.where(ended, len(t) - np.maximum(lms[left], lms[mine]), lms[at[1]] - lms[mine])
        values[a:b] = np.minimum(shared + matching(t, p, q, most), most)
    if m:
        values[0] = 0
    return starts, values


def _suffixes(t: np.ndarray, top: int, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    n = len(t)
    small = _types(t, scratch)
    lms = _lms(small, scratch)
    seeds, seed_prefixes = lms, np.zeros(len(lms), np.uint16)
    if len(lms) > 1:
        seeds, seed_prefixes = _sorted_lms(t, small, lms, top, most, scratch)
    large = scratch.array(n, bool)
    turned = scratch.array(n, t.dtype)
    for a, b in scratch.steps(n):
        large[a:b] = ~np.asarray(small[a:b])
        turned[a:b] = top - np.asarray(t[a:b])
    both, prefixes = _induce(t, large, seeds, seed_prefixes, n - 1, most, scratch)
    kept, kept_prefixes = _only(both, prefixes.values, large, scratch)
    del both, prefixes, seeds, seed_prefixes, lms, large
    down = np.zeros(1, np.uint16)
    back = kept_prefixes[::-1]  # of the turned order a suffix's neighbour is the one that came after
    back = _shifted(back, down, scratch)
    order, prefixes = _induce(turned, small, kept[::-1], back, -1, most, scratch)
    return order[::-1], _shifted(prefixes.values[::-1], down, scratch)


def _shifted(x: np.ndarray, first: np.ndarray, scratch: Scratch) -> np.ndarray:
    """`first`, then x without its last."""
    out = scratch.array(len(x), x.dtype)
    for a, b in scratch.steps(len(x)):
        out[a:b] = x[a - 1 : b - 1] if a else np.append(first, x[: b - 1])
    return out


def _only(order: np.ndarray, prefixes: np.ndarray, wanted: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The wanted suffixes alone: a common prefix is the least of those in between."""
    total = sum(int(np.count_nonzero(wanted[order[a:b]])) for a, b in scratch.steps(len(order)))
    out, values, at = scratch.places(total, len(wanted)), scratch.array(total, np.uint16), 0
    for pos, x in wanted_only(order, prefixes, lambda p: wanted[p], scratch):
        out[at : at + len(pos)], values[at : at + len(pos)] = pos, x
        at += len(pos)
    return out, values


def wanted_only(order, prefixes, wanted, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of the suffixes that `wanted` marks, with their common prefixes among themselves."""
    carried = 0
    for a, b in scratch.steps(len(order)):
        pos, x = np.asarray(order[a:b]), np.asarray(prefixes[a:b])
        at = np.flatnonzero(wanted(pos))
        if not len(at):
            carried = min(carried, int(x.min()))
            continue
        least = np.minimum.reduceat(x[: at[-1] + 1], np.append(0, at[:-1] + 1))
        least[0] = min(carried, int(least[0]))
        carried = int(x[at[-1] + 1 :].min(initial=65535))
        yield pos[at], least


def ordered(data: bytes, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the marked starts, those whose `size` bytes (8 at least) may stand twice, in order of these bytes, and which have
    all of them in common with the one before. For what fits in memory: some sixty bytes a byte.

    Prefix doubling: suffixes are ranked by 8 bytes, then by the ranks of as many neighbouring parts as fit in a word. A
    string with a part that stands once stands once itself, so it goes, and so do the parts that only such strings have.
    """
    n, deep = len(data), 8
    words = np.ndarray((max(0, n - 7),), ">u8", data, strides=(1,))
    starts, rank = np.flatnonzero(starts), np.zeros(n, np.int64)
    at, key = None, None
    while True:
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + size - deep + 1, -1)
        at = np.flatnonzero(np.cumsum(steps[:n]))  # where the parts of strings begin
        if deep == 8:
            key = words[at].astype(np.uint64)
        else:
            key = np.zeros(len(at), np.int64)
            for k in (*range(0, deep - part, part), deep - part):  # noqa: F821
                key = key << bits | rank[at + k]  # noqa: F821
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(at)]
        group = np.cumsum(new) - 1
        if deep == size or not len(at):
            return at, ~new
        rank[at] = group
        once = np.zeros(n + 1, np.int32)
        once[at + 1] = (np.bincount(group) == 1)[group]
        once = np.cumsum(once)
        starts = starts[once[starts + size - deep + 1] == once[starts]]
        bits = max(1, int(group[-1]).bit_length())
        part, deep = deep, min(size, deep * (63 // bits))


def suffix_array(t: np.ndarray, most: int = 65535, batch: int = 1 << 18, most_bytes: int = 1 << 22, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes of `t` (integers from 0) in order, a suffix before those it begins; and how many symbols
    each shares with the one before it, up to `most` (65,535 at most). `t` may be an array in a file."""
    if folder is None:
        with tempfile.TemporaryDirectory(prefix="suffixes-") as own:
            return suffix_array(t, most, batch, most_bytes, own)
    scratch = Scratch(folder, batch, most_bytes)
    if len(t) < 2:
        return np.arange(len(t)), np.zeros(len(t), np.uint16)
    return _suffixes(t, max(int(t[a:b].max()) for a, b in scratch.steps(len(t))), most, scratch)
