"""Fragments of a text around the words of a search, wanted words marked."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

START, STOP, BETWEEN = "<mark>", "</mark>", " ... "


def best_window(spots: list[tuple[int, str]], most: int) -> tuple[int, int] | None:
    """(first, last) place of the best window over `spots` (place, word), in order: most different words, then most
    places, then the shortest, then the first. A window begins and ends with a spot and is `most` long at most."""
    best, held, j = None, Counter(), 0
    for i, (first, _) in enumerate(spots):
        if i:
            word = spots[i - 1][1]
            held[word] -= 1
            if not held[word]:
                del held[word]
        while j < len(spots) and spots[j][0] - first < most:
            held[spots[j][1]] += 1
            j += 1
        last = spots[j - 1][0]
        key = len(held), j - i, first - last, -first
        if best is None or key > best[0]:
            best = key, (first, last)
    return best and best[1]


def windows(spots: list[tuple[int, str]], most: int, fragments: int) -> list[tuple[int, int]]:
    """Up to `fragments` windows: the best one, then the best that overlaps none before it; by place."""
    chosen: list[tuple[int, int]] = []
    while len(chosen) < fragments:
        edges = [-1, *(x for w in sorted(chosen) for x in w), float("inf")]
        free = [[s for s in spots if lo < s[0] < hi] for lo, hi in zip(edges[::2], edges[1::2])]
        found = [w for part in free if (w := best_window(part, most))]
        if not found:
            break
        rank = lambda w: (len({t for p, t in spots if w[0] <= p <= w[1]}), sum(w[0] <= p <= w[1] for p, _ in spots), w[0] - w[1], -w[0])
        chosen.append(max(found, key=rank))
    return sorted(chosen)


def stretched(chosen: list[tuple[int, int]], n: int, least: int) -> list[tuple[int, int]]:
    """The windows with words around them up to `least` each, half before and half after where there is room."""
    out: list[tuple[int, int]] = []
    for k, (first, last) in enumerate(chosen):
        low = out[-1][1] + 1 if out else 0
        high = chosen[k + 1][0] - 1 if k + 1 < len(chosen) else n - 1
        need = max(0, least - (last - first + 1))
        before = min(need // 2, first - low)
        after = min(need - before, high - last)
        before = min(need - after, first - low)
        out.append((first - before, last + after))
    return out


def marked(text: str | None, words: frozenset[str], fragments: int = 2, most: int = 50, least: int = 15) -> str:
    """The fragments of a text; without any wanted word its first `least` words."""
    parts = (text or "").split()
    spots = []
    for at, part in enumerate(parts):
        found = next((t for t in re.findall(r"\w+", part.lower()) if t in words), None)
        if found:
            spots.append((at, found))
    if not spots:
        return " ".join(parts[:least])
    wanted = {at for at, _ in spots}
    shown = stretched(windows(spots, most, fragments), len(parts), least)
    return BETWEEN.join(" ".join(f"{START}{parts[k]}{STOP}" if k in wanted else parts[k] for k in range(a, b + 1)) for a, b in shown)


def snippet(words: list[str], fragments: int = 2, most: int = 50, least: int = 15):
    """A pandas UDF text -> marked fragments; null is an empty text. The whole text is looked at."""
    wanted = frozenset(w.lower() for w in words)

    @F.pandas_udf("string")
    def show(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: marked(t, wanted, fragments, most, least))

    return show
