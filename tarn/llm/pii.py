"""Personal data: pattern rules, and a semi-Markov conditional random field that adds the spans they miss.

The field scores whole candidate segments (a run of characters, not a tag a character) and a bounded-entity dynamic
programme picks boundaries and types together. It is fitted here on sequences that this module makes up.

Entities are bounded by MOST_PARTS parts, but for addresses: the whole of a run that has an address's shape is a candidate
however long it is, so a long disguised address is never reported, or redacted, in part.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MOST_PARTS = 24  # parts in one entity at most; whole addresses may have more
REACH = 40  # characters of context around a digit or at-mark, before the ends move out to white space

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]|[\[(]at[\])]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of what the four patterns find, by start and then kind."""
    found = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            if start < last:
                continue
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, last := m.end()))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# The field: parts, candidate segments, whole-span features, dynamic programmes.

_PART = re.compile(r"[A-Za-z0-9_%]+|[^A-Za-z0-9_%\s]|\s")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+")
_AT_MARK = re.compile(r"@| ?[\[(]at[\])] ?")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(?:(?:\.| ?[\[(]dot[\])] ?)[0-9]{1,3}){3}")
_GROUPS = re.compile(r"[0-9]+(?:[ .-][0-9]+)*")
_LOOSE = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])*")
_DIAL = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}")
_GROUPED = {"3-3-4", "1-3-3-4", "2-3-3-4", "3-4-4", "2-4-4", "2-2-4-4", "3-2-4", "4-4-4", "4-4-4-4", "4-2-2"}
_CUES = {"email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "pay", "paid"}, "phone": {"phone", "call", "tel", "mobile", "fax"}}


def span_features(text: str, start: int, end: int, kind: str) -> list[str]:
    """What holds of the whole span text[start:end] as an entity of a kind."""
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    n = len(digits)
    fit = {"email": _MAIL, "ip": _QUAD, "card": _GROUPS, "phone": _DIAL}[kind].fullmatch(s) is not None
    out = [f"{kind}:shape={fit}"]
    if kind == "email":
        out.append(f"email:at={'@' in s or 'at' in s}")
    elif kind == "ip":
        out.append(f"ip:bytes={fit and all(int(x) < 256 for x in re.findall('[0-9]+', s))}")
    elif kind == "card":
        out += [f"card:len={14 <= n <= 19}", f"card:luhn={fit and 14 <= n <= 19 and luhn(digits)}", f"card:len16={n == 16}"]
    else:
        groups = "-".join(str(len(x)) for x in re.findall("[0-9]+", s))
        out += [f"phone:len={10 <= n <= 15}", f"phone:mark={s[0] in '+('}", f"phone:fit={fit and 10 <= n <= 13}", f"phone:groups={groups if groups in _GROUPED else n}"]
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append(f"{kind}:glued={bool(re.match('[A-Za-z0-9_]', before) or re.match('[A-Za-z0-9_]', after))}")
    out.append(f"{kind}:chained={bool(re.search('[0-9][ .-]?$', text[max(0, start - 2) : start]) or re.match('[ .-]?[0-9]', text[end : end + 2]))}")
    cue = re.findall("[a-z]+", text[max(0, start - 24) : start].lower())[-3:]
    out.append(f"{kind}:cue={bool(_CUES[kind] & set(cue))}")
    if kind == "email":
        more = re.match(r"(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9]", text[end : end + 8]) or re.search(r"[A-Za-z0-9][.+-]?$", text[max(0, start - 2) : start])
        out.append(f"email:cut={more is not None}")
    return out


def address_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the longest run around each at-mark that has an address's shape, whole however long it is.

    Two runs share no at-mark and no local part.
    """
    out, last = [], 0
    for m in _AT_MARK.finditer(text):
        host = _HOST.match(text, m.end())
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        while start < m.start() and text[start] in ".+-":
            start += 1
        last = m.end()
        if host and start < m.start():
            end = host.end()
            while not text[end - 1].isalnum():
                end -= 1
            if _MAIL.fullmatch(text, start, end):
                out.append((start, end))
    return out


def candidates(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(first part, part after the last, kind): segments that could be an entity.

    They have MOST_PARTS parts at most, but for the whole address runs.
    """
    out = []
    for a, b in address_runs(text):
        i, j = bisect_left(parts, (a, a)), bisect_left(parts, (b, b))
        if j - i > MOST_PARTS and parts[i][0] == a and parts[j - 1][1] == b:
            out.append((i, j, "email"))
    for i, (a, _) in enumerate(parts):
        c = text[a]
        if not (c.isalnum() or c in "+("):
            continue
        for j in range(i + 1, min(len(parts), i + MOST_PARTS) + 1):
            b = parts[j - 1][1]
            if not text[b - 1].isalnum():
                continue
            s = text[a:b]
            n = len(_DIGITS.findall(s))
            if _MAIL.fullmatch(s):
                out.append((i, j, "email"))
            if n >= 4 and _QUAD.fullmatch(s):
                out.append((i, j, "ip"))
            if 10 <= n <= 19 and _GROUPS.fullmatch(s):
                out.append((i, j, "card"))
            if 7 <= n <= 15 and _LOOSE.fullmatch(s):
                out.append((i, j, "phone"))
            if n > 19:
                break
    return out


def lattice(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    parts = [m.span() for m in _PART.finditer(text)]
    return parts, [(i, j, k, span_features(text, parts[i][0], parts[j - 1][1], k)) for i, j, k in candidates(text, parts)]


def viterbi(n: int, segments: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The best segmentation of n parts; a part outside all entities scores 0, ties go to fewer entities."""
    ending: dict[int, list] = {}
    for i, j, k, score in segments:
        ending.setdefault(j, []).append((i, k, score))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, score in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, k)
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _expected(n: int, segments: list[tuple[int, int, float]]) -> list[float]:
    """Each segment's probability under the field (forward and backward sums)."""
    ends, starts = {}, {}
    for s, (i, j, score) in enumerate(segments):
        ends.setdefault(j, []).append((i, score))
        starts.setdefault(i, []).append((j, score))
    fore, aft = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fore[j] = np.logaddexp.reduce([fore[j - 1], *(fore[i] + x for i, x in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        aft[i] = np.logaddexp.reduce([aft[i + 1], *(aft[j] + x for j, x in starts.get(i, ()))])
    return [float(np.exp(fore[i] + x + aft[j] - fore[n])) for i, j, x in segments]


def _made_up(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up sequence and its entities: plain, spaced, glued and disguised ones among look-alikes."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = rng.choice("3456") + number(rng.choice((14, 14, 14, 13)))
        s = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        sep = rng.choice(("", "", " ", "-"))
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone():
        area, a, b = number(3), number(3), number(4)
        return rng.choice((f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area} {a} {b}", f"{area}.{a}.{b}", f"(0{number(2)}) {number(4)} {b}", f"+44 {area} {a} {b}"))

    def entity():
        k = rng.choice(KINDS)
        host = f"{word()}.{rng.choice(('com', 'org', 'net'))}"
        s = {"email": rng.choice((f"{word()}@{host}", f"{word()}.{number(2)} (at) {word()} (dot) com", f"{word()}[at]{host}", f"{word()}.{word()}[at]{word()}.co.uk")), "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card(), "phone": phone()}[k]
        cue = rng.choice((*sorted(_CUES[k]), f"{rng.choice(sorted(_CUES[k]))} {rng.choice(('at', 'is', 'me', 'or', 'us on'))}")) + rng.choice((" ", ": ", ", "))
        return cue if rng.random() < 0.6 else "", s, k

    def decoy():
        bad = next(s for s in iter(lambda: number(16), None) if not luhn(s))
        return rng.choice((bad, f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", ".".join(str(rng.randint(256, 999)) for _ in range(4)), ".".join(number(1) for _ in range(5)), f"{number(4)}-{number(2)}-{number(2)}", number(rng.randint(1, 12)), number(24), f"{word()}@{word()}", f"{number(3)} {number(3)} {number(2)}", f"{word()}{number(16)}", f"{number(4)} {number(4)} {number(4)}", f"{number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{number(2)}.{number(2)}.{number(4)} {number(2)}:{number(2)}", f"{number(4)}-{number(2)}-{number(2)} {number(3)}", " ".join(number(rng.choice((2, 2, 3, 5))) for _ in range(rng.randint(3, 7))), f"{number(2)}.{number(4)} {number(1)}.{number(4)}", f"({number(2)} x {number(2)}) {number(3)}"))

    text, gold = "", []
    for _ in range(rng.randint(3, 9)):
        roll = rng.random()
        if roll < 0.3:
            cue, s, k = entity()
            text += cue
            gold.append((len(text), len(text) + len(s), k))
            text += s + rng.choice((" ", " ", ", ", ". "))
        elif roll < 0.5:
            text += decoy() + rng.choice((" x ", ", ", " and "))
        else:
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + " "
    return text, gold


@lru_cache(maxsize=4)
def fitted(sequences: int = 600, passes: int = 6, rate: float = 0.3, l2: float = 0.002, seed: int = 11) -> dict[str, float]:
    """Feature weights by stochastic gradient on the exact conditional likelihood of made-up sequences."""
    rng = random.Random(seed)
    data = []
    for _ in range(sequences):
        text, gold = _made_up(rng)
        parts, segments = lattice(text)
        truth = {(i, j, k) for i, j, k, _ in segments if (parts[i][0], parts[j - 1][1], k) in gold}
        data.append((len(parts), [(i, j, [*f, f"{k}:bias"], (i, j, k) in truth) for i, j, k, f in segments]))
    w: dict[str, float] = {}
    for p in range(passes):
        rng.shuffle(data)
        for n, segments in data:
            chances = _expected(n, [(i, j, sum(w.get(f, 0.0) for f in fs)) for i, j, fs, _ in segments])
            for (_, _, fs, true), chance in zip(segments, chances):
                for f in fs:
                    w[f] = w.get(f, 0.0) + rate / (1 + p) * (true - chance - l2 * w.get(f, 0.0))
    return w


def stretches(text: str) -> list[tuple[int, int]]:
    """Where an entity can lie: around every digit and at-mark, out to white space, and every address run as a whole."""
    words = [m.span() for m in _WORD.finditer(text)]
    near = [(max(0, m.start() - REACH), min(len(text), m.end() + REACH)) for m in _SEED.finditer(text)]
    out: list[list[int]] = []
    for a, b in sorted([*near, *address_runs(text)]):
        first, last = bisect_left(words, (a + 1,)) - 1, bisect_left(words, (b,)) - 1
        if first >= 0 and words[first][1] > a:
            a = words[first][0]
        if last >= 0:
            b = max(b, words[last][1])
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(text: str, base: list[tuple[int, int, int]], w: dict[str, float]) -> list[tuple[int, int, int]]:
    """The field's best segments that touch no span of `base`, in order. Only `stretches` can hold any."""
    taken: list[list[int]] = []
    for s, _, e in sorted(base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    out = []
    for a, b in stretches(text):
        piece = text[a:b]
        parts, segments = lattice(piece)
        scored = [(i, j, k, sum(w.get(f, 0.0) for f in (*fs, f"{k}:bias"))) for i, j, k, fs in segments]
        for i, j, k in viterbi(len(parts), scored):
            s, e = a + parts[i][0], a + parts[j - 1][1]
            at = bisect_left(taken, [e])
            if not at or taken[at - 1][1] <= s:
                out.append((s, KINDS.index(k), e))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: counts and digest of the base spans, and all spans with the field's additions.

    Whole texts are read; a null text counts as empty. Repeated rows and rows without id are searched like any other.
    """
    w = fitted()

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text) if text and _SEED.search(text) else []
            more = added_spans(text, base, w) if text and _SEED.search(text) else []
            counts = [sum(k == i for _, k, _ in base) for i in range(4)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), search(F.col(text_col).cast("string")).alias("r"))
    return rows.select("doc_id", "r.*")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span in `text_col` replaced by its kind in brackets, as [EMAIL]; null texts stay null."""
    w = fitted()

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text and _SEED.search(text):
                base = base_spans(text)
                last, pieces = 0, []
                for s, k, e in sorted(base + added_spans(text, base, w)):
                    if e > last:
                        pieces += [text[last:s] if s > last else "", f"[{KINDS[k].upper()}]"]
                        last = e
                text = "".join((*pieces, text[last:]))
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, redact(F.col(text_col).cast("string")))
