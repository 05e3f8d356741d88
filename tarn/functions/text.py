"""Text expressions: tokens, white space, evidence sentences, links, addresses, paths, mentions, query syntax."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[\\p{L}\\p{N}_]+"
EMAIL = "(?<![\\w.+-])[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+"
URL = "https?://[^\\s)\\]>]+"
MARKDOWN_LINK = "\\[([^\\]]+)\\]\\(((?:https?://|mailto:)[^)]+)\\)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order; no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def unwrapped(text: Column) -> Column:
    """Markdown images as their caption, links as "caption (target)", line ends as newlines."""
    t = F.regexp_replace(text, "!\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    t = F.regexp_replace(t, "\\[([^\\]]+)\\]\\(([^)]+)\\)", "$1 ($2)")
    return F.regexp_replace(t, "\\r\\n?", "\n")


def sentences(text: Column) -> Column:
    """Evidence units: stretches up to sentence marks or line ends, white space collapsed, empty ones dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^.!?\\n]+(?:[.!?]+|$|(?=\\n))"), 0)
    return F.filter(F.transform(found, collapsed), lambda s: s != "")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def sentence_spans(texts: pd.Series) -> pd.Series:
    """sentences() with offsets, which expressions cannot give."""
    pattern = re.compile(r"[^.!?\n]+(?:[.!?]+|$|(?=\n))")
    out = []
    for t in texts:
        rows = [(" ".join(m[0].split()), m.start(), m.end()) for m in pattern.finditer(t or "")]
        out.append([{"text": s, "start": a, "end": b} for s, a, b in rows if s])
    return pd.Series(out)


def emails(text: Column) -> Column:
    """Distinct lower-case addresses in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), 0)
    return F.array_distinct(F.transform(found, lambda e: F.lower(F.regexp_replace(e, "[.,;:)]+$", ""))))


def urls(text: Column) -> Column:
    """Distinct web addresses in order, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:]+$", "")))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, fragment dropped."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def normal_path(path: Column) -> Column:
    """Slashes forward, none at the ends, lower case. Non-ASCII names are composed (NFC) by nfc_path()."""
    return F.lower(F.trim(F.translate(path, "\\", "/"), F.lit("/")))


@F.pandas_udf(T.StringType())
def nfc_path(paths: pd.Series) -> pd.Series:
    import unicodedata

    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p.replace("\\", "/").strip("/")).casefold())


def like_pattern(query: str) -> str:
    """`query` as a literal inside LIKE."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", query) + "%"


def neutral_mentions(text: Column) -> Column:
    """Mass mentions kept from firing by a zero-width space after the sign."""
    return F.regexp_replace(text, "@(channel|here|everyone)\\b", "@​$1")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    out = text
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def named_list(items: Column) -> Column:
    """ "a", "a and b", "a, b, and c"."""
    n = F.size(items)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, items[0])
        .when(n == 2, F.array_join(items, " and "))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))
    )


def sections(most: int = 2800):
    """A pandas UDF text -> pieces of at most `most` code points, cut at a line end or blank where there is one."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        def pieces(t):
            t, out = (t or "").strip(), []
            while len(t) > most:
                cut = max(t.rfind("\n", 0, most + 1), t.rfind(" ", 0, most + 1))
                cut = cut if cut > 0 else most
                out.append(t[:cut].rstrip())
                t = t[cut:].lstrip()
            return [*out, t] if t else out

        return texts.map(pieces)

    return split


@dataclass(frozen=True)
class Query:
    """A parsed search: every group of `groups` must match (one of its terms or phrases), none of `none` may."""

    text: str
    groups: tuple[tuple[tuple[str, ...], ...], ...] = ()
    none: tuple[tuple[str, ...], ...] = ()
    words: tuple[str, ...] = field(default=())


def parse_query(text: str) -> Query:
    """Web-search syntax: words are all wanted, "quoted words" stand together, `or` joins neighbours, -x is unwanted."""
    groups: list[list[tuple[str, ...]]] = []
    none, alternative = [], False
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text.lower()):
        minus, body = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[4] == "or":
            alternative = bool(groups)
            continue
        terms = tuple(re.findall(r"[^\W]+", body))
        if not terms:
            continue
        if minus:
            none.append(terms)
        elif alternative:
            groups[-1].append(terms)
        else:
            groups.append([terms])
        alternative = False
    words = tuple(dict.fromkeys(w for g in groups for t in g for w in t))
    return Query(text, tuple(tuple(g) for g in groups), tuple(none), words)
