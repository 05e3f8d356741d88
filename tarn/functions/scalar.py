"""Vectors, times and numbers as Spark expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(v: Column, dimension: int | None = None) -> Column:
    """All components there and finite, and as many as asked for."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok & (F.size(v) == dimension) if dimension else ok


def parsed_time(text: Column, reference_year: int | None = None) -> Column:
    """The first format that fits, as UTC; a missing year is the reference year; null if none fits."""
    t = F.trim(text)
    formats = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE, d MMM, yyyy 'at' h:mm a", "d MMM yyyy", "d MMMM yyyy"]
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in formats if "EEE" not in f]
    tries.append(F.try_to_timestamp(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), F.lit("d MMM, yyyy 'at' h:mm a")))
    if reference_year:
        short = F.concat(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), F.lit(f" {reference_year}"))
        tries.append(F.try_to_timestamp(short, F.lit("d MMM 'at' h:mm a yyyy")))
    return F.coalesce(*tries)


def epoch_time(text: Column) -> Column:
    """Seconds since 1970 as text, with decimals, to a timestamp."""
    return F.timestamp_micros(F.round(text.try_cast("double") * 1e6).cast("long"))


def human_date(text: Column) -> Column:
    """15 September 2026, September 15, 2026 or 15/9/2026 (day first) to a date; null otherwise."""
    t = F.regexp_replace(F.trim(text), "(?i)(?<=\\d)(st|nd|rd|th)\\b", "")
    t = F.initcap(F.regexp_replace(F.regexp_replace(t, ",", ""), "\\s+", " "))
    day = lambda f: F.try_to_timestamp(t, F.lit(f)).cast("date")
    return F.coalesce(day("d MMMM yyyy"), day("MMMM d yyyy"), day("d/M/yyyy"))


def age_days(when: Column, now: datetime) -> Column:
    """Days, with fractions, from `when` to `now`."""
    at = F.lit(now).cast("timestamp_ntz")
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / 86_400_000_000.0


def recency(when: Column, now: datetime, days: float, most: float = 1.0) -> Column:
    """Falls in a line from `most` now to 0 at `days` of age; 0 without a time."""
    return F.coalesce(F.greatest(F.lit(0.0), most * (1 - age_days(when, now) / days)), F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many digits as the SQL has it: times a power of ten, rounded, divided. F.round goes by the decimal form.

    They part at halves that no double holds: 1/125 + 1/5120 is 0.0081953125, a product just below 8195312.5.
    """
    return F.round(x * 10.0**digits) / 10.0**digits


def backoff_seconds(attempts: Column, first: int = 30, most: int = 3600, doublings: int = 7) -> Column:
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.least(attempts, F.lit(doublings)))).cast("int")


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
