"""Who may see a unit: scope, role and filter predicates as one Column below any ranking or limit."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roles from least to most, and the source types that only an administrator sees.
ROLES = ("anon", "member", "verified", "committee", "admin")
RESTRICTED = ("document", "slack_message", "meeting_transcript", "meeting_summary", "meeting_notes")
SEES = {"public": ("public",), "member": ("public", "member"), "verified": ("public", "member"), "committee": ("public", "member", "committee")}


def role_at_least(actual: Column, required: str) -> Column:
    rank = F.array_position(F.array(*map(F.lit, ROLES)), actual)
    return rank >= ROLES.index(required) + 1


def visible(scope: str) -> Column:
    """An administrator sees every row; others approved, current-enough rows of open source types at their level."""
    if scope == "admin":
        return F.lit(True)
    return ~F.col("source_type").isin(*RESTRICTED) & F.col("review_status").eqNullSafe("approved") & ~F.col("is_stale") & ~F.col("is_deleted") & F.col("visibility").isin(*SEES[scope])


def visible_public() -> Column:
    """What anyone may see, whatever the caller: as scope public, and current."""
    return visible("public") & F.col("is_current")


def event_time() -> Column:
    return F.coalesce("occurred_at", "source_updated_at", "updated_at")


@dataclass(frozen=True)
class Filters:
    """Optional conditions; one that is not given leaves no trace in the plan."""

    source_types: tuple[str, ...] = ()
    area: str | None = None
    topic: str | None = None
    channel: str | None = None
    author: str | None = None
    from_time: datetime | None = None
    to_time: datetime | None = None
    include_history: bool = False
    equal: dict = field(default_factory=dict)

    def column(self) -> Column:
        parts = [F.lit(True)]
        if self.source_types:
            parts.append(F.col("source_type").isin(*self.source_types))
        for name, value in (("source_area", self.area), ("topic", self.topic), ("channel", self.channel), ("author", self.author), *self.equal.items()):
            if value is not None:
                parts.append(F.col(name) == F.lit(value))
        if self.from_time is not None:
            parts.append(event_time() >= F.lit(self.from_time).cast("timestamp_ntz"))
        if self.to_time is not None:
            parts.append(event_time() < F.lit(self.to_time).cast("timestamp_ntz"))
        if not self.include_history:
            parts.append(F.col("is_current"))
        return reduce(lambda a, b: a & b, parts)


def domain_allowed(email: Column, domains: tuple[str, ...]) -> Column:
    """Exactly one at-sign and a host that is on the list, case aside."""
    parts = F.split(F.lower(F.trim(email)), "@")
    return (F.size(parts) == 2) & (parts[0] != "") & F.element_at(parts, -1).isin(*(d.lower() for d in domains))


def access_granted(email: Column, domains: tuple[str, ...], active: Column, expires: Column, now: datetime) -> Column:
    """A listed domain, or an exception that is active and has not run out."""
    return domain_allowed(email, domains) | F.coalesce(active & (expires.isNull() | (expires > F.lit(now))), F.lit(False))
