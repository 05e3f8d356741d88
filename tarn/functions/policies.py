"""Who may read what: for each table the policies that admit a row, put on the scan by name.

A reader sees the rows that any policy of the table admits; a table without one shows nothing. Conditions on a row are
columns and reach the scan; a row that is seen because another table's row is seen becomes a semi-join with that table's
own guarded scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .access import RESTRICTED, ROLES


@dataclass(frozen=True)
class Reader:
    """Someone signed in (user) or nobody; a profile that is not active has no role."""

    role: str = "anon"
    user: str | None = None
    active: bool = True

    def has(self, role: str) -> bool:
        return self.active and ROLES.index(self.role) >= ROLES.index(role)


@dataclass(frozen=True)
class Policy:
    """Readers with `role` see rows where `rows` holds; `through` (table, its key, key here) asks that the row there is
    seen as well, under `there`."""

    role: str = "anon"
    rows: Callable[[Reader], Column] = lambda reader: F.lit(True)
    through: tuple[str, str, str] | None = None
    there: Callable[[], Column] = lambda: F.lit(True)


def _approved(*seen: str) -> Callable[[Reader], Column]:
    return lambda reader: (F.col("review_status") == "approved") & F.col("is_current") & F.col("visibility").isin(*seen)


def _unit(*seen: str) -> Callable[[Reader], Column]:
    return lambda reader: ~F.col("source_type").isin(*RESTRICTED) & F.col("visibility").isin(*seen) & (F.col("review_status") == "approved") & F.col("is_current") & ~F.col("is_stale") & ~F.col("is_deleted")


def _published(reader: Reader) -> Column:
    return (F.col("review_status") == "approved") & ~F.col("is_stale") & F.col("visibility").isin("member", "public")


ALL = Policy("committee")
ADMIN = Policy("admin")

# The tables, by who reads them.
COMMITTEE = (
    "officers", "meeting_attendees", "decisions", "action_items", "knowledge_articles", "knowledge_topics", "knowledge_roles", "knowledge_article_topics", "knowledge_article_roles",
    "knowledge_requirement_roles", "knowledge_process_roles", "knowledge_process_resources", "chat_channels", "chat_messages", "chat_users", "chat_channel_settings", "chat_reactions", "chat_message_links", "chat_files", "chat_message_changes",
)
PUBLISHED = ("knowledge_requirements", "knowledge_timing_rules", "knowledge_processes", "knowledge_process_steps", "knowledge_resources", "knowledge_contacts")
ADMINISTRATORS = (
    "auth_access_exceptions", "knowledge_article_changes", "knowledge_extraction_runs", "knowledge_review_events", "ingestion_runs", "document_versions", "document_source_changes",
    "meetings", "meeting_artifacts", "meeting_transcript_segments", "meeting_source_changes", "account_access_events", "mail_messages", "mail_checkpoints",
)

POLICIES: dict[str, tuple[Policy, ...]] = {
    **dict.fromkeys(COMMITTEE, (ALL,)),
    **dict.fromkeys(PUBLISHED, (ALL, Policy("member", _published))),
    **dict.fromkeys(ADMINISTRATORS, (ADMIN,)),
    "documents": (ADMIN, Policy("committee", lambda r: ~F.col("source_type").eqNullSafe("filesystem"))),
    "retrieval_units": (ADMIN, *(Policy(role, _unit(*seen)) for role, seen in (("anon", ("public",)), ("member", ("member", "public")), ("committee", ("committee", "member", "public"))))),
    "retrieval_embeddings": (Policy(through=("retrieval_units", "unit_id", "unit_id")),),
    "operational_records": (ADMIN, Policy("member", _approved("member", "public")), Policy("committee", _approved("committee", "member", "public"))),
    "operational_record_evidence": (Policy(through=("operational_records", "record_id", "record_id")),),
    "ticket_assignees": (Policy(through=("operational_records", "record_id", "ticket_id"), there=lambda: F.col("record_type") == "action_item"),),
    "operational_review_events": (ADMIN, Policy("committee", through=("operational_records", "record_id", "record_id"), there=lambda: (F.col("record_type") == "action_item") & (F.col("visibility") == "committee") & (F.col("review_status") == "approved") & F.col("is_current"))),
    "profiles": (ADMIN, Policy(rows=lambda r: F.col("auth_user_id") == F.lit(r.user) if r.user else F.lit(False))),
}


def guarded(name: str, reader: Reader, tables: Callable[[str], DataFrame], policies: dict[str, tuple[Policy, ...]] = POLICIES) -> DataFrame:
    """The rows of a table that a reader may see; `tables` gives a table by name, here and where a policy leads.

    Null conditions admit nothing. A row that several policies admit is there once.
    """
    rows = tables(name)
    mine = [p for p in policies.get(name, ()) if reader.has(p.role)]
    plain = [p.rows(reader) for p in mine if not p.through]
    seen = reduce(lambda a, b: a | b, plain, F.lit(False))
    led = [p for p in mine if p.through]
    if not led or any(p is ADMIN or p is ALL for p in mine):
        return rows.where(seen)
    for k, p in enumerate(led):
        other, key, here = p.through
        keys = guarded(other, reader, tables, policies).where(p.there()).select(F.col(key).alias(here)).distinct().withColumn(f"_seen{k}", F.lit(True))
        rows = rows.join(keys, here, "left")
        seen = seen | (F.col(f"_seen{k}").isNotNull() & p.rows(reader))
    return rows.where(seen).drop(*(f"_seen{k}" for k in range(len(led))))
