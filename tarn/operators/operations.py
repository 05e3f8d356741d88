"""Queues, health, tickets, accounts and state machines over event logs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar


def _at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def health(rows: DataFrame, measures: dict[str, Column], first: dict[str, tuple[str, Column]] | None = None, last: dict[str, tuple[str, Column]] | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts of the rows that meet each condition, with the earliest and latest time of others, in one pass."""
    out = [F.count_if(c).alias(n) for n, c in measures.items()]
    out += [F.min(F.when(c, F.col(t))).alias(n) for n, (t, c) in (first or {}).items()]
    out += [F.max(F.when(c, F.col(t))).alias(n) for n, (t, c) in (last or {}).items()]
    return rows.groupBy(*(by or [])).agg(*out)


def pivot_counts(rows: DataFrame, by: str, of: str, values: list[str]) -> DataFrame:
    """A row a `by` with the count of each listed value of `of`."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(of) == v).alias(f"n_{i}") for i, v in enumerate(values)), F.count("*").alias("n_all"))


def refresh_due(checkpoints: DataFrame, now: datetime, hours: float = 12, time_col: str = "checked_at", force: bool = False) -> DataFrame:
    """One row: the oldest checkpoint and whether a refresh is due (forced, one missing, or the oldest `hours` old)."""
    due = F.lit(force) | F.bool_or(F.col(time_col).isNull()) | (F.min(time_col) <= F.lit(now - timedelta(hours=hours)).cast("timestamp_ntz"))
    return checkpoints.agg(F.count("*").alias("checkpoints"), F.min(time_col).alias("oldest"), due.alias("due"))


def numbered(rows: DataFrame, code: str, order: list[str], prefix: str = "ACTION-") -> DataFrame:
    """Rows without a code get the next numbers after the largest in use, in order; three digits, more where needed."""
    pattern = f"^{prefix}(\\d+)$"
    used = rows.agg(F.coalesce(F.max(F.nullif(F.regexp_extract(F.coalesce(F.col(code), F.lit("")), pattern, 1), F.lit("")).cast("int")), F.lit(0)).alias("_top"))
    nth = F.row_number().over(Window.orderBy(*order))  # of the rows still without a code
    fresh = rows.where(F.col(code).isNull()).withColumn("_n", nth).join(used.select("_top"), F.lit(True), "inner")
    named = fresh.withColumn(code, F.concat(F.lit(prefix), F.format_string("%03d", (F.col("_top") + F.col("_n")).cast("int")))).drop("_n", "_top")
    return rows.where(F.col(code).isNotNull()).unionByName(named)


def head_of_line(outbox: DataFrame, key: str, order: str, state: str = "state", done: str = "posted") -> DataFrame:
    """The first event of each key that is not done; what comes after it waits."""
    waiting = outbox.where(F.col(state) != done)
    first = waiting.groupBy(key).agg(F.min(order).alias("_first"))
    return waiting.join(first, (waiting[key] == first[key]) & (waiting[order] == first["_first"]), "left_semi")


def claimable(outbox: DataFrame, now: datetime, key: str = "ticket_id", order: str = "id", most: int = 20, stale_hours: float = 2) -> DataFrame:
    """The heads of line to send now: pending or due again, or claimed so long ago that the claim has lapsed."""
    at = _at(now)
    ready = (F.col("state") == "pending") | ((F.col("state") == "retry") & (F.col("retry_at") <= at)) | ((F.col("state") == "sending") & (F.col("claimed_at") <= F.lit(now - timedelta(hours=stale_hours)).cast("timestamp_ntz")))
    return head_of_line(outbox, key, order).where(ready).orderBy(order).limit(most)


def settled(outbox: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """The outbox after its outcomes (id, outcome): posted stays posted, rejected retries later, unknown is uncertain."""
    rows = outbox.join(outcomes, "id", "left")
    state = F.when(F.col("outcome") == "posted", "posted").when(F.col("outcome") == "rejected", "retry").when(F.col("outcome") == "unknown", "uncertain").otherwise(F.col("state"))
    state = F.when(F.col("state") == "posted", "posted").otherwise(state)
    attempts = F.col("attempts") + F.when(F.col("outcome").isNotNull() & (F.col("state") != "posted"), 1).otherwise(0)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), scalar.backoff_seconds(attempts))
    retry = F.when(state == "retry", F.when(F.col("outcome") == "rejected", _at(now) + wait).otherwise(F.col("retry_at")))
    return rows.withColumns({"_s": state, "_n": attempts.cast("int"), "_r": retry}).drop("state", "attempts", "retry_at", "outcome").withColumnsRenamed({"_s": "state", "_n": "attempts", "_r": "retry_at"})


# How final a delivery status is, for events of one time.
SEVERITY = {"complained": 5, "bounced": 4, "failed": 3, "delivered": 2, "sent": 1}


def latest_status(events: DataFrame, key: str, status: str, at: str, severity: dict[str, int] = SEVERITY, now: datetime | None = None) -> DataFrame:
    """(key, status, at) by latest time, ties to the more final status; with `now`, only events of the last 60 days to
    one day ahead count."""
    rows = events
    if now is not None:
        rows = rows.where((F.col(at) >= F.lit(now - timedelta(days=60)).cast("timestamp_ntz")) & (F.col(at) <= F.lit(now + timedelta(days=1)).cast("timestamp_ntz")))
    rank = F.lit(0)
    for name, level in severity.items():
        rank = F.when(F.col(status) == name, level).otherwise(rank)
    last = F.max(F.struct(F.col(at).alias("at"), rank.alias("rank"), F.col(status).alias("status"))).alias("last")
    return rows.groupBy(key).agg(last).select(key, F.col("last.status").alias(status), F.col("last.at").alias(at))


# Two providers' event names and the states they stand for.
PROVIDER_STATES = {"delivered": "delivered", "delivery": "delivered", "bounced": "bounced", "bounce": "bounced", "hard_bounce": "bounced", "complained": "complained", "spam": "complained", "failed": "failed", "blocked": "failed", "sent": "sent", "request": "sent"}


def provider_state(event: Column) -> Column:
    """A provider's event name to a delivery state; null if it has none."""
    name = F.regexp_replace(F.lower(event), "^(email[.])", "")
    return F.create_map(*(F.lit(x) for pair in PROVIDER_STATES.items() for x in pair))[name]


def spaced(rows: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """Rows that come at least so long after the one before them of their key (the rate window)."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    return rows.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds)).drop("_gap")


def reminder_jobs(assignments: DataFrame, now: datetime, delay_minutes: int = 2) -> DataFrame:
    """(ticket_id, due_at, due): a timer from a ticket's first assignment of its latest version; older versions lapse."""
    latest = assignments.groupBy("ticket_id").agg(F.max("version").alias("version"))
    rows = assignments.join(latest, ["ticket_id", "version"]).groupBy("ticket_id").agg((F.min("at") + F.expr(f"interval {int(delay_minutes)} minutes")).alias("due_at"))
    return rows.withColumn("due", F.col("due_at") <= _at(now))


def repost_eligible(tickets: DataFrame, messages: DataFrame, archive_at: datetime, now: datetime, days: int = 21, fresh_hours: float = 2) -> DataFrame:
    """Open tickets whose last message is `days` old, with its number; none while the archive is not fresh.

    `messages` is (ticket_id, ts text, closed boolean); the last is by number, and a check on it closes the ticket.
    """
    if now - archive_at > timedelta(hours=fresh_hours):
        return tickets.where(F.lit(False)).withColumn("ts", F.lit(None).cast("string"))
    last = messages.groupBy("ticket_id").agg(F.max_by(F.struct("ts", "closed"), F.col("ts").try_cast("double")).alias("last"))
    rows = tickets.where(F.col("status") == "open").join(last, "ticket_id")
    old = F.col("last.ts").try_cast("double") <= (now - timedelta(days=days)).timestamp()
    return rows.where(~F.col("last.closed") & old).withColumn("ts", F.col("last.ts")).drop("last")


def recipients(assignees: DataFrame, officers: DataFrame, profiles: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(ticket_id, email): assigned officers that are active and have an active profile with one of the roles."""
    people = officers.where("active").select("officer_id", "profile_id").join(profiles.where(F.col("active") & F.col("role").isin(*roles)).select("profile_id", "email"), "profile_id")
    return assignees.join(people, "officer_id").select("ticket_id", F.lower("email").alias("email")).distinct()


def ticket_history(events: DataFrame, people: DataFrame, most: int = 2000) -> DataFrame:
    """Events newest first with a display name: the person's, else the address before its at-sign, else "Unknown"."""
    rows = events.join(people, "actor_id", "left")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.split_part("email", F.lit("@"), F.lit(1)), F.lit("")), F.lit("Unknown"))
    return rows.withColumn("display_name", name).orderBy(F.desc("at"), F.desc("event_id")).limit(most).drop("name", "email")


def progress_maps(rows: DataFrame, key: str, person: str, status: str, at: str) -> DataFrame:
    """(key, statuses map person -> latest status, done, everyone): individual progress on shared work."""
    last = rows.groupBy(key, person).agg(F.max_by(status, F.struct(at, status)).alias("_s"))
    return last.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(person, "_s")))).alias("statuses"),
        F.count_if(F.col("_s") == "completed").alias("done"),
        F.count("*").alias("everyone"),
    )


def evidence(messages: DataFrame, channels: DataFrame, units: DataFrame, now: datetime, days: float = 30, limit: int = 12) -> DataFrame:
    """Recent messages of open channels with their current unit's first chunk: id, text and a score falling with age."""
    recent = messages.where((F.col("at") >= F.lit(now - timedelta(days=days)).cast("timestamp_ntz")) & ~F.col("deleted"))
    open_ = recent.join(channels.where("is_public and enabled").select("channel_id"), "channel_id", "left_semi")
    first = units.where("chunk_index = 0 and is_current").select(F.col("source_record_id"), F.col("source_version_id"), "unit_id", "title")
    rows = open_.join(first, (open_["message_id"].cast("string") == first["source_record_id"]) & (open_["content_hash"] == first["source_version_id"]))
    score = F.round(1 - F.greatest(F.lit(0.0), scalar.age_days(F.col("at"), now) / days), 6)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "unit_id").limit(min(max(limit, 1), 12)).select("unit_id", "message_id", "title", "score")


def over_cap(accounts: DataFrame, role: str, most: int = 2, order: tuple[str, ...] = ("created_at", "account_id")) -> DataFrame:
    """Active accounts beyond the first `most` of an officer role."""
    nth = F.row_number().over(Window.partitionBy(role).orderBy(*order))
    return accounts.where("active").withColumn("nth", nth).where(F.col("nth") > most)


def field_changes(before: Column, after: Column) -> Column:
    """Of two string maps, what differs: key -> struct(before, after)."""
    pairs = F.map_zip_with(before, after, lambda k, a, b: F.struct(a.alias("before"), b.alias("after")))
    return F.map_filter(pairs, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


def version_notices(accounts: DataFrame, key: str = "account_id", version: str = "version", status: str = "status") -> DataFrame:
    """(account, version, from, to): one notice for each version that changed the status."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(version))
    return accounts.withColumn("from_status", before).where(~F.col("from_status").eqNullSafe(F.col(status))).select(key, version, "from_status", F.col(status).alias("to_status"))


def union_legacy(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions and action items as operational records of one shape."""
    a = decisions.select(F.concat(F.lit("decision:"), F.col("id").cast("string")).alias("record_id"), F.lit("decision").alias("record_type"), "title", F.lit("approved").alias("review_status"), F.lit(None).cast("string").alias("execution_status"))
    done = F.when(F.col("status").isin("F", "done"), "completed").when(F.col("status").isin("P", "doing"), "in_progress").otherwise("open")
    b = actions.select(F.concat(F.lit("action:"), F.col("id").cast("string")).alias("record_id"), F.lit("action").alias("record_type"), "title", F.lit("proposed").alias("review_status"), done.alias("execution_status"))
    return a.unionByName(b, allowMissingColumns=True)


def or_default(rows: DataFrame, default: DataFrame) -> DataFrame:
    """The rows, or the default row if there are none."""
    none = rows.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return rows.unionByName(default.join(none.select(F.lit(1).alias("_one")), F.lit(True), "left_semi"))


def duplicate_titles(drafts: DataFrame, tickets: DataFrame) -> DataFrame:
    """Drafts with a title that no open ticket has, case and blanks aside."""
    key = F.lower(F.trim(F.regexp_replace("title", "\\s+", " ")))
    return drafts.withColumn("_t", key).join(tickets.where("status <> 'completed'").select(key.alias("_t")).distinct(), "_t", "left_anti").drop("_t")
