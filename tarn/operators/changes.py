"""Change detection between snapshots, merges and version history: state is a snapshot, every change an event."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows to append: the first of each key that is not stored."""
    first = incoming.dropDuplicates([key])
    return first.join(stored.select(key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], newer: Column) -> DataFrame:
    """Stored and incoming rows as one snapshot: of each key the one that `newer` orders first."""
    rows = stored.unionByName(incoming, allowMissingColumns=True)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(newer))).where("_n = 1").drop("_n")


def upsert_keeping(stored: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The incoming rows with what reviewers set (`kept`) taken over from the stored row of the same key."""
    old = stored.select(*keys, *(F.col(c).alias(f"_{c}") for c in kept))
    out = incoming.join(old, keys, "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in kept else F.col(c) for c in incoming.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], complete: bool = True, deleted: str | None = None) -> DataFrame:
    """(key, change_type, fields_changed): created, updated, restored, missing or unchanged.

    A key that is no longer there is missing only if the new snapshot is complete; one marked `deleted` before that is
    there again is restored.
    """
    a = old.select(F.col(key), *(F.col(f).alias(f"_old_{f}") for f in fields), (F.col(deleted) if deleted else F.lit(False)).alias("_gone"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), *(F.col(f).alias(f"_new_{f}") for f in fields), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_old_{f}").eqNullSafe(F.col(f"_new_{f}")), F.lit(f)) for f in fields)))
    kind = (
        F.when(F.col("_a").isNull(), "created")
        .when(F.col("_b").isNull(), "missing" if complete else "unchanged")
        .when(F.col("_gone"), "restored")
        .when(F.size(changed) > 0, "updated")
        .otherwise("unchanged")
    )
    fields_changed = F.when(kind == "updated", changed).otherwise(F.array().cast("array<string>"))
    out = both.select(key, kind.alias("change_type"), fields_changed.alias("fields_changed"), F.coalesce("_gone", F.lit(False)).alias("_gone"))
    return out.where(~((F.col("change_type") == "missing") & F.col("_gone"))).drop("_gone")


def listed_diff(stored: DataFrame, rows: DataFrame, summary: DataFrame, root: str = "root", key: str = "norm_path", fields: tuple[str, ...] = ("size", "modified")) -> DataFrame:
    """(root, key, change_type): stored files against a listing; what a root's listing lacks is missing only if it is complete.

    `rows` are the files that were listed, `summary` has (root, complete); a root without a row there was not looked at,
    and nothing of it is missing. Of a root that is not complete, what is not listed is unknown.
    """
    a = stored.select(F.col(root).alias("root"), F.col(key).alias("key"), *(F.col(f).alias(f"_old_{f}") for f in fields), F.lit(True).alias("_a"))
    b = rows.select(F.col(root).alias("root"), F.col(key).alias("key"), *(F.col(f).alias(f"_new_{f}") for f in fields), F.lit(True).alias("_b"))
    both = a.join(b, ["root", "key"], "full").join(summary.select("root", "complete"), "root", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_old_{f}").eqNullSafe(F.col(f"_new_{f}"))
    gone = F.when(F.coalesce("complete", F.lit(False)), "missing").otherwise("unknown")
    kind = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), gone).when(same, "unchanged").otherwise("updated")
    return both.select(F.col("root").alias(root), F.col("key").alias(key), kind.alias("change_type"))


def renames(missing: DataFrame, created: DataFrame, hash_col: str = "hash", path_col: str = "path") -> DataFrame:
    """(hash, old_path, new_path, change_type): files gone and files new that are each other's only one of a content.

    In the same folder it is a rename, else a move.
    """
    lone = lambda rows, name: rows.groupBy(hash_col).agg(F.count("*").alias("_n"), F.min(path_col).alias(name)).where("_n = 1").drop("_n")
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    both = lone(missing, "old_path").join(lone(created, "new_path"), hash_col)
    return both.withColumn("change_type", F.when(folder("old_path") == folder("new_path"), "renamed").otherwise("moved"))


def unchanged_files(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files (path, size, modified) that need no hashing: size and time as stored."""
    return listed.join(stored.select("path", "size", "modified"), ["path", "size", "modified"], "left_semi")


def duplicate_groups(rows: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(hash, copies, first_id) of contents held more than once; sizes are summed map-side first."""
    return rows.groupBy(hash_col).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def two_strikes(state: DataFrame, seen: DataFrame, key: str, now: datetime, hours: float = 6) -> DataFrame:
    """The state (key, misses, last_checked, deleted) after one look: deleted at a second miss `hours` after the first.

    What is seen again starts over; a miss that comes too soon after the last one does not count.
    """
    at = F.lit(now).cast("timestamp_ntz")
    there = state.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    is_seen = F.coalesce("_seen", F.lit(False))
    due = F.col("last_checked").isNull() | (F.col("misses") == 0) | (F.col("last_checked") <= F.lit(now - timedelta(hours=hours)).cast("timestamp_ntz"))
    misses = F.when(is_seen, F.lit(0)).when(due & ~F.col("deleted"), F.col("misses") + 1).otherwise(F.col("misses"))
    checked = F.when(is_seen | due, at).otherwise(F.col("last_checked"))
    gone = F.when(is_seen, F.lit(False)).otherwise(F.col("deleted") | (misses >= 2))
    return there.select(key, misses.cast("int").alias("misses"), checked.alias("last_checked"), gone.alias("deleted"))


def recheck_order(state: DataFrame, group: str, key: str, most: int = 200) -> DataFrame:
    """What to look at again, `most` of each group: a pending second strike first, then the longest unchecked."""
    by = Window.partitionBy(group).orderBy(F.desc(F.col("misses") > 0), F.col("last_checked").asc_nulls_first(), key)
    return state.where(~F.col("deleted")).withColumn("turn", F.row_number().over(by)).where(F.col("turn") <= most)


def since_watermark(rows: DataFrame, marks: DataFrame, group: str, time_col: str, look_back: timedelta, first_run: datetime | None = None) -> DataFrame:
    """Rows at or after their group's high-water mark less the look-back; groups without a mark from `first_run` on."""
    days = look_back.total_seconds() / 86400
    from_ = F.coalesce(F.col("high_water") - F.make_dt_interval(F.lit(int(days)), F.lit(int(look_back.total_seconds() % 86400 // 3600))), F.lit(first_run).cast("timestamp_ntz") if first_run else F.lit(None).cast("timestamp_ntz"))
    joined = rows.join(marks, group, "left")
    return joined.where(from_.isNull() | (F.col(time_col) >= from_)).drop("high_water")


def advanced(marks: DataFrame, loaded: DataFrame, group: str, time_col: str) -> DataFrame:
    """The marks after a successful load: the latest time seen, never earlier than before."""
    seen = loaded.groupBy(group).agg(F.max(time_col).alias("_seen"))
    return marks.join(seen, group, "full").select(group, F.greatest("high_water", "_seen").alias("high_water"))


def latest_checkpoint(rows: DataFrame, group: str, ts: str) -> DataFrame:
    """The largest of numbers kept as text, as it was written ("11.000" is after "9.000")."""
    return rows.groupBy(group).agg(F.max_by(ts, F.col(ts).try_cast("double")).alias(ts))


def merged_children(stored: DataFrame, incoming: DataFrame, keys: list[str], first_seen: str = "first_seen") -> DataFrame:
    """Children as incoming, with the first-seen time of those that were there before; withdrawn ones are gone."""
    old = stored.select(*keys, F.col(first_seen).alias("_first"))
    return incoming.join(old, keys, "left").withColumn(first_seen, F.coalesce("_first", first_seen)).drop("_first")


def replaced_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that come in, in place of those stored."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def retained(rows: DataFrame, time_col: str, now: datetime, days: int = 45) -> DataFrame:
    return rows.where(F.col(time_col) >= F.lit(now - timedelta(days=days)).cast("timestamp_ntz"))


def message_changes(stored: DataFrame, incoming: DataFrame, key: str = "ts") -> DataFrame:
    """(key, change): created, edited, restored, deleted or skipped, by content hash; only a deletion notice deletes."""
    a = stored.select(key, F.col("content_hash").alias("_h"), F.col("deleted").alias("_d"))
    both = incoming.join(a, key, "left")
    change = (
        F.when(F.col("_h").isNull(), F.when(F.col("deleted"), "skipped").otherwise("created"))
        .when(F.col("deleted"), F.when(F.col("_d"), "skipped").otherwise("deleted"))
        .when(F.col("_d"), "restored")
        .when(F.col("_h") != F.col("content_hash"), "edited")
        .otherwise("skipped")
    )
    return both.select(key, change.alias("change"))


def with_parent(messages: DataFrame, group: str, ts: str, thread: str) -> DataFrame:
    """Messages with their thread's root (parent_ts), none for roots themselves or roots that are not there."""
    roots = messages.select(F.col(group), F.col(ts).alias("parent_ts"))
    replies = messages.withColumn("_of", F.when(F.col(thread) != F.col(ts), F.col(thread)))
    return replies.join(roots, (replies[group] == roots[group]) & (replies["_of"] == roots["parent_ts"]), "left").drop(roots[group]).drop("_of")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children that name a parent which does not exist."""
    return children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def run_counters(diff: DataFrame, by: str = "change_type") -> DataFrame:
    """(change, n): how many rows of a run were created, updated and so on, and "seen" for all of them."""
    counted = diff.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias("change")).agg(F.count("*").alias("n"))
    return counted.unionByName(diff.agg(F.lit("seen").alias("change"), F.count("*").alias("n")).select("change", "n"))


def reactions(messages: DataFrame) -> DataFrame:
    """(message_id, name, user_id): who reacted how, each once, from `reactions` array<struct<name, users array>>.

    Names are trimmed; those without one, and messages or names without anybody, give nothing.
    """
    named = messages.select("message_id", F.explode("reactions").alias("r")).select("message_id", F.trim("r.name").alias("name"), F.explode("r.users").alias("user_id"))
    return named.where("name <> '' and user_id is not null").distinct()


def merge_reactions(stored: DataFrame, seen: DataFrame, now: datetime) -> DataFrame:
    """Stored reactions with those seen now: first_seen_at stays, last_seen_at moves, what is gone is left as it was."""
    at = F.lit(now).cast("timestamp_ntz")
    keys = ["message_id", "name", "user_id"]
    both = stored.join(seen.select(*keys, F.lit(True).alias("_seen")), keys, "full")
    last = F.when(F.col("_seen"), at).otherwise(F.col("last_seen_at"))
    return both.select(*keys, F.coalesce("first_seen_at", at).alias("first_seen_at"), last.alias("last_seen_at"))
