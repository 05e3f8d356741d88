"""Recorded chat workspaces: channels, users, messages and replies, in one read or as a stream that knows where it was.

A recording is a folder of answers: channels/, users/, one folder a channel with its history, and in that one folder
replies-<thread_ts> a thread, each with first.json and further pages by cursor. Nothing is fetched or posted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import RateLimited, pages

KINDS = {"channels": ("channel", "channels"), "users": ("user", "members")}
SCHEMA = "kind string, channel string, ts string, raw string"


def at(ts: str | None) -> tuple[int, int]:
    """A message's time as (seconds, micros); the text does not sort once the seconds gain a digit."""
    seconds, _, micros = (ts or "0").partition(".")
    return int(seconds or 0), int((micros or "0").ljust(6, "0")[:6])


def recorded(folder: str) -> Iterator[dict]:
    """The pages of one recorded listing, in order; a missing first page is an empty listing."""

    def fetch(cursor):
        with open(f"{folder}/{cursor or 'first'}.json", encoding="utf-8") as f:
            page = json.load(f)
        if page.get("error") == "ratelimited":
            raise RateLimited
        if page.get("ok") is False:
            raise ValueError(f"{folder}: {page.get('error', 'unknown error')}")
        return page

    if os.path.exists(f"{folder}/first.json"):
        yield from pages(fetch)


class Span(InputPartition):
    """A channel's messages after `since` and up to `until`; or a listing of channels or users."""

    def __init__(self, name: str, since: str | None = None, until: str | None = None):
        self.name, self.since, self.until = name, since, until


def read_span(path: str, span: Span) -> Iterator[tuple]:
    if span.name in KINDS:
        kind, field = KINDS[span.name]
        for page in recorded(f"{path}/{span.name}"):
            yield from ((kind, None, None, json.dumps(x, sort_keys=True)) for x in page.get(field, ()))
        return
    fits = lambda ts: (span.since is None or at(ts) > at(span.since)) and (span.until is None or at(ts) <= at(span.until))
    for page in recorded(f"{path}/{span.name}"):
        for m in page.get("messages", ()):
            if fits(m.get("ts")):
                yield "message", span.name, m.get("ts"), json.dumps(m, sort_keys=True)
            if m.get("reply_count") and (span.since is None or at(m.get("latest_reply") or m.get("ts")) > at(span.since)):
                for more in recorded(f"{path}/{span.name}/replies-{m['ts']}"):
                    for r in more.get("messages", ()):
                        if r.get("ts") != m["ts"] and fits(r.get("ts")):  # a thread's pages begin with its root
                            yield "reply", span.name, r.get("ts"), json.dumps(r, sort_keys=True)


class Recording:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")

    def channels(self) -> list[str]:
        return sorted(x["id"] for page in recorded(f"{self.path}/channels") for x in page.get("channels", ()))

    def newest(self, channel: str) -> str | None:
        """The time of a channel's last message or reply."""
        told = [ts for page in recorded(f"{self.path}/{channel}") for m in page.get("messages", ()) for ts in (m.get("ts"), m.get("latest_reply")) if ts]
        return max(told, key=at, default=None)


class ChatReader(Recording, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [Span("channels"), Span("users"), *map(Span, self.channels())]

    def read(self, span: Span) -> Iterator[tuple]:
        return read_span(self.path, span)


class ChatStream(Recording, DataSourceStreamReader):
    """Offsets are the newest time read of every channel; a channel that is new starts at its beginning."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {c: ts for c in self.channels() if (ts := self.newest(c))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(c, start.get(c), ts) for c, ts in sorted(end.items()) if at(ts) > at(start.get(c))]

    def read(self, span: Span) -> Iterator[tuple]:
        return read_span(self.path, span)


class RecordedChat(DataSource):
    """format "recorded_chat": rows of kind channel, user, message and reply; as a stream, messages and replies."""

    @classmethod
    def name(cls) -> str:
        return "recorded_chat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChatReader:
        return ChatReader({"path": self.options["path"]})

    def streamReader(self, schema) -> ChatStream:
        return ChatStream({"path": self.options["path"]})


_CHANNEL = "id string, name string, is_private boolean, is_archived boolean, topic struct<value: string>"
_USER = "id string, name string, deleted boolean, is_bot boolean, profile struct<real_name: string, display_name: string, email: string>"
_MESSAGE = "ts string, thread_ts string, user string, bot_id string, text string, subtype string, reply_count long, edited struct<ts: string>"


def channels(rows: DataFrame) -> DataFrame:
    """(channel_id, name, is_private, is_archived, topic); of several answers about a channel one stands."""
    x = rows.where("kind = 'channel'").select(F.from_json("raw", _CHANNEL).alias("x")).select("x.*").where("id is not null")
    return x.select(F.col("id").alias("channel_id"), "name", F.coalesce("is_private", F.lit(False)).alias("is_private"), F.coalesce("is_archived", F.lit(False)).alias("is_archived"), F.col("topic.value").alias("topic")).dropDuplicates(["channel_id"])


def users(rows: DataFrame) -> DataFrame:
    """(user_id, name, email, is_bot, deleted); the name shown is the display name, the real one, or the handle."""
    x = rows.where("kind = 'user'").select(F.from_json("raw", _USER).alias("x")).select("x.*").where("id is not null")
    shown = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("profile.display_name", "profile.real_name", "name")))
    return x.select(F.col("id").alias("user_id"), shown.alias("name"), F.lower("profile.email").alias("email"), F.coalesce("is_bot", F.lit(False)).alias("is_bot"), F.coalesce("deleted", F.lit(False)).alias("deleted")).dropDuplicates(["user_id"])


def permalink(host: str, channel: Column, ts: Column, thread_ts: Column) -> Column:
    """A message's address; a reply's names its thread."""
    link = F.concat(F.lit(f"{host.rstrip('/')}/archives/"), channel, F.lit("/p"), F.replace(ts, F.lit("."), F.lit("")))
    return F.when(thread_ts.isNotNull() & (thread_ts != ts), F.concat(link, F.lit("?thread_ts="), thread_ts, F.lit("&cid="), channel)).otherwise(link)


def messages(rows: DataFrame, host: str) -> DataFrame:
    """(channel_id, ts, thread_ts, is_reply, user_id, text, edited_ts, permalink) of messages and replies, each once.

    A reply that was also sent to the channel stands in its history and in its thread; it is one message. Joins, leaves
    and other notices (a subtype, but for thread_broadcast) are left out.
    """
    x = rows.where("kind in ('message', 'reply')").select("channel", "kind", F.from_json("raw", _MESSAGE).alias("x")).select("channel", "kind", "x.*")
    x = x.where("ts is not null and coalesce(subtype, 'thread_broadcast') = 'thread_broadcast'")
    told = x.groupBy("channel", "ts").agg(*(F.max(c).alias(c) for c in ("thread_ts", "user", "bot_id", "text")), F.max("edited.ts").alias("edited_ts"))
    reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts"))
    return told.select(F.col("channel").alias("channel_id"), "ts", "thread_ts", reply.alias("is_reply"), F.coalesce("user", "bot_id").alias("user_id"), "text", "edited_ts", permalink(host, F.col("channel"), F.col("ts"), F.col("thread_ts")).alias("permalink"))
