"""Recorded chat: one read, and a stream that is stopped, goes on and reads nothing twice."""

import json
import os
import tempfile

from tarn.sources import chat
from tarn.sources.chat import RecordedChat


def put(root, path, **page):
    os.makedirs(os.path.dirname(f"{root}/{path}.json"), exist_ok=True)
    with open(f"{root}/{path}.json", "w") as f:
        json.dump({"ok": True, **page}, f)


def recording():
    root = tempfile.mkdtemp(prefix="spark-")
    put(root, "channels/first", channels=[{"id": "C1", "name": "one"}], response_metadata={"next_cursor": "n"})
    put(root, "channels/n", channels=[{"id": "C2", "name": "two", "is_private": True, "topic": {"value": "t"}}])
    put(root, "users/first", members=[{"id": "U1", "name": "u", "profile": {"display_name": " ", "real_name": "U One", "email": "U@X.org"}}, {"id": "B1", "name": "bot", "is_bot": True}])
    put(root, "C1/first", messages=[{"ts": "1000.000002", "user": "U1", "text": "b"}], response_metadata={"next_cursor": "p2"})
    put(root, "C1/p2", messages=[{"ts": "999.000001", "user": "U1", "text": "a", "thread_ts": "999.000001", "reply_count": 1, "latest_reply": "1000.000001"}])
    put(root, "C1/replies-999.000001/first", messages=[{"ts": "999.000001", "user": "U1", "text": "a"}, {"ts": "1000.000001", "thread_ts": "999.000001", "bot_id": "B1", "text": "r", "edited": {"ts": "1001.0"}}])
    return root


def test_one_read(spark):
    spark.dataSource.register(RecordedChat)
    rows = spark.read.format("recorded_chat").load(recording())
    assert sorted((r.channel_id, r.name, r.is_private, r.topic) for r in chat.channels(rows).collect()) == [("C1", "one", False, None), ("C2", "two", True, "t")]
    assert sorted((r.user_id, r.name, r.email, r.is_bot) for r in chat.users(rows).collect()) == [("B1", "bot", None, True), ("U1", "U One", "u@x.org", False)]
    got = sorted((r.ts, r.is_reply, r.user_id, r.text, r.edited_ts) for r in chat.messages(rows, "https://h/").collect())
    assert got == [("1000.000001", True, "B1", "r", "1001.0"), ("1000.000002", False, "U1", "b", None), ("999.000001", False, "U1", "a", None)]
    links = {r.ts: r.permalink for r in chat.messages(rows, "https://h/").collect()}
    assert links["999.000001"] == "https://h/archives/C1/p999000001" and links["1000.000001"] == "https://h/archives/C1/p1000000001?thread_ts=999.000001&cid=C1"


def test_a_stream_reads_nothing_twice(spark):
    spark.dataSource.register(RecordedChat)
    root, out, checkpoint = recording(), tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")

    def run():
        rows = spark.readStream.format("recorded_chat").load(root)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        query.awaitTermination()
        return sorted((r.kind, r.channel, r.ts) for r in spark.read.schema(chat.SCHEMA).parquet(out).collect())

    first = [("message", "C1", "1000.000002"), ("message", "C1", "999.000001"), ("reply", "C1", "1000.000001")]
    assert run() == first
    assert run() == first  # a restart with nothing new
    put(root, "C1/first", messages=[{"ts": "10000.5", "user": "U1", "text": "c"}, {"ts": "1000.000002", "user": "U1", "text": "b"}], response_metadata={"next_cursor": "p2"})
    put(root, "C1/p2", messages=[{"ts": "999.000001", "user": "U1", "text": "a", "reply_count": 2, "latest_reply": "10000.6"}])
    put(root, "C1/replies-999.000001/first", messages=[{"ts": "1000.000001", "text": "r"}, {"ts": "10000.6", "thread_ts": "999.000001", "text": "late"}])
    put(root, "C2/first", messages=[{"ts": "5.0", "text": "another channel, older"}])
    assert run() == sorted([*first, ("message", "C1", "10000.5"), ("reply", "C1", "10000.6"), ("message", "C2", "5.0")])


def test_order_of_times():
    assert chat.at("999.9") < chat.at("1000.000001") < chat.at("1000.1") and chat.at(None) == (0, 0)
