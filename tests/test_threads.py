"""Threads: participants, positions, transcripts, also of very large threads."""

import random

from pyspark.sql import functions as F

from mailsieve.operators import analyses, threads


def people(df, *rows):
    """(thread, minute, uid, from (name, email), to [(name, email)], labels)"""
    data = [(t, m, u, f, to, labels) for t, m, u, f, to, labels in rows]
    schema = (
        "thread_id string, minute int, uid long, from struct<name:string,email:string>,"
        "to array<struct<name:string,email:string>>, labels array<string>"
    )
    base = df.sparkSession.createDataFrame(data, schema)
    return base.withColumns(
        {
            "sent_at": F.timestamp_seconds(F.col("minute") * 60),
            "date": F.col("minute").cast("string"),
            "subject": F.concat(F.lit("s"), F.col("uid").cast("string")),
            "snippet": F.concat(F.lit("n"), F.col("uid").cast("string")),
            "is_unread": F.col("uid") == 2,
        }
    )


def test_last_name_wins_and_first_place_stays(messages):
    df = people(
        messages({}),
        ("t", 1, 1, ("Old A", "a@x"), [("B", "b@x")], ["L1"]),
        ("t", 2, 2, ("B2", "b@x"), [("New A", "a@x"), ("C", "c@x")], ["L2", "L1"]),
    )
    newest = threads.threads(df).head()
    assert [(p["email"], p["name"]) for p in newest["participants"]] == [("b@x", "B"), ("a@x", "Old A"), ("c@x", "C")]
    assert newest["labels"] == ["L2", "L1"] and newest["subject"] == "s2" and newest["snippet"] == "n2"
    assert newest["message_count"] == 2 and newest["is_unread"]
    oldest = threads.threads(df, newest_first=False, subject_from="first").head()
    assert [(p["email"], p["name"]) for p in oldest["participants"]] == [("a@x", "New A"), ("b@x", "B2"), ("c@x", "C")]
    assert oldest["labels"] == ["L1", "L2"] and oldest["subject"] == "s1" and oldest["snippet"] == "n2"


def test_blocked_only_when_everyone_is(messages):
    df = people(
        messages({}),
        ("all", 1, 1, ("", "x@chase.com"), [("", "y@a.paypal.com")], []),
        ("mixed", 1, 2, ("", "x@chase.com"), [("", "y@ok.org")], []),
    )
    assert {r["thread_id"]: r["thread_blocked"] for r in threads.blocked_threads(df).collect()} == {"all": True, "mixed": False}


def test_positions_and_parts_of_a_hot_thread(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"t{rng.randint(0, 20)}", rng.randint(0, 5000), u) for u in range(4000)]
    df = spark.createDataFrame(rows, "thread_id string, s long, uid long").repartition(6)
    df = df.withColumns(
        {
            "sent_at": F.timestamp_seconds("s"),
            "from": F.struct(F.lit("").alias("name"), F.lit("a@x").alias("email")),
            "body": F.col("uid").cast("string"),
        }
    )
    want = {}
    for t in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], -r[2])), 1):
            want[r[2]] = i
    got = {r["uid"]: r["position"] for r in threads.with_position(df, 100).collect()}
    assert got == want
    parts = analyses.transcripts(df, part_size=50).filter("thread_id = 'hot'").orderBy("part").collect()
    whole = "\n\n".join(p["transcript"] for p in parts)
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: want[r[2]])
    assert whole == "\n\n".join(f"a@x: {r[2]}" for r in hot)
    assert max(p["n_messages"] for p in parts) == 50


def test_empty_thread_list_is_kept(messages):
    from mailsieve.operators.blocklist import thread_blocked
    from mailsieve.policy import Policy

    df = messages({}).withColumn("p", F.array().cast("array<struct<name:string,email:string>>"))
    assert not df.select(thread_blocked(F.col("p"), Policy()).alias("b")).head()["b"]


def without_thread(messages):
    """(thread, minute) of messages, some without either; None is a thread like others."""
    rows = [("a", 9), ("b", 5), (None, 5), ("c", 5), ("c", None), (None, None), ("d", 1), ("e", None), ("f", None)]
    return people(messages({}), *((t, m, u, ("", f"{t}@x"), [], [f"L{t}"]) for u, (t, m) in enumerate(rows, 1)))


def test_messages_without_a_thread_are_on_a_page(messages):
    df = without_thread(messages)
    undated = df.withColumn("sent_at", F.when(F.col("thread_id").isNotNull(), F.col("sent_at")))
    for case, order in ((df, ["a", "b", "c", None, "d", "e", "f"]), (undated, ["a", "b", "c", "d", "e", "f", None])):
        for n in (1, 2, 3, 10):
            seen, token = [], None
            while rows := threads.thread_page(case, n, token=token).collect():
                seen, token = seen + rows, rows[-1]["page_token"]
            assert [r["id"] for r in seen] == order
            none = next(r for r in seen if r["id"] is None)
            assert none["message_count"] == 2 and none["labels"] == ["LNone"]
            assert [p["email"] for p in none["participants"]] == ["None@x"]


def test_lists_of_threads_have_those_without_an_id(messages):
    from mailsieve.plans import requests

    df = messages({"thread_id": None}, {"thread_id": "t"}, {"thread_id": None})
    assert {r["id"] for r in requests.list_threads(df).collect()} == {None, "t"}


def test_facts_of_undated_threads(messages):
    facts = {r["id"]: r for r in threads.thread_facts(without_thread(messages)).collect()}
    assert {i: r["message_count"] for i, r in facts.items()} == {"a": 1, "b": 1, None: 2, "c": 2, "d": 1, "e": 1, "f": 1}
    assert facts["e"]["last_sent_at"] is None and facts["e"]["subject"] == "s8"
