"""The physical plans: what reaches the scan, what is shuffled, what is not."""

import json
import re

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import threads
from mailsieve.operators.search import search
from mailsieve.operators.tables import touch_keys
from mailsieve.plans import requests
from mailsieve.plans.gateway import blocked, passed, process
from mailsieve.policy import Policy
from mailsieve.sources.messages import read_messages


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from mailsieve.checks.corpus import mail

    path = str(tmp_path_factory.mktemp("mail") / "m")
    mail(spark, "/root/testdata/sf0.001").drop("connection_id", "role").write.parquet(path)
    return read_messages(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)", text).group(1)))


def test_the_run_has_no_shuffle(stored):
    for df in (process(stored), passed(stored), blocked(stored)):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_verdict_reads_no_body(stored):
    text = plan(blocked(stored).select("id", "reason"))
    assert "body" not in columns_read(text)


def test_search_pushes_dates_and_prunes(stored):
    text = plan(search(stored, "after:2026/02/01 from:user1").select("id"))
    assert "GreaterThanOrEqual(sent_at" in text or "sent_at" in re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "body" not in columns_read(text)


def test_page_is_a_top_k(stored):
    from mailsieve.operators.paging import newest

    assert "TakeOrderedAndProject" in plan(newest(stored, 20))


def test_threads_aggregate_before_they_shuffle(stored):
    text = plan(threads.thread_facts(stored))
    assert text.count("Exchange") == 1 and "partial_" in text
    assert "body" not in columns_read(text)


def test_uses_are_reduced_before_the_join(spark):
    keys = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("long").alias("last_used_at"))
    uses = spark.range(100).select((F.col("id") % 3).cast("string").alias("key_id"), F.col("id").alias("used_at"))
    text = plan(touch_keys(keys, uses))
    assert text.index("Join") < text.index("HashAggregate")


def test_answers_about_threads(messages):
    rows = [{"thread_id": "a" if i % 2 else None, "subject": f"s{i}", "sender": "x@chase.com" if i == 3 else "u@example.com", "date": f"2026-01-{10 + i}T00:00:00Z"} for i in range(1, 8)]
    df, policy = messages(*rows), Policy(show_filtered_count=True)
    parts = {r.part: json.loads(r.response) for r in requests.thread_response(df, "a", policy, part_size=3).collect()}
    assert [[m["id"] for m in parts[k]["messages"]] for k in sorted(parts)] == [["msg-1", "msg-5"], ["msg-7"]]
    assert all(p["message_count"] == 4 and p["filtered_count"] == 1 and p["subject"] == "s1" for p in parts.values())
    nameless = [json.loads(r.response) for r in requests.thread_response(df, None, policy).collect()]
    assert len(nameless) == 1 and [m["id"] for m in nameless[0]["messages"]] == ["msg-2", "msg-4", "msg-6"]
    assert requests.thread_response(df, "unknown", policy).collect() == []
    first = json.loads(requests.threads_response(df, "", policy, n=1).head().response)
    assert (first["total_results"], first["threads"][0]["id"], "filtered_count" in first) == (2, "a", False)
    second = json.loads(requests.threads_response(df, "", policy, n=1, token=first["next_page_token"]).head().response)
    assert "id" not in second["threads"][0] and "next_page_token" not in second
    shut = json.loads(requests.threads_response(df, "", Policy(blocked_domains=("example.com",)), n=5).head().response)
    assert shut["threads"] == [] and shut["filtered_count"] == 2 and shut["total_results"] == 2
    none = json.loads(requests.threads_response(df.limit(0), "", policy).head().response)
    assert none["threads"] == [] and none["total_results"] == 0
