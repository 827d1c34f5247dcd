"""Custom rules through the index against every rule of every message's connection."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mailsieve.functions.regexes import needed
from mailsieve.operators import rule_index
from mailsieve.operators.blocklist import with_verdict
from mailsieve.operators.rule_index import custom_hits, indexed_policies
from mailsieve.operators.tenants import decode_policies, join_policies
from mailsieve.plans import gateway


@pytest.mark.parametrize(
    "pattern,wanted",
    [
        ("abc", ["abc"]),
        ("^INVOICE$", ["invoice"]),
        (r"\bverify\b.*now", ["verify"]),
        ("(invoice|receipt) #?\\d+", ["invoice", "receipt"]),
        ("ab+cd", ["bcd"]),
        ("abc{0}def", ["def"]),
        ("abc{2}def", ["cdef"]),
        ("(?:abcd)*efg", ["efg"]),
        ("(?:abcd)+", ["abcd"]),
        ("no-?reply@", ["reply@"]),
        ("(?=abcdef)x", []),
        ("(?<=abcdef)x", []),
        ("(?!abcdef)wxyz", ["wxyz"]),
        ("abcd|e", []),
        ("a.b.c", []),
        ("[abc]def\\.com", ["def.com"]),
        ("é1234", ["1234"]),
        ("(abc)\\1", ["abc"]),
        ("(unclosed", []),
    ],
)
def test_needed_strings(pattern, wanted):
    assert needed(pattern) == wanted


def test_every_match_contains_a_needed_string():
    rng = random.Random(3)
    pieces = ["a", "b", "abc", "bca", "(", ")", "(?:", "|", "*", "+", "?", "{2}", "{0,1}", "[ab]", ".", "^", "\\b", "c"]
    tried = told = 0
    for _ in range(30_000):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        strings = needed(pattern)
        if not strings:
            continue
        told += 1
        for _ in range(8):
            text = "".join(rng.choice(["a", "b", "c", "abc", "bca", " "]) for _ in range(rng.randint(0, 7)))
            if compiled.search(text):
                tried += 1
                assert any(s in text for s in strings), (pattern, text)
    assert told > 500 and tried > 500


RULES = ["user3@", "(sales|info)@", "^.{3}@", "[.]org$", "(bad", "x{3}", "ann", "(?<=ann)a"]
SUBJECTS = ["urgent|asap", "^re: .{4}$", "win+er", "[0-9]{3}", "", "free (gift|money)"]


def _tables(spark, messages):
    rng = random.Random(5)
    policies = [(f"c{i}", rng.sample(RULES, rng.randint(0, 2)), rng.sample(SUBJECTS, rng.randint(1, 5)), [["inbox"], [], [], ["sent"]][i % 4]) for i in range(12)]
    raw = spark.createDataFrame(policies, "connection_id string, s array<string>, t array<string>, f array<string>")
    raw = raw.select("connection_id", F.to_json("s").alias("blocked_sender_patterns_json"), F.to_json("t").alias("blocked_subject_patterns_json"), F.to_json("f").alias("allowed_folders_json"))
    senders = ["User3@example.com", "info@a.org", "abc@x.com", "anna@b.com", None, "", "xxx@y.de", "sales@c.com"]
    subjects = ["URGENT thing", "Re: abcd", "winnner", "call 123", None, "", "free money", "plain"]
    rows = messages(*({"sender": rng.choice(senders), "subject": rng.choice(subjects)} for _ in range(120)))
    return rows.withColumn("connection_id", F.concat(F.lit("c"), F.when(F.col("uid") % 19 > 0, F.pmod(F.col("uid") * 7, F.lit(14))).cast("string"))), decode_policies(raw)


@pytest.mark.parametrize("sent_rows", [100_000, 0])
def test_same_verdicts_as_without_the_index(spark, messages, sent_rows):
    rows, policies = _tables(spark, messages)
    verdicts = lambda joined, policy: sorted((r.id, r.reason or "") for r in with_verdict(joined, policy).collect())
    want = verdicts(*join_policies(rows, policies))
    joined, policy = indexed_policies(rows, policies, sent_rows)
    assert verdicts(joined, policy) == want and len(want) == 120
    kinds = {reason.partition(":")[0] for _, reason in want}
    assert {"Blocked sender pattern", "Blocked subject pattern", "Folder not in allowed list", ""} <= kinds | {""}


def test_rules_of_connections_without_messages_are_not_indexed(spark, messages, monkeypatch):
    """However many policies are stored, nothing is kept of those whose connection has no mail."""
    rows, policies = _tables(spark, messages)
    others = policies.drop("connection_id").crossJoin(spark.range(1000, 1200).select(F.col("id").cast("string").alias("connection_id")))
    stored = policies.unionByName(others)
    found = lambda df: sorted(map(tuple, df.collect()))
    want = found(custom_hits(rows, policies))
    assert found(custom_hits(rows, stored)) == want and len(want) > 5
    kept, real = [], rule_index.settled
    monkeypatch.setattr(rule_index, "settled", lambda df: kept.append(real(df)) or kept[-1])
    custom_hits(rows, stored)
    assert max(df.select("connection_id").distinct().count() for df in kept) <= 14


def test_messages_stay_where_they_are(spark, messages):
    """No body is in any exchange: each distinct text is judged on its own, hits are sent."""
    rows, policies = _tables(spark, messages)
    out = gateway.process_tenants(rows, policies, indexed=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert out.count() == 120
    assert set(custom_hits(rows, policies).columns) == {"connection_id", "list", "text", "shown"}


def test_no_rules_and_no_messages(spark, messages):
    rows, policies = _tables(spark, messages)
    assert custom_hits(rows.limit(0), policies).count() == 0
    assert custom_hits(rows, policies.limit(0)).count() == 0
    joined, policy = indexed_policies(rows, policies.limit(0))
    assert with_verdict(joined, policy).count() == 120
