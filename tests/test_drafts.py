"""Recipients of drafts, however many requests name one thread or none."""

from pyspark.sql import functions as F

from mailsieve.operators import drafts


def test_requests_of_one_thread_and_of_none_are_spread(spark, messages, monkeypatch):
    monkeypatch.setattr(drafts, "_TOGETHER", 40, raising=False)
    rows = messages({"thread_id": "hot", "sender": "a@x.org"}, {"thread_id": "hot", "sender": "b@x.org"}, {"thread_id": "rare", "sender": "c@x.org"})
    n = F.col("request_id")
    requests = spark.range(0, 1200, 1, 6).select(F.col("id").alias("request_id")).select(
        "request_id",
        F.when(n % 3 == 0, F.array(F.lit("u@x.org"))).alias("to"),
        F.lit("s").alias("subject"),
        F.lit("b").alias("body"),
        F.when(n == 1, "rare").when(n == 4, "unknown").when(n % 3 == 1, "hot").alias("in_reply_to"),
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = drafts.resolve_recipients(requests, rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    to, hot = "recipient@example.com", ["a@x.org", "b@x.org"]
    want = {i: (["u@x.org"], sorted([*hot, to]), [])[i % 3] for i in range(1200)} | {1: sorted(["c@x.org", to]), 4: []}
    assert len(got) == 1200 and {r.request_id: sorted(r.recipients) for r in got} == want
    assert {r.request_id for r in got if r.error} == {i for i, found in want.items() if not found}
    tasks = [r.task for r in got]
    assert max(map(tasks.count, set(tasks))) < 300
