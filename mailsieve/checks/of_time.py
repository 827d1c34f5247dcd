"""Rate limiting over all events, and streams over all mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.checks.corpus import ATTEMPTS_SQL, MAIL_SQL, attempts, mail_of, raw_policies, table
from mailsieve.checks.of_policy import _RUN_COLUMNS, _TENANT_SQL, RUN_SQL, _run_columns
from mailsieve.checks.registry import check
from mailsieve.folders import new_folder
from mailsieve.operators import ratelimit
from mailsieve.operators.tenants import decode_policies
from mailsieve.streaming.gateway import write_stream
from mailsieve.streaming.policies import publish, write_judged_stream
from mailsieve.streaming.ratelimit import limit_stream

DAY_MS = 86_400_000


def _limiter_sql(window_ms: int, limit: int) -> str:
    """One step per attempt of a key, all keys side by side."""
    live = f"list_filter(log, lambda x: n.at_ms - x < {window_ms})"
    return f"""WITH RECURSIVE {ATTEMPTS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, id) AS n FROM attempts),
    s AS (SELECT key, id, at_ms, n, true AS admitted, CAST(NULL AS BIGINT) AS retry_after_s, [at_ms] AS log FROM a WHERE n = 1
    UNION ALL SELECT n.key, n.id, n.at_ms, n.n, len({live}) < {limit},
      CASE WHEN len({live}) >= {limit} THEN CAST(ceil(({live}[1] + {window_ms} - n.at_ms) / 1000.0) AS BIGINT) END,
      CASE WHEN len({live}) < {limit} THEN list_append({live}, n.at_ms) ELSE {live} END
      FROM s JOIN a n ON n.key = s.key AND n.n = s.n + 1)"""


@check(
    "j1_rate_limit",
    _limiter_sql(DAY_MS, 3) + " SELECT key, id, at_ms, admitted, retry_after_s FROM s",
)
def j1(spark, sf_dir):
    return ratelimit.verdicts(attempts(spark, sf_dir), DAY_MS, 3)


@check(
    "j1_rate_limit_defaults",
    _limiter_sql(ratelimit.WINDOW_MS, ratelimit.LIMIT) + " SELECT key, id, at_ms, admitted, retry_after_s FROM s",
)
def j1_defaults(spark, sf_dir):
    return ratelimit.verdicts(attempts(spark, sf_dir))


@check(
    "j1_rate_limit_totals",
    _limiter_sql(DAY_MS, 3) + """ SELECT key, count(*) FILTER (admitted) AS n_admitted, count(*) FILTER (NOT admitted) AS n_rejected FROM s GROUP BY key""",
)
def j1_totals(spark, sf_dir):
    return ratelimit.totals(attempts(spark, sf_dir), DAY_MS, 3)


@check(
    "j1_trailing_attempts",
    f"""WITH {ATTEMPTS_SQL} SELECT key, id, at_ms, CAST(count(*) OVER (PARTITION BY key ORDER BY at_ms RANGE BETWEEN {DAY_MS - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n_trailing FROM attempts""",
)
def j1_trailing(spark, sf_dir):
    return ratelimit.trailing_attempts(attempts(spark, sf_dir), DAY_MS)


def _stream(spark, sf_dir: str, name: str):
    batch = table(spark, sf_dir, name)
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{name}*.parquet")


@check("a10_stream_process", f"WITH {RUN_SQL} SELECT {_RUN_COLUMNS} FROM e")
def a10(spark, sf_dir):
    at = new_folder(spark)
    write_stream(mail_of(_stream(spark, sf_dir, "conversations")), f"{at}/out", f"{at}/progress").awaitTermination()
    return _run_columns(spark.read.parquet(f"{at}/out"))


@check("j4_stream_tenants", f"WITH {_TENANT_SQL} SELECT id, connection_id, reason FROM v")
def j4(spark, sf_dir):
    at = new_folder(spark)
    policies = decode_policies(raw_policies(spark, sf_dir))
    write_stream(
        mail_of(_stream(spark, sf_dir, "conversations")), f"{at}/out", f"{at}/progress", policies=policies
    ).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("id", "connection_id", "reason")


@check(
    "j4_policy_versions",
    f"""SELECT id, connection_id, reason, 1 AS policy_version FROM (WITH {RUN_SQL} SELECT id, reason FROM e) JOIN (WITH {MAIL_SQL} SELECT id, connection_id, uid FROM m) USING (id) WHERE uid // 100 % 2 = 0
    UNION ALL SELECT id, connection_id, reason, 2 FROM (WITH {_TENANT_SQL} SELECT id, connection_id, uid, reason FROM v) WHERE uid // 100 % 2 = 1""",
)
def j4_versions(spark, sf_dir):
    """Half of the conversations arrive under no stored policies, half after these were published."""
    at, policies = new_folder(spark), decode_policies(raw_policies(spark, sf_dir))
    conversations = table(spark, sf_dir, "conversations")
    for half, version in enumerate((policies.limit(0), policies)):
        publish(version, f"{at}/policies")
        conversations.where(F.pmod("conv_id", F.lit(2)) == half).write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(conversations.schema).parquet(f"{at}/in")
        write_judged_stream(mail_of(source), f"{at}/out", f"{at}/policies", f"{at}/progress").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("id", "connection_id", "reason", "policy_version")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Events arrive in files of ten days each, but one in 13 comes a file late and one in 29 two files late.
_ARRIVAL = "floor({at} / 864000000) + CASE WHEN {id} % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN {id} % 29 = 0 THEN 2 ELSE 0 END"
_LATENESS_MS = 4 * DAY_MS


def _late_sql() -> str:
    arrived = ATTEMPTS_SQL.replace("attempts AS", "arrived AS", 1)
    return f"""{arrived}, f AS (SELECT *, {_ARRIVAL.format(at="at_ms", id="id")} AS file FROM arrived),
      w AS (SELECT file, max(max(at_ms)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_LATENESS_MS} AS watermark FROM f GROUP BY file),
      late AS (SELECT f.* FROM f JOIN w ON w.file = f.file WHERE f.at_ms < w.watermark),
      attempts AS (SELECT key, id, at_ms FROM f ANTI JOIN late ON late.id = f.id)"""


@check(
    "j1_stream_rate_limit",
    _limiter_sql(DAY_MS, 3).replace(ATTEMPTS_SQL, _late_sql(), 1)
    + " SELECT key, id, at_ms, admitted, retry_after_s, CAST(NULL AS VARCHAR) AS reason FROM s UNION ALL SELECT key, id, at_ms, NULL, NULL, 'late' FROM late",
)
def j1_stream(spark, sf_dir):
    """Out of order, a file at a time, with a last one that moves the watermark past all."""
    at, n = new_folder(spark), spark.sparkContext.defaultParallelism
    events = attempts(spark, sf_dir).withColumn("file", F.expr(_ARRIVAL.format(at="at_ms", id="id")))
    files = [r.file for r in events.select("file").distinct().orderBy("file").collect()]  # one for every ten days
    # Rows without a value, dealt round robin, so that each of the n files has a row and is written: a micro-batch reads n files.
    empty = spark.range(0, n, 1, 1).select(*(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("key", "id", "at_ms")))
    for name in files:
        events.where(F.col("file") == name).drop("file").unionByName(empty).repartition(n).write.mode("append").parquet(f"{at}/in")
    beat = events.agg((F.max("at_ms") + 10 * DAY_MS).alias("at_ms")).select(F.lit(None).cast(events.schema["key"].dataType).alias("key"), F.lit(None).cast(events.schema["id"].dataType).alias("id"), "at_ms")
    beat.write.mode("append").parquet(f"{at}/in")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        source = spark.readStream.schema(beat.schema).option("maxFilesPerTrigger", n).parquet(f"{at}/in")
        query = (
            limit_stream(source, DAY_MS, 3, f"{_LATENESS_MS} milliseconds", slice_ms=DAY_MS // 24)
            .writeStream.format("parquet")
            .option("path", f"{at}/out")
            .option("checkpointLocation", f"{at}/progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{at}/out").where("id IS NOT NULL")
