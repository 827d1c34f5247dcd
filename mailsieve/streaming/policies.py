"""A versioned store of compiled policies, and the policy run that reads it.

Rules are compiled when a version is published, once. Every micro-batch of the stream
takes the latest version there is when it begins, so a change takes effect between
two batches, and within a batch all messages are judged by one version.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailsieve.operators.tenants import compile_policies, join_compiled
from mailsieve.plans.gateway import Stage, process
from mailsieve.streaming.gateway import checkpoint_dir


def latest_version(spark: SparkSession, store: str) -> int | None:
    """The greatest version that was written to its end."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    versions = []
    for entry in files.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            versions.append(int(name.partition("=")[2]))
    return max(versions, default=None)


def publish(policies: DataFrame, store: str) -> int:
    """Compiles `policies` and adds them to the store as its next version, whose number is
    given back. One publisher at a time; a version that failed half-way is never read."""
    version = (latest_version(policies.sparkSession, store) or 0) + 1
    compile_policies(policies).write.mode("overwrite").parquet(f"{store}/version={version}")
    return version


def compiled_version(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{store}/version={version}")


def write_judged_stream(messages: DataFrame, out: str, store: str, checkpoint: str | None = None, stages: Iterable[Stage] = (), available_now: bool = True) -> StreamingQuery:
    """Judges and cleans the stream by the store's policies, into one folder for each
    micro-batch, `out`/batch=n, partitioned by action; rows carry the policy_version. A batch that is run
    again after a failure replaces its folder, so each message is in the output once. A
    store without a version is an error, not a run without rules."""
    stages = list(stages)

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = latest_version(spark, store)
        if version is None:
            raise ValueError(f"no policies in {store}")
        joined, policy = join_compiled(batch, compiled_version(spark, store, version))
        judged = process(joined, policy, stages).withColumn("policy_version", F.lit(version))
        judged.write.mode("overwrite").partitionBy("action").parquet(f"{out}/batch={number}")

    writer = messages.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint_dir(messages.sparkSession, "judged", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
