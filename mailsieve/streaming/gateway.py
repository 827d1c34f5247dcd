"""The policy run on a stream of messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailsieve.plans.gateway import Stage, process, process_tenants
from mailsieve.schema import MESSAGE
from mailsieve.sources.messages import conform


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New message files under `path`, as they arrive."""
    reader = spark.readStream.schema(MESSAGE).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return conform(reader.load(path))


def checkpoint_dir(spark: SparkSession, name: str, given: str | None = None) -> str:
    """Where a query keeps its progress: as given, else below the cluster's
    shared checkpoint folder. There is no machine-local fallback."""
    if given:
        return given
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("give a checkpoint folder or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}"


def write_stream(
    messages: DataFrame,
    out: str,
    checkpoint: str | None = None,
    policy=None,
    policies: DataFrame | None = None,
    stages: Iterable[Stage] = (),
    available_now: bool = True,
) -> StreamingQuery:
    """Judges and cleans the stream into `out`, partitioned by action, so each
    half is a table of its own and each message is handled once. With
    `policies` every connection has its own, as a stream-static join."""
    stages = list(stages)
    judged = process(messages, policy, stages) if policies is None else process_tenants(messages, policies, stages)
    writer = (
        judged.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("action")
        .option("path", out)
        .option("checkpointLocation", checkpoint_dir(messages.sparkSession, "gateway", checkpoint))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


