"""Tables kept in the shared folder, and settings of the given session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mailsieve.folders import settled, shared_folder

__all__ = ["partitions", "settled", "shared_folder", "stored", "unused"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """As `settled`, as a compressed table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
