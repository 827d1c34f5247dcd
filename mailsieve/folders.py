"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, else the checkpoint folder set on the
    context. Only a session on one machine may have neither: it gets a temporary
    one. On a cluster that is an error, as executors would not see the files."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mailsieve-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str = "run") -> str:
    """A path below the shared folder that nothing has used. Whoever writes there
    removes it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder, where the loss of an
    executor does not touch them. Spark removes them with the frame if
    `spark.cleaner.referenceTracking.cleanCheckpoints` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
