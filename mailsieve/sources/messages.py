"""Message tables, and the exports of script bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailsieve.functions.address import parse_address_list_loose, parse_address_loose
from mailsieve.functions.text import blank_if_null, parse_date
from mailsieve.schema import ADDRESSES, ATTACHMENTS, MESSAGE, STRINGS


def conform(df: DataFrame) -> DataFrame:
    """Fits a frame to the message schema: missing columns are null, missing
    texts '', missing lists empty. A missing `sent_at` is parsed from `date`;
    one that is there is left alone, so that predicates on it reach the scan."""
    if "sent_at" not in df.columns and "date" in df.columns:
        df = df.withColumn("sent_at", parse_date(F.col("date")))
    for f in MESSAGE.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    filled = {c: blank_if_null(F.col(c)) for c in ("subject", "body", "snippet")}
    filled |= {c: F.coalesce(c, F.array().cast(ADDRESSES)) for c in ("to", "cc")}
    filled |= {"labels": F.coalesce("labels", F.array().cast(STRINGS))}
    filled |= {"attachments": F.coalesce("attachments", F.array().cast(ATTACHMENTS))}
    extra = [c for c in df.columns if c not in MESSAGE.fieldNames()]
    return df.withColumns(filled).select(*MESSAGE.fieldNames(), *extra)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", with_times: bool = True) -> DataFrame:
    """Normalised messages as parquet, orc or JSON lines. The schema is given,
    so nothing is inferred and columns not asked for are not read. Files that
    hold no `sent_at` are read with `with_times=False`."""
    fields = [f for f in MESSAGE.fields if with_times or f.name != "sent_at"]
    return conform(spark.read.schema(StructType(fields)).format(fmt).load(path))


def from_script_export(df: DataFrame) -> DataFrame:
    """Bridge rows (id, threadId, subject, from, to, cc, date, plainBody, body,
    threadLabels, attachments, isUnread) to messages. The snippet is the head
    of the plain body as it stands and the labels are the thread's."""
    return conform(
        df.select(
            "id",
            F.col("threadId").alias("thread_id"),
            "subject",
            parse_address_loose(F.col("from")).alias("from"),
            parse_address_list_loose(F.col("to")).alias("to"),
            parse_address_list_loose(F.col("cc")).alias("cc"),
            "date",
            F.substring("plainBody", 1, 200).alias("snippet"),
            F.col("plainBody").alias("body"),
            F.col("body").alias("html_body"),
            F.col("threadLabels").alias("labels"),
            "attachments",
            F.col("isUnread").alias("is_unread"),
        )
    )
