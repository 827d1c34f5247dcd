"""Mail containers: files of many messages, each behind a line `From address date`.

The line is the record separator of Spark's text reader, which cuts a container
into byte ranges, so one of any size is read by many tasks, and gives the bytes
as they are. The reader relies on writers to quote such lines in bodies (`>From `,
`>>From ` and so on; one `>` is taken off). What follows an unquoted one has no headers and is
reported with the unreadable messages. Blank lines at the end of a message are not part
of it. Messages are numbered by their place in the container, wherever it was cut.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mailsieve.folders import settled
from mailsieve.schema import STRINGS
from mailsieve.sources.eml import from_pieces, parse_sources, rejects
from mailsieve.streaming.gateway import checkpoint_dir

_SEPARATOR = "\nFrom "
# Rows of (container, byte range) that are sent to every task; more are joined.
_SENT = 100_000
_STATUS = re.compile(rb"^(?:X-)?Status:[ \t]*([A-Za-z]*)", re.I | re.M)
_OPENED = T.StructType([T.StructField("flags", STRINGS), T.StructField("source", T.BinaryType())])
_LETTERS = {b"R": r"\Seen", b"F": r"\Flagged", b"A": r"\Answered", b"T": r"\Draft", b"D": r"\Deleted"}


def _record() -> list[Column]:
    where = F.col("_metadata.file_path").alias("container"), F.col("_metadata.file_block_start").alias("range")
    return [*where, F.col("value").cast("binary").alias("record")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """container, range (its first byte) and record of all containers under `path`."""
    return spark.read.option("lineSep", _SEPARATOR).option("recursiveFileLookup", "true").text(path).select(*_record())


def stream_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same of containers as they arrive. A container has to arrive whole, by a rename."""
    reader = spark.readStream.option("lineSep", _SEPARATOR).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(*_record())


def _opened(record: bytes) -> tuple[list[str], bytes]:
    """Flags and source of a record, without the rest of the separating line."""
    first, _, rest = bytes(record).partition(b"\n")
    end = b"\r\n" if first.endswith(b"\r") else b"\n"
    body = rest.rstrip(b"\r\n")
    source = re.sub(rb"(?m)^>(>*From )", rb"\1", body) + end if body else b""
    head = re.split(rb"\r?\n\r?\n", source, maxsplit=1)[0]
    letters = b"".join(_STATUS.findall(head)).upper()
    return [flag for letter, flag in _LETTERS.items() if letter in letters], source


@F.pandas_udf(_OPENED)
def _open(records: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_opened(r) for r in records], columns=["flags", "source"])


def _numbered(records: DataFrame) -> DataFrame:
    """Adds `uid`, from 1 in each container: the records in the ranges before, which
    are one row a range, and those before in the same range. No record is shuffled
    while the ranges are few enough to be sent to all tasks."""
    placed = records.withColumn("_row", F.monotonically_increasing_id())
    ranges = placed.groupBy("container", "range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("container").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = settled(ranges.select("container", "range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    ranges = F.broadcast(ranges) if ranges.count() <= _SENT else ranges
    changed = F.raise_error(F.lit("containers are cut otherwise than when they were counted"))
    uid = F.when(F.col("_before").isNull(), changed.cast("bigint")).otherwise(F.col("_before") + F.col("_row") - F.col("_first") + 1)
    return placed.join(ranges, ["container", "range"], "left").withColumn("uid", uid)


def sources(records: DataFrame, folder: Column | None = None) -> DataFrame:
    """Records as (folder, uid, flags, source), for `eml.from_eml`. The folder is the
    container's name without its ending, or as given. Flags come from the headers Status and
    X-Status. Records of blanks alone, as in front of the first message, are left out. It counts
    the records of each range when it is called."""
    name = F.regexp_replace(F.url_decode(F.substring_index("container", "/", -1)), r"(?i)\.(?:mbox|mbx|txt)\z", "")
    opened = _numbered(records).withColumn("_opened", _open("record"))
    blank = F.octet_length(F.btrim(F.col("record").cast("string"), F.lit(" \t\r\n"))) == 0
    return opened.where(~blank).select((name if folder is None else folder).alias("folder"), "uid", "_opened.flags", "_opened.source")


def messages_and_rejects(found: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Messages, and (folder, uid, error) of what cannot be read, from one pass over
    the sources; the parsed pieces are kept in the shared folder."""
    pieces = settled(parse_sources(found))
    return from_pieces(pieces, now), rejects(pieces)


def write_stream(records: DataFrame, out: str, now, checkpoint: str | None = None, folder: Column | None = None) -> StreamingQuery:
    """Messages and rejects of a stream of containers, as tables below `out`. A batch that is
    run again after a failure replaces what it has written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        for part, name in zip(messages_and_rejects(sources(batch, folder), now), ("messages", "rejects")):
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    place = checkpoint_dir(records.sparkSession, "containers", checkpoint)
    return records.writeStream.foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start()
