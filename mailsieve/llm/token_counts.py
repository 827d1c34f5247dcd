"""Token counts of documents in flat token files, by their separators.

A flat file is a run of fixed-width ids with an end-of-document id after each
document and no index. Files are cut into blocks of bounded size; each block is
read by itself and its separators are found by one vectorised comparison. What
a block cannot know, the number of documents before it and where the one that
runs into it began, is a prefix scan over one short row for each block.

An incomplete id at the end of a file is not a token. Tokens after the last
separator are a document that is not closed. An empty file has no document. Null
texts are written as empty documents. Files are those that the rows of a finished
write name, so what a lost task has left does not count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.shared import settled, shared_folder
from mailsieve.llm.tokens import byte_bpe

SEPARATOR = 50_256
BLOCK_BYTES = 8 << 20
FILE_BYTES = 256 << 20
_TEXTS_AT_A_TIME = 256


def _kind(width: int) -> str:
    if width not in (2, 4):
        raise ValueError("ids are 2 or 4 bytes wide")
    return f"<u{width}"


def write_flat(docs: DataFrame, folder: str, separator: int = SEPARATOR, width: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Writes the tokens of all documents to flat files in `folder`, a place that
    all executors share. Gives file, ordinal (of the document in it) and doc_id."""
    kind = _kind(width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode = byte_bpe(vocabulary, special=False)
        end = np.array([separator], dtype=kind).tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, ordinal, size = None, "", 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_A_TIME):
                part = batch.slice(at, _TEXTS_AT_A_TIME)
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, ordinal, size = f"{uuid.uuid4().hex}.tokens", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                data = b"".join((encode(t).astype(kind).tobytes() if t else b"") + end for t in part.column(1).to_pylist())
                out.write(data)
                size += len(data)
                places = pa.array(np.arange(ordinal, ordinal + part.num_rows), pa.int64())
                ordinal += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), places, part.column(0)], names=["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return settled(docs.select("doc_id", "text").mapInArrow(write, f"file string, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}"))


def blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, begin and size of the blocks of all files in a folder; no
    content is read. Block sizes are multiples of 4 bytes."""
    step = max(4, block_bytes // 4 * 4)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "length")
    begins = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    cut = files.select("path", "length", F.posexplode(begins).alias("block", "begin"))
    return cut.select(F.element_at(F.split("path", "/"), -1).alias("file"), "block", "begin", F.least(F.lit(step), F.col("length") - F.col("begin")).alias("size"))


def separators(found: DataFrame, folder: str, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """file, block, tokens (in the block) and places of the separators in it, as
    numbers of tokens from the file's begin."""
    kind = _kind(width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as source:
                    data = source.read_at(row["size"] // width * width, row["begin"])
                ids = np.frombuffer(data, dtype=kind)
                places = np.flatnonzero(ids == separator) + row["begin"] // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]], pa.string()), pa.array([row["block"]], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([places], pa.list_(pa.int64()))],
                    names=["file", "block", "tokens", "places"],
                )

    spread = found.repartition(max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file", "block")
    return spread.mapInArrow(search, "file string, block int, tokens long, places array<long>")


def count_documents(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator) and closed of every
    document in the flat files of a folder."""
    found = settled(separators(blocks(spark, folder, block_bytes), folder, separator, width))
    summary = found.select("file", "block", "tokens", F.size("places").alias("n"), F.element_at(F.when(F.size("places") > 0, F.col("places")), -1).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = summary.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"), F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("_open")
    )
    located = found.join(scanned, ["file", "block"])
    begins = F.transform("places", lambda p, i: F.struct((F.col("_first") + i).alias("ordinal"), F.when(i == 0, F.col("_open")).otherwise(F.element_at("places", i) + 1).alias("start"), p.alias("end")))
    closed = located.select("file", F.explode(begins).alias("d")).select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = summary.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("tokens").alias("_all"))
    rest = ends.where("start < _all").select("file", "ordinal", "start", (F.col("_all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def counted(docs: DataFrame, **options) -> DataFrame:
    """doc_id and n_tokens of every document, through flat files in the shared
    folder, which are removed at the end."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}"
    written = write_flat(docs, folder)
    if written.isEmpty():
        return written.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    found = settled(count_documents(spark, folder, **options))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return written.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
