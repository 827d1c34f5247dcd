"""Bounded samples of labelled rows, for fitting small models."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: Column, rows: int, keep: Column | None = None) -> DataFrame:
    """(text, target) of at most `rows` labelled documents, chosen by a hash of
    doc_id, so that the sample is the same in every run and spread over all
    sources. Rows without a label or id are left out; of several labels for one
    document the greatest counts."""
    known = labels.select("doc_id", target.cast("int").alias("_target")).where("doc_id IS NOT NULL AND _target IS NOT NULL")
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max("_target").alias("_target"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers are broadcast. Of rows that repeat an id, one text counts.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "_target").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.select(F.coalesce("text", F.lit("")).alias("text"), F.col("_target").alias("target"))


def outside_fold(modulus: int = 5, fold: int = 0) -> Column:
    """Rows whose crc32 of doc_id as text leaves another remainder than `fold`."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus != fold


def fit_in_one_task(features: DataFrame, fit, *arguments) -> bytes:
    """Runs `fit` on the rows of a bounded sample, in one task; its bytes are the
    model. An empty sample is fitted as well, as no rows."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([fit(table, *arguments)], pa.binary())})

    found = features.groupBy(F.lit(0).alias("_one")).applyInArrow(run, "model binary").collect()
    return bytes(found[0].model) if found else fit(features.limit(0).toArrow().append_column("_one", pa.array([], pa.int32())), *arguments)
