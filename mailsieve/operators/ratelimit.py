"""Sliding-log admission: an attempt is admitted when fewer than `limit`
admitted ones lie within the last `window_ms`. Rejected attempts leave no trace.

Admission depends on earlier admissions, so it cannot be a window aggregate.
What needs the sequence is narrowed down first, each step exact:

1. Attempts of a key at the same millisecond become one row with a count.
2. Time is cut into slices as long as the window. A slice that, together with
   the slice before it, holds at most `limit` attempts can reject nothing.
3. Only runs of the other, busy, slices are walked, each from the quiet slice
   in front of it, whose attempts are all admitted. Runs are independent.

The walk reads sorted batches and keeps `limit` times, so memory is constant
however long a run is, and it steps from admission to admission, not from attempt to
attempt. A key that stays above the limit without ever pausing is one run: each
decision there rests on the one before it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

WINDOW_MS = 15 * 60 * 1000
LIMIT = 10


class SlidingLog:
    """Times of the admitted attempts still inside the window."""

    def __init__(self, window_ms: int, limit: int, times: Iterable[int] = ()):
        self.window_ms, self.limit = window_ms, limit
        self.times = deque(times)

    def offer(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Admits what it can of n attempts at each of the ascending times: (admitted,
        seconds the others must wait, 0 where there are none). While the log is full
        nothing happens until its oldest entry leaves the window, so the steps taken
        are those of admissions, however many attempts lie between."""
        admitted, wait = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        i = 0
        while i < len(at):
            now = int(at[i])
            while self.times and now - self.times[0] >= self.window_ms:
                self.times.popleft()
            took = min(int(n[i]), self.limit - len(self.times))
            self.times.extend([now] * took)
            admitted[i] = took
            if took == n[i]:
                i += 1
                continue
            opens = self.times[0] + self.window_ms
            blocked = slice(i, int(np.searchsorted(at, opens, side="left")))
            wait[blocked] = -((at[blocked] - opens) // 1000)
            i = blocked.stop
        return admitted, wait


def _plan(instants: DataFrame, window_ms: int, limit: int) -> DataFrame:
    """One row per key and non-empty slice: its run (null when quiet) and
    whether it only leads into one."""
    slices = instants.groupBy("key", "slice").agg(F.sum("n").alias("n"))
    # At most time span / window rows per key.
    w = W.partitionBy("key").orderBy("slice")
    before = F.lag("slice").over(w) == F.col("slice") - 1
    carried = F.when(before, F.lag("n").over(w)).otherwise(0)
    busy = slices.withColumn("busy", F.col("n") + carried > limit)
    follows = (F.lag("slice").over(w) == F.col("slice") - 1) & F.lag("busy").over(w)
    opens = F.col("busy") & ~F.coalesce(follows, F.lit(False))
    runs = busy.withColumn("run", F.sum(opens.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    leads = ~F.col("busy") & F.coalesce(
        (F.lead("slice").over(w) == F.col("slice") + 1) & F.lead("busy").over(w), F.lit(False)
    )
    return runs.withColumn("leads", leads).select(
        "key",
        "slice",
        "leads",
        F.when(F.col("busy"), F.col("run")).when(F.col("leads"), F.col("run") + 1).alias("run"),
    )


def admissions(attempts: DataFrame, window_ms: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """attempts (key, at_ms) -> one row per key and time: n, admitted and
    retry_after_s for the rejected rest. Attempts without a key or a time cannot
    be decided; they are left to `verdicts`, which keeps them undecided."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    instants = (
        attempts.filter("key IS NOT NULL AND at_ms IS NOT NULL")
        .groupBy("key", "at_ms")
        .agg(F.count("*").alias("n"))
        .withColumn("slice", F.floor(F.col("at_ms") / window_ms))
    )
    planned = instants.join(_plan(instants, window_ms, limit), ["key", "slice"])
    quiet = planned.filter(F.col("run").isNull() | F.col("leads")).select(
        "key", "at_ms", "n", F.col("n").alias("admitted"), F.lit(None).cast("bigint").alias("retry_after_s")
    )
    key_type = attempts.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            *(T.StructField(c, T.LongType()) for c in ("at_ms", "n", "admitted", "retry_after_s")),
        ]
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, None
        for batch in batches:
            keys, runs = batch["key"].to_numpy(), batch["run"].to_numpy()
            at, n = batch["at_ms"].to_numpy(), batch["n"].to_numpy()
            new = np.ones(len(batch) + 1, dtype=bool)
            new[1:-1] = (keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])
            cuts = np.flatnonzero(new)
            admitted, waits = [], []
            for a, b in zip(cuts, cuts[1:]):
                if (keys[a], runs[a]) != current:
                    current, log = (keys[a], runs[a]), SlidingLog(window_ms, limit)
                took, wait = log.offer(at[a:b], n[a:b])
                admitted.append(took)
                waits.append(wait)
            if not len(batch):
                continue
            admitted, waits = np.concatenate(admitted), pd.array(np.concatenate(waits), dtype="Int64")
            waits[admitted == n] = pd.NA
            out = batch.assign(admitted=admitted, retry_after_s=waits)
            yield out.loc[~batch["leads"], ["key", "at_ms", "n", "admitted", "retry_after_s"]]

    walked = (
        planned.filter(F.col("run").isNotNull())
        .select("key", "run", "at_ms", "n", "leads")
        .repartition("key", "run")
        .sortWithinPartitions("key", "run", "at_ms")
        .mapInPandas(walk, schema)
    )
    return quiet.unionByName(walked)


def verdicts(attempts: DataFrame, window_ms: int = WINDOW_MS, limit: int = LIMIT, id_col: str = "id") -> DataFrame:
    """Every attempt (id, key, at_ms) with `admitted` and `retry_after_s`; at
    the same millisecond lower ids come first. Numbered inside (key, time),
    which spreads a busy key over all tasks. Without a key or a time `admitted` is
    null."""
    place = F.row_number().over(W.partitionBy("key", "at_ms").orderBy(id_col))
    took = admissions(attempts, window_ms, limit).select(
        "key", "at_ms", F.col("admitted").alias("_took"), F.col("retry_after_s").alias("_wait")
    )
    return (
        attempts.withColumn("_place", place)
        .join(took, ["key", "at_ms"], "left")
        .withColumn("admitted", F.col("_place") <= F.col("_took"))
        .withColumn("retry_after_s", F.when(~F.col("admitted"), F.col("_wait")))
        .drop("_place", "_took", "_wait")
    )


def totals(attempts: DataFrame, window_ms: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """Admitted and rejected attempts per key, without going back to them."""
    return (
        admissions(attempts, window_ms, limit)
        .groupBy("key")
        .agg(F.sum("admitted").alias("n_admitted"), F.sum(F.col("n") - F.col("admitted")).alias("n_rejected"))
    )


def trailing_attempts(attempts: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Per attempt, how many attempts of its key, admitted or not, lie in the
    window that ends with it; null without a key or a time.

    Counted over instants, cut into slices so that a busy key is not one task:
    a slice needs only itself and the slice before it."""
    instants = attempts.groupBy("key", "at_ms").agg(F.count("*").alias("n"))
    own = F.floor(F.col("at_ms") / window_ms)
    # Each instant counts in its own slice and, as history, in the next one.
    copies = instants.withColumn("slice", F.explode(F.array(own, own + 1))).withColumn("home", own)
    w = W.partitionBy("key", "slice").orderBy("at_ms").rangeBetween(-(window_ms - 1), 0)
    counted = copies.withColumn("n_trailing", F.sum("n").over(w)).filter("home = slice")
    return attempts.join(counted.select("key", "at_ms", "n_trailing"), ["key", "at_ms"], "left")
