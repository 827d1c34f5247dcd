"""Connected components of a table of links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.shared import settled

# Links that a task holds at a time.
TASK_LINKS = 1_000_000


def _contracted(links: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that join the same nodes: each node of what a task holds goes to the
    least one that it is joined to there. Of at most `most` links in one partition,
    that is all there is to find."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))
        for i, j in zip(places[: len(a)].tolist(), places[len(a) :].tolist()):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            while parent[j] != j:
                parent[j] = j = parent[parent[j]]
            if i < j:
                parent[j] = i
            else:
                parent[i] = j
        for i in range(len(nodes)):  # a parent is always a lesser one
            parent[i] = parent[parent[i]]
        roots = nodes[parent] if len(nodes) else nodes
        moved = roots != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(roots[moved], pa.int64())], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield stars(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if held:
            yield stars(*(np.concatenate(x) for x in zip(*held)))

    return links.select("a", "b").mapInArrow(work, "a long, b long")


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """node and component, the least node reachable, of every node that `links`
    (a, b) join to another.

    Links are contracted inside of their partitions, and once there are no more than
    `task_links` of them, in one. Until then large and small stars alternate until
    nothing moves; every round is kept in the shared folder. Nodes' links are aggregated before
    they are shuffled, and only joined afterwards, which can be split."""
    links = settled(_contracted(links.where("a != b"), task_links))
    n, before = links.count(), None
    while n > task_links:
        # No more partitions than the links fill.
        dealt = links.repartition(math.ceil(n / task_links) + 1, "a")
        both = dealt.select("a", "b").union(dealt.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        # From each node, its greater neighbours go to the least one around.
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_c"), F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("_c")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        # From each node, it and its lesser neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least.select(F.col("a").alias("_c"), "_m"), F.col("a") == F.col("_c")).where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        links = settled(_contracted(small.union(least.select("a", F.col("_m").alias("b"))), task_links).distinct())
        n, now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
    else:
        links = settled(_contracted(links.coalesce(1), task_links + 1))
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
