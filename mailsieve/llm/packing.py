"""Vector best-fit packing of tokenised documents into fixed-length sequences.

A sequence has three capacities: tokens, number of pieces and attention cost
(the sum of squared piece lengths). A piece goes, longest first, to the open
sequence that has room in every one of them and scores best: least weighted
norm of what would be left, or greatest weighted dot product of the piece with
what is left.

Pieces are dealt evenly into groups of bounded size, and groups are packed
independently, so each leaves only its last few sequences partly empty. The
assignment is made on narrow rows; token ids stay where they were computed.

Null texts are empty documents, which are the separator alone. Repeated rows
and null ids are packed like others. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.shared import settled, unused
from mailsieve.llm.tokens import byte_bpe

# Pieces in a group: what one task packs at a time.
GROUP_PIECES = 16_384
_TEXTS_AT_A_TIME = 256


def token_pieces(docs: DataFrame, capacity: int = 2048, separator: int = 0, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of
    every document, closed by the separator. A document longer than the capacity
    is cut so that only its first piece may be shorter than that."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary)
        end = np.array([separator], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_A_TIME):
                part = batch.slice(at, _TEXTS_AT_A_TIME)
                row, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tokens = np.concatenate([encode(text), end]) if text else end
                    first = (len(tokens) - 1) % capacity + 1
                    bounds = [0, *range(first, len(tokens) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(tokens[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, tokens placed in it before) of every item, given items as rows of
    sizes. An item that exceeds a capacity by itself gets a bin of its own."""
    n = len(sizes)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    need, scale = sizes / capacities, np.sqrt(weights)
    order = np.lexsort((np.arange(n), -sizes[:, 0]))
    shortest = np.minimum.accumulate(need[order[::-1], 0])[::-1] if n else need[:, 0]
    alone = (need >= 1).any(axis=1) & ((need[:, 0] >= 1) | (need > 1).any(axis=1))
    free = np.empty((max(n, 1), len(capacities)))  # what is left in open bins, as shares of the capacities
    names, used = np.empty(max(n, 1), dtype=np.int64), np.empty(max(n, 1), dtype=np.int64)
    opened = made = 0
    slack = 1e-9
    for step, item in enumerate(order):
        if step % 512 == 0 and opened:  # bins too full for any item to come are closed
            keep = np.flatnonzero(free[:opened, 0] >= shortest[step] - slack)
            free[: len(keep)], names[: len(keep)], used[: len(keep)] = free[keep], names[keep], used[keep]
            opened = len(keep)
        best = -1
        if not alone[item] and opened:
            left = free[:opened] - need[item]
            fits = np.flatnonzero(left.min(axis=1) >= -slack)
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((np.square(left[fits] * scale)).sum(axis=1))]
                else:
                    best = fits[np.argmax(free[fits] @ (need[item] * weights))]
        if best < 0:
            bins[item], offsets[item] = made, 0
            if not alone[item]:
                free[opened], names[opened], used[opened] = 1 - need[item], made, sizes[item, 0]
                opened += 1
            made += 1
        else:
            bins[item], offsets[item] = names[best], used[best]
            free[best] -= need[item]
            used[best] += int(sizes[item, 0])
    return bins, offsets


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    max_pieces: int = 2048,
    max_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """`pieces` (with a `length`) plus sequence_id and offset. `max_cost` is the
    sum of squared lengths that a sequence may hold, by default that of one full
    piece. Columns of these two names are replaced."""
    pieces = settled(pieces.drop("sequence_id", "offset"))
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    kept, dealt_by = pieces.columns, unused(pieces, "group")
    limits = np.array([capacity, max_pieces, max_cost or float(capacity) ** 2], dtype=float)
    scales = np.array(weights, dtype=float)
    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)

    def place(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(float)
        sizes = np.stack([lengths, np.ones(len(lengths)), lengths**2], axis=1)
        bins, offsets = best_fit(sizes, limits, scales, rule)
        group = table.column(dealt_by)[0].as_py() if len(bins) else 0
        table = table.select(kept)
        table = table.append_column("sequence_id", pa.array(bins + (group << 32), pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    # The checkpoint is read in the same order each time, so a task that is run
    # again deals its rows to the same groups.
    dealt = pieces.withColumn(dealt_by, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(dealt_by).applyInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, **limits) -> DataFrame:
    """Every piece of every document with the checksum of its ids and its place."""
    pieces = token_pieces(docs, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity, **limits)
