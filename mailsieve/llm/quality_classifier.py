"""Ordinal quality classifier: a cumulative-link model over hashed text.

One weight vector over hashed words, word endings, word shapes and repeats
gives every text a score s, and ordered thresholds t_1 < ... < t_K turn it into
grades: P(grade < k) = sigmoid(t_k - s). All thresholds share the weights, so
each rating teaches every boundary. Out come the expected grade and, for
selection, the probability of a grade of at least `accept`.

The model is fitted on a sample of at most `rows` rated documents in one task;
every document is then scored from its whole text without a shuffle. A null
text is scored as an empty one: by the thresholds alone. Repeated rows get equal
scores, no rows give no rows. Without any rating every grade is equally likely,
and everything is kept.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.samples import fit_in_one_task, labelled_sample
from mailsieve.llm.text import Chunk, chunks, mix

TRAINING_ROWS = 8_000
HASH_BITS = 16
_SIGNS = np.zeros(256, dtype=np.uint64)
_SIGNS[:] = 5
_SIGNS[0x30:0x3A] = 1
_SIGNS[0x41:0x5B] = 2
_SIGNS[0x61:0x7B] = 3
_SIGNS[0x80:] = 3
_STEPS = 150


def grade(labels: DataFrame) -> Column:
    """Ratings of 0 to 2 from the two judgements in `labels`: poor text, good
    text that is toxic, good text."""
    return F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))


def _features(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature, number of words of the document) of every
    occurrence: words, their last two bytes, their shapes, equal neighbours."""
    starts, stops, owners = chunk.words()
    shift = np.uint64(64 - bits)
    words = chunk.spans_hash(starts, stops)
    length = stops - starts
    data = chunk.data
    last, before = data[stops - 1].astype(np.uint64), data[np.maximum(stops - 2, starts)].astype(np.uint64)
    ending = mix(last * np.uint64(256) + before + np.uint64(1 << 20))
    shape = _SIGNS[data[starts]] + np.uint64(8) * _SIGNS[data[stops - 1]] + np.uint64(64) * _SIGNS[data[np.minimum(starts + 1, stops - 1)]]
    shape = mix(shape + np.uint64(512) * np.minimum(length, 12).astype(np.uint64) + np.uint64(2 << 20))
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owners[1:] == owners[:-1])
    repeats = np.where(again, mix(np.array([3 << 20], dtype=np.uint64))[0], mix(np.array([4 << 20], dtype=np.uint64))[0])
    found = np.stack([words, ending, shape, repeats.astype(np.uint64)], axis=1) >> shift
    return owners, found.astype(np.int64), np.bincount(owners, minlength=len(chunk))


def _counted(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                owners, found, sizes = _features(chunk, bits)
                keys, counts = np.unique((owners[:, None] << bits | found).ravel(), return_counts=True)
                cut = np.searchsorted(keys, np.arange(len(chunk) + 1) << bits)
                ids = (keys & ((1 << bits) - 1)).astype("<u4")
                values = (counts / np.maximum(sizes[keys >> bits], 1)).astype("<f4")
                rows = [(ids[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[chunk.rows], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["target", "ids", "shares"]
                )

    return count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, grades: np.ndarray, levels: int, size: int, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model for sparse rows, by
    gradient steps of adapted length on the mean log-likelihood."""
    n = max(len(grades), 1)
    weights = np.zeros(size)
    below = np.array([(np.sum(grades < k) + 0.5) / (len(grades) + 0.5 * levels) for k in range(1, levels)])
    first = np.log(below / (1 - below))
    # Thresholds are the first one plus positive gaps.
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    state = [np.zeros(size + levels - 1), np.zeros(size + levels - 1)]
    for step in range(1, _STEPS + 1 if len(grades) else 1):
        gaps = np.exp(free[1:])
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([free[:1], gaps])), [np.inf]])
        score = np.bincount(rows, weights[ids] * values, len(grades))
        upper, lower = _sigmoid(cuts[grades + 1] - score), _sigmoid(cuts[grades] - score)
        p = np.maximum(upper - lower, 1e-9)
        slope = (upper + lower - 1) / n  # of the log-likelihood, by the score
        by_cut = (np.bincount(grades, upper * (1 - upper) / p, levels)[:-1] - np.bincount(grades, lower * (1 - lower) / p, levels)[1:]) / n
        by_free = np.concatenate([[by_cut.sum()], gaps * np.cumsum(by_cut[::-1])[::-1][1:]])
        gradient = np.concatenate([np.bincount(ids, slope[rows] * values, size) - penalty * weights, by_free])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-12)
        weights += 0.5 * move[:size]
        free += 0.05 * move[size:]
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _fit(table: pa.Table, levels: int, bits: int) -> bytes:
    ids = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
    values = [np.frombuffer(x, "<f4") for x in table.column("shares").to_pylist()]
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids]).astype(np.int64)
    joined = [np.concatenate([*x, np.zeros(0, x[0].dtype if x else float)]) for x in (ids, values)]
    grades = table.column("target").to_numpy().astype(np.int64)
    weights, cuts = fit_ordinal(rows, joined[0].astype(np.int64), joined[1].astype(float), np.clip(grades, 0, levels - 1), levels, 1 << bits)
    out = io.BytesIO()
    np.savez_compressed(out, weights=weights.astype("<f4"), cuts=cuts)
    return out.getvalue()


def fit(docs: DataFrame, labels: DataFrame, target: Column | None = None, levels: int = 3, rows: int = TRAINING_ROWS, bits: int = HASH_BITS, keep: Column | None = None) -> bytes:
    """The model, from at most `rows` rated documents, as bytes. `target` is the
    grade, 0 to levels - 1, as an expression on `labels`; `keep` may leave rows
    of it out of training."""
    sample = labelled_sample(docs, labels, grade(labels) if target is None else target, rows, keep)
    counted = sample.select("text", "target").mapInArrow(_counted(bits), "target int, ids binary, shares binary")
    return fit_in_one_task(counted, _fit, levels, bits)


def rating(text: Column, model: bytes, accept: int = 1) -> Column:
    """struct(expected_grade, tail): the mean grade, and the probability of a
    grade of at least `accept`."""
    stored = np.load(io.BytesIO(model))
    weights, cuts = stored["weights"], stored["cuts"]
    bits = int(len(weights)).bit_length() - 1

    @F.arrow_udf("struct<expected_grade: double, tail: double>")
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            scores = [np.zeros(0)]
            for chunk in chunks(batch):
                owners, found, sizes = _features(chunk, bits)
                total = np.bincount(owners, weights[found].sum(axis=1), len(chunk))
                scores.append(total / np.maximum(sizes, 1))
            above = 1 - _sigmoid(cuts[None, :] - np.concatenate(scores)[:, None])
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(above[:, accept - 1])], ["expected_grade", "tail"])

    return rate(text)


def rate(docs: DataFrame, model: bytes, accept: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail and kept of every document."""
    rated = docs.select("doc_id", rating(F.col("text"), model, accept).alias("_r"))
    return rated.select("doc_id", "_r.expected_grade", "_r.tail", (F.col("_r.tail") >= least).alias("kept"))


def accepted(docs: DataFrame, model: bytes, accept: int = 1, least: float = 0.5) -> DataFrame:
    """The documents, as they are, whose grade is likely enough to be accepted."""
    return docs.where(rating(F.col("text"), model, accept)["tail"] >= least)
