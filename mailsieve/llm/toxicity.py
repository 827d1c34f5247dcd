"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes.

A feature is a hashed n-gram of lower-cased characters, present or absent in a
text. Presence counts in both classes give its log-count ratio r, and each
feature enters a logistic regression as r instead of 1. Features whose counts
differ from the share of label 1 by too few standard deviations are left out:
their ratio is noise, of which a long text would gather much.

Counts and weights come from a bounded sample of labelled documents. The counts
are taken where the texts are and summed by feature; then one task fits the weights
on the chosen features of each sampled document, at most `rows` lists of at most
`features` numbers, and on no text. Each document is scored from its whole text, without a shuffle. A null or empty text
is scored by the bias alone. Repeated rows get equal scores, no rows give no
rows, and without labels of both classes all scores are the smoothed share of
label 1.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.samples import fit_in_one_task, labelled_sample, outside_fold
from mailsieve.llm.shared import settled
from mailsieve.llm.text import Chunk, chunks, mix

TRAINING_ROWS = 12_000
SIZES = (3, 4, 5, 6)
HASH_BITS = 20
FEATURES = 4_096
LEAST_DEVIATION = 5.0
TEXTS_PER_TASK = 1_000
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 9)]


def _grams(chunk: Chunk, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, (character positions, hashed n-grams) that stay within a
    document, and the characters' documents first."""
    codes = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    leads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    bounds = leads[chunk.offsets]
    yield bounds, codes
    total, done = np.zeros(len(codes), dtype=np.uint64), 0
    for size in sizes:
        for k in range(done, min(size, len(codes))):
            total[: len(codes) - k] += (codes[k:] + np.uint64(1)) * _FACTORS[k]
        done = size
        count = max(0, len(codes) - size + 1)
        grams = (mix(total[:count] + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
        inner = np.ones(count, dtype=bool)
        for k in range(1, size):  # starts from which the n-gram would run over a document's end
            across = bounds[1:-1] - k
            inner[across[(across >= 0) & (across < count)]] = False
        yield np.flatnonzero(inner), grams[inner]


def _present(chunk: Chunk, sizes: tuple[int, ...], bits: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, each once; with `table`, only features of
    which the table's value is not 0."""
    found = _grams(chunk, sizes, bits)
    bounds, _ = next(found)
    pairs = [np.zeros(0, dtype=np.int64)]
    for at, grams in found:
        if table is not None:
            hit = table[grams] != 0
            at, grams = at[hit], grams[hit]
        pairs.append((np.searchsorted(bounds, at, side="right") - 1) << bits | grams)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def log_count_ratios(present: np.ndarray, absent: np.ndarray, share: float, smoothing: float = 1.0) -> np.ndarray:
    """Log of the count in class 1 over that in class 0, each by the size of its
    class and smoothed towards the same; 0 for what occurs in neither."""
    return np.log((present / share + smoothing) / (absent / (1 - share) + smoothing))


def deviations(present: Column, absent: Column, share: float) -> Column:
    """Standard deviations between the count in class 1 and what its share makes
    likely."""
    total = present + absent
    return (present - share * total) / F.sqrt(F.greatest(share * (1 - share) * total, F.lit(share)))


def _counts(sample: DataFrame, sizes: tuple[int, ...], bits: int) -> DataFrame:
    """feature, present, absent: in how many texts of either class each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            labels = batch.column("target").to_numpy().astype(np.int64)
            for chunk in chunks(batch.column("text")):
                owners, ids = _present(chunk, sizes, bits)
                for label in (0, 1):
                    counts[label] += np.bincount(ids[labels[chunk.rows][owners] == label], minlength=1 << bits)
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1][found]), pa.array(counts[0][found])], ["feature", "present", "absent"])

    parts = sample.mapInArrow(run, "feature long, present long, absent long")
    return parts.groupBy("feature").agg(F.sum("present").alias("present"), F.sum("absent").alias("absent"))


def _occurrences(sample: DataFrame, chosen: np.ndarray, sizes: tuple[int, ...], bits: int) -> DataFrame:
    """target, places: which of the chosen features each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(1 << bits, dtype=np.int32)
        place[chosen] = np.arange(1, len(chosen) + 1)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                owners, ids = _present(chunk, sizes, bits, place)
                ends = np.searchsorted(owners, np.arange(len(chunk) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[ids] - 1))
                yield pa.RecordBatch.from_arrays([batch.column("target").slice(chunk.first, len(chunk)), lists], ["target", "places"])

    return sample.mapInArrow(run, "target int, places array<int>")


def _weights(table: pa.Table, scale: np.ndarray, bias: float, penalty: float) -> bytes:
    """Weights of the features, and then the bias, as doubles."""
    labels = table.column("target").to_numpy().astype(np.int64)
    places = table.column("places").combine_chunks()
    rows = np.repeat(np.arange(len(labels)), places.value_lengths().to_numpy(zero_copy_only=False))
    columns = places.flatten().to_numpy()
    weights = np.zeros(len(scale))
    if 0 < labels.sum() < len(labels):
        n, m, v = len(labels), np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
        for step in range(1, 201):
            score = np.bincount(rows, (weights * scale)[columns], n) + bias
            error = (labels - 1 / (1 + np.exp(-np.clip(score, -40, 40)))) / n
            g = np.append(np.bincount(columns, error[rows], len(scale)) * scale - penalty * weights, error.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
            weights += 0.02 * move[:-1]
            bias += 0.05 * move[-1]
    return np.append(weights, bias).astype("<f8").tobytes()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = TRAINING_ROWS,
    sizes: tuple[int, ...] = SIZES,
    bits: int = HASH_BITS,
    features: int = FEATURES,
    penalty: float = 1e-5,
    keep: Column | None = None,
) -> bytes:
    """The model as bytes, from at most `rows` labelled documents."""
    sizes = tuple(sorted(sizes))
    sample = labelled_sample(docs, labels, F.col("toxic"), rows, keep).select(F.lower("text").alias("text"), "target")
    sample = settled(sample.repartition(max(1, rows // TEXTS_PER_TASK)))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0))).first()
    share = (positive + 0.5) / (n + 1)
    evidence = F.abs(deviations(F.col("present"), F.col("absent"), share))
    best = _counts(sample, sizes, bits).withColumn("evidence", evidence).where(F.col("evidence") >= LEAST_DEVIATION)
    # At most `features` rows.
    found = best.orderBy(F.desc("evidence"), "feature").limit(features).collect()
    chosen, present, absent = (np.array([r[c] for r in found], dtype=np.int64) for c in ("feature", "present", "absent"))
    scale = log_count_ratios(present, absent, share)
    fitted = np.frombuffer(fit_in_one_task(_occurrences(sample, chosen, sizes, bits), _weights, scale, float(np.log(share / (1 - share))), penalty))
    full = np.zeros(1 << bits, dtype="<f4")
    full[chosen] = fitted[:-1] * scale
    out = io.BytesIO()
    np.savez_compressed(out, weights=full, bias=fitted[-1], sizes=np.array(sizes))
    return out.getvalue()


def score(text: Column, model: bytes) -> Column:
    """Probability of label 1."""
    stored = np.load(io.BytesIO(model))
    weights, bias, sizes = stored["weights"], float(stored["bias"]), tuple(int(x) for x in stored["sizes"])
    bits = int(len(weights)).bit_length() - 1

    @F.arrow_udf("double")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            scores = [np.zeros(0)]
            for chunk in chunks(batch):
                owners, ids = _present(chunk, sizes, bits, weights)
                scores.append(np.bincount(owners, weights[ids], len(chunk)) + bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(scores), -40, 40))))

    return judge(F.lower(text))


def judged(docs: DataFrame, labels: DataFrame, modulus: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, with a model that
    has not seen the labels of the held-out fold."""
    model = fit(docs, labels, keep=outside_fold(modulus), **options)
    held_out = F.coalesce(~outside_fold(modulus), F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
