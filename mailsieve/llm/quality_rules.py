"""Quality rules on surface counts and on how well a public vocabulary fits.

Surface counts, over words (runs without ASCII space): words, their characters,
symbols, repeated lines, words in repeated five-word windows. Fit, from a
byte-fallback vocabulary applied word by word: characters per token, the share
of tokens that are single fallback bytes, and the entropy of the token
distribution in bits. A text in a script the vocabulary does not know, encoded
bytes, or a few strings over and over lie outside the bands of its script.

Every figure is of the whole text, in one pass without a shuffle. A null text
has no words, and a text of no words has tokens 0, characters per token 0,
share 0, entropy 0. Repeated rows get equal figures, no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.text import Chunk, chunks, inside_document, shingle_hashes
from mailsieve.llm.tokens import pieces

WINDOW = 5
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
# Words whose tokens a worker remembers before it starts anew.
_REMEMBERED = 1_000_000
_SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "south_asian", "east_asian", "other")
# Script by the first byte of a character; bytes that tell nothing have none.
_SCRIPT_OF_LEAD = np.full(256, -1)
for _first, _last, _script in ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xC9, 0), (0xCE, 0xCF, 1), (0xD0, 0xD4, 2), (0xD6, 0xD7, 3), (0xD8, 0xDD, 4), (0xE0, 0xE0, 5), (0xE3, 0xED, 6), (0xF0, 0xF4, 7)):
    _SCRIPT_OF_LEAD[_first : _last + 1] = _script


class Band(NamedTuple):
    """What a script's texts are accepted with: characters per token, fallback
    share, entropy and symbols per word. Figures of n tokens are known to about
    1 / sqrt(n), so characters and fallback may miss their limits by twice that. The least entropy is
    that of a text of `full_tokens` tokens or more; n of them can have log2(n) bits at
    the most, so for fewer it is less in that proportion."""

    least_chars: float = 1.0
    most_chars: float = 12.0
    most_fallback: float = 0.25
    least_entropy: float = 3.0
    most_symbols: float = 0.25
    full_tokens: int = 100


BANDS = {
    "latin": Band(1.55, 8.0, 0.10, 4.0),
    "greek": Band(0.6, 4.0, 0.10),
    "cyrillic": Band(1.0, 6.0, 0.10),
    "hebrew": Band(0.5, 4.0, 0.30),
    "arabic": Band(0.5, 4.0, 0.30),
    # Sentences of the Declaration of Human Rights have shares of 0.02 (Thai) to 0.50 (Telugu).
    "south_asian": Band(0.3, 4.0, 0.80),
    "east_asian": Band(0.3, 4.0, 0.75),
    # Emoji have 0.17 and 0.4 characters per token, Amharic 0.82 and 0.4.
    "other": Band(0.3, 12.0, 0.90),
}

_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string"


def _per_document(mask_positions: np.ndarray, chunk: Chunk) -> np.ndarray:
    return np.bincount(chunk.documents_of(mask_positions), minlength=len(chunk))


def _repeated(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more in their document."""
    order = np.lexsort((keys, owners))
    k, o = keys[order], owners[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    found = np.zeros(len(keys), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def surface_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    starts, stops, owners = chunk.words()
    leads = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    words = chunk.spans_hash(starts, stops)
    within = inside_document(owners, WINDOW)
    at = np.flatnonzero(within)
    twice = at[_repeated(shingle_hashes(words, WINDOW)[at], owners[at])]
    covered = np.zeros(len(words) + WINDOW, dtype=np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    in_repeat = np.cumsum(covered)[: len(words)] > 0
    line_starts, line_stops, line_owners = chunk.lines()
    with_word = np.searchsorted(starts, line_stops) > np.searchsorted(starts, line_starts)
    lines = chunk.spans_hash(line_starts[with_word], line_stops[with_word])
    line_owners = line_owners[with_word]
    order = np.lexsort((lines, line_owners))
    same = (lines[order][1:] == lines[order][:-1]) & (line_owners[order][1:] == line_owners[order][:-1])
    scripts = _SCRIPT_OF_LEAD[chunk.data]
    known = np.flatnonzero(scripts >= 0)
    by_script = np.bincount(chunk.documents_of(known) * len(_SCRIPTS) + scripts[known], minlength=len(chunk) * len(_SCRIPTS)).reshape(len(chunk), -1)
    return {
        "n_words": np.bincount(owners, minlength=len(chunk)),
        "word_chars": np.bincount(owners, leads[stops] - leads[starts], len(chunk)).astype(np.int64),
        "n_symbols": _per_document(np.flatnonzero(_SYMBOL[chunk.data]), chunk),
        "n_dup_lines": np.bincount(line_owners[order][1:][same], minlength=len(chunk)),
        "n_repeat_words": np.bincount(owners[in_repeat], minlength=len(chunk)),
        "script": np.where(by_script.sum(axis=1) > 0, by_script.argmax(axis=1), len(_SCRIPTS) - 1),
    }


class _Remembered(dict):
    """Token ids of words, as bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        ids = self[word] = np.array(self.model.encode(word.decode("utf-8", "replace")), dtype="<i4").tobytes()
        return ids


def figures(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id with the surface counts and the fit of the vocabulary."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        fallback = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        known = _Remembered(model)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                counts = surface_counts(chunk)
                n_tokens, shares, entropies = (np.zeros(len(chunk)) for _ in range(3))
                for i in range(len(chunk)):
                    ids = np.frombuffer(b"".join(map(known.__getitem__, chunk.text(i).split())), dtype="<i4")
                    if len(ids):
                        parts = np.bincount(ids)
                        parts = parts[parts > 0] / len(ids)
                        n_tokens[i], shares[i], entropies[i] = len(ids), fallback[ids].mean(), -(parts * np.log2(parts)).sum()
                columns = [batch.column(0)[chunk.rows]]
                columns += [pa.array(counts[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                columns += [pa.array(n_tokens.astype(np.int64)), pa.array(counts["word_chars"] / np.maximum(n_tokens, 1)), pa.array(shares), pa.array(np.abs(entropies))]
                columns.append(pa.array([_SCRIPTS[s] for s in counts["script"]], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f.split()[0] for f in _FIELDS.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {dict(docs.dtypes)['doc_id']}, {_FIELDS}")


def judged(docs: DataFrame, bands: dict[str, Band] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The figures with base_failed, fit_failed and kept."""
    inside = F.lit(False)
    for script, b in (bands or BANDS).items():
        slack = 2 / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
        fits = F.col("chars_per_token").between(b.least_chars * (1 - slack), b.most_chars * (1 + slack)) & (F.col("fallback_share") <= b.most_fallback * (1 + slack))
        share = F.least(F.lit(1.0), F.log2(F.greatest(F.col("n_tokens"), F.lit(1))) / math.log2(b.full_tokens))
        fits = fits & (F.col("token_entropy") >= share * b.least_entropy)
        inside = inside | ((F.col("script") == script) & fits & (F.col("n_symbols") <= b.most_symbols * F.col("n_words")))
    measured = figures(docs, vocabulary)
    measured = measured.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")).withColumn("fit_failed", ~inside)
    return measured.withColumn("kept", ~F.col("base_failed") & ~F.col("fit_failed"))
