"""Words and hashes of whole texts, computed on Arrow buffers.

A chunk is a run of whole documents held as one byte array. Words, lines and
n-grams are positions in that array, and every hash is 64 bits of a polynomial
over the bytes, so equal strings have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        known = _powers[base] = np.cumprod(factors)
        if size > 16 * CHUNK_BYTES:  # not kept for one very long text
            _powers.pop(base)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Chunk:
    """Whole documents side by side: `data` their UTF-8 bytes, document i at
    `offsets[i]:offsets[i + 1]`, which are rows `first + i` of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        self.first = first
        self.rows = slice(first, first + len(offsets) - 1)
        self._sums = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def documents_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of every maximal run without ASCII space."""
        inside = ~_SPACE[self.data]
        if not len(inside):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]  # a word never runs from one document into the next
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, self.documents_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of every line; a text of k breaks has k + 1."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        stops = np.concatenate([breaks, self.offsets[1:]])
        owners = np.concatenate([np.arange(len(self)), self.documents_of(breaks)])
        order = np.lexsort((starts, owners))
        ends = np.concatenate([self.documents_of(breaks), np.arange(len(self))])
        return starts[order], stops[np.lexsort((stops, ends))], owners[order]

    def spans_hash(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings start:stop."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[self.data] * _power_table(_BASE, n + 1)[:n], out=self._sums[1:])
        return mix((self._sums[stops] - self._sums[starts]) * _power_table(_BASE_INVERSE, n + 1)[starts])


def chunks(texts: pa.ChunkedArray | pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """Every document of a batch, in chunks; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield Chunk(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first], first, lower)
        first = end


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words that begin at each word; the last n - 1
    positions, and those next to a document's end, are the caller's to leave out."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, dtype=np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += words[k : k + count] * np.uint64(factor)
    return mix(total)


def inside_document(documents: np.ndarray, n: int) -> np.ndarray:
    """Where n consecutive words lie in one document."""
    count = max(0, len(documents) - n + 1)
    return documents[:count] == documents[len(documents) - count :] if count else np.zeros(0, dtype=bool)
