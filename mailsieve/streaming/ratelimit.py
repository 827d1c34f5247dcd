"""Sliding-log admission on a stream, in event time.

Attempts may arrive in any order. They wait in the state of their key, and are judged
by time slices when a timer says that the watermark has passed the end of one, so
verdicts are those of the batch operator whatever the order of arrival. An
attempt behind the watermark cannot be judged any more, as what came after it has
been; it is put out at once, without a verdict and with a reason.

A key has one timer, for its first waiting slice, and then judges all slices behind the
watermark, in order. Most keys have few attempts in a slice, so the attempts of a block of
slices wait in one entry; when that is full, they are dealt to entries by slice. What a
task holds of a key is a full entry, and the attempts of one slice.

What a key keeps: its waiting attempts, and the times of its last admissions until the
window has left them behind, when the timer drops them. A key that is idle keeps nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsieve.operators.ratelimit import LIMIT, WINDOW_MS, SlidingLog

LATE, UNDECIDABLE = "late", "no key or time"
# Attempts in one entry of the state, and slices in a block.
_ENTRY, _BLOCK = 4096, 1024


class Limiter(StatefulProcessor):
    def __init__(self, window_ms: int, limit: int, slice_ms: int, id_type: str):
        self.window_ms, self.limit, self.slice_ms, self.id_type = window_ms, limit, slice_ms, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at bigint")
        # What waits: a place, the block of a packed entry or else a slice, and the number of an
        # entry there, to its attempts; and how many entries a place has.
        self.waiting = handle.getMapState("waiting", "place bigint, packed boolean, entry int", f"at array<bigint>, id array<{self.id_type}>")
        self.entries = handle.getMapState("entries", "place bigint, packed boolean", "n int")
        # The time of the key's timer.
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known = not key[1]
        name = key[0] if known else None
        for batch in rows:
            at, ids = batch["at_ms"].to_numpy(), batch["id"].to_numpy(dtype=object, copy=True)
            ids[batch["no_id"].to_numpy()] = None
            no_time = batch["no_time"].to_numpy()
            undecidable = no_time | (not known)
            late = ~undecidable & (at < watermark)
            if undecidable.any():
                times = pd.Series(at[undecidable], dtype="Int64").mask(no_time[undecidable])
                yield _rows(name, ids[undecidable], times, None, None, UNDECIDABLE)
            if late.any():
                yield _rows(name, ids[late], at[late], None, None, LATE)
            waits = ~undecidable & ~late
            if waits.any():
                self._wait(at[waits], ids[waits])

    def _wait(self, at: np.ndarray, ids: np.ndarray) -> None:
        for block, own_at, own_ids in _by_place(at, ids, self.slice_ms * _BLOCK):
            found = self._entry((block, True, 0)) if self.waiting.containsKey((block, True, 0)) else None
            if found:
                own_at, own_ids = np.concatenate([found[0], own_at]), np.concatenate([found[1], own_ids])
            if len(own_at) <= _ENTRY:
                self._put((block, True, 0), own_at, own_ids)
                if not found:
                    self.entries.updateValue((block, True), (1,))
                continue
            if found:
                self._drop((block, True), 1)
            for place, some_at, some_ids in _by_place(own_at, own_ids, self.slice_ms):
                self._append(place, some_at, some_ids)
        wakes = (int(at.min()) // self.slice_ms + 1) * self.slice_ms
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or wakes < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self._wake(wakes)

    def _append(self, place: int, at: np.ndarray, ids: np.ndarray) -> None:
        """To the entries of a slice, of which the last is filled up first."""
        n = self.entries.getValue((place, False))[0] if self.entries.containsKey((place, False)) else 0
        if n:
            last = self._entry((place, False, n - 1))
            if len(last[0]) < _ENTRY:
                at, ids, n = np.concatenate([last[0], at]), np.concatenate([last[1], ids]), n - 1
        for start in range(0, len(at), _ENTRY):
            self._put((place, False, n), at[start : start + _ENTRY], ids[start : start + _ENTRY])
            n += 1
        self.entries.updateValue((place, False), (n,))

    def _entry(self, name: tuple[int, bool, int]) -> tuple[np.ndarray, np.ndarray]:
        at, ids = self.waiting.getValue(name)
        return np.array(at, dtype=np.int64), _objects(ids)

    def _put(self, name: tuple[int, bool, int], at: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.updateValue(name, (at.tolist(), ids.tolist()))

    def _drop(self, place: tuple[int, bool], n: int) -> None:
        for entry in range(n):
            self.waiting.removeKey((*place, entry))
        self.entries.removeKey(place)

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        end = watermark // self.slice_ms  # slices in front of it are complete
        log = SlidingLog(self.window_ms, self.limit, (t[0] for t in self.times.get()))
        kept = len(log.times)
        blocks, first, judged, size = {}, None, [], 0  # first: of the slices that go on waiting
        for (place, packed), (n,) in self.entries.iterator():
            start = place * _BLOCK if packed else place
            if start < end:
                blocks.setdefault(start // _BLOCK, []).append((start, packed, n))
            elif first is None or start < first:
                first = start
        for block in sorted(blocks):
            at, ids = np.empty(0, dtype=np.int64), _objects([])
            slices = {start: n for start, packed, n in blocks[block] if not packed}
            if any(packed for _, packed, _ in blocks[block]):
                at, ids = self._entry((block, True, 0))
                later = at >= end * self.slice_ms
                if later.any():
                    rest = int(at[later].min()) // self.slice_ms
                    first = rest if first is None else min(first, rest)
                    if not later.all():
                        self._put((block, True, 0), at[later], ids[later])
                else:
                    self._drop((block, True), 1)
                at, ids = at[~later], ids[~later]
            for some_at, some_ids in self._in_order(at, ids, slices):
                judged.append(_judged(some_at, some_ids, log))
                size += len(some_at)
                if size >= _ENTRY:
                    yield _rows(key[0], *_joined(judged), None)
                    judged, size = [], 0
        if judged:
            yield _rows(key[0], *_joined(judged), None)
        # What has left the window of all that may still be judged.
        over = watermark if first is None else end * self.slice_ms
        while log.times and log.times[0] + self.window_ms <= over:
            log.times.popleft()
        if log.times:
            self.times.put([(t,) for t in log.times])
        elif kept:
            self.times.clear()
        if first is not None:
            self._wake((first + 1) * self.slice_ms)
        elif log.times:
            self._wake(-((log.times[-1] + self.window_ms) // -self.slice_ms) * self.slice_ms)
        else:
            self.due.clear()

    def _in_order(self, at: np.ndarray, ids: np.ndarray, slices: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A block's attempts, in parts that follow each other in time: those at hand, and the entries of `slices`."""
        if not slices:
            if len(at):
                yield at, ids
            return
        own = {place: (some_at, some_ids) for place, some_at, some_ids in _by_place(at, ids, self.slice_ms)}
        for place in sorted(own.keys() | slices.keys()):
            n = slices.get(place, 0)
            parts = [self._entry((place, False, entry)) for entry in range(n)] + ([own[place]] if place in own else [])
            if n:
                self._drop((place, False), n)
            yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        pass


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _by_place(at: np.ndarray, ids: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The attempts of each stretch of time of this width: its number, their times and ids."""
    if not len(at):
        return
    places = at // width
    order = np.argsort(places, kind="stable")
    names, starts = np.unique(places[order], return_index=True)
    for name, inside in zip(names.tolist(), np.split(order, starts[1:])):
        yield name, at[inside], ids[inside]


def _judged(at: np.ndarray, ids: np.ndarray, log: SlidingLog) -> tuple[np.ndarray, ...]:
    """ids, at, admitted and seconds to wait, in order of time; of one time, by id."""
    order = sorted(range(len(at)), key=lambda i: (at[i], ids[i] is not None, ids[i]))
    at, ids = at[order], ids[order]
    instants, first, n = np.unique(at, return_index=True, return_counts=True)
    took, wait = log.offer(instants, n)
    return ids, at, np.arange(len(at)) - np.repeat(first, n) < np.repeat(took, n), np.repeat(wait, n)


def _joined(judged: list[tuple[np.ndarray, ...]]) -> tuple:
    ids, at, admitted, wait = (np.concatenate(c) for c in zip(*judged))
    return ids, at, admitted, pd.arrays.IntegerArray(wait, admitted)


def _rows(key, ids, at, admitted, retry, reason) -> pd.DataFrame:
    n = len(ids)
    return pd.DataFrame(
        {
            "key": pd.Series([key] * n, dtype=object),
            "id": pd.Series(ids, dtype=object),
            "at_ms": pd.Series(at, dtype="Int64").reset_index(drop=True),
            "admitted": pd.Series([None] * n if admitted is None else admitted, dtype="boolean"),
            "retry_after_s": pd.Series([None] * n if retry is None else retry, dtype="Int64"),
            "reason": pd.Series([reason] * n, dtype=object),
        }
    )


def limit_stream(attempts: DataFrame, window_ms: int = WINDOW_MS, limit: int = LIMIT, lateness: str = "1 minute", slice_ms: int = 1000) -> DataFrame:
    """Streaming attempts (key, id, at_ms), each in exactly one row: with its verdict,
    once the watermark has passed the end of its slice, or with a reason why it has
    none, `late` or `no key or time`. `lateness` is how far behind the latest attempt
    one may arrive and still be judged. One key's attempts of one slice are judged
    together, so `slice_ms` bounds what a task holds. Needs the RocksDB state store."""
    if limit < 1 or slice_ms < 1:
        raise ValueError("limit and slice_ms must be at least 1")
    id_type = attempts.schema["id"].dataType
    timed = attempts.select("key", "id", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", lateness)
    # Without the column of the watermark, Spark does not drop what lies behind it: `Limiter` puts it out.
    # No numbers are null, as pandas would make them inexact ones, and the key of the state would be another one.
    # Attempts without a key are spread, as nothing holds them together.
    spread = F.pmod(F.xxhash64("id", "at_ms"), F.lit(64)).cast(attempts.schema["key"].dataType)
    plain = timed.select(F.coalesce("key", spread).alias("key"), F.col("key").isNull().alias("no_key"), F.coalesce("id", F.lit("0").cast(id_type)).alias("id"), F.col("id").isNull().alias("no_id"), F.coalesce("at_ms", F.lit(0)).alias("at_ms"), F.col("at_ms").isNull().alias("no_time"))
    verdict = T.StructType(
        [
            T.StructField("key", attempts.schema["key"].dataType),
            T.StructField("id", id_type),
            T.StructField("at_ms", T.LongType()),
            T.StructField("admitted", T.BooleanType()),
            T.StructField("retry_after_s", T.LongType()),
            T.StructField("reason", T.StringType()),
        ]
    )
    return plain.groupBy("key", "no_key").transformWithStateInPandas(
        statefulProcessor=Limiter(window_ms, limit, slice_ms, id_type.simpleString()),
        outputStructType=verdict,
        outputMode="Append",
        timeMode="EventTime",
    )
