"""The limiter against the plain rule, attempt by attempt."""

import math
import random

import pandas as pd
import pytest

from mailsieve.operators.ratelimit import admissions, trailing_attempts, verdicts
from mailsieve.streaming import ratelimit as stream
from mailsieve.streaming.ratelimit import limit_stream


def plain(rows, window, limit):
    out, logs = {}, {}
    for key, at, id_ in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        log = [t for t in logs.get(key, []) if at - t < window]
        ok = len(log) < limit
        out[id_] = (ok, None if ok else math.ceil((log[0] + window - at) / 1000))
        logs[key] = [*log, at] if ok else log
    return out


def rows_of(seed, n=3000, span=400_000):
    """One key with a third of all attempts, bursts at one millisecond, pauses."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randint(0, 30)}"
        at = rng.randint(0, span)
        at = at - at % 5000 if rng.random() < 0.3 else at
        rows.append((key, at + (span * 3 if rng.random() < 0.2 else 0), i))
    return rows


@pytest.mark.parametrize("window,limit", [(10_000, 3), (1_000, 1), (60_000, 10), (7_001, 2)])
def test_equals_the_plain_rule(spark, window, limit):
    rows = rows_of(window)
    df = spark.createDataFrame(rows, "key string, at_ms long, id long").repartition(5)
    got = {r["id"]: (r["admitted"], r["retry_after_s"]) for r in verdicts(df, window, limit).collect()}
    assert got == plain(rows, window, limit)


def test_quiet_keys_are_not_walked(spark):
    df = spark.createDataFrame([("a", i * 1000, i) for i in range(50)], "key string, at_ms long, id long")
    got = admissions(df, 1000, 5).collect()
    assert all(r["admitted"] == r["n"] == 1 for r in got) and len(got) == 50


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        admissions(spark.createDataFrame([("a", 1)], "key string, at_ms long"), 10, 0)


def test_trailing_counts(spark):
    rows = rows_of(5, 1500)
    df = spark.createDataFrame(rows, "key string, at_ms long, id long")
    got = {r["id"]: r["n_trailing"] for r in trailing_attempts(df, 10_000).collect()}
    want = {i: sum(k2 == k and t - 10_000 < t2 <= t for k2, t2, _ in rows) for k, t, i in rows}
    assert got == want


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "key string, at_ms long, id long"


def _streamed(spark, at, parts, *limits, **options):
    """The output rows and, of each state variable, the number of entries left."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        writer = limit_stream(source, *limits, **options).writeStream.format("parquet").option("path", f"{at}/out")
        writer.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
        state = {v: spark.read.format("statestore").option("path", f"{at}/progress").option("stateVarName", v).load().count() for v in ("times", "waiting", "entries")}
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{at}/out").collect(), state


def test_stream_out_of_order(spark, tmp_path):
    """Attempts in any order, some too late, some without a key or a time: each is in the
    output once, verdicts are those of the plain rule over what came in time, and nothing is kept of
    keys that have gone quiet."""
    start, lateness = 1_700_000_000_000, 30_000
    rows = [(k, at + start, i) for k, at, i in rows_of(9, 900)]
    rng = random.Random(1)
    rows.sort(key=lambda r: r[1] + rng.randint(0, 200_000))
    parts = [rows[i * 300 : (i + 1) * 300] for i in range(3)]
    parts[1] = parts[1] + [(None, start, 9001), ("k1", None, 9002), (None, None, 2**60 + 1)]
    beat = ("beat", start + 10_000_000, -1)
    got, state = _streamed(spark, tmp_path, [*parts, [beat]], 20_000, 3, "30 seconds")
    late, watermark = set(), 0
    for part in parts:
        late |= {i for k, at, i in part if k and at and at < watermark}
        watermark = max(watermark, max(at for _, at, _ in part if at) - lateness)
    assert len(got) == 903 and len({r.id for r in got}) == 903 and 50 < len(late) < 500
    assert {r.id for r in got if r.reason == "late"} == late
    assert {r.id for r in got if r.reason == "no key or time"} == {9001, 9002, 2**60 + 1}
    assert all(r.admitted is None and r.retry_after_s is None for r in got if r.reason)
    judged = {r.id: (r.admitted, r.retry_after_s) for r in got if not r.reason}
    assert judged == plain([r for r in rows if r[2] not in late], 20_000, 3)
    # Only the last attempt waits; the admissions of 31 keys have left the window.
    assert state == {"times": 0, "waiting": 1, "entries": 1}


def test_stream_keeps_what_the_window_needs(spark, tmp_path):
    """A slice of many attempts fills several entries; a log behind the watermark still counts for slices that wait."""
    start = 1_700_000_000_000
    rows = [("hot", start + i // 10, i) for i in range(9000)] + [("hot", start + 15_000, 9000), ("hot", start + 40_000, 9001)]
    got, state = _streamed(spark, tmp_path, [rows, [("beat", start + 41_000 + 1000, -1)]], 20_000, 2, "1 second", slice_ms=1000)
    assert {r.id: (r.admitted, r.retry_after_s) for r in got} == plain(rows, 20_000, 2)
    assert state["times"] == 1  # of the last admission, 40 seconds on


def test_stream_of_numeric_keys_next_to_none(spark, tmp_path, monkeypatch):
    """Attempts without a key leave the keys of those beside them as they are."""
    monkeypatch.setitem(globals(), "SCHEMA", "key long, at_ms long, id long")
    start = 1_700_000_000_000
    rows = [(2**60 + i % 3, start + 1000 * i, i) for i in range(60)]
    parts = [[*rows, (None, start, 900), (None, start + 1, 901)], [(7, start + 10_000_000, -1)]]
    got, _ = _streamed(spark, tmp_path, parts, 20_000, 3, "1 second")
    assert {r.id: r.key for r in got} == {i: k for k, _, i in rows} | {900: None, 901: None}
    assert {r.id: (r.admitted, r.retry_after_s) for r in got if not r.reason} == plain(rows, 20_000, 3)


class _State(dict):
    """The state of one key: list, map and value at once."""

    get = lambda self: iter(self["list"]) if "list" in self else self["value"]
    clear = lambda self: self.put([]) if "list" in self else dict.clear(self)
    put = lambda self, rows: self.__setitem__("list", rows)
    update = lambda self, row: self.__setitem__("value", row)
    exists = lambda self: len(self) > 0
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__
    iterator = dict.items


class _Handle:
    """State variables and timers in memory, with a count of the timers set."""

    def __init__(self):
        self.states, self.timers, self.n_set = {}, set(), 0
        self.getMapState = self.getValueState = lambda name, *_: self.states.setdefault(name, _State())
        self.getListState = lambda name, *_: self.states.setdefault(name, _State(list=[]))
        self.deleteTimer = self.timers.remove

    def registerTimer(self, at):
        self.n_set += at not in self.timers
        self.timers.add(at)


class _Now:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def _limited(batches, window, limit, slice_ms):
    """One key's batches (watermark, [(at, id)]) through a limiter: rows out and its handle."""
    limiter, handle, out = stream.Limiter(window, limit, slice_ms, "bigint"), _Handle(), []
    limiter.init(handle)
    for watermark, rows in batches:
        if rows:
            frame = pd.DataFrame({"id": [i for _, i in rows], "no_id": False, "at_ms": [at for at, _ in rows], "no_time": False})
            out += limiter.handleInputRows(("k", False), iter([frame]), _Now(watermark))
        for at in sorted(t for t in handle.timers if t <= watermark):
            handle.timers.discard(at)
            timer, now = _Now(at), _Now(watermark)
            out += limiter.handleExpiredTimer(("k", False), now, timer)
    return pd.concat(out).astype(object).where(lambda x: x.notna(), None), handle


def test_a_key_has_one_timer():
    """Attempts of a thousand slices take a timer, not a thousand, and come out in one frame."""
    rows = [(i * 1000, i) for i in range(1000)]
    out, handle = _limited([(0, rows), (10_000_000, [])], 5_000, 3, 1000)
    assert {r.id: (r.admitted, r.retry_after_s) for r in out.itertuples()} == plain([("k", *r) for r in rows], 5_000, 3)
    assert handle.n_set <= 2 and not handle.timers
    assert not any(handle.states[v] for v in ("waiting", "entries", "due"))


@pytest.mark.parametrize("entry,block", [(4, 8), (4096, 256), (3, 1), (16, 4)])
def test_full_entries_are_dealt_by_slice(monkeypatch, entry, block):
    """Whatever the sizes of entries and blocks, and wherever the watermark stands in them."""
    monkeypatch.setattr(stream, "_ENTRY", entry, raising=False)
    monkeypatch.setattr(stream, "_BLOCK", block, raising=False)
    rng = random.Random(entry)
    for _ in range(60):
        lateness, span = rng.choice([0, 300, 3_000]), rng.choice([500, 5_000])
        batches, late, kept, watermark, at, n = [], set(), [], 0, 1_000, 0
        for _ in range(rng.randint(1, 8)):
            rows = [(max(0, at + rng.randint(-span, span)), n + i) for i in range(rng.randint(0, 40))]
            n, at = n + len(rows), at + rng.randint(0, span)
            batches.append((watermark, rows))
            late |= {i for t, i in rows if t < watermark}
            kept += [("k", t, i) for t, i in rows if t >= watermark]
            watermark = max([watermark, *(t - lateness for t, _ in rows)])
        if n == 0:
            continue
        out, handle = _limited([*batches, (10**9, [])], 700, 2, 100)
        assert len(out) == n and {r.id for r in out.itertuples() if r.reason == "late"} == late
        assert {r.id: (r.admitted, r.retry_after_s) for r in out.itertuples() if not r.reason} == plain(kept, 700, 2)
        assert not any(handle.states[v] for v in ("waiting", "entries")) and not handle.timers
