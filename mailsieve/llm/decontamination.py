"""Benchmark decontamination as a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item, or a whole item of
fewer. A document contains a window only if it contains every shingle of it, so
the rarest one, by its count over all documents, is a sufficient prefix: each
window is looked for at the occurrences of that shingle alone. Bounds on length
and position drop occurrences too near to a document's ends, and the words
around the rest are compared with the window.

Documents never leave their partitions: shingles are looked up in a broadcast
table whose rows are counted first, in as many passes as it has parts of
bounded size. Only occurrences are shuffled.

A null text has no words and nothing is found in it; a null item text gives no
window, and a null item_id is found but not counted among items. Rows are known
by doc_id and text, so repeated rows each get the same full result. No documents give no
rows; no items leave every document clean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.shared import settled

WINDOW = 10
SHINGLE = 3
# Rows of the benchmark's tables that are broadcast at once, about 200 bytes each.
BROADCAST_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case: runs of ASCII letters and digits
    and of anything beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN_WORDS), "")


def _starts(words: Column, length: Column | int) -> Column:
    """0, 1, ... up to the last place where `length` words begin."""
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hash(words: str, at: str, size: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'get({words}, {at} + {k})' for k in range(size))})")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window_text (its words, by spaces), n (how many) of every window."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_w")).where("size(_w) > 0")
    items = items.withColumn("n", F.least(F.size("_w"), F.lit(window)))
    cut = items.withColumn("_s", F.explode(_starts(F.col("_w"), F.col("n"))))
    return cut.select("item_id", F.concat_ws(" ", F.expr("slice(_w, _s + 1, n)")).alias("window_text"), "n")


def _parts(rows: int) -> int:
    return max(1, math.ceil(rows / BROADCAST_ROWS))


def _shingles_of(docs: DataFrame, size: int) -> DataFrame:
    """Every document's shingles: its columns, place and hash."""
    placed = docs.withColumn("_i", F.explode(_starts(F.col("_words"), size)))
    return placed.withColumn("_hash", _hash("_words", "_i", size))


def _prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The rarest shingle of every distinct window: size, _hash, _at (its place in
    the window), window_text, n."""
    distinct = windows.select("window_text", "n").distinct().withColumn("_w", F.split("window_text", " "))
    shingles = None
    for size in sizes:
        own = distinct.where(F.least("n", F.lit(SHINGLE)) == size).withColumn("_at", F.explode(_starts(F.col("_w"), size)))
        own = own.select("window_text", "n", "_at", _hash("_w", "_at", size).alias("_hash"), F.lit(size).alias("size"))
        shingles = own if shingles is None else shingles.union(own)
    shingles = settled(shingles)
    wanted = settled(shingles.select("size", "_hash").distinct())
    parts, counted = _parts(wanted.count()), None
    for size in sizes:
        for part in range(parts):
            some = wanted.where((F.col("size") == size) & (F.pmod("_hash", F.lit(parts)) == part)).select("_hash")
            found = _shingles_of(docs.select("_words"), size).select("_hash").join(F.broadcast(some), "_hash", "left_semi")
            found = found.groupBy("_hash").count().withColumn("size", F.lit(size))
            counted = found if counted is None else counted.unionByName(found)
    rarity = F.struct(F.coalesce("count", F.lit(0)).alias("c"), "_hash", "_at")
    ranked = shingles.join(counted, ["size", "_hash"], "left").groupBy("window_text", "n", "size").agg(F.min(rarity).alias("_r"))
    return ranked.select("size", "_r._hash", "_r._at", "window_text", "n")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_words"))


def _found(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, _text, start, n, window_text of every occurrence, each once."""
    keyed = _keyed(docs)
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE)).cast("int")).distinct().collect())  # at most SHINGLE values
    if not sizes:
        return keyed.limit(0).select("doc_id", "_text", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("window_text"))
    prefixes = settled(_prefixes(keyed, windows, sizes))
    parts, found = _parts(prefixes.count()), None
    for size in sizes:
        for part in range(parts):
            some = prefixes.where((F.col("size") == size) & (F.pmod("_hash", F.lit(parts)) == part)).drop("size")
            met = _shingles_of(keyed, size).join(F.broadcast(some), "_hash").withColumn("start", F.col("_i") - F.col("_at"))
            met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("_words")))
            met = met.where(F.concat_ws(" ", F.expr("slice(_words, greatest(start, 0) + 1, n)")) == F.col("window_text"))
            met = met.select("doc_id", "_text", "start", "n", "window_text")
            found = met if found is None else found.union(met)
    return found.distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start and n (in words) and item_id of every place where a window of
    an item occurs."""
    windows = settled(item_windows(benchmark, window))
    items = windows.select("window_text", "item_id").distinct()
    return _found(docs, windows).join(items, "window_text").select("doc_id", "start", "n", "item_id")


def _hit(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, _text, n_hit and items of every document in which a window occurs."""
    windows = settled(item_windows(benchmark, window))
    found = settled(_found(docs, windows))
    spans = found.groupBy("doc_id", "_text", "start").agg((F.col("start") + F.max("n")).alias("end"))
    before = Window.partitionBy("doc_id", "_text").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("_new", new).groupBy("doc_id", "_text").agg(F.sum("_new").alias("n_hit"))
    items = windows.select("window_text", F.col("item_id").cast("string").alias("item")).distinct()
    named = found.select("doc_id", "_text", "window_text").distinct().join(items, "window_text")
    named = named.groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = named.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "items")
    return covered.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))).drop("_d", "_t")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), items (ids as strings,
    sorted) and contaminated of every document."""
    hit = _hit(docs, benchmark, window).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "n_hit", "items")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    all_rows = sizes.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return all_rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, as they are, in which no window occurs."""
    hit = _hit(docs, benchmark, window).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"))
    hit = settled(hit)  # so that its columns are no longer those of the documents
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (F.xxhash64(docs["text"]) == hit["_t"]), "left_anti")


def digest(reported: DataFrame) -> DataFrame:
    """The report with the number of items and a checksum of them."""
    ids = F.sha2(F.array_join("items", ","), 256)
    return reported.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


DIGEST_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT dw.r, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
i AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
