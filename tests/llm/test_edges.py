"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names, for every operator."""

import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailsieve.llm import decontamination, packing, pii, quality_classifier, quality_rules, secret_scan, signature_join, token_counts, toxicity, url_filters

SENTENCE = "the quick brown fox jumps over the lazy dog near the quiet river bank at noon"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, SENTENCE),
    (2, SENTENCE),
    (2, SENTENCE),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "orphan text with password = abcdefghijklmnop inside of it here"),
    (6, LONG),
    (7, "short"),
    (8, "é" * 50 + " \U00013000 ünï"),
]
# Names that operators use for their own columns.
CLASHING = ["lang", "source", "n_chars", "_text", "_words", "_d", "_h", "_r", "ids", "length", "target", "class", "n", "host", "group", "made", "text_hash", "best", "_i", "_hash", "kind", "start"]


def frame(spark, rows, clashing=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) if c != "n_chars" else F.length("text").cast("long").alias(c) for c in CLASHING)) if clashing else df


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 9)] + [(1, None, None), (None, 1, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    words = SENTENCE.split()
    rows = [(1, " ".join(words[2:14])), (2, "short"), (3, None), (4, ""), (2, "short"), (None, " ".join(words[3:13]))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(0))


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality(spark, labels):
    docs = frame(spark, ROWS)
    model = quality_classifier.fit(docs, labels)
    rated = by_id(quality_classifier.rate(docs, model))
    assert len(rated) == len(ROWS)
    assert all(0 <= tail <= 1 and 0 <= grade <= 2 for _, grade, tail, _ in rated)
    empty = [r[1:] for r in rated if r[0] in (3, 4, 5)]
    assert len(set(empty)) == 1 and len({r[1:] for r in rated if r[0] in (1, 2)}) == 1
    assert quality_classifier.accepted(docs, model).columns == docs.columns
    assert quality_classifier.rate(frame(spark, []), model).count() == 0
    unrated = quality_classifier.fit(docs, labels.limit(0))
    assert all(r[3] for r in by_id(quality_classifier.rate(docs, unrated)))


def test_rules(spark):
    rows = {r.doc_id: r for r in quality_rules.judged(frame(spark, ROWS)).collect()}
    assert (rows[3].n_words, rows[3].n_tokens, rows[3].chars_per_token, rows[3].token_entropy, rows[3].kept) == (0, 0, 0.0, 0.0, False)
    assert rows[1][1:] == rows[2][1:] and rows[1].kept
    assert rows[6].n_words == 60_000 and rows[8].fallback_share > 0
    assert quality_rules.judged(frame(spark, [])).count() == 0


def test_lists(spark):
    day = datetime.date(2024, 5, 1)
    captures = spark.createDataFrame(
        [(1, "http://a.b.example/x", day), (1, "http://a.b.example/x", day), (2, None, day), (3, "http://b.example", None), (4, "no url", day), (5, "ftp://user@B.example.:80/", day)], "page_id long, url string, day date"
    ).withColumn("_host", F.lit("x")).withColumn("domain", F.lit("x")).withColumn("best", F.lit("x"))
    entries = spark.createDataFrame(
        [("block", "b.example", datetime.date(2024, 1, 1), "add"), ("block", "b.example", day, "remove"), ("block", "b.example", day, "add"), ("block", None, day, "add"), ("block", "a.b.example", day, "other")],
        "list string, domain string, day date, action string",
    )
    found = url_filters.judged(captures, entries)
    assert sorted(r.verdict for r in found.collect()) == ["blocked"] * 3 + ["unlisted"] * 3
    assert found.where("page_id = 1").select("_host", "best", "domain").distinct().collect() == [("x", "x", "b.example")]
    assert {r.verdict for r in url_filters.judged(captures, entries.limit(0)).collect()} == {"unlisted"}
    assert url_filters.judged(captures.limit(0), entries).count() == 0


def test_secrets(spark):
    rows = by_id(secret_scan.report(frame(spark, ROWS)))
    assert len(rows) == len(ROWS)
    assert [r[1] for r in rows if r[0] is None] == [1]
    assert len({r[4] for r in rows if r[0] in (3, 4, 5)}) == 1
    assert secret_scan.report(frame(spark, [])).count() == 0


def test_counts(spark):
    rows = by_id(token_counts.counted(frame(spark, ROWS), block_bytes=1 << 12))
    assert len(rows) == len(ROWS) and [n for i, n in rows if i in (3, 4)] == [0, 0]
    assert token_counts.counted(frame(spark, [])).count() == 0


def test_packing(spark):
    docs = frame(spark, ROWS)
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows if r.doc_id in (3, 4)) == 2
    assert sum(r.length == 1 for r in rows) == 2
    assert packing.pack_documents(frame(spark, [])).count() == 0
    again = packing.pack(spark.createDataFrame([(5, "x", "y", 1)], "length long, group string, `offset` string, sequence_id long"), 8)
    assert again.columns == ["length", "group", "sequence_id", "offset"] and again.count() == 1


def test_near_duplicates(spark):
    docs = frame(spark, ROWS)
    found = {(r.doc_id, r.n_shingles): r.component_id for r in signature_join.near_duplicates(docs).collect()}
    assert found[(2, 12)] == 1 and found[(3, 0)] == 3 and found[(4, 0)] == 4 and found[(7, 1)] == 7
    kept = signature_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert signature_join.near_duplicates(frame(spark, [])).count() == 0
    assert signature_join.deduplicated(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, SENTENCE), (1, SENTENCE), (9, SENTENCE)])
    assert [r.doc_id for r in signature_join.deduplicated(twice).collect()] == [1]


def test_decontamination(spark, benchmark):
    docs = frame(spark, ROWS)
    rows = by_id(decontamination.digest(decontamination.report(docs, benchmark)))
    assert len(rows) == len(ROWS)
    assert [r[2] for r in rows if r[0] in (1, 2)] == [12, 12, 12] and [r[3] for r in rows if r[0] == 7] == [1]
    cleaned = decontamination.clean(docs, benchmark)
    assert cleaned.columns == docs.columns and sorted(r.doc_id or 0 for r in cleaned.collect()) == [0, 3, 4, 5, 6, 8]
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(ROWS)
    assert decontamination.report(frame(spark, []), benchmark).count() == 0
    spots = decontamination.occurrences(docs.where("doc_id = 7"), benchmark)
    assert [(r.start, r.n, r.item_id) for r in spots.collect()] == [(0, 1, 2)]


def test_pii(spark):
    docs = frame(spark, ROWS + [(9, "call +1 (415) 555-2671 now")])
    changed = pii.pseudonymised(docs)
    assert changed.columns == docs.columns
    before, after = ({(r.doc_id, r.text) for r in d.collect()} for d in (docs, changed))
    assert {i for i, _ in before - after} == {9} and {r._r for r in changed.collect()} == {"x"}
    assert pii.pseudonymised(frame(spark, [])).count() == 0


def test_toxicity(spark, labels):
    docs = frame(spark, ROWS)
    rows = by_id(toxicity.judged(docs, labels))
    assert len(rows) == len(ROWS) and all(0 <= r[2] <= 1 for r in rows)
    assert len({r[2] for r in rows if r[0] in (3, 4)}) == 1
    assert len(by_id(toxicity.judged(docs, labels.limit(0)))) == len(ROWS)
    assert toxicity.judged(frame(spark, []), labels).count() == 0


def test_stages(spark, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert kept.columns == docs.columns, name
                assert kept.dtypes == docs.dtypes, name
            kept.write.parquet(f"{tmp_path}/{len(rows)}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{len(rows)}-{name}")
        if rows:
            assert {3, 4}.issubset({r.doc_id for r in docs.collect()}) or docs.count() == 0
