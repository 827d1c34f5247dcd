"""Places in groups of any size, and the pages that are made from them."""

import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import paging, positions, threads
from mailsieve.operators.positions import numbered


def _rows(seed, n=4000):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.4 else rng.choice("abc"), rng.choice([None, 5, 5, 5, rng.randint(0, 30)]), i) for i in range(n)]


@pytest.mark.parametrize("part_rows", [40, 500, 100_000])
def test_places(spark, part_rows):
    """40 % of the rows in one group, and most of those at one time."""
    rows = _rows(part_rows)
    df = spark.createDataFrame(rows, "g string, t long, id long").withColumn("_key", F.lit("x")).withColumn("_part", F.lit(1)).repartition(5)
    got = numbered(df, [F.col("g")], [F.col("t"), F.col("id")], "place", "of", part_rows)
    assert got.columns == [*df.columns, "place", "of"]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=order)
        want |= {r[2]: (i, len(own)) for i, r in enumerate(own, 1)}
    assert {r.id: (r.place, r.of) for r in got.collect()} == want


def test_equal_rows_are_numbered_once_each(spark):
    df = spark.createDataFrame([(1, 1)] * 300 + [(1, 2)] * 5, "g long, t long")
    places = numbered(df, [F.col("g")], [F.col("t")], "place", part_rows=20).collect()
    assert sorted(r.place for r in places) == list(range(1, 306))
    assert all((r.place > 300) == (r.t == 2) for r in places)
    assert numbered(df.limit(0), [F.col("g")], [F.col("t")], "place", "of").collect() == []


def test_parts_of_a_hot_group_are_small(spark):
    """One thread and one instant with most rows: no part has a 20th of them."""
    rows = [("hot", 5 if i % 4 else i, i) for i in range(20_000)] + [(f"t{i}", i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, t long, id long").select(F.struct("g").alias("_g"), F.struct("t", "id").alias("_k"))
    large = df.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1000")
    cuts = positions._borders(df, large, "_g", "_k", "_n", "_b", 1000)
    parts = df.join(cuts, "_g").groupBy("_g", positions._below(F.col("_b"), F.col("_k")).alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 20_000 and len(parts) > 80 and max(r["count"] for r in parts) < 1100


def _gapped(messages):
    rng = random.Random(2)
    return messages(*({"uid": rng.choice([None, 3, 3, i]), "date": rng.choice([None, f"2026-01-{1 + i % 9:02d}T00:00:00Z"]), "thread_id": rng.choice([None, "a", f"t{i}"])} for i in range(60)))


def test_directory_leads_to_the_pages_of_a_walk(messages):
    df = _gapped(messages).select("id", "uid", "sent_at").cache()
    placed = {}
    for r in paging.paged(df, 7, part_rows=10).collect():
        placed.setdefault(r.page, {})[r.page_row] = r.id
    listed = {r.page: (r.token, r.n_rows) for r in paging.directory(df, 7, part_rows=10).collect()}
    page, k = paging.keyset_page(df, 7), 0
    while True:
        walked = {r.page_row: r.id for r in page.rows.collect()}
        assert walked == placed[k] and listed[k][1] == len(walked)
        # The first page needs no token, but has one.
        assert {r.page_row: r.id for r in paging.keyset_page(df, 7, listed[k][0]).rows.collect()} == walked
        token, k = page.next_token(), k + 1
        if token is None:
            break
        assert listed[k][0] == token
        page = paging.keyset_page(df, 7, token)
    assert k == len(placed) == len(listed) == 9
    assert sorted(r.id for r in paging.on_pages(df, 7, part_rows=10).collect()) == sorted(r.id for r in df.collect())


def test_thread_directory_leads_to_the_pages_of_a_walk(messages):
    df = _gapped(messages).cache()
    facts = threads.thread_facts(df)
    listed = {r.page: r for r in threads.thread_directory(facts, 6, 5).collect()}
    seen, token, k = [], None, 0
    while rows := threads.thread_page(df, 6, token=token).collect():
        assert (listed[k].token, listed[k].n_threads, listed[k].first_id) == (token, len(rows), rows[0].id)
        seen += [(r.id, k) for r in rows]
        token, k = rows[-1].page_token, k + 1
    assert k == len(listed) and None in [i for i, _ in seen]
    found = [(r.id, r.page) for r in threads.on_thread_pages(facts, threads.thread_directory(facts, 6, 5), 6, 5).collect()]
    assert sorted(found, key=repr) == sorted(seen, key=repr)


def test_page_sizes_are_refused_not_cut(messages):
    with pytest.raises(ValueError):
        paging.offset_page(messages({}), F.desc("uid"), n=51)


def test_the_thread_without_an_id_is_read(messages):
    df = messages({"thread_id": None}, {"thread_id": "a"}, {"thread_id": None})
    assert threads.thread_messages(df, None).count() == 2 and threads.thread_messages(df, "a").count() == 1
