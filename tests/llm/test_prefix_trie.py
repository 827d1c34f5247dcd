"""The trie of conversations against dictionaries, on bushes, chains and edges."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mailsieve.llm import prefix_trie
from mailsieve.llm.prefix_trie import decomposed, fingerprints, spliced, trie, turns_in_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn int, role string, text string"


def _conversations(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in found.items()}


def _spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for way, inside in members.items():
        subtree = [(w, m) for w, m in members.items() if w[: len(way)] == way]
        kids = {w for w in members if len(w) == len(way) + 1 and w[:-1] == way}
        leaves = sum(not any(u[:-1] == w for u in members if len(u) == len(w) + 1) for w, _ in subtree)
        saved = sum((len(m) - 1) * len(WORD.findall(w[-1][1])) for w, m in subtree if w)
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(way))
        rows.append((min(inside), len(way), min(members[way[:-1]]) if way else None, len(inside), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def _rows(seed, n=25, choices=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 - 20
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, " x\ty  z "][:choices])))
    rng.shuffle(rows)
    return rows


EDGES = [(0, 0, "user", "same"), (0, 0, "user", "same"), (0, None, None, None), (None, 1, "user", "nobody's"), (40, 5, "", ""), (41, 1, "user", "é 日 \U0001f600"), (-7, 1, "user", "x"), (2**40, 1, "user", "w " * 5000)]


@pytest.mark.parametrize("seed,local_nodes,piece", [(1, 20_000, 4096), (2, 6, 2), (3, 12, 3)])
def test_equals_dictionaries(spark, monkeypatch, seed, local_nodes, piece):
    monkeypatch.setattr(prefix_trie, "_PIECE", piece)
    rows = _rows(seed) + EDGES
    table = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("pos", "size", "depth", "h", "top", "_key")))
    turns, ids = spliced(fingerprints(turns_in_order(table, part_rows=40 if piece == 2 else 1000)))
    found = trie(turns, ids, local_nodes)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _brute(_spliced(_conversations(rows)))


def test_one_long_conversation(spark):
    """A chain, split by joins and finished in tasks."""
    rows = [(1, i, "user", f"turn {i}") for i in range(600)] + [(2, i, "user", f"turn {i}") for i in range(300)] + [(3, 0, "user", "other")]
    turns = fingerprints(turns_in_order(spark.createDataFrame(rows, SCHEMA), part_rows=100))
    got = {(r.conv_id, r.depth): r for r in trie(turns.drop("size"), turns.select("conv_id").distinct(), 100).collect()}
    assert len(got) == 602
    assert all(got[1, d].n_leaves == 1 and got[1, d].saved_tokens == 2 * max(0, 301 - d) and got[1, d].n_convs == (2 if d <= 300 else 1) for d in range(1, 601))
    assert got[1, 0].n_leaves == 2 and got[1, 0].saved_tokens == 600 and got[1, 0].n_children == 2


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        turns, ids = spliced(fingerprints(turns_in_order(spark.createDataFrame(rows, SCHEMA))))
        assert trie(turns, ids).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_decomposition(shape):
    """Totals of a tree of any shape."""
    rng, n = random.Random(shape), 3000
    parent = [{"chain": i - 1, "star": 0, "random": rng.randint(0, max(0, i - 1)), "caterpillar": i - 2 + i % 2}[shape] for i in range(n)]
    children = [[] for _ in range(n)]
    for i in range(1, n):
        children[max(0, parent[i])].append(i)
    values = [(rng.randint(0, 9), 1) for _ in range(n)]
    totals = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        for j in range(2):
            totals[max(0, parent[i])][j] += totals[i][j]
    assert decomposed(children, [t[1] for t in totals], values) == [tuple(t) for t in totals]
    assert decomposed([], [], []) == []
