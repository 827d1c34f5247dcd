"""Fill-in-the-middle against cuts made by hand, and on texts at the edges."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mailsieve.llm.fill_in_middle import SkipList, digest, restored, transformed, unit_starts

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 60, 900, 40_000])
def test_every_rank_is_reached(n):
    rng = random.Random(n)
    text = "".join(rng.choice("ab Zé\n日\U0001f600<") for _ in range(n))
    units = UNIT.findall(text)
    lanes = SkipList(unit_starts(text))
    assert lanes.n == len(units)
    ranks = range(len(units) + 1) if n < 1000 else [0, len(units), *(rng.randint(0, len(units)) for _ in range(200))]
    assert all(lanes.point_of(k) == len("".join(units[:k])) for k in ranks)
    if n == 40_000:  # few nodes a lane are passed
        assert len(lanes.unit_widths) > 5 and all(int(w.sum()) == lanes.n for w in lanes.unit_widths)
        assert all(int(w.sum()) == len(text) for w in lanes.point_widths)


def _by_hand(doc_id, text, rate, spm, salt):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or c % 100 >= rate:
        return len(units), "plain", None, None, text
    i, j = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if d % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


EDGES = [None, "", " ", "a", "word", "\n", "a<P>b", "x <S", "<M>", "<<S", "P>S>M>", "\U0001f600é" * 40, "one two\r\nthree " * 5000]


@pytest.mark.parametrize("rate,spm,salt", [(90, 20, 1), (100, 100, 1), (100, 0, 7), (0, 20, 1)])
def test_forms(spark, rate, spm, salt):
    rows = [(i, t) for i, t in enumerate(EDGES * 4)] + [(3, "a"), (3, "a"), (None, "no id"), (-5, "minus five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Columns that clash with those of the operator.
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("n", "form", "output", "a", "b", "prefix_chars")))
    found = transformed(docs, rate, spm, salt)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(((i, *_by_hand(i, t, rate, spm, salt)) for i, t in rows), key=repr)
    again = found.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted((tuple(r) for r in again.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digest(transformed(docs)).collect() == []
