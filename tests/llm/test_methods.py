"""Each operator against a plain version of what it computes, on small tables."""

import collections
import datetime
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailsieve.checks.run import compare, duck
from mailsieve.llm import decontamination, packing, pii, quality_classifier, quality_rules, secret_scan, signature_join, token_counts, toxicity, url_filters
from mailsieve.llm.components import components
from mailsieve.llm.queries import QUERIES, SQL
from mailsieve.llm.samples import labelled_sample, outside_fold
from mailsieve.llm.tokens import byte_bpe, pieces, vocabulary_path

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def documents(spark, sf=LARGER):
    return spark.read.parquet(f"{sf}/documents.parquet")


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF) is None


# Quality and toxicity: accuracy on rows that training has not seen.


@needs_tables
def test_quality_held_out(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{LARGER}/labels.parquet")
    model = quality_classifier.fit(docs, labels, keep=outside_fold())
    rated = quality_classifier.rate(docs, model).join(labels, "doc_id").where(~outside_fold()).collect()
    assert sum(r.kept == (r.quality == 1) for r in rated) >= 0.95 * len(rated)
    good, poor = ([r.expected_grade for r in rated if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > sum(poor) / len(poor) + 0.8


def test_samples_are_bounded_in_rows(spark):
    """One row of each chosen id, however often it is repeated."""
    docs = texts(spark, ["a", "b", "c"]).union(spark.createDataFrame([(1, f"again {i}") for i in range(500)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, toxic int")
    for rows in (2, 3, 100):
        found = labelled_sample(docs, labels, F.col("toxic"), rows).collect()
        assert len(found) == min(rows, 3) and sum(r.text.startswith(("b", "again")) for r in found) <= 1


def test_ordinal_thresholds():
    rng = np.random.default_rng(7)
    x = rng.normal(size=600)
    grades = np.digitize(x * 2 + rng.logistic(size=600), [-1.5, 1.5])
    weights, cuts = quality_classifier.fit_ordinal(np.arange(600), np.zeros(600, int), x, grades, 3, 1)
    assert abs(weights[0] - 2) < 0.6 and abs(cuts[0] + 1.5) < 0.5 and abs(cuts[1] - 1.5) < 0.5 and cuts[0] < cuts[1]


@needs_tables
def test_toxicity_held_out(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)


def plain_toxicity(some, labels):
    """Scores of a model fitted as the module says, on strings instead of hashes."""
    grams = [{t[i : i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)} for t in map(str.lower, some)]
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    scale = {}
    for g in sorted(set().union(*grams)):
        present, absent = (sum(g in found for found, y in zip(grams, labels) if y == label) for label in (1, 0))
        total = present + absent
        if abs(present - share * total) / math.sqrt(max(share * (1 - share) * total, share)) >= toxicity.LEAST_DEVIATION:
            scale[g] = math.log((present / share + 1) / (absent / (1 - share) + 1))
    x = np.array([[r if g in found else 0.0 for g, r in scale.items()] + [1.0] for found in grams])
    y, w = np.array(labels), np.append(np.zeros(len(scale)), math.log(share / (1 - share)))
    rate, decay = np.append(np.full(len(scale), 0.02), 0.05), np.append(np.full(len(scale), 1e-5), 0.0)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, 201):
        g = x.T @ ((y - 1 / (1 + np.exp(-(x @ w)))) / len(y)) - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12))
    return len(scale), 1 / (1 + np.exp(-(x @ w)))


def test_toxicity_against_a_plain_fit(spark):
    rng = random.Random(12)
    labels = [int(i % 3 == 0) for i in range(150)]
    some = [" ".join(rng.choices(["green", "Hügel", "river", "stone", "𝄞 song"], k=rng.randrange(0, 9)) + (["Vile scum"] if y and rng.random() < 0.9 else [])) for y in labels]
    docs = texts(spark, some)
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    found = [r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).orderBy("doc_id").collect()]
    n_features, want = plain_toxicity(some, labels)
    assert n_features > 10 and np.abs(np.array(found) - want).max() < 1e-4


def test_log_count_ratio():
    r = toxicity.log_count_ratios(np.array([9.0, 0.0, 0.0]), np.array([0.0, 0.0, 10.0]), 0.5)
    assert r[0] > 2 and r[1] == 0 and r[2] < -2


# Quality rules.


def test_rules_by_hand(spark):
    rng = random.Random(3)
    some = ["a b c d e f a b c d e g", "x\nx\n\n \nx y\nx", "#* $%&|<> été ö 日本", "one two", "\t\x0b\x0c\r a\x1cb"]
    some += [" ".join(rng.choice("abcd") for _ in range(n)) for n in (4, 5, 6, 30, 200)]
    model = pieces()
    for r in quality_rules.judged(texts(spark, some)).collect():
        text = some[r.doc_id]
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines, again = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in lines
                lines.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit))
        ids = [i for w in words for i in model.encode(w)]
        shares = [n / len(ids) for n in collections.Counter(ids).values()]
        assert r.n_tokens == len(ids) and math.isclose(r.token_entropy, -sum(s * math.log2(s) for s in shares), abs_tol=1e-9)
        assert math.isclose(r.fallback_share, sum(map(model.is_byte, ids)) / len(ids), abs_tol=1e-12)
        assert math.isclose(r.chars_per_token, r.word_chars / len(ids))
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
        letters = collections.Counter("latin" if c.isascii() and c.isalpha() or c in "étöñïü" else "east_asian" if c in "日本" else None for c in text)
        letters.pop(None, None)
        assert r.script == (max(letters, key=letters.get) if letters else "other")
        b = quality_rules.BANDS[r.script]
        off = 2 / math.sqrt(len(ids))
        fits = b.least_chars * (1 - off) <= r.chars_per_token <= b.most_chars * (1 + off) and r.fallback_share <= b.most_fallback * (1 + off) and r.n_symbols <= b.most_symbols * r.n_words
        fits = fits and r.token_entropy >= b.least_entropy * min(1, math.log2(len(ids)) / math.log2(100)) - 1e-9
        assert r.kept == (fits and not r.base_failed), text


def test_short_texts_are_held_to_the_bands(spark):
    """Wholly fallback, few tokens over and over, plain, and half fallback."""
    some = [" ".join("\u1200\u1208\U00012000" for _ in range(11)), " ".join(["a b"] * 3 + ["c d"] * 3), "the river ran past the old mill and the children played there"]
    some.append("\U00012000 " * 11 + "a word or two here")
    got = {r.doc_id: r for r in quality_rules.judged(texts(spark, some)).collect()}
    assert all(got[i].n_tokens < 150 for i in got), [got[i].n_tokens for i in got]
    assert [got[i].fit_failed for i in range(4)] == [True, True, False, True]


# Packing and token counts.


def test_packing_rules():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 400).astype(float)
    sizes = np.stack([lengths, np.ones(400), lengths**2], axis=1)
    for rule in ("norm", "dot"):
        for caps in ((64, 400, 4096.0), (64, 3, 2000.0)):
            bins, offsets = packing.best_fit(sizes, np.array(caps, dtype=float), np.array([1, 0.1, 0.1]), rule)
            for b in set(bins):
                inside = bins == b
                total = sizes[inside].sum(axis=0)
                assert inside.sum() == 1 or (total <= np.array(caps) + 1e-6).all()
                at = np.argsort(offsets[inside])
                assert (offsets[inside][at] == np.concatenate([[0], np.cumsum(lengths[inside][at])[:-1]])).all()
    bins, _ = packing.best_fit(sizes, np.array([64, 400, 4096.0]), np.array([1, 0.01, 0.01]))
    assert len(set(bins)) <= math.ceil(lengths.sum() / 64) * 1.05


@needs_tables
def test_packed_documents(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = collections.defaultdict(list)
    for r in QUERIES["op6_vector_best_fit"](spark, SF).collect():
        rows[r.doc_id].append(r)
    for doc_id, text in documents(spark, SF).select("doc_id", "text").collect():
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = sorted(rows[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    by_sequence = collections.defaultdict(list)
    for r in sum(rows.values(), []):
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 2048


@needs_tables
@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_separator_scan(spark, block_bytes):
    encode = byte_bpe(special=False)
    expected = {i: len(encode(t)) for i, t in documents(spark, SF).select("doc_id", "text").collect()}
    found = token_counts.counted(documents(spark, SF).limit(20) if block_bytes == 64 else documents(spark, SF), block_bytes=block_bytes).collect()
    assert found and all(expected[r.doc_id] == r.n_tokens for r in found)


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.tokens").write_bytes(np.array([9, 1, 1, 9, 9, 1, 1, 1], dtype="<u2").tobytes() + b"\x01")
    (tmp_path / "b.tokens").write_bytes(b"")
    for block in (4, 8, 1 << 20):
        rows = sorted(tuple(r) for r in token_counts.count_documents(spark, f"file://{tmp_path}", separator=9, block_bytes=block).collect())
        assert rows == [("a.tokens", 0, 0, 0, True), ("a.tokens", 1, 1, 2, True), ("a.tokens", 2, 4, 0, True), ("a.tokens", 3, 5, 3, False)]


# Near duplicates.


def _brute_components(values):
    sets = []
    for text in values:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed,block,hot_least", [(1, 1024, 2), (2, 4, 1000), (3, 8, 8)])
def test_components_of_near_copies(spark, seed, block, hot_least):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    values = [None, "", " ", "a b", "A B", "a b c d", "a b c d e"]
    passage = " ".join(rng.choices(words, k=30))
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(12, 90))
        for _ in range(rng.choice((1, 2, 9, 25))):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            values.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    rng.shuffle(values)
    found = signature_join.near_duplicates(texts(spark, values), bucket_tokens=300, block=block, hot_least=hot_least)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert [got[i] for i in range(len(values))] == _brute_components(values)


def test_one_large_group_of_near_copies(spark):
    """Far more classes than a block holds, joined by anchors, with some that are
    only linked to a few of them, and some to none."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    values = []
    for i in range(500):
        copy = list(base)
        for _ in range(rng.randint(0, 2) if i % 25 else 5):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        values.append(" ".join(copy))
    found = signature_join.near_duplicates(texts(spark, values), bucket_tokens=5_000, block=32)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == [c for _, c in _brute_components(values)]


def test_signature_bound_never_hides_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(5, 50))) for _ in range(12)]
        sizes = np.array([len(s) for s in sets])
        label = signature_join.linked_labels(sizes, sets)
        for i in range(12):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 75 * (sizes[i] + sizes[j] - common):
                    assert label[i] == label[j]


@pytest.mark.parametrize("task_links", [1_000_000, 40, 5])
def test_connected_components(spark, task_links):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), task_links).collect()}
    assert got == {i: root(i) for a, b in links if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), task_links).count() == 0


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    """Near copies of long texts: few classes, and many blocks."""
    monkeypatch.setattr(signature_join, "BLOCK_TOKENS", 700)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    values = [" ".join(words)]
    for _ in range(12):
        some = list(words)
        some[rng.randrange(400)] = "x"
        values.append(" ".join(some))
    values += [" ".join(words[:200] + [f"z{i}" for i in range(200)])]
    found = signature_join.near_duplicates(texts(spark, values))
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == [c for _, c in _brute_components(values)]


# Decontamination.


def test_windows_by_hand(spark):
    rng = random.Random(8)
    alphabet = ["Ka", "lo", "Éa", "m", "x9", "..", "　z"]
    items = [" ".join(rng.choices(alphabet, k=n)) for n in (1, 2, 3, 9, 10, 11, 25)] + [None, "", "!!"]
    values = [" - ".join(rng.choices(alphabet, k=n)) for n in (0, 1, 2, 5, 30, 80, 300)] + [f"m lo {t} x9" for t in items if t] + [None]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: split.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    for r in decontamination.digest(decontamination.report(texts(spark, values), benchmark)).collect():
        words, hit, found = cut(values[r.doc_id]), set(), set()
        for i, text in enumerate(items):
            item = cut(text)
            n = min(10, len(item))
            for s in range(len(item) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == item[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        expected = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert tuple(r)[1:] == expected


def test_large_benchmark_is_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 5)
    words = [f"w{i}" for i in range(60)]
    benchmark = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[20:50]))], "item_id long, text string")
    rows = decontamination.report(texts(spark, [" ".join(words), "w1 w2"]), benchmark).orderBy("doc_id").collect()
    assert [(r.n_hit, r["items"]) for r in rows] == [(50, ["1", "2"]), (0, [])]


# Secrets, pseudonyms, lists.


def test_secret_spans(spark):
    some = [
        "password: abcdefghijkl token=short secret : secret=abcdefghijklmnop",
        "AKIA" + "A" * 14 + " and AKIAB deadbeefdeadbeef0 DEADBEEFDEADBEEF",
        "é𝄞 API_KEY='zzzzzzzzzzzz' user=ann pwd=hunter22",
        "pwd=hunter22 alone",
        "user=bob" + " " * 500 + "pwd=hunter22",
        "https://h.example/x token = 0123456789abcdef0123",
    ]
    patterns = [("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16)]
    rows = {r.doc_id: r for r in secret_scan.report(texts(spark, some)).collect()}
    for i, text in enumerate(some):
        spans = sorted((m.start(), o, f"{kind}:{m.start()}:{m.end()}") for o, (kind, p, least) in enumerate(patterns) for m in re.finditer(p, text) if len(m[m.lastindex]) >= least)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
    assert "weak:" in rows[2].spans and "ident:" in rows[2].spans
    assert rows[3].spans == rows[4].spans == "" and rows[5].spans.startswith("endpoint:0:")


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    rng = random.Random(6)
    cards = []
    for _ in range(60):
        body = "".join(rng.choices("0123456789", k=15))
        cards.append(next(body + str(d) for d in range(10) if _luhn(body + str(d))))
    dates = [str(datetime.date(1900, 1, 1) + datetime.timedelta(days=rng.randrange(73_049))) for _ in range(60)] + ["1850-03-04", "1804-02-29"]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)]
    ssns = [f"{rng.choice([1, 665, 667, 899, 123]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10_000):04}" for _ in range(60)]
    values = [*cards, *dates, *ips, *ssns]
    report = pii.report(texts(spark, [f"<{v}> {v}" for v in values]))
    out = [r.text for r in report.orderBy("doc_id").collect()]
    new = [re.fullmatch(r"<(.*)> \1", t)[1] for t in out]
    assert len(set(zip(values, new))) == len(set(values)) == len(set(new))
    a, b, c = len(cards), len(cards) + len(dates), len(cards) + len(dates) + len(ips)
    assert all(_luhn(x) and len(x) == 16 for x in new[:a])
    assert all(datetime.date.fromisoformat(x) for x in new[a:b]) and new[b - 2].startswith("1850") and new[b - 1].startswith("1804")
    assert all(max(map(int, x.split("."))) < 256 for x in new[b:c])
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new[c:])
    other = [r.text for r in pii.report(texts(spark, [f"<{v}> {v}" for v in values[:20]]), key="another").orderBy("doc_id").collect()]
    assert all(x != y for x, y in zip(other, out))


def test_dates_are_permuted(spark):
    """The whole of a small domain maps onto itself."""
    days = [str(datetime.date(1804, 1, 1) + datetime.timedelta(days=i)) for i in range(366)]
    out = {r.text for r in pii.report(texts(spark, days)).collect()}
    assert out == set(days)


def test_invalid_values_stay(spark):
    kept = ["4111111111111112", "2023-02-29", "999.1.1.1", "666-12-1234", "1.2.3.4.5", "x4111111111111111", "id 12345678"]
    assert {r.text for r in pii.report(texts(spark, kept)).collect()} == set(kept)


NEXT_TO_ANOTHER = [
    "card 4111111111111111 12/27",
    "card 4111 1111 1111 1111 123 cvv",
    "order 12 4111 1111 1111 1111",
    "call 555-123-4567 100 times",
    "call 555-123-4567 555-987-6543",
    "4111 1111 1111 1111 555-123-4567 and 2023-02-29 4111 1111 1111 1111",
    "666-12-1234 4111111111111111, 12345678 123-45-6789",
    "é𝄞 4111 1111 1111 1112@mail.example 12 34@x.example",
    "4111 1111 1111 1111.bob@x.example bob.555-123-4567@x.example4111 1111 1111 1111",
]


def _first_valid(text, i):
    """(kind, end) of the value at i, by the rule of the module and without Spark."""
    at = {k: re.compile(p).match(text, i) for k, p in pii.PATTERNS.items()}
    digits = lambda m: re.sub("[^0-9]", "", m)

    def is_date(m):
        p = [int(x) for x in re.split("[-/.]", m)]
        for y, mo, d in [p] if "-" in m else [p[::-1], (p[2], p[0], p[1])]:
            try:
                return bool(datetime.date(y, mo, d))
            except ValueError:
                continue
        return False

    is_ssn = lambda m: re.fullmatch("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", m)
    valid = {"email": bool, "ip": lambda m: all(int(x) < 256 for x in m.split(".")), "date": is_date, "ssn": is_ssn, "card": lambda m: _luhn(digits(m)), "phone": bool}
    del at["card"]
    apart = {k: m for k, m in at.items() if k != "phone"} | {"card": _card_at(text, i), "phone": at["phone"]}
    for kind, m in apart.items():
        if m and valid[kind](m[0]):
            return kind, m.end()
    return None


CARD_GROUPS = [(4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(19, 12, -1))]


def _card_at(text, i):
    """The first of the ways of writing a card, longest first, that fits at i and has a right check digit."""
    if i and (text[i - 1].isascii() and text[i - 1].isalnum() or text[i - 1] == "+"):
        return None
    for groups in CARD_GROUPS:
        m = re.compile("[ -]".join(f"[0-9]{{{n}}}" for n in groups)).match(text, i)
        if not m or re.match("[0-9A-Za-z]", text[m.end() :]) or re.match("-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z])", text[m.end() :]):
            continue
        if len(groups) == 5 and re.match("[ .-]?[0-9]", text[m.end() :]):
            continue
        if _luhn(re.sub("[^0-9]", "", m[0])):
            return m
    return None


def plain_values(text):
    """(start, end, kind) of all values, from left to right."""
    found, i = [], 0
    while i < len(text):
        hit = _first_valid(text, i)
        if hit:
            found.append((i, hit[1], hit[0]))
        i = hit[1] if hit else i + 1
    return found


def mixed_numbers(seed, n):
    """Texts of numbers of all kinds, right and wrong, next to each other."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choices("0123456789", k=k))

    def card():
        body = some(15)
        d = body + next(c for c in "0123456789" if _luhn(body + c))
        return rng.choice([d, " ".join(d[i : i + 4] for i in (0, 4, 8, 12)), "-".join(d[i : i + 4] for i in (0, 4, 8, 12))])

    phone = lambda: rng.choice(["{}-{}-{}", "({}) {}-{}", "+1 {} {} {}", "{}.{}.{}"]).format(some(3), some(3), some(4))
    abroad = lambda: rng.choice([f"+44 {some(2)} {some(4)} {some(4)}", f"+49 {some(2)} {some(6)}", f"+33 {some(1)} {some(2)} {some(2)} {some(2)} {some(2)}", f"+9{some(9)}"])
    makes = [card, card, phone, phone, abroad, lambda: some(rng.randrange(1, 6)), lambda: some(16), lambda: f"{some(3)}-{some(2)}-{some(4)}", lambda: f"2{some(3)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 33):02}", lambda: f"{some(2)}/{some(2)}/{some(4)}", lambda: ".".join(some(rng.randrange(1, 4)) for _ in range(4)), lambda: f"u{some(2)}@h.example", lambda: "word"]
    return ["".join(rng.choice(makes)() + rng.choice([" ", " ", " ", "-", ".", ", ", "  ", "/", "", "@x.example "]) for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def expected_pseudonyms(spark, some):
    """Texts as a scan without Spark rewrites them; a value's pseudonym is that which it gets alone."""
    spans = [plain_values(t) for t in some]
    values = sorted({t[a:b] for t, s in zip(some, spans) for a, b, _ in s})
    alone = dict(zip(values, (r.text for r in pii.report(texts(spark, values)).orderBy("doc_id").collect())))
    out = []
    for text, found in zip(some, spans):
        for a, b, _ in reversed(found):
            text = text[:a] + alone[text[a:b]] + text[b:]
        out.append((text, collections.Counter(k for *_, k in found)))
    return out


def test_pseudonyms_next_to_another_number(spark):
    some = NEXT_TO_ANOTHER + mixed_numbers(8, 1500)
    rows = pii.report(texts(spark, some)).orderBy("doc_id").collect()
    want = expected_pseudonyms(spark, some)
    for text, r, (new, kinds) in zip(some, rows, want):
        assert r.text == new, text
        assert {k: r[f"n_{k}"] for k in pii.PATTERNS} == {k: kinds[k] for k in pii.PATTERNS}, text
    for text, r in zip(NEXT_TO_ANOTHER[:5], rows):
        for value in ("4111111111111111", "4111 1111 1111 1111", "555-123-4567", "555-987-6543"):
            assert value not in r.text, text


def test_telephone_numbers_side_by_side(spark):
    """Each keeps the pseudonym that it has alone, whatever digits are next to it."""
    rng = random.Random(11)
    phones = [f"217-555-{rng.randrange(10_000):04}" for _ in range(300)]
    alone = {r.text for r in pii.report(texts(spark, phones)).collect()}
    (row,) = pii.report(texts(spark, [" ".join(phones)])).collect()
    assert row.n_phone == 300 and row.n_card == 0 and set(row.text.split(" ")) == alone


def test_telephone_numbers_abroad(spark):
    some = ["+44 20 7946 0958", "+442079460958", "+49 30 901820", "+49 30 901820 217-555-1017", "+49 30 901820 2024-01-02", "+1 217 555 1017", "217-555-1017", "2024-01-02"]
    new = [r.text for r in pii.report(texts(spark, some)).orderBy("doc_id").collect()]
    assert new[0].replace(" ", "") == new[1] != some[1] and new[0].startswith("+44 ")
    assert new[2].startswith("+49 ") and new[2] != some[2]
    assert new[3] == f"{new[2]} {new[6]}" and new[4] == f"{new[2]} {new[7]}"
    assert new[5] == "+1 " + new[6].replace("-", " ")


def test_pseudonyms_take_linear_time(spark):
    def seconds(n):
        rows = texts(spark, [" ".join(f"{i % 1000:03}-555-{i % 9973:04}," for i in range(n))])
        started = time.monotonic()
        assert pii.report(rows).collect()[0].n_phone == n
        return time.monotonic() - started

    seconds(100)
    assert seconds(16_000) < 8 * seconds(4_000) + 2


def test_pipeline_pseudonyms(spark):
    """The pipeline's stage, with other columns and repeated rows, against the scan without Spark."""
    some = NEXT_TO_ANOTHER + NEXT_TO_ANOTHER[:2] + mixed_numbers(9, 300)
    docs = texts(spark, some).withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit("en"))
    stage = dict(corpus_pipeline.STAGES)["PII"](spark, docs, "")
    assert stage.columns == docs.columns
    rows = [(r.doc_id, r.text, r.n_chars, r.lang) for r in stage.orderBy("doc_id").collect()]
    assert rows == [(i, new, len(new), "en") for i, (new, _) in enumerate(expected_pseudonyms(spark, some))]


def test_intervals(spark):
    d = lambda n: datetime.date(2024, 1, n)
    entries = spark.createDataFrame(
        [("block", "x.org", d(1), "add"), ("block", "x.org", d(3), "add"), ("block", "x.org", d(5), "remove"), ("block", "x.org", d(9), "add"), ("allow", "a.x.org", d(4), "add"), ("block", "y.org", d(2), "remove")],
        "list string, domain string, day date, action string",
    )
    assert sorted(tuple(r) for r in url_filters.intervals(entries).where("list = 'block'").collect()) == [("block", "x.org", d(1), d(5)), ("block", "x.org", d(9), None)]
    captures = spark.createDataFrame([(i, h, d(i)) for i in range(1, 11) for h in ("https://a.x.org/p", "https://b.x.org:8/", "https://xx.org")], "n int, url string, day date")
    found = {(r.n, r.host): r.verdict for r in url_filters.judged(captures, entries).collect()}
    listed = {1, 2, 3, 4, 9, 10}
    assert all(found[i, "b.x.org"] == ("blocked" if i in listed else "unlisted") and found[i, "xx.org"] == "unlisted" for i in range(1, 11))
    assert all(found[i, "a.x.org"] == ("allowed" if i >= 4 else "blocked") for i in range(1, 11))


@needs_tables
def test_native_plans_run_no_python(spark):
    for n in ("op3_", "op4_", "op8_", "op10_"):
        name = next(q for q in QUERIES if q.startswith(n))
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name
