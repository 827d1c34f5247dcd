"""Reading messages and settings."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from mailsieve.functions import regexes
from mailsieve.functions.text import from_base64url, normalize_subject, parse_date
from mailsieve.operators.tenants import backfill_policies, decode_policies
from mailsieve.sources import mbox
from mailsieve.sources.api_json import from_gmail_export
from mailsieve.sources.eml import from_eml, read_eml, unreadable
from mailsieve.sources.messages import read_messages

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_messages_come_back_as_written(spark, messages, tmp_path, fmt):
    df = messages(dict(subject="a", body="é\nb"), dict(labels=["X", "Y"]))
    df.write.format(fmt).save(str(tmp_path / fmt))
    back = read_messages(spark, str(tmp_path / fmt), fmt)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def eml(spark, *sources):
    rows = [("Work: x", i, [r"\Seen"] if i == 1 else [], s) for i, s in enumerate(sources, 1)]
    return spark.createDataFrame(rows, "folder string, uid long, flags array<string>, source binary")


MULTI = (
    b"From: =?utf-8?B?SsO2LCBBbm4=?= <ann@x.org>\r\nTo: Bob <bob@x.org>, c@x.org\r\nCc: d@x.org\r\n"
    b"Subject: =?utf-8?Q?Caf=C3=A9?=\r\n =?utf-8?Q?_two?=\r\nDate: Thu, 15 Jan 2026 12:00:00 +0200\r\n"
    b"Message-ID: <m1@x>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
    b"--B\r\nContent-Type: multipart/alternative; boundary=C\r\n\r\n"
    b"--C\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\ncaf\xe9  body\r\n--C\r\n"
    b"Content-Type: text/html; charset=utf-8\r\n\r\n<p>html</p>\r\n--C--\r\n"
    b"--B\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n"
    b"Content-Transfer-Encoding: base64\r\n\r\nAAECAw==\r\n--B--\r\n"
)
HTML_ONLY = b"Subject: h\r\nContent-Type: text/html; charset=nonsense\r\n\r\n<p>Hello <b>you</b></p>\r\n"


def test_eml(spark):
    rows = from_eml(eml(spark, MULTI, HTML_ONLY, b""), NOW).orderBy("uid").collect()
    assert len(rows) == 2
    a, b = rows
    assert (a["id"], a["subject"], a["body"]) == ("Work: x:1", "Café two", "café  body")
    assert a["from"].asDict() == {"name": "Jö, Ann", "email": "ann@x.org"}
    assert [t["email"] for t in a["to"]] == ["bob@x.org", "c@x.org"] and [c["email"] for c in a["cc"]] == ["d@x.org"]
    assert a["date"] == "2026-01-15T10:00:00.000Z" and a["snippet"] == "café body" and not a["is_unread"]
    assert [x.asDict() for x in a["attachments"]] == [{"filename": "a.pdf", "mime_type": "application/pdf", "size": 4}]
    assert a["html_body"].strip() == "<p>html</p>"
    assert b["body"] == "Hello you" and b["date"] == "2026-01-01T00:00:00.000Z" and b["is_unread"]
    assert b["from"].asDict() == {"name": "", "email": ""}
    counted = unreadable(eml(spark, MULTI, HTML_ONLY, b"")).head()
    assert (counted["n_sources"], counted["n_unreadable"]) == (3, 1)


def test_read_eml_files(spark, tmp_path):
    (tmp_path / "Sent").mkdir()
    (tmp_path / "Sent" / "17.eml").write_bytes(MULTI)
    (tmp_path / "INBOX").mkdir()
    (tmp_path / "INBOX" / "9;2,FS").write_bytes(HTML_ONLY)
    rows = read_eml(spark, str(tmp_path)).orderBy("uid").collect()
    assert [(r["folder"], r["uid"], r["flags"]) for r in rows] == [("INBOX", 9, [r"\Seen", r"\Flagged"]), ("Sent", 17, [])]


def container(end: bytes) -> bytes:
    """Messages with quoted lines, other charsets, blank lines at their ends, repeats and one that is none."""
    mails = [
        b"Subject: one\nStatus: RO\nX-Status: AF\n\nfirst\n>From the desk\n>>From afar\n From here\n",
        b"Subject: two\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf\xe9\n\n\n",
        b"no header\n",
        b"Subject: two\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf\xe9\n",
        b"Subject: four\n\n" + b"long " * 60 + b"\nFrom\n",
    ]
    return b"".join(b"From a@x.org Thu Jan 15 10:00:00 2026\n" + m + b"\n" for m in mails).replace(b"\n", end)


def expected_sources(name: str, end: bytes) -> list[tuple]:
    rows = [
        ([r"\Seen", r"\Flagged", r"\Answered"], b"Subject: one\nStatus: RO\nX-Status: AF\n\nfirst\nFrom the desk\n>From afar\n From here\n"),
        ([], b"Subject: two\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf\xe9\n"),
        ([], b"no header\n"),
        ([], b"Subject: two\nContent-Type: text/plain; charset=iso-8859-1\n\ncaf\xe9\n"),
        ([], b"Subject: four\n\n" + b"long " * 60 + b"\nFrom\n"),
    ]
    return [(name, i, flags, source.replace(b"\n", end)) for i, (flags, source) in enumerate(rows, 1)]


@pytest.fixture
def containers(tmp_path):
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "In box.mbox").write_bytes(container(b"\n"))
    (tmp_path / "mail" / "Sent").write_bytes(container(b"\r\n"))
    (tmp_path / "mail" / "Empty.mbox").write_bytes(b"")
    (tmp_path / "mail" / "Blank.mbox").write_bytes(b"\n \n")
    return str(tmp_path / "mail")


@pytest.mark.parametrize("size", [*range(13, 60, 4), 211, 1 << 20])
def test_containers_cut_anywhere(spark, containers, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        records = mbox.read_records(spark, containers)
        assert size > 1000 or records.rdd.getNumPartitions() > 1
        rows = [(r["folder"], r["uid"], r["flags"], bytes(r["source"])) for r in mbox.sources(records).orderBy("folder", "uid").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == expected_sources("In box", b"\n") + expected_sources("Sent", b"\r\n")


def test_containers_become_messages_and_rejects(spark, containers):
    good, bad = mbox.messages_and_rejects(mbox.sources(mbox.read_records(spark, containers)), NOW)
    rows = good.orderBy("id").collect()
    assert [r["subject"] for r in rows] == ["one", "two", "two", "four"] * 2
    assert [r["is_unread"] for r in rows[:2]] == [False, True] and rows[1]["body"] == "café\n"
    assert [(r["folder"], r["uid"]) for r in bad.orderBy("folder").collect()] == [("In box", 3), ("Sent", 3)]
    assert all("no headers" in r["error"] for r in bad.collect())
    none = mbox.sources(mbox.read_records(spark, containers).limit(0))
    assert none.count() == 0 and none.columns == ["folder", "uid", "flags", "source"]


def test_containers_on_a_stream(spark, containers, tmp_path):
    out = str(tmp_path / "out")
    for late in (False, True):
        if late:
            (tmp_path / "mail" / "Late.mbox").write_bytes(container(b"\n"))
        mbox.write_stream(mbox.stream_records(spark, containers, 1), out, NOW, str(tmp_path / "progress")).awaitTermination()
        read = lambda name: spark.read.parquet(f"{out}/{name}")
        n = 3 if late else 2
        assert read("messages").count() == read("messages").select("id").distinct().count() == 4 * n
        assert read("rejects").count() == n


def test_deep_and_shallow_documents(spark):
    def leaf(kind, text):
        import base64

        return {"mimeType": kind, "filename": "", "body": {"size": 1, "data": base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")}}

    def doc(levels, **extra):
        part = {"mimeType": "multipart/mixed", "parts": [leaf("text/plain", ""), leaf("text/plain", f"first {levels} ÿ?>"), leaf("text/html", "<i>h</i>")]}
        for _ in range(levels):
            part = {"mimeType": "multipart/mixed", "parts": [part, {"filename": "z.bin", "body": {"attachmentId": "x", "size": 7}}]}
        part["headers"] = [{"name": "from", "value": "A <a@x>"}]
        return json.dumps({"id": f"m{levels}", "threadId": "t", "labelIds": ["UNREAD"], "payload": part} | extra)

    df = spark.createDataFrame([(doc(n),) for n in range(12)], "json string")
    rows = {r["id"]: r for r in from_gmail_export(df).collect()}
    assert len(rows) == 12
    for n in range(12):
        r = rows[f"m{n}"]
        assert r["body"] == f"first {n} ÿ?>" and r["html_body"] == "<i>h</i>" and r["is_unread"]
        assert [a["filename"] for a in r["attachments"]] == ["z.bin"] * n and r["from"]["email"] == "a@x"


def test_base64_of_broken_utf8(column):
    assert column(from_base64url, ["_w", "YQ==", "YQ"]) == ["�", "a", "a"]


def test_dates(column):
    good = ["2026-01-15T10:00:00Z", "2026-01-15T10:00:00.000Z", "Thu, 15 Jan 2026 12:00:00 +0200", "15 Jan 2026 10:00 GMT", "Thu, 15 Jan 2026 10:00:00 +0000 (UTC)"]
    assert column(lambda c: F.unix_seconds(parse_date(c)), good) == [1768471200] * 5
    assert column(parse_date, ["", "soon", None, "2026-99-99T00:00:00Z"]) == [None] * 4


def test_subjects(column):
    said = {"Re: Fwd: AW:  Plan ": "plan", "Regarding: x": "regarding: x", "re : sv:TR:rif: X": "x", "": "", None: ""}
    assert dict(zip(said, column(normalize_subject, said))) == said


PATTERNS = {
    r"a.c$": ("a\u0085c", True), r"^\s+x": (" x", True), r"otp\b": ("otpé", True), r"[\s,]b": (" b", True),
    r"x{2,3}": ("xx", True), "a{b": ("a{b", True), "a]": ("a]", True), "[[]": ("[", True), "[a&&b]": ("&", True),
    r"é": ("é", True), r"a\/b": ("a/b", True), "(?<n>a)b": ("ab", True), "(?!a)b": ("b", True), "(?<=a)b": ("ab", True),
}


def test_user_patterns(spark):
    for pattern, (text, hit) in PATTERNS.items():
        jdk = regexes.to_jdk(pattern)
        assert jdk is not None, pattern
        got = spark.range(1).select(F.lit(text).rlike("(?i)" + jdk)).head()[0]
        assert got == hit, pattern


MORE_PATTERNS = {
    r"(?<=a+)b": ("aaab", True), r"(?<n>a)\k<n>": ("aa", True), "[^]x": ("\nx", True), r"\p{L}": ("p{L}", True), r"\cA": ("\x01", True), r"foo\Z": ("fooZ", True),
    "a[]": ("a", False), r"[\S]b": (" b", False), r"[^\S]b": (" b", True), r"[\w-.]+$": ("a-.", True), r"\u00e9": ("é", True), r"\ud83d\ude00": ("\U0001f600", True),
    r"(a)\12": ("a\n", True), r"\8": ("8", True), "x{,3}": ("x{,3}", True), r"(?=a)*b": ("b", True), r"\c": (r"\c", True), "}": ("}", True), r"(\1a)": ("a", True),
    "^$": ("", True), "(?:a|)+b": ("b", True), r"[\b]": ("\x08", True), r"[\0-\x1f]": ("\x05", True), r"\k<n>": ("k<n>", True), r"[a-\d]": ("-", True),
}


def test_more_user_patterns(spark):
    for pattern, (text, hit) in MORE_PATTERNS.items():
        jdk = regexes.to_jdk(pattern)
        assert jdk is not None, pattern
        assert spark.range(1).select(F.lit(text).rlike("(?i)" + jdk)).head()[0] == hit, (pattern, jdk)


def test_what_is_valid_compiles(spark):
    """Random patterns: none is accepted that the JDK refuses."""
    rng = random.Random(11)
    pieces = list("ab01()[]{}|^$.*+?-\\,<>=!:&#") + ["(?:", "(?=", "(?<=", "(?<!", "(?<n>", "(?", "\\k<n>", "\\1", "\\b", "\\w", "\\p{L}", "\\u{", "[^", "{2,3}", "{2,}", "[a-", "&&", "\\Q", "(?i)", "\\x4", "é"]
    compiler, accepted = spark._jvm.java.util.regex.Pattern, 0
    for _ in range(3000):
        jdk = regexes.to_jdk("".join(rng.choices(pieces, k=rng.randint(1, 9))))
        if jdk is not None:
            compiler.compile("(?i)" + jdk)
            accepted += 1
    assert accepted > 300


def test_invalid_user_patterns():
    for pattern in ("(?#x)foo", "(?P<n>a)b", "a++", "(?i)x", "(?<n>a)(?<n>b)", r"\k<m>(?<n>a)", "(?<1>a)", "{2}", r"\b+", "^*", "(?<=a)*", "[b-a]", "\\", "x{2}{3}"):
        assert regexes.to_jdk(pattern) is None, pattern
    assert [regexes.to_jdk(p) for p in ("(", "[a", "*a", "a{3,1}", ")", "a**")] == [None] * 6


def test_old_policy_rows_get_defaults(spark):
    raw = spark.createDataFrame([("c", '["a"]', 0)], "connection_id string, blocked_domains_json string, pii_redaction_enabled int")
    row = decode_policies(raw).head()
    assert row["blocked_domains"] == ["a"] and row["allowed_folders"] == [] and not row["pii_redaction"] and row["attachment_filtering"]
    assert backfill_policies(raw).head()["attachment_filtering_enabled"] == 1
