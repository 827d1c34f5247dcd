"""Settings read back, drafts written and rendered."""

from pyspark.sql import functions as F

from mailsieve.operators import drafts
from mailsieve.sources import config


def test_tables_are_read_by_their_schema(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "c1", None)], "id string, connection_id string, note string")
    rows.write.parquet(f"{tmp_path}/keys")
    read = config.read_table(spark, "api_keys", f"{tmp_path}/keys")
    assert read.columns == config.TABLES["api_keys"].fieldNames()
    assert [r.id for r in config.by_id(read, "k1").collect()] == ["k1"] and config.by_id(read, "k2").count() == 0


def test_policies_are_read_with_defaults(spark, tmp_path):
    spark.createDataFrame([("c1", '["x.example"]')], "connection_id string, blocked_domains_json string").write.json(f"{tmp_path}/p")
    row = config.read_policies(spark, f"{tmp_path}/p", "json").head()
    assert row.blocked_domains == ["x.example"] and row.pii_redaction and row.allowed_folders == []


def test_valid_drafts_are_written(spark, tmp_path):
    asked = spark.createDataFrame(
        [("r1", ["a@b.example"], "Hi", "text", None), ("r2", ["a@b.example"], "Hi", "text", "bad")], "request_id string, recipients array<string>, subject string, body string, error string"
    )
    drafts.write_drafts(drafts.build_drafts(asked), f"{tmp_path}/drafts")
    kept = spark.read.parquet(f"{tmp_path}/drafts").collect()
    assert [r.request_id for r in kept] == ["r1"] and "To: a@b.example" in kept[0].mime


def test_mailbox_text(spark):
    def text(reply):
        columns = [F.lit(x) for x in ("<1@x>",)] + [F.array(F.lit("a@b.example"), F.lit("c@d.example"))] + [F.lit(x) for x in ("Hi", "Thu, 15 Jan 2026 10:00:00 +0000", "body", reply)]
        return spark.range(1).select(drafts.mailbox_text(*columns)).head()[0].split("\r\n")

    plain, reply = text(None), text("<0@x>")
    assert plain[:3] == ["Message-ID: <1@x>", "To: a@b.example, c@d.example", "Subject: Hi"] and plain[-2:] == ["", "body"]
    assert [x for x in reply if x not in plain] == ["In-Reply-To: <0@x>", "References: <0@x>"]


def test_rejected_exports(spark):
    from mailsieve.sources.api_json import from_gmail_export, rejected_exports

    docs = spark.createDataFrame([('{"id":"1","payload":{"headers":[]}}',), ("{broken",), ('{"threadId":"t"}',), (None,), ("",)], "json string")
    assert [r.id for r in from_gmail_export(docs).collect()] == ["1"]
    assert sorted(r.reason for r in rejected_exports(docs).collect()) == ["no id", "not a JSON document", "not a JSON document", "not a JSON document"]


def test_all_text_parts_are_kept(spark):
    from mailsieve.sources.eml import from_eml

    source = (
        b"From: a@b.example\r\nSubject: s\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=x\r\n\r\n"
        b"--x\r\nContent-Type: text/plain\r\n\r\nfirst\r\n--x\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=f\r\n\r\n%\r\n"
        b"--x\r\nContent-Type: text/plain\r\n\r\nsecond\r\n--x--\r\n"
    )
    df = spark.createDataFrame([("INBOX", 1, [], bytearray(source))], "folder string, uid long, flags array<string>, source binary")
    body = from_eml(df, now=F.lit(0).cast("timestamp")).head().body
    assert "first" in body and "second" in body
