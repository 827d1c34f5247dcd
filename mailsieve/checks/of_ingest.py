"""Sources: exports made of the given tables, read back as messages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.checks.corpus import MAIL_SQL, TEXTS_SQL, mail, texts
from mailsieve.checks.registry import check
from mailsieve.folders import new_folder
from mailsieve.functions import text as tx
from mailsieve.sources import mbox
from mailsieve.sources.api_json import from_gmail_export, mime_attachments, mime_body, with_parts
from mailsieve.sources.eml import from_eml, unreadable
from mailsieve.sources.messages import from_script_export

_EVERY = f"WITH {MAIL_SQL} "


def _listed(column: str):
    return F.array_join(F.transform(column, lambda a: F.concat(a["name"], F.lit("<"), a["email"], F.lit(">"))), ";")


def _files(column: str = "attachments"):
    return F.array_join(F.transform(column, lambda a: F.concat_ws("/", a["filename"], a["mime_type"], a["size"].cast("string"))), ";")


def _leaf(mime: str, data) -> Column:
    """One part with content, as JSON text."""
    body = F.struct(F.lit(0).alias("size"), tx.to_base64url(data).alias("data"))
    return F.to_json(F.struct(F.lit(mime).alias("mimeType"), F.lit("").alias("filename"), body.alias("body")))


def _branch(mime: str, *children) -> Column:
    """A part of parts. Put together as text, so that nesting needs no schema."""
    head = F.lit(f'{{"mimeType":"{mime}","filename":"","body":{{"size":0}},"parts":[')
    return F.concat(head, F.concat_ws(",", *children), F.lit("]}"))


def gmail_documents(spark, sf_dir):
    """An API export of the mail: plain and HTML alternatives, an attachment
    now and then, and for some messages ten levels of nesting."""
    html = F.concat(F.lit("<p>"), F.col("body"), F.lit("</p>"))
    tree = _branch("multipart/alternative", _leaf("text/plain", F.col("body")), _leaf("text/html", html))
    deep = tree
    for _ in range(9):
        deep = _branch("multipart/mixed", deep)
    file = F.format_string(
        '{"filename":"f%d.bin","body":{"attachmentId":"att1","size":%d}}', F.col("uid"), F.col("uid") * 10
    )
    sender = F.concat("from.name", F.lit(" <"), "from.email", F.lit(">"))
    to = F.col("to")[0]
    values = {
        "SUBJECT": F.col("subject"),
        "From": F.when(F.col("from.name") == "", F.col("from.email")).otherwise(sender),
        "To": F.concat(to["name"], F.lit(" <"), to["email"], F.lit(">")),
        "Date": F.date_format("sent_at", "EEE, d MMM yyyy HH:mm:ss Z"),
        "Subject": F.lit("not this one"),
    }
    headers = F.to_json(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items())))
    root = F.concat(
        F.lit('{"mimeType":"multipart/mixed","filename":"","body":{"size":0},"headers":'),
        headers,
        F.lit(',"parts":['),
        F.concat_ws(
            ",", F.when(F.col("uid") % 6 == 0, deep).otherwise(tree), F.when(F.size("attachments") > 0, file)
        ),
        F.lit("]}"),
    )
    plain = F.to_json(
        F.struct("id", F.col("thread_id").alias("threadId"), "snippet", F.col("labels").alias("labelIds"))
    )
    doc = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(',"payload":'), root, F.lit("}"))
    return mail(spark, sf_dir).select(doc.alias("json"))


@check(
    "a2_gmail_export",
    _EVERY + """SELECT id, thread_id, subject, CASE WHEN contains(from_email, '@') THEN concat(from_name, '<', from_email, '>') ELSE
      concat('<', CASE WHEN from_name = '' THEN from_email ELSE concat(from_name, ' <', from_email, '>') END, '>') END AS sender,
    concat(to_name, '<', to_email, '>') AS "to", date_epoch AS sent_s, snippet, body, concat('<p>', body, '</p>') AS html_body,
    array_to_string(labels, ',') AS labels, CASE WHEN n_attachments = 1 THEN concat('f', CAST(uid AS VARCHAR), '.bin/application/octet-stream/', CAST(uid * 10 AS VARCHAR)) ELSE '' END AS attachments,
    is_unread FROM m""",
)
def a2(spark, sf_dir):
    out = from_gmail_export(gmail_documents(spark, sf_dir))
    return out.select(
        "id", "thread_id", "subject", F.concat("from.name", F.lit("<"), "from.email", F.lit(">")).alias("sender"), _listed("to").alias("to"),
        F.unix_seconds("sent_at").alias("sent_s"), "snippet", "body", "html_body", F.array_join("labels", ",").alias("labels"),
        _files().alias("attachments"), "is_unread",
    )


@check("b1_header", _EVERY + "SELECT id, subject, '' AS absent FROM m")
def b1(spark, sf_dir):
    flat = with_parts(gmail_documents(spark, sf_dir))
    return flat.select("id", tx.header(F.col("headers"), "Subject").alias("subject"), tx.header(F.col("headers"), "Reply-To").alias("absent"))


@check("b2_mime_body", _EVERY + "SELECT id, body AS plain, concat('<p>', body, '</p>') AS html FROM m")
def b2(spark, sf_dir):
    flat = with_parts(gmail_documents(spark, sf_dir))
    return flat.select("id", mime_body(F.col("parts"), "text/plain").alias("plain"), mime_body(F.col("parts"), "text/html").alias("html"))


@check(
    "b3_mime_attachments",
    _EVERY + """SELECT id, CASE WHEN n_attachments = 1 THEN concat('f', CAST(uid AS VARCHAR), '.bin/application/octet-stream/', CAST(uid * 10 AS VARCHAR)) ELSE '' END AS attachments FROM m""",
)
def b3(spark, sf_dir):
    flat = with_parts(gmail_documents(spark, sf_dir))
    return flat.withColumn("a", mime_attachments(F.col("parts"))).select("id", _files("a").alias("attachments"))


@check(
    "b4_base64url",
    f"WITH {TEXTS_SQL} SELECT id, text, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS encoded FROM x",
)
def b4(spark, sf_dir):
    coded = texts(spark, sf_dir).select("id", tx.to_base64url(F.col("text")).alias("encoded"))
    return coded.select("id", tx.from_base64url(F.col("encoded")).alias("text"), "encoded")


def _eml(spark, sf_dir):
    """The mail as RFC 822 sources, one in thirteen of them unreadable."""
    df = mail(spark, sf_dir)
    line = F.lit("\r\n")
    source = F.concat_ws(
        "\r\n",
        F.concat(F.lit("Message-ID: <"), F.col("uid").cast("string"), F.lit("@x.org>")),
        F.when(F.col("uid") % 3 == 0, F.concat(F.lit("References: <"), "thread_id", F.lit("@x.org> <z@x.org>"))),
        F.when(F.col("uid") % 3 == 1, F.concat(F.lit("In-Reply-To: <"), "thread_id", F.lit("@x.org>"))),
        F.concat(F.lit("Subject: "), "subject"),
        F.concat(F.lit("From: sender <"), F.lit("user@x.org>")),
        F.concat(F.lit("To: "), F.col("to")[0]["name"], F.lit(" <"), F.col("to")[0]["email"], F.lit(">, plain@x.org")),
        F.concat(F.lit("Date: "), F.date_format("sent_at", "EEE, d MMM yyyy HH:mm:ss Z")),
        F.lit("MIME-Version: 1.0"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: base64"),
        F.lit(""),
        F.base64(F.encode("body", "UTF-8")),
    )
    broken = F.col("uid") % 13 == 5
    return df.select(
        F.col("labels")[0].alias("folder"), "uid",
        F.when(F.col("is_unread"), F.array().cast("array<string>")).otherwise(F.array(F.lit(r"\Seen"))).alias("flags"),
        F.when(broken, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(F.concat(source, line), "UTF-8")).alias("source"),
    )


@check(
    "a3_eml",
    _EVERY + """SELECT concat(folder, ':', CAST(uid AS VARCHAR)) AS id, uid, subject, 'sender<user@x.org>' AS sender,
    concat(to_name, '<', to_email, '>;<plain@x.org>') AS "to", date, date_epoch AS sent_s, snippet, body, folder AS labels, is_unread,
    concat('imap-thread-', substr(sha256(CASE WHEN uid % 3 = 2 THEN concat('<', CAST(uid AS VARCHAR), '@x.org>') ELSE concat('<', thread_id, '@x.org>') END), 1, 16)) AS thread_id
    FROM m WHERE uid % 13 <> 5""",
)
def a3(spark, sf_dir):
    out = from_eml(_eml(spark, sf_dir), datetime(2026, 1, 1, tzinfo=timezone.utc))
    return out.select(
        "id", "uid", "thread_id", "subject", F.concat("from.name", F.lit("<"), "from.email", F.lit(">")).alias("sender"), _listed("to").alias("to"),
        "date", F.unix_seconds("sent_at").alias("sent_s"), "snippet", "body", F.array_join("labels", ",").alias("labels"), "is_unread",
    )


@check(
    "a3_eml_unreadable",
    _EVERY + "SELECT folder, count(*) AS n_sources, count(*) FILTER (uid % 13 = 5) AS n_unreadable FROM m GROUP BY ALL",
)
def a3_bad(spark, sf_dir):
    return unreadable(_eml(spark, sf_dir))


# A line that containers have to quote, in every fourth message.
_QUOTED = "CASE WHEN uid % 4 = 1 THEN concat(body, chr(10), 'From here on', chr(10), '>From there') ELSE body END"


def _containers(spark, sf_dir):
    """The mail as containers, one or more a folder, one message in thirteen unreadable, at the folder given back."""
    df = mail(spark, sf_dir).withColumn("text", F.expr(_QUOTED))
    whole = F.concat_ws(
        "\n",
        F.concat(F.lit("Message-ID: <"), F.col("uid").cast("string"), F.lit("@x.org>")),
        F.concat(F.lit("Subject: "), "subject"),
        F.lit("From: sender <user@x.org>"),
        F.concat(F.lit("Date: "), F.date_format("sent_at", "EEE, d MMM yyyy HH:mm:ss Z")),
        F.when(~F.col("is_unread"), F.lit("Status: RO")),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: 8bit"),
        F.lit(""),
        F.regexp_replace("text", "(?m)^(>*From )", ">$1"),
    )
    mails = F.when(F.col("uid") % 13 == 5, F.lit("nothing that is a header")).otherwise(whole)
    line = F.concat(F.lit("From user@x.org "), F.date_format("sent_at", "EEE MMM dd HH:mm:ss yyyy"), F.lit("\n"), mails, F.lit("\n"))
    at = new_folder(spark, "containers")
    df.select(line.alias("value"), F.col("labels")[0].alias("folder")).write.partitionBy("folder").text(at)
    return mbox.sources(mbox.read_records(spark, at), F.regexp_extract("container", "folder=([^/]+)", 1))


@check(
    "a3_mail_container",
    _EVERY + f"""SELECT subject, date_epoch AS sent_s, folder AS labels, is_unread,
    sha256(regexp_replace({_QUOTED}, '[\\n]+$', '')) AS body_sha256 FROM m WHERE uid % 13 <> 5""",
)
def a3_container(spark, sf_dir):
    out = from_eml(_containers(spark, sf_dir), datetime(2026, 1, 1, tzinfo=timezone.utc))
    return out.select(
        "subject", F.unix_seconds("sent_at").alias("sent_s"), F.array_join("labels", ",").alias("labels"), "is_unread",
        F.sha2(F.regexp_replace("body", r"\n+\z", ""), 256).alias("body_sha256"),
    )


@check(
    "a3_mail_container_rejects",
    _EVERY + "SELECT folder, count(*) AS n_rejects FROM m WHERE uid % 13 = 5 GROUP BY ALL",
)
def a3_container_rejects(spark, sf_dir):
    _, bad = mbox.messages_and_rejects(_containers(spark, sf_dir), datetime(2026, 1, 1, tzinfo=timezone.utc))
    return bad.groupBy("folder").agg(F.count("*").alias("n_rejects"))


@check(
    "a4_script_export",
    _EVERY + """SELECT id, thread_id, subject, concat(CASE WHEN from_name = '' THEN '' ELSE from_name END, '<', from_email, '>') AS sender,
    concat(to_name, '<', to_email, '>;<b@x.org>') AS "to", '' AS cc, date, date_epoch AS sent_s, substr(body, 1, 200) AS snippet, body, concat('<p>', body) AS html_body,
    array_to_string(labels, ',') AS labels, CASE WHEN n_attachments = 1 THEN concat('file', CAST(uid AS VARCHAR), '.pdf/application/pdf/', CAST(uid * 1000 AS VARCHAR)) ELSE '' END AS attachments, is_unread FROM m""",
)
def a4(spark, sf_dir):
    name = F.col("from.name")
    raw = mail(spark, sf_dir).select(
        "id", F.col("thread_id").alias("threadId"), "subject",
        F.when(name == "", F.col("from.email")).otherwise(F.concat(F.lit('"'), name, F.lit('" <'), F.col("from.email"), F.lit(">"))).alias("from"),
        F.concat(F.col("to")[0]["name"], F.lit(" <"), F.col("to")[0]["email"], F.lit(">,, b@x.org")).alias("to"),
        F.lit(None).cast("string").alias("cc"), "date", F.col("body").alias("plainBody"), F.concat(F.lit("<p>"), "body").alias("body"),
        F.col("labels").alias("threadLabels"), "attachments", F.col("is_unread").alias("isUnread"),
    )
    out = from_script_export(raw)
    return out.select(
        "id", "thread_id", "subject", F.concat("from.name", F.lit("<"), "from.email", F.lit(">")).alias("sender"), _listed("to").alias("to"),
        _listed("cc").alias("cc"), "date", F.unix_seconds("sent_at").alias("sent_s"), "snippet", "body", "html_body",
        F.array_join("labels", ",").alias("labels"), _files().alias("attachments"), "is_unread",
    )

