"""Raw RFC 822 mail. Python only takes the source apart, batch by batch in the
tasks that hold it; everything derived from the pieces is column work."""

from __future__ import annotations

import email
import email.header
import email.utils
import re
from collections.abc import Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.address import flatten_address_groups
from mailsieve.functions.sanitize import body_or_html
from mailsieve.functions.text import iso_utc, message_id, snippet, thread_key
from mailsieve.schema import ADDRESS, ADDRESSES, ATTACHMENTS, STRINGS
from mailsieve.sources.messages import conform

_PIECES = T.StructType(
    [
        T.StructField("folder", T.StringType()),
        T.StructField("uid", T.LongType()),
        T.StructField("flags", STRINGS),
        T.StructField("subject", T.StringType()),
        T.StructField("from", T.ArrayType(ADDRESSES)),
        T.StructField("to", T.ArrayType(ADDRESSES)),
        T.StructField("cc", T.ArrayType(ADDRESSES)),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("attachments", ATTACHMENTS),
        T.StructField("references", STRINGS),
        T.StructField("in_reply_to", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def _header(msg, name: str) -> str | None:
    value = msg.get(name)
    return None if value is None else _decoded(value)


def _decoded(value) -> str:
    text = re.sub(r"\r?\n(?=[ \t])", "", str(value))
    return str(email.header.make_header(email.header.decode_header(text))) if "=?" in text else text


def _groups(msg, name: str) -> list[list[dict]]:
    def group(value) -> list[dict]:
        # Names are decoded after the split: an encoded one may hold commas.
        pairs = email.utils.getaddresses([re.sub(r"\r?\n(?=[ \t])", "", str(value))])
        return [{"name": _decoded(n), "email": a} for n, a in pairs if n or a]

    return [group(value) for value in msg.get_all(name, [])]


def _leaves(msg):
    """Parts without parts; an attached message counts as one."""
    if msg.is_multipart() and msg.get_content_maintype() == "multipart":
        for part in msg.get_payload():
            yield from _leaves(part)
    else:
        yield msg


def _text(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:  # a charset nobody knows
        return data.decode("utf-8", "replace")


def _content(part) -> bytes:
    return part.get_payload(0).as_bytes() if part.is_multipart() else part.get_payload(decode=True) or b""


def _pieces(source: bytes) -> dict:
    # The plain policy: it parses a mail several times faster than the default one.
    msg = email.message_from_bytes(bytes(source))
    if not msg.keys():
        raise ValueError("no headers")
    try:
        date = email.utils.parsedate_to_datetime(msg["date"]) if msg["date"] else None
    except ValueError:
        date = None
    if date is not None and date.tzinfo is None:
        date = date.replace(tzinfo=timezone.utc)
    texts, files = {}, []
    for part in _leaves(msg):
        kind = part.get_content_type()
        if part.get_content_disposition() == "attachment" or kind not in ("text/plain", "text/html"):
            files.append({"filename": part.get_filename(), "mime_type": kind, "size": len(_content(part))})
        else:
            texts.setdefault(kind, []).append(_text(part))
    return {
        "subject": _header(msg, "subject"),
        **{n: _groups(msg, n) for n in ("from", "to", "cc")},
        "sent_at": date,
        # All parts of a kind, in order: text behind an attachment is text as well.
        "text": "\n".join(texts["text/plain"]) if "text/plain" in texts else None,
        "html": "\n".join(texts["text/html"]) if "text/html" in texts else None,
        "attachments": files,
        "references": (_header(msg, "references") or "").split(),
        "in_reply_to": _header(msg, "in-reply-to"),
        "message_id": _header(msg, "message-id"),
    }


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = _PIECES.fieldNames()
    for batch in batches:
        rows = []
        for source in batch["source"]:
            try:
                rows.append(_pieces(source))
            except Exception as e:  # any fault of one message stays with it
                rows.append({"error": f"{type(e).__name__}: {e}"})
        # object columns: a batch without any date must still be a timestamp column
        out = pd.DataFrame(rows, columns=names[3:], index=batch.index).astype(object)
        out = out.where(out.notna(), None)
        out["sent_at"] = pd.to_datetime(out["sent_at"], utc=True)
        yield pd.concat([batch[["folder", "uid", "flags"]], out], axis=1)[names]


def parse_sources(df: DataFrame) -> DataFrame:
    """(folder, uid, flags, source) to the pieces of each mail; `error` is set
    on those that cannot be read."""
    return df.select("folder", F.col("uid").cast("bigint").alias("uid"), "flags", "source").mapInPandas(
        _parse_batches, _PIECES
    )


def unreadable(df: DataFrame) -> DataFrame:
    """How many sources of each folder cannot be read."""
    return parse_sources(df).groupBy("folder").agg(
        F.count("*").alias("n_sources"), F.count_if(F.col("error").isNotNull()).alias("n_unreadable")
    )


def from_eml(df: DataFrame, now) -> DataFrame:
    """(folder, uid, flags, source) to messages. Unreadable sources are left
    out, see `unreadable`. `now` dates messages without a date."""
    return from_pieces(parse_sources(df), now)


def rejects(pieces: DataFrame) -> DataFrame:
    """What cannot be read, of `parse_sources`."""
    return pieces.filter("error is not null").select("folder", "uid", "error")


def from_pieces(pieces: DataFrame, now) -> DataFrame:
    """`from_eml` of sources that have been parsed already."""
    ok = pieces.filter("error is null")
    sent = F.coalesce("sent_at", F.lit(now).cast("timestamp"))
    body = body_or_html(F.col("text"), F.col("html"), wrap=None)
    files = F.transform(
        "attachments",
        lambda a: F.struct(
            F.coalesce(a["filename"], F.lit("unnamed")).alias("filename"),
            F.coalesce(a["mime_type"], F.lit("application/octet-stream")).alias("mime_type"),
            F.coalesce(a["size"], F.lit(0)).cast("bigint").alias("size"),
        ),
    )
    nobody = F.struct(F.lit("").alias("name"), F.lit("").alias("email")).cast(ADDRESS)
    built = ok.withColumn("body", body).select(
        message_id(F.col("folder"), F.col("uid")).alias("id"),
        "uid",
        thread_key(
            F.col("references"), F.col("in_reply_to"), F.col("message_id"), F.coalesce("subject", F.lit(""))
        ).alias("thread_id"),
        F.coalesce("subject", F.lit("(no subject)")).alias("subject"),
        F.coalesce(F.get(flatten_address_groups(F.col("from")), F.lit(0)), nobody).alias("from"),
        flatten_address_groups(F.col("to")).alias("to"),
        flatten_address_groups(F.col("cc")).alias("cc"),
        iso_utc(sent).alias("date"),
        sent.alias("sent_at"),
        snippet(F.col("body")).alias("snippet"),
        "body",
        F.nullif("html", F.lit("")).alias("html_body"),
        F.array("folder").alias("labels"),
        files.alias("attachments"),
        (~F.array_contains(F.coalesce("flags", F.array().cast(STRINGS)), r"\Seen")).alias("is_unread"),
    )
    return conform(built)


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """Files under `path` as (folder, uid, flags, source): the folder is the
    file's directory, the uid the leading digits of its name, and flags come
    from the `:2,FS` ending that mail directories use. Hadoop cannot open a
    name with a colon, so mail has to be copied with `;` or `!` in its place."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    letters = F.regexp_extract(name, r"(?:[:;!]|%3[AB]|%21)2,([A-Za-z]*)\z", 1)
    known = {"S": r"\Seen", "F": r"\Flagged", "D": r"\Draft", "R": r"\Answered", "T": r"\Deleted"}
    flags = F.array_compact(F.array(*(F.when(letters.contains(k), F.lit(v)) for k, v in known.items())))
    return files.select(
        F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("folder"),
        F.regexp_extract(name, r"^([0-9]+)", 1).try_cast("bigint").alias("uid"),
        flags.alias("flags"),
        F.col("content").alias("source"),
    )
