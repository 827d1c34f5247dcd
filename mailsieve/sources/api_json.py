"""Mail API exports: one JSON document per message, with a MIME part tree."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.address import parse_address, parse_address_list
from mailsieve.functions.text import blank_if_null, from_base64url, header, parse_date
from mailsieve.schema import ATTACHMENTS, STRINGS
from mailsieve.sources.messages import conform

# Nesting levels read by the typed path; deeper documents take the other one.
TYPED_LEVELS = 6
_HEADERS = "array<struct<name:string,value:string>>"
PART = T.StructType(
    [
        T.StructField(c, T.StringType()) for c in ("mime_type", "data", "filename", "attachment_id")
    ]
    + [T.StructField("size", T.LongType())]
)


def _part_type(levels: int) -> str:
    children = f",parts:array<{_part_type(levels - 1)}>" if levels > 1 else ""
    return (
        "struct<mimeType:string,filename:string,body:struct<data:string,attachmentId:string,size:bigint>"
        f"{children}>"
    )


def _payload_type(levels: int) -> str:
    return _part_type(levels).replace("struct<", f"struct<headers:{_HEADERS},", 1)


def _flatten(part: Column, levels: int) -> Column:
    """A part and everything below it in pre-order, as array<PART>."""
    own = F.struct(
        part["mimeType"].alias("mime_type"),
        part["body"]["data"].alias("data"),
        part["filename"].alias("filename"),
        part["body"]["attachmentId"].alias("attachment_id"),
        part["body"]["size"].alias("size"),
    )
    if levels == 1:
        return F.array(own)
    below = F.flatten(F.transform(part["parts"], lambda p: _flatten(p, levels - 1)))
    return F.concat(F.array(own), F.coalesce(below, F.array().cast(T.ArrayType(PART))))


@F.pandas_udf(T.ArrayType(PART))
def _flatten_deep(payloads: pd.Series) -> pd.Series:
    """The same for documents nested deeper than the typed path reads."""

    def flat(payload: str) -> list[dict]:
        out, todo = [], [json.loads(payload)]
        while todo:
            part = todo.pop()
            body = part.get("body") or {}
            out.append(
                {
                    "mime_type": part.get("mimeType"),
                    "data": body.get("data"),
                    "filename": part.get("filename"),
                    "attachment_id": body.get("attachmentId"),
                    "size": body.get("size"),
                }
            )
            todo.extend(reversed(part.get("parts") or []))
        return out

    return payloads.map(flat, na_action="ignore")


def mime_body(parts: Column, mime_type: str) -> Column:
    """Text of the first non-empty part of that type, else ''."""
    texts = F.transform(
        F.filter(parts, lambda p: (p["mime_type"] == mime_type) & (F.coalesce(p["data"], F.lit("")) != "")),
        lambda p: from_base64url(p["data"]),
    )
    return blank_if_null(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)))


def mime_attachments(parts: Column) -> Column:
    def named(p: Column) -> Column:
        return (F.coalesce(p["filename"], F.lit("")) != "") & (F.coalesce(p["attachment_id"], F.lit("")) != "")

    return F.transform(
        F.filter(parts, named),
        lambda p: F.struct(
            p["filename"].alias("filename"),
            F.coalesce(p["mime_type"], F.lit("application/octet-stream")).alias("mime_type"),
            F.coalesce(p["size"], F.lit(0)).cast("bigint").alias("size"),
        ),
    ).cast(ATTACHMENTS)


_FIELDS = "id:string,threadId:string,snippet:string,labelIds:array<string>"


def with_parts(df: DataFrame, column: str = "json") -> DataFrame:
    """Fields, `headers` and `parts` (flat, pre-order) of every document.

    A document cannot nest deeper than it has "parts" keys. Counting them in
    the text tells, before any parsing, which documents the typed path reads
    whole; only the rest reaches Python, as text that is null for all others. Both
    come from one scan."""
    is_deep = F.regexp_count(column, F.lit('"parts"')) >= TYPED_LEVELS
    text = F.col(column)
    parsed = df.select(
        F.from_json(text, f"struct<{_FIELDS},payload:struct<headers:{_HEADERS}>>").alias("m"),
        F.from_json(F.when(~is_deep, text), f"struct<payload:{_payload_type(TYPED_LEVELS)}>").alias("t"),
        F.from_json(F.when(is_deep, text), "struct<payload:string>")["payload"].alias("deep"),
    )
    parts = F.coalesce(_flatten_deep("deep"), F.when(F.col("t.payload").isNotNull(), _flatten(F.col("t.payload"), TYPED_LEVELS)))
    return parsed.select("m.id", "m.threadId", "m.snippet", "m.labelIds", F.col("m.payload.headers").alias("headers"), parts.alias("parts"))


def rejected_exports(df: DataFrame, column: str = "json") -> DataFrame:
    """The rows of an export that are no messages, with `reason`: they do not
    parse, or have no id. `from_gmail_export` leaves out just these."""
    id_ = F.from_json(F.col(column), "struct<id:string,_broken:string>", {"columnNameOfCorruptRecord": "_broken"})
    reason = F.when(F.col(column).isNull() | id_["_broken"].isNotNull() | id_.isNull(), "not a JSON document").when(id_["id"].isNull(), "no id")
    return df.withColumn("reason", reason).filter("reason IS NOT NULL")


def from_gmail_export(df: DataFrame, column: str = "json") -> DataFrame:
    """API documents in `column` to messages; what is none is in
    `rejected_exports`."""
    flat = with_parts(df, column).filter("id IS NOT NULL")
    h = F.coalesce(F.col("headers"), F.array().cast(_HEADERS))
    labels = F.coalesce("labelIds", F.array().cast(STRINGS))
    date = header(h, "Date")
    html = mime_body(F.col("parts"), "text/html")
    return conform(
        flat.select(
            "id",
            F.col("threadId").alias("thread_id"),
            header(h, "Subject").alias("subject"),
            parse_address(header(h, "From")).alias("from"),
            parse_address_list(header(h, "To")).alias("to"),
            parse_address_list(header(h, "Cc")).alias("cc"),
            date.alias("date"),
            parse_date(date).alias("sent_at"),
            blank_if_null(F.col("snippet")).alias("snippet"),
            mime_body(F.col("parts"), "text/plain").alias("body"),
            F.nullif(html, F.lit("")).alias("html_body"),
            labels.alias("labels"),
            mime_attachments(F.col("parts")).alias("attachments"),
            F.array_contains(labels, "UNREAD").alias("is_unread"),
        )
    )
