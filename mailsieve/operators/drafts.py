"""Drafts: listing them, and turning requests into messages ready to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.text import to_base64url
from mailsieve.operators.paging import newest
from mailsieve.operators.search import carries
from mailsieve.operators.threads import thread_participants

CREATED = "Draft created successfully. The user must review and send it manually."
NO_RECIPIENTS = (
    "No recipients specified. Provide 'to' addresses or 'in_reply_to_thread_id' to auto-populate recipients."
)
_CRLF = "\r\n"
# Requests that meet the list of their thread in one group of a join, about.
_TOGETHER = 2000


def list_drafts(messages: DataFrame, n: int = 20, label: str = "DRAFT") -> DataFrame:
    """Newest drafts first."""
    drafts = newest(messages.filter(carries(label)), n)
    return drafts.select(
        "id",
        F.col("id").alias("message_id"),
        "to",
        "subject",
        "snippet",
        F.col("date").alias("updated_at"),
    )


def resolve_recipients(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """Requests (request_id, to, subject, body, in_reply_to) with `recipients`:
    those given, else everyone in the thread replied to, the mailbox owner
    included. Without any, `error` says so.

    Participants are reduced to one row per thread and address before they
    meet a request, and only for threads that some request needs. Requests that need
    none stay where they are. The others are joined by thread and, as any number may reply to
    one, by part of the thread: its list is copied once for every `_TOGETHER` of them."""
    given = F.coalesce("to", F.array().cast("array<string>"))
    asked = requests.withColumn("_given", given)
    needs = (F.size("_given") == 0) & F.col("in_reply_to").isNotNull()
    wanted = asked.filter(needs).groupBy("in_reply_to").agg(F.ceil(F.count("*") / _TOGETHER).alias("_parts"))
    people = thread_participants(
        messages.join(wanted.select(F.col("in_reply_to").alias("thread_id")), "thread_id", "left_semi"), newest_first=False
    )
    lists = people.groupBy(F.col("thread_id").alias("in_reply_to")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first_seen", "email"))), lambda p: p["email"]).alias("_found")
    )
    copies = lists.join(wanted, "in_reply_to").select(
        "in_reply_to", "_found", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    )
    # At most one row for every `_TOGETHER` requests.
    hot = F.broadcast(wanted.filter(F.col("_parts") > 1))
    part = F.pmod(F.xxhash64("request_id"), F.coalesce("_parts", F.lit(1)))
    dealt = asked.filter(needs).join(hot, "in_reply_to", "left").withColumn("_part", part).drop("_parts")
    found = dealt.join(copies, ["in_reply_to", "_part"], "left").drop("_part")
    others = asked.filter(~needs).withColumn("_found", F.lit(None).cast("array<string>"))
    joined = found.unionByName(others)
    recipients = F.when(F.size("_given") > 0, F.col("_given")).otherwise(
        F.coalesce("_found", F.array().cast("array<string>"))
    )
    return (
        joined.withColumn("recipients", recipients)
        .withColumn("error", F.when(F.size("recipients") == 0, F.lit(NO_RECIPIENTS)))
        .drop("_given", "_found")
    )


def mime_text(to: Column, subject: Column, body: Column) -> Column:
    """The message an API draft consists of."""
    return F.concat_ws(
        _CRLF,
        F.concat(F.lit("To: "), F.array_join(to, ", ")),
        F.concat(F.lit("Subject: "), subject),
        F.lit('Content-Type: text/plain; charset="UTF-8"'),
        F.lit(""),
        body,
    )


def mailbox_text(
    message_id: Column, to: Column, subject: Column, date: Column, body: Column, in_reply_to: Column
) -> Column:
    """The message appended to a drafts folder. `date` is RFC 822 text; it and
    the message id are given, so that a rerun writes the same bytes."""
    reply = F.when(
        F.coalesce(in_reply_to, F.lit("")) != "",
        F.concat(F.lit("In-Reply-To: "), in_reply_to, F.lit(_CRLF + "References: "), in_reply_to),
    )
    return F.concat_ws(
        _CRLF,
        F.concat(F.lit("Message-ID: "), message_id),
        F.concat(F.lit("To: "), F.array_join(to, ", ")),
        F.concat(F.lit("Subject: "), subject),
        F.concat(F.lit("Date: "), date),
        F.lit('Content-Type: text/plain; charset="UTF-8"'),
        F.lit("MIME-Version: 1.0"),
        reply,  # concat_ws leaves nulls out
        F.lit(""),
        body,
    )


def build_drafts(resolved: DataFrame) -> DataFrame:
    """Requests with recipients to draft rows; the others keep their error."""
    ok = F.col("error").isNull()
    text = mime_text(F.col("recipients"), F.col("subject"), F.col("body"))
    return (
        resolved.withColumn("mime", F.when(ok, text))
        .withColumn("raw", F.when(ok, to_base64url(F.col("mime"))))
        .withColumn("status", F.when(ok, F.lit(CREATED)))
    )


def write_drafts(drafts: DataFrame, path: str) -> None:
    """Appends the valid drafts."""
    drafts.filter("error is null").drop("error").write.mode("append").parquet(path)
