"""Reports over a corpus, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.address import sender_domain
from mailsieve.operators.search import carries
from mailsieve.operators.threads import UNDATED, with_position

PROMOTIONS = "CATEGORY_PROMOTIONS"


def top_senders(messages: DataFrame, n: int = 20) -> DataFrame:
    return (
        messages.groupBy(F.col("from.email").alias("email"))
        .agg(F.count("*").alias("n_messages"), F.count_if("is_unread").alias("n_unread"))
        .orderBy(F.desc("n_messages"), "email")
        .limit(n)
    )


def label_distribution(messages: DataFrame) -> DataFrame:
    return (
        messages.select(F.explode("labels").alias("label"), "is_unread")
        .groupBy("label")
        .agg(F.count("*").alias("n_messages"), F.count_if("is_unread").alias("n_unread"))
    )


def _is_sent(sent_label: str):
    return carries(sent_label)


def last_inbound(messages: DataFrame, sent_label: str = "SENT") -> DataFrame:
    """Per thread the times of the last message in and the last message out."""
    sent = _is_sent(sent_label)
    return messages.groupBy("thread_id").agg(
        F.max(F.when(~sent, F.col("sent_at"))).alias("last_in"),
        F.max(F.when(sent, F.col("sent_at"))).alias("last_out"),
    )


def awaiting_reply(messages: DataFrame, sent_label: str = "SENT") -> DataFrame:
    """Sent messages nobody wrote after in their thread. An undated message counts
    as older than any dated one, and messages without a thread are one thread. The
    thread side of the join has one row per thread; a heavy thread's own messages are
    split by Spark's skew handling."""
    sent = _is_sent(sent_label)
    place = F.coalesce(F.unix_micros("sent_at"), F.lit(UNDATED))
    ends = messages.groupBy(F.col("thread_id").alias("_thread")).agg(F.max(F.when(~sent, place)).alias("_last_in"))
    own = messages.filter(sent).join(ends, F.col("thread_id").eqNullSafe(F.col("_thread")))
    return own.filter(F.col("_last_in").isNull() | (F.col("_last_in") <= place)).drop("_thread", "_last_in")


def unanswered(messages: DataFrame, domain: str, since, until, sent_label: str = "SENT") -> DataFrame:
    """Threads whose last message came in, from a sender on `domain`, within
    [since, until). Only the last message of each thread is kept on the way."""
    last = messages.groupBy("thread_id").agg(
        F.max_by(
            F.struct("id", "subject", F.col("from.email").alias("email"), "sent_at", _is_sent(sent_label).alias("sent")),
            F.struct("sent_at", "uid"),
        ).alias("last")
    )
    name = sender_domain(F.coalesce("last.email", F.lit("")))
    below = (name == domain) | F.endswith(name, F.lit("." + domain))
    recent = (F.col("last.sent_at") >= F.lit(since)) & (F.col("last.sent_at") < F.lit(until))
    return last.filter(~F.col("last.sent") & below & recent).select(
        "thread_id", "last.id", "last.subject", "last.email", "last.sent_at"
    )


def history(messages: DataFrame, sender: str) -> DataFrame:
    """Everything from one address, or from a domain and below, oldest first."""
    email = F.lower("from.email")
    name = sender_domain(F.coalesce("from.email", F.lit("")))
    who = email == sender.lower() if "@" in sender else (name == sender) | F.endswith(name, F.lit("." + sender))
    return messages.filter(who).orderBy("sent_at", "uid")


def subscriptions(messages: DataFrame, label: str = PROMOTIONS) -> DataFrame:
    return (
        messages.filter(F.array_contains("labels", label))
        .groupBy(F.col("from.email").alias("email"))
        .agg(
            F.count("*").alias("n_messages"),
            F.count_if("is_unread").alias("n_unread"),
            F.max("sent_at").alias("last_sent_at"),
        )
    )


def transcripts(messages: DataFrame, part_size: int = 1000) -> DataFrame:
    """Each thread as text, oldest message first. A thread longer than
    `part_size` messages continues in further parts, in order, so no row and
    no task ever holds an unbounded thread."""
    line = F.concat(
        F.coalesce(F.nullif("from.name", F.lit("")), "from.email", F.lit("")), F.lit(": "), F.coalesce("body", F.lit(""))
    )
    placed = with_position(messages).select(
        "thread_id", "position", F.floor((F.col("position") - 1) / part_size).alias("part"), line.alias("line")
    )
    return placed.groupBy("thread_id", "part").agg(
        F.count("*").alias("n_messages"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n\n"
        ).alias("transcript"),
    )
