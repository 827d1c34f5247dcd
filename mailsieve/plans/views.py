"""What a reader gets to see of a message, thread, draft or label.

Every view takes one policy, or the columns of each connection's own that
`gateway.tenant_run` leaves beside its messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.address import format_address, format_addresses
from mailsieve.functions.redact import redact
from mailsieve.functions.sanitize import strip_invisible
from mailsieve.policy import Policy, PolicyColumns


def search_view(messages: DataFrame, policy: Policy | PolicyColumns | None = None, *extra: str) -> DataFrame:
    """Summary line. Attachments count only when the policy leaves them in."""
    policy = policy or Policy()
    return messages.select(
        "id",
        "thread_id",
        "subject",
        format_address(F.col("from"), policy.email_redaction).alias("from"),
        "date",
        "snippet",
        "is_unread",
        "labels",
        (F.size("attachments") > 0).alias("has_attachments"),
        *extra,
    )


def message_view(messages: DataFrame, policy: Policy | PolicyColumns | None = None, *extra: str) -> DataFrame:
    policy = policy or Policy()
    return messages.select(
        "id",
        "thread_id",
        "subject",
        format_address(F.col("from"), policy.email_redaction).alias("from"),
        format_addresses(F.col("to"), policy.email_redaction).alias("to"),
        format_addresses(F.col("cc"), policy.email_redaction).alias("cc"),
        "date",
        "body",
        "labels",
        "is_unread",
        "attachments",
        *extra,
    )


def thread_message_view(messages: DataFrame, policy: Policy | PolicyColumns | None = None, *extra: str) -> DataFrame:
    policy = policy or Policy()
    return messages.select(
        "id",
        format_address(F.col("from"), policy.email_redaction).alias("from"),
        format_addresses(F.col("to"), policy.email_redaction).alias("to"),
        format_addresses(F.col("cc"), policy.email_redaction).alias("cc"),
        "date",
        "body",
        "attachments",
        *extra,
    )


def harden(df: DataFrame, policy: Policy | PolicyColumns, *columns: str) -> DataFrame:
    """Cleans columns that views otherwise show as stored."""
    return df.withColumns({c: redact(strip_invisible(F.col(c)), policy) for c in columns})


def thread_view(threads: DataFrame, policy: Policy | PolicyColumns | None = None, hardened: bool = False, *extra: str) -> DataFrame:
    """Thread line. Subject and snippet appear as stored unless hardened."""
    policy = policy or Policy()
    if hardened:
        threads = harden(threads, policy, "subject", "snippet")
    return threads.select(
        "id",
        "subject",
        format_addresses(F.col("participants"), policy.email_redaction).alias("participants"),
        "message_count",
        "snippet",
        "last_message_date",
        "is_unread",
        "labels",
        *extra,
    )


def draft_view(drafts: DataFrame, policy: Policy | PolicyColumns | None = None, hardened: bool = False) -> DataFrame:
    policy = policy or Policy()
    if hardened:
        drafts = harden(drafts, policy, "subject", "snippet")
    return drafts.select(
        "id",
        "message_id",
        format_addresses(F.col("to"), policy.email_redaction).alias("to"),
        "subject",
        "snippet",
        "updated_at",
    )


def label_view(labels: DataFrame) -> DataFrame:
    return labels.select("id", "name", "type", "messages_total", "messages_unread")


def read_view(processed: DataFrame, policy: Policy | PolicyColumns | None = None) -> DataFrame:
    """A processed message: its full view, or only why it is withheld."""
    view = message_view(processed, policy, "action", "reason").withColumnRenamed("id", "message_id")
    blocked = F.col("action") == "block"
    shown = [c for c in view.columns if c not in ("message_id", "action", "reason")]
    return view.select(
        "message_id",
        F.when(blocked, "blocked").alias("error"),
        F.when(blocked, F.col("reason")).alias("reason"),
        *(F.when(~blocked, F.col(c)).alias(c) for c in shown),
    )
