"""Column layouts shared by every source, operator and view."""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])
ADDRESSES = T.ArrayType(ADDRESS)
ATTACHMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)
ATTACHMENTS = T.ArrayType(ATTACHMENT)
STRINGS = T.ArrayType(T.StringType())

# One row per message. `date` keeps the source's text; `sent_at` is that text
# parsed once at ingest, so range predicates reach the Parquet scan.
MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("uid", T.LongType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("from", ADDRESS),
        T.StructField("to", ADDRESSES),
        T.StructField("cc", ADDRESSES),
        T.StructField("date", T.StringType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("html_body", T.StringType()),
        T.StructField("labels", STRINGS),
        T.StructField("attachments", ATTACHMENTS),
        T.StructField("is_unread", T.BooleanType()),
    ]
)

ACCOUNT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "email", "name", "avatar_url", "password_hash")]
    + [T.StructField(c, T.LongType()) for c in ("created_at", "updated_at")]
)
CONNECTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "account_id", "email", "provider", "display_name", "status")]
    + [T.StructField(c, T.LongType()) for c in ("created_at", "updated_at")]
)
SESSION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "account_id")]
    + [T.StructField(c, T.LongType()) for c in ("expires_at", "created_at")]
)
API_KEY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "connection_id", "account_id", "name", "key_hash", "prefix")]
    + [T.StructField(c, T.LongType()) for c in ("created_at", "last_used_at", "revoked_at")]
)
