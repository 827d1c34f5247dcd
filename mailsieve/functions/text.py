"""Scalar text functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.rules import REPLY_PREFIXES, WS

_EDGES = rf"^{WS}+|{WS}+\z"
_REPLIES = rf"^(?i)(?:(?:{'|'.join(REPLY_PREFIXES)}){WS}*:{WS}*)+"


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used: a
    one-element transform gives it a name inside the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    """Trims every kind of white space, not only blanks."""
    return F.regexp_replace(text, _EDGES, "")


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def snippet(body: Column) -> Column:
    head = F.substring(blank_if_null(body), 1, 200)
    return F.trim(F.regexp_replace(head, f"{WS}+", " "))


def normalize_subject(subject: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(blank_if_null(subject), _REPLIES, "")))


def thread_key(references: Column, in_reply_to: Column, message_id: Column, subject: Column) -> Column:
    def given(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    root = F.coalesce(
        given(F.get(references, F.lit(0))), given(in_reply_to), given(message_id), normalize_subject(subject)
    )
    return F.concat(F.lit("imap-thread-"), F.substring(F.sha2(root, 256), 1, 16))


def message_id(folder: Column, uid: Column) -> Column:
    return F.concat(folder, F.lit(":"), uid.cast("string"))


def message_folder(id_: Column) -> Column:
    """Folder part of `folder:uid`; folders may hold colons themselves."""
    cut = F.length(id_) - F.length(F.substring_index(id_, ":", -1)) - 1
    return F.when(F.contains(id_, F.lit(":")), F.substring(id_, F.lit(1), cut)).otherwise(F.lit("INBOX"))


def message_uid(id_: Column) -> Column:
    """Leading digits behind the last colon; null when there are none."""
    digits = F.regexp_extract(F.substring_index(id_, ":", -1), rf"^{WS}*([+-]?[0-9]+)", 1)
    return digits.try_cast("bigint")


def from_base64url(data: Column) -> Column:
    """Web-safe base64 to text. Bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.unbase64(F.translate(data, "-_", "+/")).cast("string"))


def to_base64url(text: Column) -> Column:
    # base64 puts a line break after every 76 characters; the web-safe form has none.
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, whatever its case."""
    found = F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))
    return blank_if_null(found["value"])


def fingerprint(key: Column) -> Column:
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 8)


# --- FIXED VALUES: named zones of RFC 2822 ---------------------------------
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_date(date: Column) -> Column:
    """ISO or RFC 2822 text to a timestamp; null when it is neither."""
    rfc = F.regexp_replace(date, rf"^{WS}*[A-Za-z]{{3}},{WS}*|{WS}*\([^)]*\){WS}*\z", "")
    rfc = F.regexp_replace(F.regexp_replace(rfc, f"{WS}+", " "), r"(?:GMT|UTC|UT|Z)\z", "+0000")
    # Zones of the standard that are written as names.
    zone = F.try_element_at(F.create_map(*map(F.lit, (x for pair in ZONES.items() for x in pair))), F.regexp_extract(rfc, r" ([A-Z]{3})\z", 1))
    rfc = F.when(zone.isNotNull(), F.concat(F.regexp_replace(rfc, r"[A-Z]{3}\z", ""), zone)).otherwise(rfc)
    return F.coalesce(
        F.when(F.rlike(date, F.lit(r"^[0-9]{4}-")), F.try_to_timestamp(date)),
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm[:ss] Z")),
    )


def iso_utc(ts: Column) -> Column:
    """2026-01-15T10:00:00.000Z, whatever the session's time zone is."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
