"""Mailbox search: a query string becomes one predicate over message columns,
so column pruning and filter push-down apply to it as to any filter."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.rules import FOLDER_ALIASES, LOGICAL_FOLDERS

# Blank-separated; quotes may open anywhere in a word and run to their end or
# the end of the query.
_WORD = re.compile(r"""(?:[^ "']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))+""", re.DOTALL)
_QUOTED = re.compile(r""""([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)""", re.DOTALL)


def words(query: str) -> list[str]:
    plain = (_QUOTED.sub(lambda m: m[1] if m[1] is not None else m[2], w) for w in _WORD.findall(query))
    return [w for w in plain if w]


@dataclass
class Terms:
    folder: str = "inbox"
    values: dict[str, str] = field(default_factory=dict)  # from, to, subject, after, before ...
    seen: bool | None = None
    flagged: bool = False
    attachment: bool = False


# Terms whose last use wins; the second group is answered from columns only.
_TEXT_TERMS = ("from", "to", "subject")
_WIDE_TERMS = ("filename", "larger", "smaller", "body")


def _day(value: str) -> str | None:
    m = re.fullmatch(r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", value)
    try:
        return date(*map(int, m.groups())).isoformat() if m else None
    except ValueError:
        return None


def parse(query: str, wide: bool = False) -> Terms:
    """`wide` also understands has:, filename:, larger:, smaller: and body:,
    which are otherwise words like any other."""
    terms, free = Terms(), []
    for word in words(query):
        op, colon, value = word.partition(":")
        op, value = op.lower(), re.sub(r"^[\"']|[\"']\Z", "", value)
        if not colon:
            free.append(word)
        elif op in _TEXT_TERMS or (wide and op in _WIDE_TERMS):
            terms.values[op] = value
        elif op in ("after", "before"):
            if _day(value):
                terms.values[op] = _day(value)
        elif op == "is":
            if value in ("read", "unread"):
                terms.seen = value == "read"
            terms.flagged |= value in ("starred", "flagged")
        elif op in ("in", "label"):
            terms.folder = FOLDER_ALIASES.get(value.lower(), value)
        elif wide and (op, value.lower()) == ("has", "attachment"):
            terms.attachment = True
        else:
            free.append(word)
    text = " ".join(free).strip()
    if text:
        own = terms.values.get("subject")
        terms.values["subject"] = f"{own} {text}" if own else text
    return terms


def _has(text: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def _shown(addr: Column) -> Column:
    return F.concat(F.coalesce(addr["name"], F.lit("")), F.lit(" <"), F.coalesce(addr["email"], F.lit("")), F.lit(">"))


def _size(value: str) -> int | None:
    m = re.fullmatch(r"(\d+)([KkMmGg]?)[Bb]?", value)
    return int(m[1]) * 1024 ** " KMG".index(m[2].upper() or " ") if m else None


def folder_paths(logical: str) -> list[str]:
    """Every path the folder may have when no mailbox list is at hand."""
    if logical == "inbox":
        return ["INBOX"]
    return LOGICAL_FOLDERS[logical][1] + [logical] if logical in LOGICAL_FOLDERS else [logical]


def predicates(terms: Terms, paths: list[str] | None = None) -> list[Column]:
    """One column per condition; `paths` overrides the folder's paths and an
    empty list searches everywhere."""
    out = []
    paths = folder_paths(terms.folder) if paths is None else paths
    if paths:
        lowered = [p.lower() for p in paths]
        out.append(F.exists("labels", lambda label: F.lower(label).isin(lowered)))
    v = terms.values
    if v.get("from"):
        out.append(_has(_shown(F.col("from")), v["from"]))
    if v.get("to"):
        out.append(F.exists("to", lambda a: _has(_shown(a), v["to"])))
    if v.get("subject"):
        out.append(_has(F.col("subject"), v["subject"]))
    if v.get("body"):
        out.append(_has(F.col("body"), v["body"]))
    if terms.seen is not None:
        out.append(F.col("is_unread") != F.lit(terms.seen))
    if terms.flagged:
        out.append(F.exists("labels", lambda label: F.lower(label).isin("starred", "flagged", r"\flagged")))
    if "after" in v:
        out.append(F.col("sent_at") >= F.lit(v["after"] + " 00:00:00+00:00").cast("timestamp"))
    if "before" in v:
        out.append(F.col("sent_at") < F.lit(v["before"] + " 00:00:00+00:00").cast("timestamp"))
    if terms.attachment:
        out.append(F.size("attachments") > 0)
    if v.get("filename"):
        out.append(F.exists("attachments", lambda a: _has(a["filename"], v["filename"])))
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda acc, a: acc + F.coalesce(a["size"], F.lit(0)))
    if "larger" in v and _size(v["larger"]) is not None:
        out.append(total > _size(v["larger"]))
    if "smaller" in v and _size(v["smaller"]) is not None:
        out.append(total < _size(v["smaller"]))
    return out


def search(
    messages: DataFrame, query: str, paths: list[str] | None = None, wide: bool = False
) -> DataFrame:
    """All messages the query matches, in no particular order."""
    for condition in predicates(parse(query, wide), paths):
        messages = messages.filter(condition)
    return messages


def folder_names(label: str) -> list[str]:
    """A label and, when it names a usual folder, all names that folder has in
    any source, in lower case."""
    logical = FOLDER_ALIASES.get(label.lower())
    aliases = [alias for alias, name in FOLDER_ALIASES.items() if name == logical] if logical else []
    paths = LOGICAL_FOLDERS[logical][1] if logical in LOGICAL_FOLDERS else []
    return sorted({label.lower(), *aliases, *(path.lower() for path in paths)})


def carries(label: str) -> Column:
    """Whether a message carries the label, under whichever of its names."""
    names = folder_names(label)
    return F.coalesce(F.exists("labels", lambda x: F.lower(x).isin(names)), F.lit(False))


def resolve_folders(mailboxes: DataFrame, logical: str) -> DataFrame:
    """The real path of a logical folder for every connection of a mailbox
    table (connection_id, position, path, special_use): the special-use flag
    decides, then the usual names in order, then the first usual name.

    The candidates are a handful of literals, so this is a projection and one
    map-side combined aggregate."""
    if logical not in LOGICAL_FOLDERS:
        path = "INBOX" if logical == "inbox" else logical
        return mailboxes.select("connection_id").distinct().withColumn("path", F.lit(path))
    flag, names = LOGICAL_FOLDERS[logical]
    place = F.array_position(F.array(*(F.lit(n.lower()) for n in names)), F.lower("path"))
    rank = F.when(F.col("special_use") == flag, F.lit(0)).when(place > 0, place)
    best = F.min_by(F.when(rank.isNotNull(), F.col("path")), F.when(rank.isNotNull(), F.struct(rank, "position")))
    return mailboxes.groupBy("connection_id").agg(F.coalesce(best, F.lit(names[0])).alias("path"))
