"""Mail addresses: header text to structs, structs to display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.text import blank_if_null, trimmed
from mailsieve.policy import guarded
from mailsieve.rules import DOT, EMAIL_LIKE, WS, WS_CHARS
from mailsieve.schema import ADDRESSES

_STRICT = rf'^(?:"?({DOT}+?)"?{WS}+)?<?([^{WS_CHARS}<>]+@[^{WS_CHARS}<>]+)>?\z'
_LOOSE = rf"^({DOT}+?){WS}*<({DOT}+?)>\z"
UNNAMED = "[Name Unavailable]"


def address(name: Column, email: Column) -> Column:
    return F.struct(name.alias("name"), email.alias("email"))


def no_addresses() -> Column:
    return F.array().cast(ADDRESSES)


def parse_address(raw: Column) -> Column:
    """`"Name" <a@b>`, `Name <a@b>` or `a@b`; anything else is an address as it stands."""
    email = F.regexp_extract(raw, _STRICT, 2)
    found = email != ""
    return address(
        F.when(found, trimmed(F.regexp_extract(raw, _STRICT, 1))).otherwise(""),
        F.when(found, email).otherwise(trimmed(raw)),
    )


def parse_address_list(raw: Column) -> Column:
    """Splits at every comma, quoted or not."""
    parts = F.transform(F.split(raw, ","), lambda p: parse_address(trimmed(p)))
    return F.when(blank_if_null(raw) == "", no_addresses()).otherwise(parts)


def parse_address_loose(raw: Column) -> Column:
    raw = blank_if_null(raw)
    email = F.regexp_extract(raw, _LOOSE, 2)
    name = F.regexp_replace(F.regexp_extract(raw, _LOOSE, 1), r"^[\"']|[\"']\z", "")
    found = email != ""
    return address(
        F.when(found, trimmed(name)).otherwise(""), F.when(found, trimmed(email)).otherwise(trimmed(raw))
    )


def parse_address_list_loose(raw: Column) -> Column:
    parts = F.transform(F.split(blank_if_null(raw), ","), trimmed)
    return F.transform(F.filter(parts, lambda p: p != ""), parse_address_loose)


def flatten_address_groups(groups: Column) -> Column:
    """array<array<struct>> to one list, missing names and addresses as ''."""
    filled = F.transform(
        F.flatten(groups), lambda a: address(blank_if_null(a["name"]), blank_if_null(a["email"]))
    )
    return F.coalesce(filled, no_addresses())


def format_address(addr: Column, redact: bool | Column = True) -> Column:
    name = trimmed(blank_if_null(addr["name"]))
    hidden = F.when((name == "") | F.rlike(name, F.lit(EMAIL_LIKE)), F.lit(UNNAMED)).otherwise(name)
    shown = F.concat(blank_if_null(addr["name"]), F.lit(" <"), blank_if_null(addr["email"]), F.lit(">"))
    return guarded(redact, hidden, shown)


def format_addresses(addrs: Column, redact: bool | Column = True) -> Column:
    return F.transform(addrs, lambda a: format_address(a, redact))


def sender_domain(email: Column) -> Column:
    """Text between the first and second @ of the lower-cased address, else ''."""
    return F.coalesce(F.get(F.split(F.lower(email), "@"), F.lit(1)), F.lit(""))


def domain_suffixes(domain: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: equal-or-subdomain becomes plain equality."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
