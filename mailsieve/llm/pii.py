"""Pseudonyms for personal numbers and dates, by a keyed Feistel permutation.

Card numbers (with a right check digit), telephone and social security numbers,
IPv4 addresses and dates are validated, and each is permuted within its own
format: a card becomes a card of as many digits with a right check digit, a date
a date. The permutation depends on the key alone, so a value gets the same
pseudonym in every document and two values never the same one; with the key it can be
undone. Separators and layout stay. E-mail addresses, which have no number to
permute, get a keyed digest instead. What looks like one of these but is not
valid stays as it is; other kinds and other values are looked for at its place and
inside of it.

A card is written unbroken or in groups of 4-4-4-4, 4-4-4-4-3, 4-6-5 or 4-6-4 digits,
so numbers next to each other are not taken for one. A telephone number is written in
groups of 3-3-4 digits or begins with + and has 8 to 15 digits; its country code
stays. Behind a + the digits have no fixed groups: what follows after one separator
is read as part of the number unless it begins another value.

The network splits a value into two parts of a mixed base and adds a keyed hash
of one to the other, modulo its base, in rounds; it is an aggregate over a short
array of rounds, evaluated in the JVM. There is no shuffle.

Null texts stay null. All other columns and repeated rows stay as they are. No
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.shared import unused

# Stands in for a secret; callers give their own.
EXAMPLE_KEY = "example key, not a secret"
ROUNDS = 10
_BEFORE, _AFTER = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
# A card of 19 digits is tried before those that it may begin with, and is not followed by more digits.
_CARDS = (
    f"{_BEFORE}(?<![+])[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}[ -][0-9]{{3}}(?![ .-]?[0-9]){_AFTER}",
    f"{_BEFORE}(?<![+])(?:[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{4,5}}|[0-9]{{13,19}})(?!-[0-9]{{2}}-[0-9]{{2}}{_AFTER}){_AFTER}",
)
_NATIONAL = "[(]?[0-9]{3}(?:[)] ?|[ .-])[0-9]{3}[ .-][0-9]{4}"
# Values that the groups behind a + do not run into.
_OTHERS = f"(?:{_NATIONAL}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}){_AFTER}"
# In the order in which they are tried at a place.
PATTERNS: dict[str, str] = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}",
    "ip": f"{_BEFORE}(?<![.])[0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}}(?![.]?[0-9A-Za-z])",
    "date": f"{_BEFORE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}([/.])[0-9]{{1,2}}\\1[0-9]{{4}}){_AFTER}",
    "ssn": f"{_BEFORE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_AFTER}(?!-)",
    "card": "|".join(_CARDS),
    "phone": f"{_BEFORE}(?:[+][0-9]{{1,3}}[ .-]?[(]?[0-9]{{3}}[)]?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|[+](?=[1-9])(?:(?:[ .-](?!{_OTHERS}))?[(]?[0-9][)]?){{8,15}}|{_NATIONAL}){_AFTER}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# FIXED VALUES: country codes of one and of two digits; all others have three.
_COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
_DAYS, _DAY_BASES = 73_049, (17, 4_297)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _number(text: Column) -> Column:
    return text.cast("long")


def _feistel(left: Column, right: Column, left_base: Column | int, right_base: Column | int, tweak: Column | str, key: str) -> Column:
    """struct(l, r): the permutation of the pairs below (left_base, right_base)."""
    bases = F.struct(F.lit(left_base).cast("long").alias("a"), F.lit(right_base).cast("long").alias("b"))
    tweak = F.lit(tweak)

    def step(pair: Column, i: Column) -> Column:
        keyed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), pair["r"].cast("string")), 256)
        pulled = F.conv(F.substring(keyed, 1, 15), 16, 10).cast("long")
        base = F.when(i % 2 == 1, bases["a"]).otherwise(bases["b"])
        return F.struct(pair["r"].alias("l"), F.pmod(pair["l"] + pulled, base).alias("r"))

    first = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step)


def _then(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")
    pair = _feistel(_number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1, rest)), power(half), power(rest), F.concat(F.lit(tweak), F.length(digits).cast("string")), key)
    return _then(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), rest, F.lit("0"))))


def _laid_out(digits: Column, like: Column) -> Column:
    """`like` with its digits, in order, replaced by `digits`."""
    chars = F.filter(F.split(like, ""), lambda c: c != "")
    place = lambda i: F.length(_digits(F.substr(like, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, place(i), F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """Sum of the digits, with every second one doubled from the given place
    counted from the end."""
    last = F.length(digits)

    def worth(total: Column, i: Column) -> Column:
        d = F.substr(digits, last - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == doubled_from_end, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0), worth)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    closed = _then(_permuted_digits(body, "card", key), lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _then(closed, lambda d: _laid_out(d, m)))


def _phone(m: Column, key: str) -> Column:
    """The digits behind the country code change."""
    digits = _digits(m)
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, _COUNTRY, 0)).otherwise("")
    own = F.substr(digits, F.length(code) + 1)
    return _then(F.concat(code, _permuted_digits(own, "phone", key)), lambda d: _laid_out(d, m))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, "[.]"), _number)
    at = lambda i: F.element_at(o, i)
    pair = _feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), 65_536, 65_536, "ip", key)
    parts = lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)))
    return F.when(F.forall(o, lambda x: x < 256), _then(pair, parts))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (_number(F.element_at(F.split(m, "-"), i)) for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = _feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, "ssn", key)

    def shown(p: Column) -> Column:
        a = p["l"] + 1 + (p["l"] >= 665).cast("int")
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((a, 3), (F.floor(p["r"] / 9_999) + 1, 2), (p["r"] % 9_999 + 1, 4))))

    return F.when(valid, _then(pair, shown))


def _date(m: Column, key: str) -> Column:
    """Dates of 1900 to 2099 among themselves, others within their year. A date
    with slashes or dots is read day first if it can be."""
    parts = F.split(m, "[-/.]")
    part = lambda i: F.element_at(parts, i)
    iso = m.contains("-")
    read = lambda y, mo, d: F.try_to_date(F.concat_ws("-", part(y), F.lpad(part(mo), 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")
    day_first = read(3, 2, 1)
    value = F.when(iso, read(1, 2, 3)).otherwise(F.coalesce(day_first, read(3, 1, 2)))
    epoch = F.lit("1900-01-01").cast("date")

    def moved(date: Column) -> Column:
        day = F.datediff(date, epoch)
        pair = _feistel(F.floor(day / _DAY_BASES[1]), day % _DAY_BASES[1], *_DAY_BASES, "date", key)
        in_range = _then(pair, lambda p: F.date_add(epoch, (p["l"] * _DAY_BASES[1] + p["r"]).cast("int")))
        start = F.trunc(date, "year")
        leap = F.datediff(F.add_months(start, 12), start) == 366
        one, two = F.when(leap, 6).otherwise(5), F.when(leap, 61).otherwise(73)
        of_year = F.datediff(date, start)
        own = _feistel(F.floor(of_year / two), of_year % two, one, two, F.concat(F.lit("date"), F.year(date).cast("string")), key)
        in_year = _then(own, lambda p: F.date_add(start, (p["l"] * two + p["r"]).cast("int")))
        return F.when(day.between(0, _DAYS - 1), in_range).otherwise(in_year)

    def shown(date: Column) -> Column:
        sep = F.regexp_extract(m, "[-/.]", 0)
        wide = lambda i, x: F.when(F.length(part(i)) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        day, month, year = F.dayofmonth(date), F.month(date), F.lpad(F.year(date).cast("string"), 4, "0")
        as_iso = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        first, second = F.when(day_first.isNotNull(), day).otherwise(month), F.when(day_first.isNotNull(), month).otherwise(day)
        return F.when(iso, as_iso).otherwise(F.concat(wide(1, first), sep, wide(2, second), sep, year))

    return F.when(value.isNotNull(), _then(value, lambda d: _then(moved(d), shown)))


def _email(m: Column, key: str) -> Column:
    keyed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(keyed, 1, 16), F.lit("@"), F.lit("h"), F.substring(keyed, 17, 8), F.lit(".invalid"))


_KINDS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


# Where a value may begin, and for each such place the character before it and then a
# whole address or enough for any number (61 characters at most) and what may not
# follow it.
_PLACE = f"(?={_ANY})"
_HEAD = f"(?s)(?=.(?:{_ANY}))(?=(.(?:{PATTERNS['email']}|.{{1,96}})))"
_START = "(?s)(?<=^.)"
# Picks are gathered by this many places at a time, since every addition to an array copies it.
_BLOCK = 64
_PICKS = "array<struct<at:int,new:struct<kind:string,length:int,text:string>>>"


def _first_valid(head: Column, key: str) -> Column:
    """struct(kind, length, text) for the value at the start of `head`: the first
    kind that is valid there; null if there is none."""

    def tried(kind: str, value: Column) -> Column:
        make = lambda m: _then(_KINDS[kind](m, key), lambda new: F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.length(m).alias("length"), new.alias("text"))))
        return _then(value, lambda m: F.when(m != "", make(m)))

    shapes = [(kind, p) for kind, any_of in PATTERNS.items() for p in (_CARDS if kind == "card" else (any_of,))]
    return F.coalesce(*(tried(kind, F.regexp_extract(head, f"{_START}(?:{p})", 0)) for kind, p in shapes))


def rewritten(text: Column, key: str = EXAMPLE_KEY) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kind of each. Values
    are taken from left to right; where none is valid, the next place is tried, also
    inside of what has failed."""
    # A line feed in front, so that no place is the start of the string, where split() gives no piece.
    fed = F.concat(F.lit("\n"), text)
    pieces = F.split(fed, _PLACE, -1)
    heads = F.regexp_extract_all(fed, F.lit(_HEAD), F.lit(2))
    places = F.transform(heads, lambda h, i: F.struct((i + 2).alias("at"), _first_valid(h, key).alias("new")))

    def put_together(pieces: Column, places: Column) -> Column:
        none = F.array().cast(_PICKS)

        def step(state: Column, i: Column) -> Column:
            place = F.get(places, i)
            size = F.length(F.get(pieces, i + 1))
            taken = (state["covered"] <= 0) & place["new"].isNotNull()
            covered = F.when(taken, place["new"]["length"]).otherwise(state["covered"]) - size
            return F.struct(F.greatest(covered, F.lit(0)).alias("covered"), F.when(taken, F.concat(state["picks"], F.array(place))).otherwise(state["picks"]).alias("picks"))

        def block(state: Column, first: Column) -> Column:
            of_block = F.sequence(first, F.least(first + _BLOCK, F.size(places)) - 1)
            start = F.struct(state["covered"].alias("covered"), none.alias("picks"))
            return _then(F.aggregate(of_block, start, step), lambda s: F.struct(s["covered"].alias("covered"), F.concat(state["blocks"], F.array(s["picks"])).alias("blocks")))

        def joined(picks: Column) -> Column:
            until = lambda i: F.coalesce(F.get(picks, i)["at"], F.size(pieces) + 1)
            # Piece by piece: a slice of an array would copy the whole of it.
            span = lambda a, b: F.array_join(F.transform(F.sequence(a, b - 1), lambda k: F.get(pieces, k - 1)), "")
            changed = F.transform(picks, lambda p, i: F.concat(p["new"]["text"], F.substr(span(p["at"], until(i + 1)), p["new"]["length"] + 1)))
            first = F.substr(span(F.lit(1), until(F.lit(0))), F.lit(2))
            return F.struct(F.concat(first, F.array_join(changed, "")).alias("text"), F.transform(picks, lambda p: p["new"]["kind"]).alias("kinds"))

        start = F.struct(F.lit(0).alias("covered"), F.array().cast(f"array<{_PICKS}>").alias("blocks"))
        blocks = F.aggregate(F.sequence(F.lit(0), F.size(places) - 1, F.lit(_BLOCK)), start, block, lambda s: s["blocks"])
        return _then(F.flatten(blocks), joined)

    untouched = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(_ANY), _then(pieces, lambda p: _then(places, lambda q: put_together(p, q)))).otherwise(untouched)


def pseudonymised(docs: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """The documents with pseudonyms in their texts, and `n_chars`, where there is
    such a column, of the new text."""
    made = unused(docs, "made")
    after = docs.withColumn(made, rewritten(F.col("text"), key))
    new = {"text": F.col(f"{made}.text")}
    if "n_chars" in docs.columns:
        length = F.length(F.col(f"{made}.text")).cast(dict(docs.dtypes)["n_chars"])
        new["n_chars"] = F.when(F.size(F.col(f"{made}.kinds")) > 0, length).otherwise(F.col("n_chars"))
    return after.withColumns(new).select(docs.columns)


def report(docs: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """doc_id, the new text and how many values of each kind were replaced."""
    after = docs.select("doc_id", rewritten(F.col("text"), key).alias("_r"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_r.kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, PATTERNS)
    return after.select("doc_id", "_r.text", *counts)
