"""Redaction of personal data and secrets.

Nearly all text is clean, so each stage hangs on a cheap sign without which its
pattern cannot match: a run of digits, a word or a literal. Signs are read off
the text as it came. That is exact, because what a stage writes is bracketed and
holds no digit, `@`, `$` or small letter, so it makes no later pattern match
where the original could not. The exception is a secret's hint, which some marks
contain; the signs of those marks therefore count for it as well. A single
alternation of all patterns would be simpler, but costs as much as the chain.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.text import bound
from mailsieve.policy import guarded
from mailsieve.rules import PII_PATTERNS, SECRET_HINT

# The chain in running order with the signs each stage hangs on.
_SIGNED = [
    (("digits",), ("ssn", "card")),
    (("begin",), ("pem",)),
    (("stripe",), ("sk_key", "pk_key")),
    (("words",), ("generic_key",)),
    (("akia",), ("aws_key",)),
    (("words", "begin", "stripe", "akia"), ("aws_secret",)),
    (("bearer",), ("bearer",)),
    (("digits",), ("account_ending", "account_label", "routing")),
    (("dollar",), ("dollar",)),
    (("at",), ("email",)),
]
# Look-aheads put in front of a pattern. They hold wherever it matches and let
# the scan give up on most positions after a letter or two.
_LEADS = {
    "ssn": "(?=[0-9])",
    "card": "(?=[3-6])",
    "generic_key": "(?=[aAtT][pPoO][iIkK])",
    "account_ending": "(?=[acAC][acAC][crCR])",
    "account_label": "(?=[aA][cC][cC])",
    "routing": "(?=[ratRAT][obrOBR][uanUAN])",
}
_LINES = r"(?<=[\n\r\x{2028}\x{2029}])"


def redact_kind(text: Column, kind: str) -> Column:
    """One stage of the chain."""
    if kind == "aws_secret":
        return _redact_secrets(text)
    pattern, mark = PII_PATTERNS[kind]
    return F.regexp_replace(text, _LEADS.get(kind, "") + pattern, mark)


def _redact_secrets(text: Column) -> Column:
    """Secrets standing in front of an aws/secret/key hint on the same line.

    A look-ahead would rescan the rest of the line for every candidate, which
    is quadratic on long lines. Each line is cut in front of its last hint
    instead and only that part searched. The `_` stands in for the hint's
    first letter, so the boundary test at the cut stays what it was.
    """
    pattern, mark = PII_PATTERNS["aws_secret"]

    def one_line(line: Column) -> Column:
        head = F.regexp_extract(line, rf"^([\s\S]*){SECRET_HINT}", 1)
        marked = F.regexp_replace(F.concat(head, F.lit("_")), pattern, mark)
        rest = F.substring(line, F.length(head) + 1, F.length(line))
        return F.concat(F.substring(marked, F.lit(1), F.length(marked) - 1), rest)

    def whole(text: Column) -> Column:
        lines = F.transform(
            F.split(text, _LINES), lambda line: F.when(line.rlike(SECRET_HINT), one_line(line)).otherwise(line)
        )
        return F.when(text.rlike("[A-Za-z0-9/+=]{40}"), F.array_join(lines, "")).otherwise(text)

    return bound(text, whole)


def _has(text: Column, *parts: str) -> Column:
    return reduce(or_, (F.contains(text, F.lit(p)) for p in parts))


def _signs(text: Column) -> dict[str, Column]:
    """Cheapest first."""
    return {
        "at": _has(text, "@"),
        "dollar": _has(text, "$"),
        "begin": _has(text, "-----BEGIN "),
        "stripe": _has(text, "k_live_", "k_test_"),
        "akia": _has(text, "AKIA"),
        "bearer": _has(text, "Bearer"),
        "digits": text.rlike("[0-9]{4}"),
        # Part of every generic key's name, and every secret's hint.
        "words": text.rlike("(?=[tTaAsSkK][oOwWeE][kKsScCyY])(?i:token|aws|secret|key)"),
    }


def _stage(kinds: tuple[str, ...], wanted: Column):
    return lambda text: F.when(wanted, reduce(redact_kind, kinds, text)).otherwise(text)


def redact_pii(text: Column, emails: bool | Column = True, dollars: bool | Column = True) -> Column:
    """The whole chain over one text column."""
    switches = {"dollar": dollars, "email": emails}

    def stages(signed: Column) -> Column:
        out = signed["text"]
        for names, kinds in _SIGNED:
            switch = switches.get(kinds[0], True)
            if switch is False:
                continue
            sign = reduce(or_, (signed[n] for n in names))
            wanted = sign if switch is True else sign & switch
            out = bound(out, _stage(kinds, wanted))
        return out

    signs = _signs(text)
    any_sign = reduce(or_, signs.values())
    signed = F.struct(text.alias("text"), *(s.alias(n) for n, s in signs.items()))
    return F.when(any_sign, bound(signed, stages)).otherwise(text)


def redact(text: Column, policy) -> Column:
    """The chain under a policy: the master switch governs all of it."""
    chain = redact_pii(text, policy.email_redaction, policy.dollar_amount_redaction)
    return guarded(policy.pii_redaction, chain, text)
