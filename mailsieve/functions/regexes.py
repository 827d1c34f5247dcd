"""User-written patterns come in the ECMAScript dialect; Spark runs
java.util.regex. `to_jdk` restates one in the other, or returns None when the
pattern is not valid, which callers report and otherwise ignore."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions import ecmascript
from mailsieve.rules import WS_CHARS


def to_jdk(pattern: str) -> str | None:
    try:
        return ecmascript.to_jdk(pattern)
    except (ecmascript.Invalid, RecursionError):
        return None


def standalone(jdk: str) -> bool:
    """True when the pattern keeps its meaning inside a larger alternation:
    back-references do not."""
    return re.search(r"\\[1-9]", jdk) is None


def any_of(patterns: list[str], flags: str = "(?i)") -> str:
    return flags + "|".join(f"(?:{p})" for p in patterns)


def opening_letters(openings: list[str]) -> str:
    """Look-ahead that only passes where each next letter is the like-placed
    letter of some opening, in either case (a blank is white space). A cheap necessary test that spares
    an alternation from being tried at every position."""
    places = zip(*({o.lower() for o in openings}))
    classes = ("".join(sorted({c for x in place for c in (x, x.upper())})) for place in places)
    quoted = (re.sub(r"([^0-9A-Za-z ])", r"\\\1", c).replace(" ", WS_CHARS) for c in classes)
    return "(?=" + "".join(f"[{c}]" for c in quoted) + ")"


def shown(pattern: str) -> str:
    """The pattern as a reason quotes it: slashes outside brackets escaped."""
    out, in_class = [], False
    for piece in re.findall(r"\\.|.", pattern, re.DOTALL):
        in_class = (in_class or piece == "[") and piece != "]"
        out.append({"\n": r"\n"}.get(piece, r"\/" if piece == "/" and not in_class else piece))
    return "".join(out) or "(?:)"


def needed(pattern: str) -> list[str]:
    """Lower-case strings one of which every match contains; none when unknown."""
    try:
        return list(ecmascript.needed(pattern))
    except (ecmascript.Invalid, RecursionError):
        return []


COMPILED_RULE = T.StructType([T.StructField("shown", T.StringType()), T.StructField("jdk", T.StringType()), T.StructField("needed", T.ArrayType(T.StringType()))])


@F.pandas_udf(COMPILED_RULE)
def compiled_rule(patterns: pd.Series) -> pd.DataFrame:
    """(shown, jdk, needed) of each pattern; jdk is null when it is not valid. Meant
    for rule tables, never for message rows."""
    return pd.DataFrame({"shown": patterns.map(shown), "jdk": patterns.map(to_jdk), "needed": patterns.map(needed)})


def hits(text: Column, jdk_pattern: Column) -> Column:
    """Case-insensitive test against a pattern held in a column. regexp_instr
    keeps its last compiled pattern, unlike rlike, so runs of rows with the
    same pattern compile it once."""
    return F.regexp_instr(text, F.concat(F.lit("(?i)"), jdk_pattern)) > 0
