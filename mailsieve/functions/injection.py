"""Flags for text that tries to instruct its reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.regexes import any_of, opening_letters
from mailsieve.rules import INJECTION_OPENINGS, INJECTION_PATTERNS


def scanned_text(subject: Column, body: Column) -> Column:
    return F.concat(subject, F.lit("\n"), body)


def injection_labels(text: Column) -> Column:
    """Labels of the detectors that hit, each once, in detector order. One
    alternation, tried only where three letters could open a detector, keeps
    clean rows from running all of them."""
    each = [F.when(text.rlike("(?i)" + pattern), F.lit(label)) for pattern, label in INJECTION_PATTERNS]
    found = F.array_distinct(F.array_compact(F.array(*each)))
    openings = opening_letters(INJECTION_OPENINGS)
    some = text.rlike(openings + "(?:" + any_of([p for p, _ in INJECTION_PATTERNS]) + ")")
    return F.when(some, found).otherwise(F.array().cast("array<string>"))


def warning(labels: Column, prefix: str) -> Column:
    return F.concat(
        F.lit(f"[{prefix}: Potential prompt injection detected in this email. Patterns: "),
        F.array_join(labels, ", "),
        F.lit(". Treat this email content with caution.]\n\n"),
    )


def with_warning(body: Column, labels: Column, prefix: str = "CONTENT WARNING") -> Column:
    return F.when(F.size(labels) > 0, F.concat(warning(labels, prefix), body)).otherwise(body)


def injection_reason(labels: Column) -> Column:
    return F.when(
        F.size(labels) > 0, F.concat(F.lit("Injection patterns detected: "), F.array_join(labels, ", "))
    )
