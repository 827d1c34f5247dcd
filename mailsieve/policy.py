"""The policy: which rules apply to a row.

`Policy` holds plain values and is used when one policy covers the whole frame.
When every connection has its own, `operators.tenants` joins the policy table
and hands the same attribute names over as columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE_LISTS = ("blocked_domains", "blocked_sender_patterns", "blocked_subject_patterns", "allowed_folders")
FLAGS = (
    "pii_redaction",
    "injection_detection",
    "email_redaction",
    "show_filtered_count",
    "security_blocking",
    "financial_blocking",
    "sensitive_sender_blocking",
    "dollar_amount_redaction",
    "attachment_filtering",
)
MAX_RULES = 200
MAX_RULE_CHARS = 500


@dataclass(frozen=True)
class Policy:
    blocked_domains: tuple[str, ...] = ()
    blocked_sender_patterns: tuple[str, ...] = ()
    blocked_subject_patterns: tuple[str, ...] = ()
    allowed_folders: tuple[str, ...] = ()
    pii_redaction: bool = True
    injection_detection: bool = True
    email_redaction: bool = True
    show_filtered_count: bool = True
    security_blocking: bool = True
    financial_blocking: bool = True
    sensitive_sender_blocking: bool = True
    dollar_amount_redaction: bool = True
    attachment_filtering: bool = True
    # Opening words of the note put in front of suspicious bodies.
    warning_prefix: str = field(default="CONTENT WARNING")


@dataclass(frozen=True)
class PolicyColumns:
    """A joined policy row: each flag is a boolean column, each rule list the
    array column that `operators.tenants.compile_policies` builds. Where custom rules
    are `judged` already, the row has the ones that were hit instead of the lists."""

    qualifier: str
    warning_prefix: str = "CONTENT WARNING"
    judged: bool = False

    def col(self, name: str) -> Column:
        return F.col(f"{self.qualifier}.{name}")

    def __getattr__(self, name: str) -> Column:
        if name in FLAGS or name in RULE_LISTS:
            return self.col(name)
        raise AttributeError(name)


def default_flags() -> dict[str, bool]:
    return {f.name: f.default for f in fields(Policy) if f.name in FLAGS}


def guarded(flag: bool | Column, on: Column, off: Column) -> Column:
    """`on` where the flag holds. A plain flag is settled while the plan is
    built, so a switched-off stage leaves nothing behind in it."""
    if isinstance(flag, Column):
        return F.when(flag, on).otherwise(off)
    return on if flag else off
