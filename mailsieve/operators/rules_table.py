"""The rule set of every connection as rows, and messages against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.rules import FINANCIAL_DOMAINS, FINANCIAL_SUBJECTS, SECURITY_SUBJECTS, SENSITIVE_SENDERS

# kind -> (default rules with the switch each hangs on, custom column)
_KINDS = {
    "domain": ([("financial_blocking", FINANCIAL_DOMAINS)], "blocked_domains"),
    "sender": ([("sensitive_sender_blocking", SENSITIVE_SENDERS)], "blocked_sender_patterns"),
    "subject": (
        [("security_blocking", SECURITY_SUBJECTS), ("financial_blocking", FINANCIAL_SUBJECTS)],
        "blocked_subject_patterns",
    ),
}


def rule_set(policies: DataFrame) -> DataFrame:
    """connection_id, kind, position, rule: switched-on defaults, then custom
    rules. One explode over the policy table, no join."""
    parts = []
    for kind, (defaults, custom) in _KINDS.items():
        none = F.array().cast("array<string>")
        lists = [F.when(F.col(flag), F.array(*map(F.lit, rules))).otherwise(none) for flag, rules in defaults]
        lists.append(F.coalesce(F.col(custom), none))
        parts.append(
            policies.select(
                "connection_id",
                F.lit(kind).alias("kind"),
                F.posexplode(F.concat(*lists)).alias("position", "rule"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
