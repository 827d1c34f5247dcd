"""Which messages and threads a policy blocks, and why.

Each rule kind has one cheap test over an alternation of all its patterns; the
ordered search for the rule that names the reason runs only on hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.address import domain_suffixes, sender_domain
from mailsieve.functions.regexes import any_of, hits, shown, standalone, to_jdk
from mailsieve.policy import Policy, PolicyColumns, guarded
from mailsieve.rules import FINANCIAL_DOMAINS, FINANCIAL_SUBJECTS, SECURITY_SUBJECTS, SENSITIVE_SENDERS

NOT_IN_FOLDER = "Folder not in allowed list"
DOMAIN_REASON = "Blocked sender domain: "
SENDER_REASON = "Blocked sender pattern: "
SUBJECT_REASON = "Blocked subject pattern: "


def _none() -> Column:
    return F.lit(None).cast("string")


def folder_reason(labels: Column, policy) -> Column:
    """Set when the policy names folders and no label is one of them."""
    if isinstance(policy, Policy):
        if not policy.allowed_folders:
            return _none()
        allowed = [f.lower() for f in policy.allowed_folders]
        inside = F.exists(labels, lambda label: F.lower(label).isin(allowed))
        return F.when(~F.coalesce(inside, F.lit(False)), F.lit(NOT_IN_FOLDER))
    allowed = F.transform(policy.allowed_folders, F.lower)
    inside = F.exists(labels, lambda label: F.array_contains(allowed, F.lower(label)))
    gated = F.size(policy.allowed_folders) > 0
    return F.when(gated & ~F.coalesce(inside, F.lit(False)), F.lit(NOT_IN_FOLDER))


def domain_blocked(domain: Column, policy) -> Column:
    """Equal to, or below, a blocked domain. Custom entries count as written."""
    suffixes = domain_suffixes(domain)
    financial = F.exists(suffixes, lambda s: s.isin(FINANCIAL_DOMAINS))
    if isinstance(policy, Policy):
        listed = (FINANCIAL_DOMAINS if policy.financial_blocking else []) + list(policy.blocked_domains)
        return F.exists(suffixes, lambda s: s.isin(listed)) if listed else F.lit(False)
    return (policy.financial_blocking & financial) | F.arrays_overlap(suffixes, policy.blocked_domains)


def domain_reason(email: Column, policy) -> Column:
    domain = sender_domain(email)
    return F.when(domain_blocked(domain, policy), F.concat(F.lit(DOMAIN_REASON), domain))


def first_hit(text: Column, patterns: list[str], prefix: str) -> Column:
    """Reason of the first pattern, in list order, that the text matches.
    Patterns that are not valid are left out."""
    valid = [(shown(p), jdk) for p in patterns if (jdk := to_jdk(p)) is not None]
    if not valid:
        return _none()
    ordered = F.coalesce(*(F.when(text.rlike("(?i)" + jdk), F.lit(prefix + src)) for src, jdk in valid))
    if not all(standalone(jdk) for _, jdk in valid):
        return ordered
    return F.when(text.rlike(any_of([jdk for _, jdk in valid])), ordered)


def first_custom_hit(text: Column, rules: Column, prefix: str) -> Column:
    """The same over a compiled rule column: struct<any, rules<shown, jdk>>.
    `any` is null when the rules cannot share one alternation."""
    found = F.get(F.filter(rules["rules"], lambda r: hits(text, r["jdk"])), F.lit(0))
    worth = F.when(rules["any"].isNull(), F.size(rules["rules"]) > 0).otherwise(hits(text, rules["any"]))
    return F.when(worth, F.concat(F.lit(prefix), found["shown"]))


def _custom(text: Column, policy: PolicyColumns, rules: str, hit: str, prefix: str) -> Column:
    if policy.judged:
        return F.concat(F.lit(prefix), policy.col(hit))
    return first_custom_hit(text, policy.col(rules), prefix)


def sender_reason(email: Column, policy) -> Column:
    sender = F.lower(email)
    if isinstance(policy, Policy):
        patterns = (SENSITIVE_SENDERS if policy.sensitive_sender_blocking else []) + list(
            policy.blocked_sender_patterns
        )
        return first_hit(sender, patterns, SENDER_REASON)
    return F.coalesce(
        F.when(policy.sensitive_sender_blocking, first_hit(sender, SENSITIVE_SENDERS, SENDER_REASON)),
        _custom(sender, policy, "blocked_sender_patterns", "sender_hit", SENDER_REASON),
    )


def subject_reason(subject: Column, policy) -> Column:
    text = F.lower(subject)
    if isinstance(policy, Policy):
        patterns = (
            (SECURITY_SUBJECTS if policy.security_blocking else [])
            + (FINANCIAL_SUBJECTS if policy.financial_blocking else [])
            + list(policy.blocked_subject_patterns)
        )
        return first_hit(text, patterns, SUBJECT_REASON)
    return F.coalesce(
        F.when(policy.security_blocking, first_hit(text, SECURITY_SUBJECTS, SUBJECT_REASON)),
        F.when(policy.financial_blocking, first_hit(text, FINANCIAL_SUBJECTS, SUBJECT_REASON)),
        _custom(text, policy, "blocked_subject_patterns", "subject_hit", SUBJECT_REASON),
    )


def block_reason(policy: Policy | PolicyColumns, gate: bool = True) -> Column:
    """First reason in the order folder, domain, sender, subject; null when the
    message may pass. Reads columns `labels`, `from` and `subject`."""
    email = F.coalesce(F.col("from.email"), F.lit(""))
    reasons = [
        domain_reason(email, policy),
        sender_reason(email, policy),
        subject_reason(F.coalesce(F.col("subject"), F.lit("")), policy),
    ]
    return F.coalesce(*([folder_reason(F.col("labels"), policy)] if gate else []), *reasons)


def with_verdict(df: DataFrame, policy: Policy | PolicyColumns | None = None, gate: bool = True) -> DataFrame:
    """Adds `reason` and `action` (pass or block)."""
    judged = df.withColumn("reason", block_reason(policy or Policy(), gate))
    return judged.withColumn("action", F.when(F.col("reason").isNull(), "pass").otherwise("block"))


def reason_class(reason: Column) -> Column:
    """The reason without the rule it quotes."""
    return F.regexp_extract(reason, r"^([^:]*)", 1)


def blocked_by_class(df: DataFrame, policy: Policy | None = None) -> DataFrame:
    judged = with_verdict(df, policy).filter("action = 'block'")
    return judged.groupBy(reason_class(F.col("reason")).alias("reason_class")).agg(
        F.count("*").alias("n_blocked")
    )


def thread_blocked(participants: Column, policy) -> Column:
    """True when there are participants and every one is on a blocked domain."""
    each = F.forall(participants, lambda p: domain_blocked(sender_domain(p["email"]), policy))
    return (F.size(participants) > 0) & each


def domains_in_table(df: DataFrame, domains: DataFrame) -> DataFrame:
    """Messages whose sender domain is, or lies below, a row of `domains`
    (column `domain`): the form for lists too long to write into a plan.
    Exploding suffixes gives an equality join, so any join strategy works.

    Only distinct sender domains are exploded and tested, so one busy sender
    weighs no more than a quiet one in the first join."""
    judged = df.withColumn("_domain", sender_domain(F.coalesce(F.col("from.email"), F.lit(""))))
    known = judged.select("_domain").distinct()
    listed = (
        known.select("_domain", F.explode(domain_suffixes(F.col("_domain"))).alias("domain"))
        .join(domains.select("domain").distinct(), "domain", "left_semi")
        .select("_domain")
        .distinct()
    )
    return judged.join(listed, "_domain", "left_semi").drop("_domain")

