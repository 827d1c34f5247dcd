"""The policy run over all mail: blocking, cleaning, counting, per tenant."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from mailsieve.checks.corpus import MAIL_SQL, RAW_POLICIES_SQL, mail, raw_policies, table
from mailsieve.checks.oracle import labels, pii, q, strip, verdict, warned
from mailsieve.checks.registry import check
from mailsieve.operators import blocklist as bl
from mailsieve.operators import rules_table
from mailsieve.operators.tenants import (
    compile_policies,
    decode_policies,
    encode_policies,
    invalid_rules,
    join_policies,
    validate_policies,
)
from mailsieve.plans import gateway
from mailsieve.plans.views import read_view
from mailsieve.policy import Policy
from mailsieve.rules import FINANCIAL_DOMAINS, FINANCIAL_SUBJECTS, SECURITY_SUBJECTS, SENSITIVE_SENDERS


def _verdict(name: str, policy: Policy, case: str, gate: bool = True) -> None:
    sql = f"""WITH {MAIL_SQL}, v AS (SELECT id, {case} AS reason FROM m)
    SELECT id, CASE WHEN reason IS NULL THEN 'pass' ELSE 'block' END AS action, reason FROM v"""

    @check(name, sql)
    def run(spark, sf_dir):
        return bl.with_verdict(mail(spark, sf_dir), policy, gate).select("id", "action", "reason")


_verdict(
    "c1_folder_gate",
    Policy(allowed_folders=("inbox", "Sent"), security_blocking=False, financial_blocking=False, sensitive_sender_blocking=False),
    verdict("false", "false", "false", folders="['inbox', 'sent']"),
)
_verdict(
    "c2_domain_block",
    Policy(security_blocking=False, sensitive_sender_blocking=False, blocked_domains=("notchase.com", "Example.com")),
    verdict("false", "true", "false", domains="['notchase.com', 'Example.com']"),
)
_verdict(
    "c3_sender_block",
    Policy(security_blocking=False, financial_blocking=False, blocked_sender_patterns=("user1[0-3]@", "a/b")),
    verdict(
        "false",
        "false",
        "true",
        senders="WHEN regexp_matches(lower(from_email), 'user1[0-3]@', 'i') THEN 'Blocked sender pattern: user1[0-3]@'",
    ),
)
_verdict(
    "c4_security_subjects",
    Policy(financial_blocking=False, sensitive_sender_blocking=False),
    verdict("true", "false", "false"),
)
_verdict(
    "c5_financial_subjects",
    Policy(security_blocking=False, sensitive_sender_blocking=False),
    verdict("false", "true", "false"),
)
_verdict("c6_blocklist_verdict", Policy(), verdict())
_verdict(
    "c7_all_categories_off",
    Policy(security_blocking=False, financial_blocking=False, sensitive_sender_blocking=False),
    verdict("false", "false", "false"),
)
_verdict(
    "c8_custom_rules",
    Policy(
        security_blocking=False,
        financial_blocking=False,
        sensitive_sender_blocking=False,
        blocked_domains=("chase.com",),
        blocked_sender_patterns=("^sales@",),
        blocked_subject_patterns=("topic 1$", "(bad", "^re: "),
    ),
    verdict(
        "false",
        "false",
        "false",
        domains="['chase.com']",
        senders="WHEN regexp_matches(lower(from_email), '^sales@', 'i') THEN 'Blocked sender pattern: ^sales@'",
        subjects="WHEN regexp_matches(lower(subject), 'topic 1$', 'i') THEN 'Blocked subject pattern: topic 1$' "
        "WHEN regexp_matches(lower(subject), '^re: ', 'i') THEN 'Blocked subject pattern: ^re: '",
    ),
)

_POLICY_LISTS = """CAST(json(blocked_domains_json) AS VARCHAR[]) AS blocked_domains,
  CAST(json(blocked_sender_patterns_json) AS VARCHAR[]) AS blocked_sender_patterns,
  CAST(json(blocked_subject_patterns_json) AS VARCHAR[]) AS blocked_subject_patterns,
  CAST(json(allowed_folders_json) AS VARCHAR[]) AS allowed_folders"""


@check(
    "c9_invalid_rules",
    f"""WITH {RAW_POLICIES_SQL}, p AS (SELECT connection_id, {_POLICY_LISTS} FROM raw_policies),
    r AS (SELECT connection_id, unnest(blocked_subject_patterns) AS pattern FROM p)
    SELECT connection_id, 'blocked_subject_patterns' AS list, pattern,
    concat('Invalid regex pattern in blocked_subject_patterns: ', pattern) AS message FROM r WHERE pattern = '(bad'""",
)
def c9(spark, sf_dir):
    return invalid_rules(decode_policies(raw_policies(spark, sf_dir))).select(
        "connection_id", "list", "pattern", "message"
    )


@check(
    "c10_validate_policies",
    """WITH p AS (SELECT concat('c', CAST(doc_id AS VARCHAR)) AS connection_id, text, doc_id FROM documents)
    SELECT connection_id, CASE WHEN length(text) > 500 THEN 'blocked_domains must be an array of strings (max 500 chars each)'
      WHEN doc_id % 9 = 0 THEN 'blocked_sender_patterns must have at most 200 entries'
      WHEN doc_id % 4 = 0 THEN 'Invalid regex pattern in blocked_subject_patterns: [a' END AS error FROM p""",
)
def c10(spark, sf_dir):
    many = F.array_repeat(F.lit("x"), F.when(F.col("doc_id") % 9 == 0, 201).otherwise(200))
    policies = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("connection_id"),
        F.array("text").alias("blocked_domains"),
        many.alias("blocked_sender_patterns"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("ok"), F.lit("[a"), F.lit("(b")))
        .otherwise(F.array(F.lit("ok")))
        .alias("blocked_subject_patterns"),
        F.array(F.lit("inbox")).alias("allowed_folders"),
    )
    return validate_policies(policies).select("connection_id", "error")


@check(
    "a5_read_policies",
    f"""WITH {RAW_POLICIES_SQL} SELECT connection_id, blocked_domains_json, blocked_sender_patterns_json,
    blocked_subject_patterns_json, allowed_folders_json, pii_redaction_enabled = 1 AS pii_redaction,
    injection_detection_enabled = 1 AS injection_detection, email_redaction_enabled = 1 AS email_redaction,
    true AS show_filtered_count, security_blocking_enabled = 1 AS security_blocking,
    financial_blocking_enabled = 1 AS financial_blocking, sensitive_sender_blocking_enabled = 1 AS sensitive_sender_blocking,
    dollar_amount_redaction_enabled = 1 AS dollar_amount_redaction, true AS attachment_filtering FROM raw_policies""",
)
def a5(spark, sf_dir):
    typed = decode_policies(raw_policies(spark, sf_dir))
    stored = encode_policies(typed).select("connection_id", *(f"{n}_json" for n in ("blocked_domains", "blocked_sender_patterns", "blocked_subject_patterns", "allowed_folders")))
    flags = typed.drop("blocked_domains", "blocked_sender_patterns", "blocked_subject_patterns", "allowed_folders")
    return flags.join(stored, "connection_id")


# --- the whole run ---------------------------------------------------------
_STRIPPED = f"s AS (SELECT m.*, {strip('body')} AS b1, {strip('subject')} AS s1, {strip('snippet')} AS n1 FROM m)"
_REDACTED = f"r AS (SELECT s.*, {pii('b1')} AS b2, {pii('s1')} AS s2, {pii('n1')} AS n2 FROM s)"
_FLAGGED = f"f AS (SELECT r.*, {labels('concat(s2, chr(10), b2)')} AS found FROM r)"
RUN_SQL = f"""{MAIL_SQL}, {_STRIPPED}, {_REDACTED}, {_FLAGGED},
  v AS (SELECT f.*, {verdict()} AS reason FROM f),
  e AS (SELECT id, uid, thread_id, connection_id, reason, CASE WHEN reason IS NULL THEN 'pass' ELSE 'block' END AS action,
    CASE WHEN reason IS NULL THEN {warned('b2', 'found')} ELSE body END AS body,
    CASE WHEN reason IS NULL THEN s2 ELSE subject END AS subject,
    CASE WHEN reason IS NULL THEN n2 ELSE snippet END AS snippet,
    CASE WHEN reason IS NULL THEN 0 ELSE n_attachments END AS n_attachments,
    reason IS NULL AND (b1 <> b2 OR s1 <> s2 OR n1 <> n2) AS pii_redacted,
    CASE WHEN reason IS NULL THEN found ELSE '' END AS found,
    from_name, from_email, to_name, to_email, cc_email, date, labels, is_unread FROM v)"""
_RUN_COLUMNS = "id, action, reason, body, subject, snippet, CAST(n_attachments AS INTEGER) AS n_attachments, pii_redacted, found"


def _run_columns(df):
    return df.select(
        "id",
        "action",
        "reason",
        "body",
        "subject",
        "snippet",
        F.size("attachments").alias("n_attachments"),
        "pii_redacted",
        F.array_join("injection_labels", ", ").alias("found"),
    )


@check("e1_process", f"WITH {RUN_SQL} SELECT {_RUN_COLUMNS} FROM e")
def e1(spark, sf_dir):
    return _run_columns(gateway.process(mail(spark, sf_dir)))


@check(
    "e1_audit_action",
    f"""WITH {RUN_SQL} SELECT id, CASE WHEN action = 'block' THEN 'block' WHEN pii_redacted OR found <> '' THEN 'redact' ELSE 'pass' END AS audit_action,
    CASE WHEN action = 'block' THEN reason WHEN found <> '' THEN concat('Injection patterns detected: ', found)
    WHEN pii_redacted THEN 'PII patterns redacted' END AS audit_reason FROM e""",
)
def e1_audit(spark, sf_dir):
    return gateway.final_action(gateway.process(mail(spark, sf_dir))).select("id", "audit_action", "audit_reason")


@check("e2_passed", f"WITH {RUN_SQL} SELECT id, body, subject, snippet FROM e WHERE action = 'pass'")
def e2_passed(spark, sf_dir):
    return gateway.passed(mail(spark, sf_dir)).select("id", "body", "subject", "snippet")


@check("e2_blocked", f"WITH {RUN_SQL} SELECT id, body, subject, snippet, reason FROM e WHERE action = 'block'")
def e2_blocked(spark, sf_dir):
    return gateway.blocked(mail(spark, sf_dir)).select("id", "body", "subject", "snippet", "reason")


@check(
    "e3_filtered_count",
    f"""WITH {RUN_SQL} SELECT thread_id, CASE WHEN count(*) FILTER (action = 'block') > 0
    THEN count(*) FILTER (action = 'block') END AS filtered_count FROM e GROUP BY thread_id""",
)
def e3(spark, sf_dir):
    return gateway.filtered_count(bl.with_verdict(mail(spark, sf_dir)), True, ["thread_id"])


_NAME = "CASE WHEN trim({0}) = '' OR regexp_matches(trim({0}), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') THEN '[Name Unavailable]' ELSE trim({0}) END"


@check(
    "e4_read_messages",
    f"""WITH {RUN_SQL} SELECT id AS message_id, CASE WHEN action = 'block' THEN 'blocked' END AS error, reason,
    CASE WHEN action = 'pass' THEN subject END AS subject, CASE WHEN action = 'pass' THEN {_NAME.format('from_name')} END AS "from",
    CASE WHEN action = 'pass' THEN {_NAME.format('to_name')} END AS "to",
    CASE WHEN action = 'pass' THEN CASE WHEN cc_email IS NULL THEN '' ELSE '[Name Unavailable]' END END AS cc,
    CASE WHEN action = 'pass' THEN date END AS date, CASE WHEN action = 'pass' THEN body END AS body,
    CASE WHEN action = 'pass' THEN array_to_string(labels, ',') END AS labels,
    CASE WHEN action = 'pass' THEN is_unread END AS is_unread FROM e""",
)
def e4(spark, sf_dir):
    shown = read_view(gateway.process(mail(spark, sf_dir)))
    return shown.select(
        "message_id", "error", "reason", "subject", "from", F.array_join("to", ",").alias("to"),
        F.array_join("cc", ",").alias("cc"), "date", "body", F.array_join("labels", ",").alias("labels"), "is_unread",
    )


@F.pandas_udf(gateway.STAGE_RESULT)
def _shout(subject: pd.Series, body: pd.Series, snippet: pd.Series) -> pd.DataFrame:
    """A user stage: blocks one topic and marks the others' subjects."""
    blocked = subject == "Topic 3"
    return pd.DataFrame(
        {
            "action": blocked.map({True: "block", False: "redact"}),
            "reason": blocked.map({True: "Topic 3 is private", False: None}),
            "body": body,
            "subject": "[x] " + subject,
            "snippet": snippet,
        }
    )


@check(
    "e5_user_stages",
    f"""WITH {RUN_SQL} SELECT id, CASE WHEN action = 'pass' AND (subject = 'Topic 3' OR subject = 'Topic 5') THEN 'block' ELSE action END AS action,
    CASE WHEN action = 'pass' AND subject = 'Topic 3' THEN 'Topic 3 is private' WHEN action = 'pass' AND subject = 'Topic 5' THEN 'Blocked' ELSE reason END AS reason,
    CASE WHEN action = 'pass' AND subject NOT IN ('Topic 3', 'Topic 5') THEN concat('[x] ', subject, ' (seen)') ELSE subject END AS subject FROM e""",
)
def e5(spark, sf_dir):
    def seen(df):
        return df.withColumn("subject", F.concat("subject", F.lit(" (seen)")))

    stages = [gateway.UdfStage(_shout), gateway.ColumnStage(block=F.col("subject") == "[x] Topic 5"), seen]
    return gateway.process(mail(spark, sf_dir), stages=stages).select("id", "action", "reason", "subject")


_TENANT_CASE = verdict(
    "security_blocking",
    "financial_blocking",
    "sensitive_sender_blocking",
    domains="blocked_domains",
    folders="list_transform(allowed_folders, lambda af: lower(af))",
    senders="""WHEN kind = 1 AND regexp_matches(lower(from_email), '^sales@') THEN 'Blocked sender pattern: ^sales@'
      WHEN kind = 1 AND regexp_matches(lower(from_email), 'user1[0-3]@') THEN 'Blocked sender pattern: user1[0-3]@'""",
    subjects="""WHEN kind = 1 AND contains(lower(subject), 'topic 1') THEN 'Blocked subject pattern: topic 1'
      WHEN kind = 1 AND regexp_matches(lower(subject), 'plan$') THEN 'Blocked subject pattern: plan$'
      WHEN kind = 2 AND regexp_matches(lower(subject), 'topic [2-4]') THEN 'Blocked subject pattern: topic [2-4]'""",
)
_TENANT_SQL = f"""{MAIL_SQL}, {RAW_POLICIES_SQL}, p AS (SELECT connection_id AS c, {_POLICY_LISTS},
  pii_redaction_enabled = 1 AS pii_on, injection_detection_enabled = 1 AS injection_on, email_redaction_enabled = 1 AS email_on,
  dollar_amount_redaction_enabled = 1 AS dollar_on, security_blocking_enabled = 1 AS sec, financial_blocking_enabled = 1 AS fin,
  sensitive_sender_blocking_enabled = 1 AS sens FROM raw_policies),
  t AS (SELECT m.*, coalesce(p.blocked_domains, []) AS blocked_domains, coalesce(p.allowed_folders, []) AS allowed_folders,
    coalesce(pii_on, true) AS pii_on, coalesce(injection_on, true) AS injection_on, coalesce(email_on, true) AS email_on,
    coalesce(dollar_on, true) AS dollar_on, coalesce(sec, true) AS security_blocking, coalesce(fin, true) AS financial_blocking,
    coalesce(sens, true) AS sensitive_sender_blocking,
    CASE WHEN p.c IS NULL THEN 0 ELSE CAST(substr(connection_id, 2) AS BIGINT) % 3 END AS kind
    FROM m LEFT JOIN p ON m.connection_id = p.c),
  v AS (SELECT t.*, {_TENANT_CASE} AS reason FROM t)"""


@check(
    "e6_process_tenants",
    f"""WITH {_TENANT_SQL}, s AS (SELECT v.*, {strip('body')} AS b1, {strip('subject')} AS s1 FROM v),
    r AS (SELECT s.*, {pii('b1', 'email_on', 'dollar_on', 'pii_on')} AS b2, {pii('s1', 'email_on', 'dollar_on', 'pii_on')} AS s2 FROM s),
    f AS (SELECT r.*, CASE WHEN injection_on THEN {labels('concat(s2, chr(10), b2)')} ELSE '' END AS found FROM r)
    SELECT id, connection_id, CASE WHEN reason IS NULL THEN 'pass' ELSE 'block' END AS action, reason,
    CASE WHEN reason IS NULL THEN {warned('b2', 'found')} ELSE body END AS body,
    CASE WHEN reason IS NULL THEN s2 ELSE subject END AS subject FROM f""",
)
def e6(spark, sf_dir):
    out = gateway.process_tenants(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)))
    return out.select("id", "connection_id", "action", "reason", "body", "subject")


@check(
    "f4_rules_join",
    f"""WITH {_TENANT_SQL} SELECT id, connection_id, reason FROM v WHERE reason IS NOT NULL""",
)
def f4(spark, sf_dir):
    joined, policy = join_policies(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)))
    return bl.with_verdict(joined, policy).filter("action = 'block'").select("id", "connection_id", "reason")


@check(
    "g9_blocked_by_class",
    f"""WITH {RUN_SQL} SELECT split_part(reason, ':', 1) AS reason_class, count(*) AS n_blocked FROM e
    WHERE action = 'block' GROUP BY ALL""",
)
def g9(spark, sf_dir):
    return bl.blocked_by_class(mail(spark, sf_dir))


_DOMAIN = "split_part(lower(from_email), '@', 2)"


@check(
    "f7_domain_table_join",
    f"""WITH {MAIL_SQL}, d AS (SELECT DISTINCT split_part(url, '/', 3) AS domain FROM pages UNION SELECT 'chase.com')
    SELECT id, from_email FROM m WHERE EXISTS (SELECT 1 FROM d WHERE {_DOMAIN} = domain OR suffix({_DOMAIN}, concat('.', domain)))""",
)
def f7(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), F.lit(2)).alias("domain"))
    listed = hosts.union(spark.range(1).select(F.lit("chase.com")))
    return bl.domains_in_table(mail(spark, sf_dir), listed).select("id", F.col("from.email").alias("from_email"))


def _rule_values(kind: str, flag: str, rules: list[str], at: int) -> str:
    rows = ", ".join(f"({i + at}, {q(r)})" for i, r in enumerate(rules))
    return (
        f"SELECT connection_id, '{kind}' AS kind, CAST(pos AS INTEGER) AS position, rule FROM raw_policies, "
        f"(VALUES {rows}) AS d(pos, rule) WHERE {flag} = 1"
    )


def _custom_values(kind: str, column: str, at: str) -> str:
    return (
        f"SELECT connection_id, '{kind}', CAST({at} + unnest(range(len(CAST(json({column}) AS VARCHAR[])))) AS INTEGER), "
        f"unnest(CAST(json({column}) AS VARCHAR[])) FROM raw_policies"
    )


_SEC, _FIN = len(SECURITY_SUBJECTS), len(FINANCIAL_SUBJECTS)


@check(
    "h1_rule_set",
    f"""WITH {RAW_POLICIES_SQL}, r AS ({_rule_values('domain', 'financial_blocking_enabled', FINANCIAL_DOMAINS, 0)}
    UNION ALL {_custom_values('domain', 'blocked_domains_json', f'{len(FINANCIAL_DOMAINS)} * financial_blocking_enabled')}
    UNION ALL {_rule_values('sender', 'sensitive_sender_blocking_enabled', SENSITIVE_SENDERS, 0)}
    UNION ALL {_custom_values('sender', 'blocked_sender_patterns_json', f'{len(SENSITIVE_SENDERS)} * sensitive_sender_blocking_enabled')}
    UNION ALL {_rule_values('subject', 'security_blocking_enabled', SECURITY_SUBJECTS, 0)}
    UNION ALL SELECT connection_id, kind, CAST(position - {_SEC} * (1 - security_blocking_enabled) AS INTEGER), rule FROM
      ({_rule_values('subject', 'financial_blocking_enabled', FINANCIAL_SUBJECTS, _SEC)}) JOIN raw_policies USING (connection_id)
    UNION ALL {_custom_values('subject', 'blocked_subject_patterns_json', f'{_SEC} * security_blocking_enabled + {_FIN} * financial_blocking_enabled')})
    SELECT kind, rule, count(*) AS n_connections, CAST(sum(position) AS BIGINT) AS sum_position FROM r GROUP BY kind, rule""",
)
def h1(spark, sf_dir):
    rows = rules_table.rule_set(decode_policies(raw_policies(spark, sf_dir)))
    return rows.groupBy("kind", "rule").agg(
        F.count("*").alias("n_connections"), F.sum("position").alias("sum_position")
    )


@check(
    "g11_compiled_rules",
    f"""WITH {RAW_POLICIES_SQL} SELECT connection_id,
    CAST(CASE CAST(substr(connection_id, 2) AS BIGINT) % 3 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS n_sender_rules,
    CAST(CASE CAST(substr(connection_id, 2) AS BIGINT) % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS n_subject_rules FROM raw_policies""",
)
def g11(spark, sf_dir):
    done = compile_policies(decode_policies(raw_policies(spark, sf_dir)))
    return done.select(
        "connection_id",
        F.size("blocked_sender_patterns.rules").alias("n_sender_rules"),
        F.size("blocked_subject_patterns.rules").alias("n_subject_rules"),
    )
