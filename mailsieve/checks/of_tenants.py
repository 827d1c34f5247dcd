"""Views, counts and gates with each connection's own policy."""

from __future__ import annotations

from mailsieve.checks.corpus import MAIL_SQL, mail, raw_policies
from mailsieve.checks.of_policy import _NAME, _TENANT_SQL
from mailsieve.checks.oracle import domain_hit, sql_list
from mailsieve.checks.registry import SQL, check
from mailsieve.operators import threads
from mailsieve.operators.blocklist import with_verdict
from mailsieve.operators.rule_index import custom_hits, indexed_policies
from mailsieve.operators.tenants import decode_policies, join_policies
from mailsieve.plans import gateway, views
from mailsieve.rules import FINANCIAL_DOMAINS
from pyspark.sql import functions as F

_FROM = f"CASE WHEN email_on THEN {_NAME.format('from_name')} ELSE concat(from_name, ' <', from_email, '>') END"
_TO = f"CASE WHEN email_on THEN {_NAME.format('to_name')} ELSE concat(to_name, ' <', to_email, '>') END"


def _run(spark, sf_dir):
    return gateway.tenant_run(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)))


@check("b17_tenants", f"""WITH {_TENANT_SQL} SELECT id, {_FROM} AS "from", date FROM v WHERE reason IS NULL""")
def b17(spark, sf_dir):
    df, policy = _run(spark, sf_dir)
    return views.search_view(df.filter("action = 'pass'"), policy).select("id", "from", "date")


@check(
    "b20_tenants",
    f"""WITH {_TENANT_SQL} SELECT id AS message_id, CASE WHEN reason IS NOT NULL THEN 'blocked' END AS error, reason,
    CASE WHEN reason IS NULL THEN {_FROM} END AS "from", CASE WHEN reason IS NULL THEN {_TO} END AS "to" FROM v""",
)
def b20(spark, sf_dir):
    df, policy = _run(spark, sf_dir)
    return views.read_view(df, policy).select("message_id", "error", "reason", "from", F.array_join("to", ",").alias("to"))


@check(
    "c11_tenants",
    f"""WITH {_TENANT_SQL}, d AS (SELECT connection_id, thread_id, concat(CASE WHEN financial_blocking THEN 'y' ELSE 'n' END) AS fin,
      [split_part(lower(from_email), '@', 2), split_part(lower(to_email), '@', 2)] AS doms, blocked_domains, financial_blocking FROM t)
    SELECT connection_id, thread_id, bool_and(len(list_filter(doms, lambda x: NOT ((financial_blocking AND {domain_hit('x', sql_list(FINANCIAL_DOMAINS))}) OR {domain_hit('x', 'blocked_domains')}))) = 0) AS thread_blocked
    FROM d GROUP BY connection_id, thread_id""",
)
def c11(spark, sf_dir):
    joined, policy = join_policies(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)))
    return threads.blocked_threads(joined, policy)


@check(
    "e3_tenants",
    f"""WITH {_TENANT_SQL} SELECT connection_id, CASE WHEN count(reason) > 0 THEN count(reason) END AS filtered_count FROM v GROUP BY connection_id""",
)
def e3(spark, sf_dir):
    joined, policy = join_policies(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)))
    return gateway.filtered_count(with_verdict(joined, policy), policy.show_filtered_count, ["connection_id"])


def _many_rules(spark, sf_dir):
    """200 sender and 200 subject rules for every connection; each third one has no needed string."""
    policies = decode_policies(raw_policies(spark, sf_dir))
    places = F.sequence(F.lit(1), F.lit(200))
    senders = F.transform(places, lambda i: F.when(i % 3 == 0, F.concat(F.lit("^u.{3}"), i, F.lit("@"))).otherwise(F.concat(F.lit("user"), (i * 7) % 31, F.lit("@(EXAMPLE|sample)[.]com"))))
    subjects = F.transform(places, lambda i: F.when(i % 3 == 0, F.concat(F.lit("^[a-t].{4} "), i % 5, F.lit("$"))).otherwise(F.concat(F.lit("topic "), (i * 11) % 23 + 4, F.lit("$|no such thing"))))
    return policies.withColumns({"blocked_sender_patterns": senders, "blocked_subject_patterns": subjects})


def _many_sql(columns: str) -> str:
    sender, subject = "lower(from_email)", "lower(subject)"
    first = lambda text, every, other: f"list_min(list_filter(range(1, 201), lambda i: CASE WHEN i % 3 = 0 THEN regexp_matches({text}, {every}) ELSE regexp_matches({text}, {other}) END))"
    s_every, s_other = "'^u.{3}' || i || '@'", "'user' || (i * 7) % 31 || '@(example|sample)[.]com'"
    t_every, t_other = "'^[a-t].{4} ' || i % 5 || '$'", "'topic ' || ((i * 11) % 23 + 4) || '$|no such thing'"
    shown_s = "CASE WHEN s % 3 = 0 THEN '^u.{3}' || s || '@' ELSE 'user' || (s * 7) % 31 || '@(EXAMPLE|sample)[.]com' END"
    shown_t = "CASE WHEN b % 3 = 0 THEN '^[a-t].{4} ' || b % 5 || '$' ELSE 'topic ' || ((b * 11) % 23 + 4) || '$|no such thing' END"
    return f"""WITH {MAIL_SQL}, o AS (SELECT DISTINCT 'c' || c_custkey AS connection_id FROM customer),
      h AS (SELECT id, m.connection_id, from_email, subject, {first(sender, s_every, s_other)} AS s, {first(subject, t_every, t_other)} AS b FROM m JOIN o ON o.connection_id = m.connection_id)
      {columns.format(shown_s=shown_s, shown_t=shown_t)}"""


@check(
    "c8_rule_index",
    _many_sql("""SELECT DISTINCT connection_id, 'blocked_sender_patterns' AS list, lower(from_email) AS text, {shown_s} AS shown FROM h WHERE s IS NOT NULL
      UNION SELECT DISTINCT connection_id, 'blocked_subject_patterns', lower(subject), {shown_t} FROM h WHERE b IS NOT NULL"""),
)
def c8_index(spark, sf_dir):
    return custom_hits(mail(spark, sf_dir), _many_rules(spark, sf_dir))


@check("f4_indexed_rules", f"""WITH {_TENANT_SQL} SELECT id, connection_id, reason FROM v WHERE reason IS NOT NULL""")
def f4_indexed(spark, sf_dir):
    joined, policy = indexed_policies(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)))
    return with_verdict(joined, policy).filter("action = 'block'").select("id", "connection_id", "reason")


@check("e6_indexed_tenants", SQL["e6_process_tenants"])
def e6_indexed(spark, sf_dir):
    out = gateway.process_tenants(mail(spark, sf_dir), decode_policies(raw_policies(spark, sf_dir)), indexed=True)
    return out.select("id", "connection_id", "action", "reason", "body", "subject")
