"""Accounts, connections, keys, sessions and policies over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.checks.corpus import (
    ACCOUNTS_SQL,
    API_KEYS_SQL,
    CONNECTIONS_SQL,
    NOW_MS,
    RAW_POLICIES_SQL,
    SESSIONS_SQL,
    accounts,
    api_keys,
    connections,
    raw_key,
    raw_policies,
    sessions,
    table,
)
from mailsieve.checks.registry import check
from mailsieve.operators import tables as tb
from mailsieve.operators.tenants import backfill_policies, decode_policies, encode_policies
from mailsieve.sources.config import by_email, by_id


@check("a6_accounts_by_email", f"WITH {ACCOUNTS_SQL} SELECT * FROM accounts WHERE email = 'customer.000000007@example.com'")
def a6_email(spark, sf_dir):
    return by_email(accounts(spark, sf_dir), "customer.000000007@example.com")


@check("a6_connection_by_id", f"WITH {CONNECTIONS_SQL} SELECT id, account_id, status, created_at FROM connections WHERE id = 'c33'")
def a6_id(spark, sf_dir):
    return by_id(connections(spark, sf_dir), "c33").select("id", "account_id", "status", "created_at")


@check(
    "a6_connections_of",
    f"WITH {CONNECTIONS_SQL} SELECT id, created_at FROM connections WHERE account_id = '31'",
)
def a6_of(spark, sf_dir):
    return tb.connections_of(connections(spark, sf_dir), "31").select("id", "created_at")


@check(
    "h9_keys_newest_first",
    f"""WITH {API_KEYS_SQL} SELECT id, prefix, created_at FROM api_keys WHERE account_id = '31'""",
)
def h9(spark, sf_dir):
    return tb.keys_of(api_keys(spark, sf_dir), account_id="31").select("id", "prefix", "created_at")


@check(
    "f1_accounts_connections",
    f"""WITH {ACCOUNTS_SQL}, {CONNECTIONS_SQL} SELECT a.id AS account_id, a.email AS email, c.id AS connection_id, c.status AS status
    FROM accounts a LEFT JOIN connections c ON c.account_id = a.id""",
)
def f1(spark, sf_dir):
    joined = tb.accounts_with_connections(accounts(spark, sf_dir), connections(spark, sf_dir))
    return joined.select(
        F.col("a.id").alias("account_id"), F.col("a.email").alias("email"), F.col("c.id").alias("connection_id"), "c.status"
    )


@check(
    "g7_connection_counts",
    f"""WITH {ACCOUNTS_SQL}, {CONNECTIONS_SQL} SELECT a.id AS id, a.email AS email, a.name AS name, a.created_at AS created_at, count(c.id) AS connections
    FROM accounts a LEFT JOIN connections c ON c.account_id = a.id GROUP BY ALL""",
)
def g7(spark, sf_dir):
    return tb.connection_counts(accounts(spark, sf_dir), connections(spark, sf_dir))


@check(
    "g8_connection_states",
    f"""WITH {CONNECTIONS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
    count(*) FILTER (status <> 'active') AS issues FROM connections""",
)
def g8(spark, sf_dir):
    return tb.connection_states(connections(spark, sf_dir))


@check(
    "c18_connection_gate",
    f"""WITH {CONNECTIONS_SQL} SELECT id, CASE WHEN status <> 'active' THEN concat('Connection is ', status, '. Reconnect your email account to continue.') END AS error FROM connections""",
)
def c18(spark, sf_dir):
    return tb.gate_connections(connections(spark, sf_dir)).select("id", "error")


@check("c19_live_keys", f"WITH {API_KEYS_SQL} SELECT id FROM api_keys WHERE revoked_at IS NULL")
def c19_keys(spark, sf_dir):
    return tb.live_keys(api_keys(spark, sf_dir)).select("id")


@check("c19_live_sessions", f"WITH {SESSIONS_SQL} SELECT id FROM sessions WHERE expires_at > {NOW_MS}")
def c19_sessions(spark, sf_dir):
    return tb.live_sessions(sessions(spark, sf_dir), NOW_MS).select("id")


@check(
    "f2_resolve_requests",
    f"""WITH {API_KEYS_SQL}, {CONNECTIONS_SQL}, {RAW_POLICIES_SQL},
    r AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, concat('mk_', lpad(CAST((l_orderkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END) * 7919 AS VARCHAR), 12, '0')) AS api_key FROM lineitem),
    j AS (SELECT request_id, k.id AS key_id, k.connection_id, c.account_id, c.status, p.connection_id AS pc,
      coalesce(p.blocked_domains_json, '[]') AS domains, coalesce(p.security_blocking_enabled = 1, true) AS security_blocking
      FROM r LEFT JOIN (SELECT * FROM api_keys WHERE revoked_at IS NULL) k ON sha256(r.api_key) = k.key_hash
      LEFT JOIN connections c ON c.id = k.connection_id LEFT JOIN raw_policies p ON p.connection_id = k.connection_id)
    SELECT request_id, key_id, connection_id, account_id, replace(replace(replace(domains, '"', ''), '[', ''), ']', '') AS domains, security_blocking,
    CASE WHEN key_id IS NULL THEN 'Invalid API key' WHEN status <> 'active' THEN concat('Connection is ', status, '. Reconnect your email account to continue.') END AS error FROM j""",
)
def f2(spark, sf_dir):
    number = F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)
    asked = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), raw_key(number).alias("api_key")
    )
    out = tb.resolve_requests(asked, api_keys(spark, sf_dir), connections(spark, sf_dir), raw_policies(spark, sf_dir))
    return out.select(
        "request_id", "key_id", "connection_id", "account_id", F.array_join("blocked_domains", ",").alias("domains"), "security_blocking", "error"
    )


@check(
    "f5_owned_keys",
    f"""WITH {API_KEYS_SQL}, {CONNECTIONS_SQL}, k AS (SELECT * REPLACE (CASE WHEN id LIKE '%3' THEN '0' ELSE account_id END AS account_id) FROM api_keys)
    SELECT k.id FROM k WHERE EXISTS (SELECT 1 FROM connections c WHERE c.id = k.connection_id AND c.account_id = k.account_id)""",
)
def f5(spark, sf_dir):
    keys = api_keys(spark, sf_dir)
    keys = keys.withColumn("account_id", F.when(F.endswith("id", F.lit("3")), "0").otherwise(F.col("account_id")))
    return tb.owned_by(keys, connections(spark, sf_dir), "connection_id").select("id")


@check(
    "f6_cascade_delete",
    f"""WITH {API_KEYS_SQL}, {CONNECTIONS_SQL}, {RAW_POLICIES_SQL}, gone AS (SELECT id FROM connections WHERE status = 'revoked')
    SELECT id, 'key' AS kind FROM api_keys WHERE connection_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT connection_id, 'policy' FROM raw_policies WHERE connection_id NOT IN (SELECT id FROM gone)""",
)
def f6(spark, sf_dir):
    gone = connections(spark, sf_dir).filter("status = 'revoked'")
    keys = tb.without_parents(api_keys(spark, sf_dir), gone, "connection_id")
    policies = tb.without_parents(raw_policies(spark, sf_dir), gone, "connection_id")
    return keys.select("id", F.lit("key").alias("kind")).unionAll(
        policies.select(F.col("connection_id").alias("id"), F.lit("policy").alias("kind"))
    )


# --- rewrites --------------------------------------------------------------
@check(
    "i1_merge_policies",
    f"""WITH {RAW_POLICIES_SQL}, x AS (SELECT concat('c', CAST(s_suppkey * 20 AS VARCHAR)) AS connection_id, s_suppkey AS n FROM supplier)
    SELECT coalesce(p.connection_id, x.connection_id) AS connection_id,
    CASE WHEN x.n % 2 = 0 THEN '["new.com"]' ELSE coalesce(blocked_domains_json, '[]') END AS blocked_domains_json,
    CAST(CASE WHEN x.n % 3 = 0 THEN 0 ELSE coalesce(pii_redaction_enabled, 1) END AS INTEGER) AS pii_redaction_enabled,
    CAST(coalesce(financial_blocking_enabled, 1) AS INTEGER) AS financial_blocking_enabled
    FROM raw_policies p FULL JOIN x ON p.connection_id = x.connection_id""",
)
def i1(spark, sf_dir):
    n = F.col("s_suppkey")
    patches = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), (n * 20).cast("string")).alias("connection_id"),
        F.when(n % 2 == 0, F.array(F.lit("new.com"))).alias("blocked_domains"),
        F.when(n % 3 == 0, F.lit(False)).alias("pii_redaction"),
    )
    merged = encode_policies(tb.merge_policies(decode_policies(raw_policies(spark, sf_dir)), patches))
    return merged.select("connection_id", "blocked_domains_json", "pii_redaction_enabled", "financial_blocking_enabled")


@check(
    "i2_upsert_policies",
    f"""WITH {RAW_POLICIES_SQL}, x AS (SELECT concat('c', CAST(o_custkey * 2 AS VARCHAR)) AS connection_id, concat('["o', CAST(o_orderkey AS VARCHAR), '.com"]') AS d,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders), y AS (SELECT * FROM x WHERE n = 1)
    SELECT coalesce(y.connection_id, p.connection_id) AS connection_id, coalesce(y.d, p.blocked_domains_json) AS blocked_domains_json,
    CAST(CASE WHEN y.d IS NULL THEN p.pii_redaction_enabled ELSE 1 END AS INTEGER) AS pii_redaction_enabled
    FROM raw_policies p FULL JOIN y ON p.connection_id = y.connection_id""",
)
def i2(spark, sf_dir):
    columns = ["connection_id", "blocked_domains_json", "pii_redaction_enabled"]
    changes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") * 2).cast("string")).alias("connection_id"),
        F.concat(F.lit('["o'), F.col("o_orderkey").cast("string"), F.lit('.com"]')).alias("blocked_domains_json"),
        F.lit(1).alias("pii_redaction_enabled"),
        F.col("o_orderkey").alias("version"),
    )
    return tb.upsert(raw_policies(spark, sf_dir).select(*columns), changes, "connection_id", "version")


@check(
    "i3_upsert_accounts",
    f"""WITH {ACCOUNTS_SQL}, x AS (SELECT concat('n', id) AS id, CASE WHEN id LIKE '%5' THEN concat('new', id, '@example.com') ELSE email END AS email,
      concat(name, '!') AS name, 'pic' AS avatar_url, CASE WHEN id LIKE '%2' THEN 'fresh' END AS password_hash, created_at + 5 AS created_at, updated_at + 5 AS updated_at
      FROM accounts WHERE created_at % 10000 < 6000)
    SELECT coalesce(a.id, x.id) AS id, coalesce(a.email, x.email) AS email, CASE WHEN x.id IS NULL THEN a.name ELSE x.name END AS name,
    CASE WHEN x.id IS NULL THEN a.avatar_url ELSE x.avatar_url END AS avatar_url, coalesce(x.password_hash, a.password_hash) AS password_hash,
    coalesce(a.created_at, x.created_at) AS created_at, coalesce(x.updated_at, a.updated_at) AS updated_at
    FROM accounts a FULL JOIN x ON a.email = x.email""",
)
def i3(spark, sf_dir):
    current = accounts(spark, sf_dir)
    changes = current.filter("created_at % 10000 < 6000").select(
        F.concat(F.lit("n"), "id").alias("id"),
        F.when(F.endswith("id", F.lit("5")), F.concat(F.lit("new"), "id", F.lit("@example.com"))).otherwise(F.col("email")).alias("email"),
        F.concat("name", F.lit("!")).alias("name"),
        F.lit("pic").alias("avatar_url"),
        F.when(F.endswith("id", F.lit("2")), "fresh").alias("password_hash"),
        (F.col("created_at") + 5).alias("created_at"),
        (F.col("updated_at") + 5).alias("updated_at"),
    )
    return tb.upsert_accounts(current, changes)


@check(
    "i4_revoke_keys",
    f"""WITH {API_KEYS_SQL} SELECT id, CASE WHEN prefix = 'mk_00000' AND revoked_at IS NULL THEN {NOW_MS} ELSE revoked_at END AS revoked_at FROM api_keys""",
)
def i4(spark, sf_dir):
    return tb.revoke_keys(api_keys(spark, sf_dir), "mk_00000", NOW_MS).select("id", "revoked_at")


@check(
    "i4_revoked_count",
    f"WITH {API_KEYS_SQL} SELECT count(*) AS changes FROM api_keys WHERE prefix = 'mk_00000' AND revoked_at IS NULL",
)
def i4_count(spark, sf_dir):
    return tb.revoked_count(api_keys(spark, sf_dir), "mk_00000")


@check(
    "i5_add_rules",
    f"""WITH {RAW_POLICIES_SQL}, x AS (SELECT concat('c', CAST(c_custkey * 2 AS VARCHAR)) AS connection_id, c_custkey % 3 AS k FROM customer)
    SELECT coalesce(p.connection_id, x.connection_id) AS connection_id,
    concat('[', array_to_string(list_filter([CASE WHEN blocked_domains_json LIKE '%example%' THEN '"example.com","Notchase.com"' END,
      CASE WHEN x.k IS NULL OR (x.k <> 1 AND blocked_domains_json LIKE '%example%') THEN NULL WHEN x.k = 1 THEN '"a.org","b.org"' ELSE '"example.com"' END], lambda v: v IS NOT NULL), ','), ']') AS blocked_domains_json,
    CAST(coalesce(pii_redaction_enabled, 1) AS INTEGER) AS pii_redaction_enabled
    FROM raw_policies p FULL JOIN x ON p.connection_id = x.connection_id""",
)
def i5(spark, sf_dir):
    n = F.col("c_custkey")
    rules = F.when(n % 3 == 1, F.array(F.lit("a.org"), F.lit("b.org"), F.lit("a.org"))).otherwise(F.array(F.lit("example.com")))
    additions = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), (n * 2).cast("string")).alias("connection_id"), F.posexplode(rules).alias("position", "rule")
    )
    out = tb.add_rules(decode_policies(raw_policies(spark, sf_dir)), additions, "blocked_domains")
    return encode_policies(out).select("connection_id", "blocked_domains_json", "pii_redaction_enabled")


@check("i6_purge_sessions", f"WITH {SESSIONS_SQL} SELECT id, expires_at FROM sessions WHERE NOT expires_at <= {NOW_MS}")
def i6(spark, sf_dir):
    return tb.purge_sessions(sessions(spark, sf_dir), NOW_MS).select("id", "expires_at")


@check(
    "i7_touch_keys",
    f"""WITH {API_KEYS_SQL} SELECT id, max(epoch_us(e.ts) // 1000) AS last_used_at FROM api_keys k
    LEFT JOIN events e ON k.id = concat('k', CAST(e.user_id AS VARCHAR)) GROUP BY id""",
)
def i7(spark, sf_dir):
    uses = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("used_at"),
    )
    return tb.touch_keys(api_keys(spark, sf_dir), uses).select("id", "last_used_at")


@check(
    "i8_backfill_policies",
    f"""WITH {RAW_POLICIES_SQL} SELECT connection_id, allowed_folders_json, 1 AS attachment_filtering_enabled,
    pii_redaction_enabled FROM raw_policies""",
)
def i8(spark, sf_dir):
    return backfill_policies(raw_policies(spark, sf_dir)).select(
        "connection_id", "allowed_folders_json", "attachment_filtering_enabled", "pii_redaction_enabled"
    )


@check(
    "j2_client_address",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('10.0.0.', CAST(user_id AS VARCHAR)) WHEN 1 THEN event_type WHEN 2 THEN 'unknown' ELSE '' END AS client FROM events""",
)
def j2(spark, sf_dir):
    n = F.col("event_id") % 4
    user = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    forwarded = F.when(n == 0, F.concat(F.lit(" "), user, F.lit(" , 10.1.1.1"))).when(n == 3, "")
    real = F.when(n == 1, F.col("event_type")).when(n == 0, F.lit("10.9.9.9"))
    return table(spark, sf_dir, "events").select("event_id", tb.client_address(forwarded, real).alias("client"))
