"""Accounts, connections, keys, sessions and policies as plain tables: the
look-ups become joins and the updates become rewrites of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailsieve.functions.text import blank_if_null, trimmed
from mailsieve.operators.tenants import decode_policies
from mailsieve.policy import FLAGS, RULE_LISTS, default_flags



def _no_strings() -> Column:
    return F.array().cast("array<string>")



# --- reads -----------------------------------------------------------------
def accounts_with_connections(accounts: DataFrame, connections: DataFrame, email: str | None = None) -> DataFrame:
    if email is not None:
        accounts = accounts.filter(F.col("email") == email)
    return accounts.alias("a").join(connections.alias("c"), F.col("a.id") == F.col("c.account_id"), "left")


def connection_counts(accounts: DataFrame, connections: DataFrame, email: str | None = None) -> DataFrame:
    """Accounts with how many connections they have, newest account first.
    Connections are counted before the join, so a busy account moves one row."""
    if email is not None:
        accounts = accounts.filter(F.col("email") == email)
    per_account = connections.groupBy(F.col("account_id").alias("id")).agg(F.count("id").alias("connections"))
    return (
        accounts.select("id", "email", "name", "created_at")
        .join(per_account, "id", "left")
        .withColumn("connections", F.coalesce("connections", F.lit(0)).cast("bigint"))
        .orderBy(F.desc("created_at"), "id")
    )


def connections_of(connections: DataFrame, account_id: str) -> DataFrame:
    return connections.filter(F.col("account_id") == account_id).orderBy("created_at", "id")


def keys_of(keys: DataFrame, connection_id: str | None = None, account_id: str | None = None) -> DataFrame:
    if connection_id is not None:
        keys = keys.filter(F.col("connection_id") == connection_id)
    elif account_id is not None:
        keys = keys.filter(F.col("account_id") == account_id)
    return keys.orderBy(F.desc("created_at"), "id")


def connection_states(connections: DataFrame) -> DataFrame:
    return connections.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") != "active").alias("issues"),
    )


def gate_connections(connections: DataFrame) -> DataFrame:
    """Adds `error` for connections that may not be used."""
    text = F.concat(
        F.lit("Connection is "), F.col("status"), F.lit(". Reconnect your email account to continue.")
    )
    return connections.withColumn("error", F.when(F.col("status") != "active", text))


def live_keys(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("revoked_at").isNull())


def live_sessions(sessions: DataFrame, now_ms: int) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now_ms)


def resolve_requests(requests: DataFrame, keys: DataFrame, connections: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests (with `api_key`) to their connection and policy. Unknown or
    revoked keys and unusable connections get an `error` instead.

    No side is forced to be broadcast: all three grow with the customers."""
    hashed = requests.withColumn("key_hash", F.sha2("api_key", 256))
    found = live_keys(keys).select("key_hash", F.col("id").alias("key_id"), "connection_id")
    usable = gate_connections(connections).select(
        F.col("id").alias("connection_id"), "account_id", F.col("error").alias("connection_error"), "status"
    )
    typed = decode_policies(policies).withColumn("has_policy", F.lit(True))
    defaults = {n: F.coalesce(n, _no_strings()) for n in RULE_LISTS}
    defaults |= {n: F.coalesce(n, F.lit(v)) for n, v in default_flags().items()}
    error = (
        F.when(F.col("key_id").isNull(), "Invalid API key")
        .when(F.col("status").isNull(), "Connection not found. Connect an email account first.")
        .otherwise(F.col("connection_error"))
    )
    # The small sides first: requests, of which one key may have a third, are joined once.
    known = found.join(usable, "connection_id", "left").join(typed, "connection_id", "left")
    return (
        hashed.join(known, "key_hash", "left")
        .withColumns(defaults)
        .withColumn("error", error)
        .drop("key_hash", "api_key", "connection_error", "status", "has_policy")
    )


def owned_by(children: DataFrame, parents: DataFrame, key: str, owner: str = "account_id") -> DataFrame:
    """Children whose (key, owner) pair exists among the parents' (id, owner)."""
    pairs = parents.select(F.col("id").alias(key), F.col(owner))
    return children.join(pairs, [key, owner], "left_semi")


def client_address(headers_forwarded, headers_real):
    """First forwarded address, else the real one, else `unknown`. An empty
    forwarded header is an empty key, not a missing one."""
    first = trimmed(F.get(F.split(headers_forwarded, ","), F.lit(0)))
    return F.coalesce(first, headers_real, F.lit("unknown"))


# --- rewrites --------------------------------------------------------------
def without_parents(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Cascade delete: children of removed parents go."""
    return children.join(removed.select(F.col("id").alias(key)), key, "left_anti")


def merge_policies(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Each field: patch, else stored value, else default. Typed policies."""
    names = [*RULE_LISTS, *FLAGS]
    defaults = {n: _no_strings() for n in RULE_LISTS} | {n: F.lit(v) for n, v in default_flags().items()}
    new = patches.select("connection_id", *(F.col(n).alias(f"_{n}") for n in names if n in patches.columns))
    joined = current.join(new, "connection_id", "full")
    merged = [
        F.coalesce(*([F.col(f"_{n}")] if f"_{n}" in joined.columns else []), F.col(n), defaults[n]).alias(n)
        for n in names
    ]
    return joined.select("connection_id", *merged)


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of `changes` replace rows of the same key; the highest version of a
    key wins among them. Aggregates with map-side combine, no window."""
    columns = current.columns
    both = current.select(F.lit(0).alias("_new"), F.lit(None).cast("bigint").alias("_v"), *columns).unionByName(
        changes.select(F.lit(1).alias("_new"), F.col(version).cast("bigint").alias("_v"), *columns)
    )
    latest = F.max_by(F.struct(*columns), F.struct("_new", F.coalesce("_v", F.lit(-1))))
    return both.groupBy(F.col(key).alias("_key")).agg(latest.alias("row")).select("row.*")


def upsert_accounts(current: DataFrame, changes: DataFrame) -> DataFrame:
    """By email: profile fields are overwritten, the id and creation time stay,
    and a missing password hash keeps the stored one."""
    new = changes.select("email", *(F.col(c).alias(f"_{c}") for c in changes.columns if c != "email"))
    joined = current.join(new, "email", "full")
    known, changed = F.col("id").isNotNull(), F.col("_id").isNotNull()
    kept = {"id", "created_at"}

    def pick(name: str):
        if name == "email":
            return F.col("email")
        if name in kept:
            return F.coalesce(name, f"_{name}")
        if name == "password_hash":
            return F.coalesce(f"_{name}", name)
        return F.when(changed, F.col(f"_{name}")).when(known, F.col(name))

    return joined.select(*(pick(c).alias(c) for c in current.columns))


def revoke_keys(keys: DataFrame, prefix: str, now_ms: int) -> DataFrame:
    hit = (F.col("prefix") == prefix) & F.col("revoked_at").isNull()
    return keys.withColumn("revoked_at", F.when(hit, F.lit(now_ms).cast("bigint")).otherwise(F.col("revoked_at")))


def revoked_count(keys: DataFrame, prefix: str) -> DataFrame:
    return keys.agg(F.count_if((F.col("prefix") == prefix) & F.col("revoked_at").isNull()).alias("changes"))


def add_rules(policies: DataFrame, additions: DataFrame, column: str) -> DataFrame:
    """Adds `rule` rows (connection_id, position, rule) to a list column: no
    duplicates, new entries behind the old, and a default policy for a
    connection that has none yet. Additions repeat at most a rule list, 200."""
    first = additions.groupBy("connection_id", "rule").agg(F.min("position").alias("position"))
    new = first.groupBy("connection_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "rule"))), lambda r: r["rule"]).alias("_new")
    )
    joined = policies.join(new, "connection_id", "full")
    defaults = {n: _no_strings() for n in RULE_LISTS} | {n: F.lit(v) for n, v in default_flags().items()}
    filled = joined.withColumns({n: F.coalesce(n, v) for n, v in defaults.items() if n in policies.columns})
    extra = F.filter(
        F.coalesce("_new", _no_strings()), lambda r: ~F.array_contains(F.col(column), r)
    )
    return filled.withColumn(column, F.concat(F.col(column), extra)).drop("_new")


def purge_sessions(sessions: DataFrame, now_ms: int) -> DataFrame:
    return sessions.filter(~(F.col("expires_at") <= now_ms))


def touch_keys(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """Latest use (key_id, used_at) per key. Uses are reduced to one row per
    key before the join, so a busy key is no heavier than any other."""
    last = uses.groupBy(F.col("key_id").alias("id")).agg(F.max("used_at").alias("_used"))
    return (
        keys.join(last, "id", "left").withColumn("last_used_at", F.coalesce("_used", "last_used_at")).drop("_used")
    )
