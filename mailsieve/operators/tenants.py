"""One policy per connection: decoding, checking and joining the policy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.regexes import compiled_rule
from mailsieve.policy import FLAGS, MAX_RULE_CHARS, MAX_RULES, RULE_LISTS, PolicyColumns, default_flags

PATTERN_LISTS = ("blocked_sender_patterns", "blocked_subject_patterns")
# Stored name of each flag.
STORED = {n: n if n == "show_filtered_count" else f"{n}_enabled" for n in FLAGS}


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def decode_policies(raw: DataFrame) -> DataFrame:
    """Stored rows (JSON text arrays, 0/1 flags) to typed columns. A missing
    column, as in snapshots older than the setting, takes its default."""
    have = set(raw.columns)
    columns = [F.col("connection_id")]
    for name in RULE_LISTS:
        text = F.col(f"{name}_json") if f"{name}_json" in have else F.lit("[]")
        columns.append(F.coalesce(F.from_json(text, "array<string>"), _no_strings()).alias(name))
    for name, default in default_flags().items():
        stored = F.col(STORED[name]) == 1 if STORED[name] in have else F.lit(None)
        columns.append(F.coalesce(stored, F.lit(default)).alias(name))
    return raw.select(*columns)


def encode_policies(policies: DataFrame) -> DataFrame:
    """The stored form again."""
    return policies.select(
        "connection_id",
        *(F.to_json(F.col(n)).alias(f"{n}_json") for n in RULE_LISTS),
        *(F.col(n).cast("int").alias(STORED[n]) for n in FLAGS),
    )


def backfill_policies(raw: DataFrame) -> DataFrame:
    """Adds the stored columns an old snapshot lacks, with their defaults."""
    for name in RULE_LISTS:
        if f"{name}_json" not in raw.columns:
            raw = raw.withColumn(f"{name}_json", F.lit("[]"))
    for name, default in default_flags().items():
        if STORED[name] not in raw.columns:
            raw = raw.withColumn(STORED[name], F.lit(int(default)))
    return raw


def _list_error(name: str) -> Column:
    rules = F.coalesce(F.col(name), _no_strings())
    fits = F.forall(rules, lambda r: r.isNotNull() & (F.length(r) <= MAX_RULE_CHARS))
    return F.when(
        ~F.coalesce(fits, F.lit(False)), F.lit(f"{name} must be an array of strings (max {MAX_RULE_CHARS} chars each)")
    ).when(F.size(rules) > MAX_RULES, F.lit(f"{name} must have at most {MAX_RULES} entries"))


def validate_policies(policies: DataFrame) -> DataFrame:
    """Adds `error`: the first thing wrong with the row, or null."""
    sized = policies.withColumn("error", F.coalesce(*(_list_error(n) for n in RULE_LISTS)))
    bad = invalid_rules(sized.filter("error is null"))
    first = bad.groupBy("connection_id").agg(
        F.min_by("message", F.struct("list", "position")).alias("pattern_error")
    )
    return (
        sized.join(first, "connection_id", "left")
        .withColumn("error", F.coalesce("error", "pattern_error"))
        .drop("pattern_error")
    )


def rule_rows(policies: DataFrame) -> DataFrame:
    """One row per pattern rule: connection_id, list, position, pattern."""
    lists = [
        policies.select(
            "connection_id", F.lit(name).alias("list"), F.posexplode(F.col(name)).alias("position", "pattern")
        )
        for name in PATTERN_LISTS
    ]
    return lists[0].unionByName(lists[1])


def compiled_rules(policies: DataFrame) -> DataFrame:
    rows = rule_rows(policies)
    # Tenants share rules, so each distinct text is checked once; a filter on the
    # outcome would otherwise be moved, and the check with it, in front of `distinct`.
    once = compiled_rule.asNondeterministic()
    checked = rows.select("pattern").distinct().withColumn("rule", once("pattern"))
    return rows.join(checked, "pattern")


def invalid_rules(policies: DataFrame) -> DataFrame:
    """Pattern rules that do not compile. They are ignored when messages are
    judged, so this table is where their owner learns of them."""
    bad = compiled_rules(policies).filter(F.col("rule.jdk").isNull())
    text = F.concat(F.lit("Invalid regex pattern in "), F.col("list"), F.lit(": "), F.col("pattern"))
    return bad.select("connection_id", "list", "position", "pattern", text.alias("message"))


def compile_policies(policies: DataFrame) -> DataFrame:
    """Policies ready to join: each pattern list becomes
    struct<any: one alternation of the list, rules: array<struct<shown, jdk>>>.
    A list holds at most 200 rules, so the gathered arrays are small."""
    standalone = ~F.col("rule.jdk").rlike(r"\\[1-9]|\\k<|\(\?<[A-Za-z]")
    entry = F.struct("position", F.col("rule.shown").alias("shown"), F.col("rule.jdk").alias("jdk"))
    lists = (
        compiled_rules(policies)
        .filter(F.col("rule.jdk").isNotNull())
        .groupBy("connection_id")
        .agg(
            *(
                F.sort_array(F.collect_list(F.when(F.col("list") == n, entry))).alias(f"{n}_rules")
                for n in PATTERN_LISTS
            ),
            *(F.bool_and(F.when(F.col("list") == n, standalone)).alias(f"{n}_joint") for n in PATTERN_LISTS),
        )
    )
    joined = policies.join(lists, "connection_id", "left")
    for name in PATTERN_LISTS:
        rules = F.coalesce(
            F.transform(F.col(f"{name}_rules"), lambda r: F.struct(r["shown"].alias("shown"), r["jdk"].alias("jdk"))),
            F.array().cast("array<struct<shown:string,jdk:string>>"),
        )
        alternation = F.array_join(
            F.transform(rules, lambda r: F.concat(F.lit("(?:"), r["jdk"], F.lit(")"))), "|"
        )
        # An empty list gets a pattern nothing matches.
        one = F.when(F.size(rules) == 0, F.lit("(?!)")).when(F.col(f"{name}_joint"), alternation)
        joined = joined.withColumn(name, F.struct(one.alias("any"), rules.alias("rules")))
    return joined.select("connection_id", *RULE_LISTS, *FLAGS)


def join_policies(messages: DataFrame, policies: DataFrame) -> tuple[DataFrame, PolicyColumns]:
    """Messages with their connection's policy in one struct column, defaults
    where it has none, and the handle the stages take.

    A connection may own a third of all messages. The policy side has one row
    per connection, so the join never multiplies rows; Spark broadcasts it
    when its measured size allows and otherwise splits the heavy key's
    partitions (skew join)."""
    return join_compiled(messages, compile_policies(policies))


def join_compiled(messages: DataFrame, compiled: DataFrame) -> tuple[DataFrame, PolicyColumns]:
    """The same with policies that were compiled before."""
    packed = compiled.select(
        "connection_id", F.struct(*RULE_LISTS, *FLAGS).alias("_stored")
    )
    joined = messages.join(packed, "connection_id", "left")
    no_rules = F.struct(
        F.lit("(?!)").alias("any"), F.array().cast("array<struct<shown:string,jdk:string>>").alias("rules")
    )
    lists = {n: F.coalesce(F.col(f"_stored.{n}"), no_rules) for n in PATTERN_LISTS}
    return joined_policy(joined, lists), PolicyColumns("_policy")


def flag_columns(policies: DataFrame) -> DataFrame:
    """connection_id and, in one struct, all of a policy but its patterns."""
    return policies.select("connection_id", F.struct(*(n for n in RULE_LISTS if n not in PATTERN_LISTS), *FLAGS).alias("_stored"))


def joined_policy(joined: DataFrame, more: dict[str, Column]) -> DataFrame:
    """`_stored` and what else is known of a message's policy as the struct `_policy`,
    with defaults where the connection has none."""
    fallback = {n: _no_strings() for n in RULE_LISTS if n not in PATTERN_LISTS}
    fallback |= {n: F.lit(v) for n, v in default_flags().items()}
    policy = {n: F.coalesce(F.col(f"_stored.{n}"), v) for n, v in fallback.items()} | more
    return joined.withColumn("_policy", F.struct(*(v.alias(n) for n, v in policy.items()))).drop("_stored")
