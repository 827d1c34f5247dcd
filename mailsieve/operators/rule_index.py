"""Custom rules of all connections against all senders and subjects, through an index.

With one policy row beside each message, every message is held against each rule of
its connection. Here each distinct (connection, sender) and (connection, subject) is
judged once, and only against rules that can match it: rules are indexed of connections
that have messages, and a pattern's grammar tells strings
one of which every match contains, and the first three characters of each are what
texts and rules are joined by. Rules without such strings meet all texts of their
connection, 200 at the most. What comes out are hits alone, so message bodies have no
part in any of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.folders import settled
from mailsieve.functions.ecmascript import NEEDED_CHARS
from mailsieve.functions.regexes import hits
from mailsieve.operators.tenants import PATTERN_LISTS, compiled_rules, flag_columns, joined_policy
from mailsieve.policy import PolicyColumns

SENDERS, SUBJECTS = PATTERN_LISTS
# Rows of a table that is sent to all tasks; larger ones are joined by shuffles.
SENT_ROWS = 100_000


def rule_index(policies: DataFrame) -> DataFrame:
    """connection_id, list, position, shown, jdk and gram of every valid pattern rule, once
    for each of its needed strings' grams; the gram is null where none is known."""
    rules = compiled_rules(policies).where("rule.jdk IS NOT NULL")
    grams = F.array_distinct(F.transform("rule.needed", lambda n: F.substring(n, 1, NEEDED_CHARS)))
    return rules.select("connection_id", "list", "position", "rule.shown", "rule.jdk", F.explode_outer(grams).alias("gram"))


def distinct_texts(messages: DataFrame) -> DataFrame:
    """connection_id, list and text: what rules are held against, each once."""
    email, subject = (F.lower(F.coalesce(c, F.lit(""))) for c in ("from.email", "subject"))
    both = F.array(F.struct(F.lit(SENDERS).alias("list"), email.alias("text")), F.struct(F.lit(SUBJECTS).alias("list"), subject.alias("text")))
    return messages.select("connection_id", F.inline(both)).distinct()


def custom_hits(messages: DataFrame, policies: DataFrame) -> DataFrame:
    """connection_id, list, text and shown, the first rule of the connection's list that
    the text matches; only texts with a hit. Computed once and kept in the shared folder."""
    every = settled(distinct_texts(messages))
    # A service stores policies of far more connections than have mail in one run. A test by subquery, as
    # Spark moves it in front of what makes the lists, which it does not do with a join; settled, as
    # Spark would otherwise make every list to leave out empty ones.
    owned = policies.select("connection_id", *PATTERN_LISTS).where(F.col("connection_id").isin(every.select("connection_id").distinct()))
    index = settled(rule_index(settled(owned)))
    texts = every.join(index.select("connection_id", "list").distinct(), ["connection_id", "list"], "left_semi")
    last = F.length("text") - (NEEDED_CHARS - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("text"), i, F.lit(NEEDED_CHARS))))
    by_gram = texts.withColumn("gram", F.explode(grams)).join(index.where("gram IS NOT NULL"), ["connection_id", "list", "gram"]).drop("gram")
    others = texts.join(index.where("gram IS NULL").drop("gram"), ["connection_id", "list"])
    # A rule that is met by several of its strings is tried more than once; its first place is the same.
    found = by_gram.unionByName(others).where(hits(F.col("text"), F.col("jdk")))
    return settled(found.groupBy("connection_id", "list", "text").agg(F.min_by("shown", "position").alias("shown")))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def indexed_policies(messages: DataFrame, policies: DataFrame, sent_rows: int = SENT_ROWS) -> tuple[DataFrame, PolicyColumns]:
    """As `join_policies`, with custom rules already judged: beside each message stand its
    connection's flags, domains and folders and the custom rules that its sender and its
    subject hit. Tables of up to `sent_rows` rows are sent to the tasks, so that messages
    stay where they are."""
    found = custom_hits(messages, policies)
    sender, subject = (found.where(F.col("list") == name).select(F.col("connection_id").alias("_owner"), F.col("text").alias("_text"), F.col("shown").alias(shown)) for name, shown in ((SENDERS, "_sender_hit"), (SUBJECTS, "_subject_hit")))
    flags = settled(flag_columns(policies))
    joined = messages.join(_sent(flags, sent_rows), "connection_id", "left")
    for hit, text in ((sender, F.col("from.email")), (subject, F.col("subject"))):
        text = F.lower(F.coalesce(text, F.lit("")))
        joined = joined.join(_sent(hit, sent_rows), (F.col("connection_id") == F.col("_owner")) & (text == F.col("_text")), "left").drop("_owner", "_text")
    return joined_policy(joined, {"sender_hit": F.col("_sender_hit"), "subject_hit": F.col("_subject_hit")}).drop("_sender_hit", "_subject_hit"), PolicyColumns("_policy", judged=True)
