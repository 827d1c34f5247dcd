"""Threads: summaries, participants, and messages in order.

A thread may hold any share of the corpus, so nothing gathers a thread's
messages. Summaries are algebraic aggregates with map-side combine; the lists
in them hold distinct participants and labels, already reduced to one row each
before they are gathered.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.address import sender_domain
from mailsieve.operators.blocklist import domain_blocked
from mailsieve.operators.positions import PART_ROWS, numbered
from mailsieve.policy import Policy, PolicyColumns
from mailsieve.schema import ADDRESSES, STRINGS


# An undated message counts as older than any dated one, whichever way a thread
# is read, and a message without a uid as older than those of its time with one.
UNDATED, _NO_UID = -(2**62), 2**62


def _time_key(newest_first: bool) -> Column:
    """Sort key of a message in its thread. Equal times keep newest uid first,
    in both directions."""
    at = F.coalesce(F.unix_micros("sent_at"), F.lit(UNDATED))
    return F.struct((-at if newest_first else at).alias("at"), F.coalesce(-F.col("uid"), F.lit(_NO_UID)).alias("uid"))


def _addressed(include_to: bool) -> Column:
    sender = F.array(F.col("from"))
    return F.concat(sender, F.coalesce(F.col("to"), F.array().cast(ADDRESSES))) if include_to else sender


def thread_participants(messages: DataFrame, newest_first: bool = True, include_to: bool = True) -> DataFrame:
    """One row per thread and address (thread_id, email, name, first_seen): the
    place is that of the first mention, the name that of the last."""
    mentions = messages.select(
        "thread_id", _time_key(newest_first).alias("key"), F.posexplode(_addressed(include_to)).alias("pos", "who")
    )
    place = F.struct("key.at", "key.uid", "pos")
    return mentions.groupBy("thread_id", F.col("who.email").alias("email")).agg(
        F.max_by("who.name", place).alias("name"), F.min(place).alias("first_seen")
    )


def thread_labels(messages: DataFrame, newest_first: bool = True) -> DataFrame:
    """One row per thread and label (thread_id, label, first_seen)."""
    mentions = messages.select(
        "thread_id", _time_key(newest_first).alias("key"), F.posexplode("labels").alias("pos", "label")
    )
    return mentions.groupBy("thread_id", "label").agg(
        F.min(F.struct("key.at", "key.uid", "pos")).alias("first_seen")
    )


def _mentions(messages: DataFrame, newest_first: bool, include_to: bool) -> DataFrame:
    """Participants and labels through one shuffle: both are a (kind, value)
    pair with a place and, for people, a name."""
    people = F.transform(
        _addressed(include_to),
        lambda a: F.struct(F.lit("who").alias("kind"), a["email"].alias("value"), a["name"].alias("name")),
    )
    labels = F.transform(
        F.coalesce(F.col("labels"), F.array().cast(STRINGS)),
        lambda label: F.struct(
            F.lit("label").alias("kind"), label.alias("value"), F.lit(None).cast("string").alias("name")
        ),
    )
    rows = messages.select(
        "thread_id",
        _time_key(newest_first).alias("key"),
        F.posexplode(F.concat(people, labels)).alias("pos", "item"),
    )
    place = F.struct("key.at", "key.uid", "pos")
    distinct = rows.groupBy(
        "thread_id", F.col("item.kind").alias("kind"), F.col("item.value").alias("value")
    ).agg(F.min(place).alias("place"), F.max_by("item.name", place).alias("name"))
    who = F.when(F.col("kind") == "who", F.struct("place", "name", "value"))
    label = F.when(F.col("kind") == "label", F.struct("place", "value"))
    return distinct.groupBy("thread_id").agg(
        F.transform(
            F.sort_array(F.collect_list(who)),
            lambda p: F.struct(p["name"].alias("name"), p["value"].alias("email")),
        ).alias("participants"),
        F.transform(F.sort_array(F.collect_list(label)), lambda x: x["value"]).alias("labels"),
    )


def thread_facts(messages: DataFrame, newest_first: bool = True, subject_from: str = "latest") -> DataFrame:
    """The scalar part of a thread: one aggregate, no lists."""
    # The latest message comes first newest-first and last otherwise.
    pick_latest = F.min_by if newest_first else F.max_by
    pick_first = F.max_by if newest_first else F.min_by
    key = _time_key(newest_first)
    subject = (pick_latest if subject_from == "latest" else pick_first)("subject", key)
    latest = pick_latest(F.struct("snippet", "date", "sent_at"), key)
    facts = messages.groupBy("thread_id").agg(
        subject.alias("subject"),
        F.count("*").alias("message_count"),
        latest.alias("latest"),
        F.bool_or("is_unread").alias("is_unread"),
    )
    return facts.select(
        F.col("thread_id").alias("id"),
        "subject",
        "message_count",
        F.col("latest.snippet").alias("snippet"),
        F.col("latest.date").alias("last_message_date"),
        F.col("latest.sent_at").alias("last_sent_at"),
        "is_unread",
    )


def threads(
    messages: DataFrame, newest_first: bool = True, subject_from: str = "latest", include_to: bool = True
) -> DataFrame:
    """Thread summaries. Defaults are those of the mailbox listing; the single
    thread view lists oldest first and takes the first message's subject; the
    API listing names senders only."""
    facts = thread_facts(messages, newest_first, subject_from)
    lists = _mentions(messages, newest_first, include_to).withColumnRenamed("thread_id", "id")
    return facts.join(lists, facts["id"].eqNullSafe(lists["id"]), "left").drop(lists["id"])


def _after(token: str) -> Column:
    """Threads behind the one that a `page_token` names."""
    at, thread_id = json.loads(token)
    # The thread of the messages without one is the last of its time.
    behind = F.lit(False) if thread_id is None else (F.col("id") > F.lit(thread_id)) | F.col("id").isNull()
    last, same = F.unix_micros("last_sent_at"), behind
    if at is None:
        return last.isNull() & same
    return last.isNull() | (last < at) | ((last == at) & same)


def _token() -> Column:
    """Names the thread of a row of facts, for pages that begin behind it."""
    at = F.coalesce(F.unix_micros("last_sent_at").cast("string"), F.lit("null"))
    return F.concat(F.lit("["), at, F.lit(","), F.expr("if(id IS NULL, 'null]', substring(to_json(array(id)), 2))"))


def thread_page(messages: DataFrame, n: int, scan: int | None = None, token: str | None = None, since: str | None = None, **kind) -> DataFrame:
    """The n threads with the latest messages, or those behind `token`; undated
    ones come last, and messages without a thread are one whose id is null. The lists are built only for threads on the page. Each row
    has the `page_token` after which the next page begins, so the last one's
    continues. `since` looks at messages from that time on only, a predicate that
    prunes files; all pages must be asked for with the same one. `scan` looks at so many messages,
    newest uid first; it is off by default and the whole frame is used."""
    if since is not None:
        messages = messages.where(F.col("sent_at") >= F.lit(since).cast("timestamp"))
    if scan is not None:
        messages = messages.orderBy(F.desc_nulls_last("uid"), F.desc_nulls_last("sent_at"), "id").limit(scan)
    facts = thread_facts(messages, kind.get("newest_first", True), kind.get("subject_from", "latest"))
    order = (F.desc_nulls_last("last_sent_at"), F.asc_nulls_last("id"))
    page = (facts if token is None else facts.filter(_after(token))).orderBy(*order).limit(n)
    page = page.withColumn("page_token", _token())
    # At most n ids: small enough to send everywhere, whatever the corpus.
    ids = F.broadcast(page.select(F.col("id").alias("_page_id")))
    on_page = messages.join(ids, messages["thread_id"].eqNullSafe(ids["_page_id"]), "left_semi")
    lists = _mentions(on_page, kind.get("newest_first", True), kind.get("include_to", True)).withColumnRenamed(
        "thread_id", "_list_id"
    )
    return page.join(lists, page["id"].eqNullSafe(lists["_list_id"]), "left").drop("_list_id").orderBy(*order)


def blocked_threads(messages: DataFrame, policy: Policy | PolicyColumns | None = None, include_to: bool = True) -> DataFrame:
    """Per thread whether every participant is on a blocked domain. A plain
    boolean aggregate, without building participant lists. With a policy per
    connection, `messages` come from `join_policies` and threads are told apart by
    connection as well."""
    policy = policy or Policy()
    each = F.forall(_addressed(include_to), lambda a: domain_blocked(sender_domain(F.coalesce(a["email"], F.lit(""))), policy))
    keys = ["connection_id", "thread_id"] if isinstance(policy, PolicyColumns) else ["thread_id"]
    return messages.groupBy(*keys).agg(F.bool_and(each).alias("thread_blocked"))


def latest_per_thread(messages: DataFrame) -> DataFrame:
    """One row per thread: its latest message, whole."""
    row = F.struct(*messages.columns)
    return messages.groupBy("thread_id").agg(F.min_by(row, _time_key(True)).alias("m")).select("m.*")


def thread_messages(messages: DataFrame, thread_id: str | None) -> DataFrame:
    """One thread, oldest first; None is that of the messages without one. The sort is a range-partitioned one, so a
    thread of any size is spread over the cluster."""
    return messages.filter(F.col("thread_id").eqNullSafe(F.lit(thread_id))).orderBy("sent_at", F.desc_nulls_last("uid"), "id")


def with_position(messages: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds `position`, 1 for a thread's oldest message. Undated messages come
    first, and those without a thread are one of their own.

    A thread of more than `part_rows` messages is numbered in parts cut at its own
    quantiles, so neither a thread nor an instant that holds much of the corpus
    meets in one task."""
    ties = [F.col("id")] if "id" in messages.columns else []
    order = [F.col("sent_at"), F.coalesce(-F.col("uid"), F.lit(_NO_UID)), *ties]
    return numbered(messages, [F.col("thread_id")], order, "position", part_rows=part_rows)


def _list_key(at: Column, thread_id: Column) -> Column:
    """Sort key of a thread in the list of threads, latest first."""
    return F.struct(F.coalesce(-at, F.lit(-UNDATED)).alias("at"), thread_id.isNull().alias("nameless"), thread_id.alias("id"))


def thread_directory(facts: DataFrame, n: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Every page of `thread_page`, n threads each: page (from 0), `token` behind which
    it begins (null for the first one), n_threads and first_id. `facts` has the id and
    last_sent_at of threads, as `thread_facts` gives them. Threads are numbered in parts, so no page has to
    be read for the next one."""
    placed = numbered(facts.select("id", "last_sent_at"), [], [_list_key(F.unix_micros("last_sent_at"), F.col("id"))], "place", "total", part_rows)
    placed = placed.withColumn("page", F.floor((F.col("place") - 1) / n))
    first = placed.where((F.col("place") - 1) % n == 0).select("page", F.col("id").alias("first_id"), F.least(F.lit(n), F.col("total") - F.col("page") * n).cast("long").alias("n_threads"))
    tokens = placed.where((F.col("place") % n == 0) & (F.col("place") < F.col("total"))).select((F.col("page") + 1).alias("page"), _token().alias("token"))
    return first.join(tokens, "page", "left").select("page", "token", "n_threads", "first_id")


def on_thread_pages(facts: DataFrame, directory: DataFrame, n: int, part_rows: int = PART_ROWS) -> DataFrame:
    """For each thread (id) the pages of a directory that it is on: it lies behind the
    page's token and not behind the next one's. A range join of threads with the page that
    their place says and those beside it."""
    parts = F.from_json("token", STRINGS)
    at, thread_id = parts[0].cast("long"), parts[1]
    begins = directory.select("page", F.when(F.col("token").isNotNull(), _list_key(at, thread_id)).alias("_after"))
    bounds = begins.join(begins.select((F.col("page") - 1).alias("page"), F.col("_after").alias("_until")), "page", "left")
    own = _list_key(F.unix_micros("last_sent_at"), F.col("id"))
    page = F.floor((F.col("place") - 1) / n)
    near = numbered(facts.select("id", "last_sent_at"), [], [own], "place", part_rows=part_rows).withColumn("page", F.explode(F.array(page - 1, page, page + 1)))
    inside = (F.col("_after").isNull() | (own > F.col("_after"))) & (F.col("_until").isNull() | (own <= F.col("_until")))
    return near.join(bounds, "page").where(inside).select("id", "page")


def label_stats(messages: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Messages and unread messages per label. `dim` (id, name, type) adds
    labels that no message carries; a label not in it is a user label."""
    per_label = (
        messages.select(F.explode("labels").alias("id"), "is_unread")
        .groupBy("id")
        .agg(F.count("*").alias("messages_total"), F.count_if("is_unread").alias("messages_unread"))
    )
    if dim is None:
        named = per_label.withColumns({"name": F.col("id"), "type": F.lit("user")})
    else:
        named = per_label.join(dim, "id", "full").withColumns(
            {"name": F.coalesce("name", "id"), "type": F.coalesce("type", F.lit("user"))}
        )
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("messages_total", "messages_unread")}
    return named.withColumns(zero).select("id", "name", "type", "messages_total", "messages_unread")


def allowed_labels(labels: DataFrame, policy: Policy) -> DataFrame:
    if not policy.allowed_folders:
        return labels
    return labels.filter(F.lower("name").isin([f.lower() for f in policy.allowed_folders]))
