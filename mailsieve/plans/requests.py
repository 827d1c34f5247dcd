"""The reader's requests as whole jobs: search, read, threads, labels, drafts,
and the JSON documents that answer them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailsieve.operators import drafts as drafts_ops
from mailsieve.operators import threads as threads_ops
from mailsieve.operators.blocklist import thread_blocked
from mailsieve.operators.paging import keyset_page, page_size
from mailsieve.operators.search import search
from mailsieve.plans import views
from mailsieve.plans.gateway import passed, process
from mailsieve.policy import Policy


def search_page(messages: DataFrame, query: str, n: int = 20, token: str | None = None, **options) -> DataFrame:
    """The page as it is before the policy: at most n rows, newest first."""
    return keyset_page(search(messages, query, **options), page_size(n), token).rows


def search_emails(
    messages: DataFrame, query: str, policy: Policy | None = None, n: int = 20, token: str | None = None, **options
) -> DataFrame:
    """Cut first, judge afterwards: the costly stages see one page only, and a
    blocked message leaves a gap in it."""
    page = search_page(messages, query, n, token, **options)
    return views.search_view(passed(page, policy), policy)


def read_email(messages: DataFrame, message_id: str, policy: Policy | None = None) -> DataFrame:
    return views.read_view(process(messages.filter(F.col("id") == message_id), policy), policy)


def list_threads(
    messages: DataFrame, query: str = "", policy: Policy | None = None, n: int = 20, hardened: bool = False, token: str | None = None, **options
) -> DataFrame:
    policy = policy or Policy()
    page = threads_ops.thread_page(search(messages, query, **options), page_size(n), token=token)
    kept = page.filter(~thread_blocked(F.col("participants"), policy))
    return views.thread_view(kept, policy, hardened)


def get_thread(messages: DataFrame, thread_id: str, policy: Policy | None = None) -> DataFrame:
    """The thread's messages that pass, oldest first."""
    own = threads_ops.thread_messages(messages, thread_id)
    return views.thread_message_view(passed(own, policy), policy)


def list_labels(messages: DataFrame, policy: Policy | None = None, dim: DataFrame | None = None) -> DataFrame:
    stats = threads_ops.label_stats(messages, dim)
    return views.label_view(threads_ops.allowed_labels(stats, policy or Policy()))


def list_drafts(messages: DataFrame, policy: Policy | None = None, n: int = 20, hardened: bool = False) -> DataFrame:
    return views.draft_view(drafts_ops.list_drafts(messages, n), policy, hardened)


# --- documents -------------------------------------------------------------
def to_response(view: DataFrame, key: str = "id") -> DataFrame:
    """One JSON document per row, beside the key."""
    return view.select(F.col(key), F.to_json(F.struct(*view.columns)).alias("response"))


def search_response(
    messages: DataFrame, query: str, policy: Policy | None = None, n: int = 20, token: str | None = None, **options
) -> DataFrame:
    """The whole answer to a search as one JSON document: the page's passed
    rows, the number of matches before any were blocked, the next token, and
    the blocked count when the policy shows it. Gathers one page, at most 200
    rows; the match count is a plain aggregate."""
    policy = policy or Policy()
    found = search(messages, query, **options)
    page = keyset_page(found, page_size(n), token)
    # n + 1 rows at the most: everything but the total is read off them at once.
    own = ("page_row", "page_token", "action")
    view = views.search_view(process(page.both, policy, carry=own[:2]), policy, *own)
    here = F.col("page_row") <= n
    row = F.struct(*(c for c in view.columns if c not in own))
    n_blocked = F.count_if(here & (F.col("action") == "block"))
    listed = view.agg(
        F.sort_array(F.collect_list(F.when(here & (F.col("action") == "pass"), F.struct("page_row", row.alias("row"))))).alias("rows"),
        F.max(F.when(~here, F.col("page_token"))).alias("next_page_token"),
        F.when((n_blocked > 0) & F.lit(policy.show_filtered_count), n_blocked).alias("filtered_count"),
    ).select(F.transform("rows", lambda r: r["row"]).alias("results"), "next_page_token", "filtered_count")
    total = found.agg(F.count("*").alias("total_results"))
    return side_by_side(listed, total).select(
        F.to_json(F.struct("results", "total_results", "next_page_token", "filtered_count")).alias("response")
    )


def threads_response(messages: DataFrame, query: str = "", policy: Policy | None = None, n: int = 20, token: str | None = None, hardened: bool = False, **options) -> DataFrame:
    """The whole answer to a request for threads as one JSON document: the page's
    threads that are not blocked, the number of threads found, the token of the next page, and
    the blocked count when the policy shows it. Gathers one page, at most 200 threads."""
    policy = policy or Policy()
    found = search(messages, query, **options)
    # One thread more than the page has tells whether there is a next page.
    page = threads_ops.thread_page(found, page_size(n) + 1, token=token)
    in_order = W.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("last_sent_at"), F.asc_nulls_last("id"))
    page = page.withColumns({"_row": F.row_number().over(in_order), "_blocked": thread_blocked(F.col("participants"), policy)})
    view = views.thread_view(page, policy, hardened, "_row", "_blocked", "page_token")
    here = F.col("_row") <= n
    row = F.struct(*(c for c in view.columns if c not in ("_row", "_blocked", "page_token")))
    n_blocked = F.count_if(here & F.col("_blocked"))
    listed = view.agg(
        F.sort_array(F.collect_list(F.when(here & ~F.col("_blocked"), F.struct("_row", row.alias("row"))))).alias("rows"),
        F.max(F.when(F.col("_row") > n, 1)).alias("more"),
        F.max(F.when(F.col("_row") == n, F.col("page_token"))).alias("last"),
        F.when((n_blocked > 0) & F.lit(policy.show_filtered_count), n_blocked).alias("filtered_count"),
    ).select(F.transform("rows", lambda r: r["row"]).alias("threads"), F.when(F.col("more") == 1, F.col("last")).alias("next_page_token"), "filtered_count")
    total = found.select(F.struct("thread_id").alias("t")).agg(F.count_distinct("t").alias("total_results"))
    return side_by_side(listed, total).select(F.to_json(F.struct("threads", "total_results", "next_page_token", "filtered_count")).alias("response"))


def thread_response(messages: DataFrame, thread_id: str | None, policy: Policy | None = None, part_size: int = 200) -> DataFrame:
    """One thread as JSON documents, oldest message first: part (from 0) and response.
    Each has the thread's head (subject of its first message, participants, number of messages and how many of
    the thread are blocked, when the policy shows it) and the messages that pass of `part_size` in a row, so
    nearly all threads are one document, and none holds an unbounded thread. An unknown
    thread has no documents."""
    policy = policy or Policy()
    own = messages.where(F.col("thread_id").eqNullSafe(F.lit(thread_id)))
    head = threads_ops.threads(own, newest_first=False, subject_from="first")
    head = views.thread_view(head, policy).select("id", "subject", "participants", "message_count")
    judged = process(threads_ops.with_position(own), policy, carry=["position"])
    view = views.thread_message_view(judged, policy, "position", "action")
    message = F.struct(*(c for c in view.columns if c not in ("position", "action")))
    passes = F.col("action") == "pass"
    parts = view.groupBy(F.floor((F.col("position") - 1) / part_size).alias("part")).agg(
        F.sort_array(F.collect_list(F.when(passes, F.struct("position", message.alias("m"))))).alias("rows"), F.count_if(~passes).alias("blocked")
    )
    n_blocked = parts.agg(F.sum("blocked").alias("n"))
    shown = F.when((F.col("n") > 0) & F.lit(policy.show_filtered_count), F.col("n"))
    facts = side_by_side(head, n_blocked).where("message_count IS NOT NULL")
    # One row beside every part.
    beside = parts.withColumn("_one", F.col("part") * 0).join(F.broadcast(facts.withColumn("_one", F.col("message_count") * 0)), "_one")
    response = F.struct(F.col("id").alias("thread_id"), "subject", "participants", "message_count", F.transform("rows", lambda r: r["m"]).alias("messages"), shown.alias("filtered_count"))
    return beside.select("part", F.to_json(response).alias("response"))


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Single-row frames with different columns as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*(F.any_value(c, F.lit(True)).alias(c) for c in stacked.columns))
