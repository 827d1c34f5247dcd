"""Operators on mail and attempts with gaps: undated messages, missing and
repeated uids, attempts without key or time. Nothing may get lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.checks.corpus import ATTEMPTS_SQL, MAIL_SQL, attempts, mail
from mailsieve.checks.registry import check
from mailsieve.operators import analyses, paging, ratelimit, threads

DAY_MS = 86_400_000


def gapped(spark, sf_dir: str) -> DataFrame:
    """Mail of which a seventh has no time, a 17th no thread, a fifth no uid, and a fifth one uid."""
    left = F.col("uid")
    return mail(spark, sf_dir).withColumns(
        {
            "sent_at": F.when(left % 7 != 0, F.col("sent_at")),
            "thread_id": F.when(left % 17 != 3, F.col("thread_id")),
            "uid": F.when(left % 5 == 1, 7).when(left % 5 != 0, left),
        }
    )


_GAPPED = f"""{MAIL_SQL}, g AS (SELECT id, folder, CASE WHEN uid % 17 <> 3 THEN thread_id END AS thread_id, CASE WHEN uid % 7 <> 0 THEN date_epoch END AS s,
  CASE WHEN uid % 5 = 1 THEN 7 WHEN uid % 5 <> 0 THEN uid END AS u FROM m)"""


@check(
    "h8_position_gaps",
    f"""WITH {_GAPPED} SELECT id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY s NULLS FIRST, u DESC NULLS LAST, id) AS position FROM g""",
)
def h8(spark, sf_dir):
    return threads.with_position(gapped(spark, sf_dir)).select("id", "thread_id", "position")


@check("l6_transcripts_gaps", f"WITH {_GAPPED} SELECT thread_id, count(*) AS n_messages FROM g GROUP BY thread_id")
def l6(spark, sf_dir):
    parts = analyses.transcripts(gapped(spark, sf_dir))
    return parts.groupBy("thread_id").agg(F.sum("n_messages").alias("n_messages"))


@check(
    "g1_thread_facts_gaps",
    f"""WITH {_GAPPED} SELECT thread_id AS id, count(*) AS message_count, CAST(max(s) AS BIGINT) AS last_s,
    first(id ORDER BY s DESC NULLS LAST, u DESC NULLS LAST) AS latest FROM g GROUP BY thread_id""",
)
def g1(spark, sf_dir):
    named = gapped(spark, sf_dir).withColumn("subject", F.col("id"))
    facts = threads.thread_facts(named)
    return facts.select("id", "message_count", F.unix_seconds("last_sent_at").alias("last_s"), F.col("subject").alias("latest"))


_PAGED = f"{_GAPPED}, k AS (SELECT id, s, u, row_number() OVER (ORDER BY u DESC NULLS LAST, s DESC NULLS LAST, id DESC) - 1 AS spot FROM g)"


@check("h3_all_pages_gaps", f"WITH {_GAPPED} SELECT id, CAST(1 AS BIGINT) AS times FROM g")
def h3(spark, sf_dir):
    """Every message is on one page, though many share a uid or have none."""
    return paging.on_pages(gapped(spark, sf_dir).select("id", "uid", "sent_at"), 200).groupBy("id").agg(F.count("*").alias("times"))


@check("h3_paged", f"WITH {_PAGED} SELECT id, spot // 200 AS page, spot % 200 + 1 AS page_row FROM k")
def h3_paged(spark, sf_dir):
    return paging.paged(gapped(spark, sf_dir).select("id", "uid", "sent_at"), 200).select("id", "page", "page_row")


@check(
    "h3_page_directory",
    f"""WITH {_PAGED}, p AS (SELECT *, lag(u) OVER (ORDER BY spot) AS v, count(*) OVER (PARTITION BY spot // 20) AS n_rows FROM k)
    SELECT spot // 20 AS page, CASE WHEN u IS NULL OR u = v THEN CAST(to_json([CAST(u AS VARCHAR), CAST(CAST(s AS BIGINT) * 1000000 AS VARCHAR), id]) AS VARCHAR) ELSE CAST(u AS VARCHAR) END AS token, n_rows
    FROM p WHERE spot % 20 = 0""",
)
def h3_directory(spark, sf_dir):
    return paging.directory(gapped(spark, sf_dir).select("id", "uid", "sent_at"), 20)


_THREADS = f"{_GAPPED}, t AS (SELECT thread_id AS id, max(s) AS last_s FROM g GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY last_s DESC NULLS LAST, id NULLS LAST) - 1 AS spot FROM t)"


@check("h6_all_thread_pages_gaps", f"WITH {_GAPPED} SELECT thread_id AS id, CAST(1 AS BIGINT) AS times FROM g GROUP BY thread_id")
def h6(spark, sf_dir):
    """Every thread lies behind the token of one page and before that of the next."""
    facts = threads.thread_facts(gapped(spark, sf_dir)).select("id", "last_sent_at")
    return threads.on_thread_pages(facts, threads.thread_directory(facts, 200), 200).groupBy("id").agg(F.count("*").alias("times"))


@check(
    "h6_thread_directory",
    f"""WITH {_THREADS}, p AS (SELECT *, lag(id) OVER (ORDER BY spot) AS before, lag(last_s) OVER (ORDER BY spot) AS before_s, count(*) OVER (PARTITION BY spot // 20) AS n_threads FROM o)
    SELECT spot // 20 AS page, CASE WHEN spot > 0 THEN '[' || coalesce(CAST(CAST(before_s AS BIGINT) * 1000000 AS VARCHAR), 'null') || ',' || CASE WHEN before IS NULL THEN 'null]' ELSE '"' || before || '"]' END END AS token,
      n_threads, id AS first_id FROM p WHERE spot % 20 = 0""",
)
def h6_directory(spark, sf_dir):
    return threads.thread_directory(threads.thread_facts(gapped(spark, sf_dir)), 20)


_GAPPED_ATTEMPTS = f"{ATTEMPTS_SQL}, b AS (SELECT id, CASE WHEN id % 11 <> 0 THEN key END AS key, CASE WHEN id % 13 <> 0 THEN at_ms END AS at_ms FROM attempts)"


def gapped_attempts(spark, sf_dir: str) -> DataFrame:
    df = attempts(spark, sf_dir)
    return df.withColumns({"key": F.when(F.col("id") % 11 != 0, F.col("key")), "at_ms": F.when(F.col("id") % 13 != 0, F.col("at_ms"))})


@check(
    "j1_trailing_gaps",
    f"""WITH {_GAPPED_ATTEMPTS} SELECT id, CASE WHEN key IS NOT NULL AND at_ms IS NOT NULL THEN
    CAST(count(*) OVER (PARTITION BY key, at_ms IS NULL ORDER BY at_ms RANGE BETWEEN {DAY_MS - 1} PRECEDING AND CURRENT ROW) AS BIGINT) END AS n_trailing FROM b""",
)
def j1_trailing(spark, sf_dir):
    return ratelimit.trailing_attempts(gapped_attempts(spark, sf_dir), DAY_MS).select("id", "n_trailing")


@check(
    "j1_undecided_gaps",
    f"WITH {_GAPPED_ATTEMPTS} SELECT id, key IS NULL OR at_ms IS NULL AS undecided FROM b",
)
def j1_undecided(spark, sf_dir):
    found = ratelimit.verdicts(gapped_attempts(spark, sf_dir), DAY_MS, 3)
    return found.select("id", F.col("admitted").isNull().alias("undecided"))


@check(
    "l2_awaiting_aliases",
    f"""WITH {MAIL_SQL} SELECT id, thread_id FROM m a WHERE folder = 'SENT' AND NOT EXISTS
    (SELECT 1 FROM m b WHERE b.thread_id = a.thread_id AND b.folder <> 'SENT' AND b.date_epoch < a.date_epoch)""",
)
def l2(spark, sf_dir):
    """Read backwards, so that sent messages come last, and with folder paths as labels."""
    df = mail(spark, sf_dir)
    back = F.timestamp_seconds(F.lit(4_000_000_000) - F.unix_seconds("sent_at"))
    paths = F.transform("labels", lambda x: F.when(x == "SENT", "Sent Items").otherwise(x))
    return analyses.awaiting_reply(df.withColumns({"sent_at": back, "labels": paths})).select("id", "thread_id")


@check(
    "l2_awaiting_gaps",
    f"""WITH {_GAPPED} SELECT id, thread_id FROM g a WHERE folder = 'SENT' AND NOT EXISTS (SELECT 1 FROM g b WHERE b.folder <> 'SENT'
    AND b.thread_id IS NOT DISTINCT FROM a.thread_id AND coalesce(4000000000 - b.s, -1) > coalesce(4000000000 - a.s, -1))""",
)
def l2_gaps(spark, sf_dir):
    """Read backwards, with sent messages that have no time or no thread."""
    df = gapped(spark, sf_dir)
    return analyses.awaiting_reply(df.withColumn("sent_at", F.timestamp_seconds(F.lit(4_000_000_000) - F.unix_seconds("sent_at")))).select("id", "thread_id")
