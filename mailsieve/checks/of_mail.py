"""Views, search, paging, threads, drafts and reports over all mail."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.checks.corpus import MAIL_SQL, mail, table
from mailsieve.checks.of_policy import _NAME, RUN_SQL
from mailsieve.checks.oracle import domain_hit, q, sql_list
from mailsieve.checks.registry import check
from mailsieve.functions import address as ad
from mailsieve.functions import text as tx
from mailsieve.operators import analyses, drafts, paging, search, threads
from mailsieve.operators.blocklist import thread_blocked
from mailsieve.plans import gateway, requests, views
from mailsieve.policy import Policy
from mailsieve.rules import FINANCIAL_DOMAINS, SYSTEM_LABELS

_EVERY = f"WITH {MAIL_SQL} "


def _listed(column: str):
    """array<struct<name, email>> as one string."""
    return F.array_join(F.transform(column, lambda a: F.concat(a["name"], F.lit("<"), a["email"], F.lit(">"))), ";")


@check(
    "a1_read_messages",
    _EVERY + """SELECT id, thread_id, subject, date, date_epoch AS sent_s, snippet, '' AS cc, array_to_string(labels, ',') AS labels,
    is_unread FROM m""",
)
def a1(spark, sf_dir):
    from mailsieve.sources.messages import conform

    bare = mail(spark, sf_dir).select("id", "thread_id", "subject", "from", "to", "date", "snippet", "body", "labels", "is_unread")
    return conform(bare).select(
        "id", "thread_id", "subject", "date", F.unix_seconds("sent_at").alias("sent_s"), "snippet", _listed("cc").alias("cc"),
        F.array_join("labels", ",").alias("labels"), "is_unread",
    )


# --- scalar functions ------------------------------------------------------
@check(
    "b9_snippet",
    """SELECT doc_id, trim(regexp_replace(substr(text, 1, 200), '[\\t\\n\\v\\f\\r \\x{00A0}]+', ' ', 'g')) AS snippet FROM documents""",
)
def b9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


_SUBJECTS = "concat(CASE doc_id % 5 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'FWD : re:aw: ' WHEN 2 THEN 'Rif:SV:  ' WHEN 3 THEN 'Response: ' ELSE '' END, substr(text, 1, 40), '  ')"
_NORMAL = f"lower(trim(regexp_replace({_SUBJECTS}, '^((Re|Fwd|Fw|AW|SV|TR|Rif)\\s*:\\s*)+', '', 'i')))"


@check("b11_normalize_subject", f"SELECT doc_id, regexp_replace({_NORMAL}, '^\\s+|\\s+$', '', 'g') AS subject FROM documents")
def b11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_subject(F.expr(_SUBJECTS)).alias("subject"))


@check(
    "b10_thread_key",
    f"""SELECT doc_id, concat('imap-thread-', substr(sha256(CASE doc_id % 4 WHEN 0 THEN concat('<r', CAST(doc_id % 17 AS VARCHAR), '>')
    WHEN 1 THEN '<parent@x>' WHEN 2 THEN concat('<', CAST(doc_id AS VARCHAR), '>')
    ELSE regexp_replace({_NORMAL}, '^\\s+|\\s+$', '', 'g') END), 1, 16)) AS thread_id FROM documents""",
)
def b10(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    which = F.col("doc_id") % 4
    refs = F.when(which == 0, F.array(F.concat(F.lit("<r"), (F.col("doc_id") % 17).cast("string"), F.lit(">")), n))
    reply = F.when(which <= 1, F.lit("<parent@x>")).otherwise("")
    own = F.when(which <= 2, F.concat(F.lit("<"), n, F.lit(">")))
    return d.select("doc_id", tx.thread_key(refs, reply, own, F.expr(_SUBJECTS)).alias("thread_id"))


@check(
    "b12_message_id",
    """SELECT page_id, concat(url, ':', CAST(page_id AS VARCHAR)) AS id, url AS folder, page_id AS uid, 'INBOX' AS bare_folder FROM pages""",
)
def b12(spark, sf_dir):
    made = tx.message_id(F.col("url"), F.col("page_id"))
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", made.alias("id"))
        .select(
            "page_id", "id", tx.message_folder(F.col("id")).alias("folder"), tx.message_uid(F.col("id")).alias("uid"),
            tx.message_folder(F.col("page_id").cast("string")).alias("bare_folder"),
        )
    )


@check(
    "b13_is_unread",
    _EVERY + "SELECT id, is_unread AS by_label, NOT is_unread AS by_flag FROM m",
)
def b13(spark, sf_dir):
    flags = F.transform("labels", lambda x: F.when(x == "UNREAD", F.lit(r"\Seen")).otherwise(x))
    return mail(spark, sf_dir).select(
        "id", F.array_contains("labels", "UNREAD").alias("by_label"), (~F.array_contains(flags, r"\Seen")).alias("by_flag")
    )


_RAW_FROM = """CASE WHEN from_name = '' THEN from_email WHEN uid % 3 = 0 THEN concat('"', from_name, '" <', from_email, '>')
  WHEN uid % 3 = 1 THEN concat(from_name, '  ', from_email) ELSE concat(from_name, ' <', from_email, '>') END"""


def _raw_from(df):
    name, email = F.col("from.name"), F.col("from.email")
    return (
        F.when(name == "", email)
        .when(F.col("uid") % 3 == 0, F.concat(F.lit('"'), name, F.lit('" <'), email, F.lit(">")))
        .when(F.col("uid") % 3 == 1, F.concat(name, F.lit("  "), email))
        .otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))
    )


@check(
    "b5_parse_address",
    _EVERY + f"""SELECT id, CASE WHEN contains(from_email, '@') THEN from_name ELSE '' END AS name,
    CASE WHEN contains(from_email, '@') THEN from_email ELSE {_RAW_FROM} END AS email FROM m""",
)
def b5(spark, sf_dir):
    got = ad.parse_address(_raw_from(None))
    return mail(spark, sf_dir).select("id", got["name"].alias("name"), got["email"].alias("email"))


@check(
    "b6_parse_address_list",
    _EVERY + """SELECT id, CASE WHEN uid % 6 = 0 THEN '' ELSE concat(to_name, '<', to_email, '>;<', to_email, '>;Doe<d@x.org>') END AS parsed FROM m""",
)
def b6(spark, sf_dir):
    to = F.col("to")[0]
    raw = F.concat(to["name"], F.lit(" <"), to["email"], F.lit(">, "), to["email"], F.lit(' ,"Doe" <d@x.org>'))
    raw = F.when(F.col("uid") % 6 == 0, "").otherwise(raw)
    return mail(spark, sf_dir).withColumn("p", ad.parse_address_list(raw)).select("id", _listed("p").alias("parsed"))


@check(
    "b7_parse_address_loose",
    _EVERY + """SELECT id, concat(CASE WHEN from_name = '' THEN '' ELSE from_name END, '<', from_email, '>;<', to_email, '>') AS parsed FROM m""",
)
def b7(spark, sf_dir):
    name = F.col("from.name")
    first = F.when(name == "", F.col("from.email")).otherwise(F.concat(F.lit("'"), name, F.lit("' <"), F.col("from.email"), F.lit(">")))
    raw = F.concat(first, F.lit(",, "), F.col("to")[0]["email"], F.lit(" ,"))
    return mail(spark, sf_dir).withColumn("p", ad.parse_address_list_loose(raw)).select("id", _listed("p").alias("parsed"))


@check(
    "b8_flatten_groups",
    _EVERY + "SELECT id, concat(from_name, '<', from_email, '>;', to_name, '<', to_email, '>;<>') AS parsed FROM m",
)
def b8(spark, sf_dir):
    nobody = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("email"))
    groups = F.array(F.array("from"), F.concat("to", F.array(nobody)))
    return mail(spark, sf_dir).withColumn("p", ad.flatten_address_groups(groups)).select("id", _listed("p").alias("parsed"))


@check(
    "b14_defaults",
    """SELECT page_id, '(no subject)' AS subject, concat('<', '>') AS sender, 'unnamed/application/octet-stream/0' AS attachment,
    '2026-01-01T00:00:00.000Z' AS date FROM pages""",
)
def b14(spark, sf_dir):
    from datetime import datetime, timezone

    from mailsieve.sources.eml import from_eml

    part = "--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment\r\n\r\n\r\n--b--\r\n"
    source = F.concat(
        F.lit("MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\n"
              "Content-Transfer-Encoding: base64\r\n\r\n"),
        F.base64(F.encode("url", "UTF-8")),
        F.lit("\r\n" + part),
    )
    raw = table(spark, sf_dir, "pages").select(
        F.lit("INBOX").alias("folder"), F.col("page_id").alias("uid"), F.array().cast("array<string>").alias("flags"),
        F.encode(source, "UTF-8").alias("source"),
    )
    out = from_eml(raw, datetime(2026, 1, 1, tzinfo=timezone.utc))
    a = F.col("attachments")[0]
    return out.select(
        F.col("uid").alias("page_id"), "subject", F.concat("from.name", F.lit("<"), "from.email", F.lit(">")).alias("sender"),
        F.concat_ws("/", a["filename"], a["mime_type"], a["size"].cast("string")).alias("attachment"), "date",
    )


@check(
    "b15_format_address",
    _EVERY + f"SELECT id, {_NAME.format('from_name')} AS redacted, concat(from_name, ' <', from_email, '>') AS plain FROM m",
)
def b15(spark, sf_dir):
    return mail(spark, sf_dir).select(
        "id", ad.format_address(F.col("from")).alias("redacted"), ad.format_address(F.col("from"), False).alias("plain")
    )


@check(
    "b16_format_addresses",
    _EVERY + f"""SELECT id, concat({_NAME.format('from_name')}, ';', {_NAME.format('to_name')}) AS redacted FROM m""",
)
def b16(spark, sf_dir):
    both = F.concat(F.array("from"), F.col("to"))
    return mail(spark, sf_dir).select("id", F.array_join(ad.format_addresses(both), ";").alias("redacted"))


@check(
    "b22_parse_date",
    """WITH d AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT + (o_orderkey % 86400) AS s FROM orders)
    SELECT o_orderkey, s AS iso_s, s AS rfc_s, s - 7200 AS offset_s, CAST(NULL AS BIGINT) AS bad_s FROM d""",
)
def b22(spark, sf_dir):
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
    at = F.timestamp_seconds(s)
    rfc = F.date_format(at, "EEE, d MMM yyyy HH:mm:ss")
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.iso_utc(at).alias("iso"), F.concat(rfc, F.lit(" GMT")).alias("rfc"),
        F.concat(rfc, F.lit(" +0200 (CEST)")).alias("off"), F.concat(F.lit("on "), rfc).alias("bad"),
    )
    read = {"iso_s": "iso", "rfc_s": "rfc", "offset_s": "off", "bad_s": "bad"}
    return df.select("o_orderkey", *(F.unix_seconds(tx.parse_date(F.col(c))).alias(n) for n, c in read.items()))


@check(
    "b23_key_fingerprint",
    "SELECT doc_id, sha256(text) AS fingerprint, substr(text, 1, 8) AS prefix FROM documents",
)
def b23(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"), tx.key_prefix(F.col("text")).alias("prefix")
    )


# --- views -----------------------------------------------------------------
@check(
    "b17_search_view",
    f"""WITH {RUN_SQL} SELECT id, thread_id, subject, {_NAME.format('from_name')} AS "from", date, snippet, is_unread,
    array_to_string(labels, ',') AS labels, false AS has_attachments FROM e WHERE action = 'pass'""",
)
def b17(spark, sf_dir):
    return views.search_view(gateway.passed(mail(spark, sf_dir))).withColumn("labels", F.array_join("labels", ","))


@check(
    "b18_message_view",
    _EVERY + """SELECT id, thread_id, subject, concat(from_name, ' <', from_email, '>') AS "from", concat(to_name, ' <', to_email, '>') AS "to",
    CASE WHEN cc_email IS NULL THEN '' ELSE concat(' <', cc_email, '>') END AS cc, date, body, array_to_string(labels, ',') AS labels,
    is_unread, CASE WHEN n_attachments = 1 THEN concat('file', CAST(uid AS VARCHAR), '.pdf/application/pdf/', CAST(uid * 1000 AS VARCHAR)) ELSE '' END AS attachments FROM m""",
)
def b18(spark, sf_dir):
    open_policy = Policy(email_redaction=False)
    files = F.transform("attachments", lambda a: F.concat_ws("/", a["filename"], a["mime_type"], a["size"].cast("string")))
    joined = {c: F.array_join(c, ",") for c in ("to", "cc", "labels")} | {"attachments": F.array_join(files, ",")}
    return views.message_view(mail(spark, sf_dir), open_policy).withColumns(joined)


@check(
    "b19_thread_message_view",
    f"""WITH {RUN_SQL} SELECT id, {_NAME.format('from_name')} AS "from", {_NAME.format('to_name')} AS "to",
    CASE WHEN cc_email IS NULL THEN '' ELSE '[Name Unavailable]' END AS cc, date, body, CAST(0 AS INTEGER) AS n_attachments FROM e WHERE action = 'pass'""",
)
def b19(spark, sf_dir):
    shown = views.thread_message_view(gateway.passed(mail(spark, sf_dir)))
    joined = {c: F.array_join(c, ",") for c in ("to", "cc")}
    return shown.withColumns(joined).withColumn("n_attachments", F.size("attachments")).drop("attachments")


# --- threads ---------------------------------------------------------------
def _people_sql(order: str, with_to: bool = True) -> str:
    to = f"UNION ALL SELECT thread_id, to_email, to_name, {order}, 1 FROM m" if with_to else ""
    return f"""a AS (SELECT thread_id, from_email AS email, from_name AS name, {order} AS ord, 0 AS pos FROM m {to}),
    pp AS (SELECT thread_id, email, min([ord[1], ord[2], pos]) AS first_seen, arg_max(name, [ord[1], ord[2], pos]) AS name FROM a GROUP BY ALL),
    p AS (SELECT thread_id, string_agg(concat(name, '<', email, '>'), ';' ORDER BY first_seen) AS participants,
      list(email ORDER BY first_seen) AS emails FROM pp GROUP BY ALL),
    ll AS (SELECT thread_id, label, min([ord[1], ord[2], pos]) AS first_seen FROM
      (SELECT thread_id, {order} AS ord, unnest(labels) AS label, unnest(range(len(labels))) AS pos FROM m) GROUP BY ALL),
    l AS (SELECT thread_id, string_agg(label, ',' ORDER BY first_seen) AS labels FROM ll GROUP BY ALL)"""


_DESC, _ASC = "[-date_epoch, -uid]", "[date_epoch, -uid]"
_FACTS = """t AS (SELECT thread_id, count(*) AS message_count, bool_or(is_unread) AS is_unread,
    arg_max(snippet, [date_epoch, uid]) AS snippet, max(date_epoch) AS last_s,
    arg_max(subject, [date_epoch, uid]) AS latest_subject, arg_min(subject, [date_epoch, -uid]) AS first_subject FROM m GROUP BY ALL)"""


def _thread_rows(df):
    return df.select(
        "id", "subject", "message_count", "snippet", F.unix_seconds("last_sent_at").alias("last_s"), "is_unread",
        _listed("participants").alias("participants"), F.array_join("labels", ",").alias("labels"),
    )


def _threads_sql(order: str, subject: str, with_to: bool = True) -> str:
    return f"""WITH {MAIL_SQL}, {_FACTS}, {_people_sql(order, with_to)}
    SELECT t.thread_id AS id, {subject} AS subject, message_count, snippet, last_s, is_unread, participants, labels
    FROM t JOIN p USING (thread_id) JOIN l USING (thread_id)"""


@check("g1_threads", _threads_sql(_DESC, "latest_subject"))
def g1(spark, sf_dir):
    return _thread_rows(threads.threads(mail(spark, sf_dir)))


@check("g3_threads_senders_only", _threads_sql(_ASC, "first_subject", with_to=False))
def g3(spark, sf_dir):
    return _thread_rows(threads.threads(mail(spark, sf_dir), newest_first=False, subject_from="first", include_to=False))


@check("g4_threads_first_subject", _threads_sql(_ASC, "first_subject"))
def g4(spark, sf_dir):
    return _thread_rows(threads.threads(mail(spark, sf_dir), newest_first=False, subject_from="first"))


@check(
    "g2_thread_participants",
    f"WITH {MAIL_SQL}, {_people_sql(_DESC)} SELECT thread_id, email, name FROM pp",
)
def g2(spark, sf_dir):
    return threads.thread_participants(mail(spark, sf_dir)).select("thread_id", "email", "name")


@check("g5_thread_labels", f"WITH {MAIL_SQL}, {_people_sql(_DESC)} SELECT thread_id, label FROM ll")
def g5(spark, sf_dir):
    return threads.thread_labels(mail(spark, sf_dir)).select("thread_id", "label")


_HIDE = "list_transform(names, lambda nm: CASE WHEN trim(nm) = '' OR regexp_matches(trim(nm), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') THEN '[Name Unavailable]' ELSE trim(nm) END)"


@check(
    "b20_thread_view",
    f"""WITH {MAIL_SQL}, {_FACTS}, {_people_sql(_DESC)}, n AS (SELECT thread_id, list(name ORDER BY first_seen) AS names FROM pp GROUP BY ALL)
    SELECT thread_id AS id, latest_subject AS subject, array_to_string({_HIDE}, ';') AS participants, message_count, snippet,
    strftime(to_timestamp(last_s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') AS last_message_date, is_unread, labels
    FROM t JOIN n USING (thread_id) JOIN l USING (thread_id)""",
)
def b20(spark, sf_dir):
    shown = views.thread_view(threads.threads(mail(spark, sf_dir)))
    return shown.withColumns({"participants": F.array_join("participants", ";"), "labels": F.array_join("labels", ",")})


@check(
    "c11_blocked_threads",
    f"""WITH {MAIL_SQL}, {_people_sql(_DESC)}, b AS (SELECT thread_id, bool_and(split_part(lower(email), '@', 2) IN ('example.com', 'alerts.chase.com')) AS thread_blocked FROM pp GROUP BY ALL)
    SELECT thread_id, thread_blocked, thread_blocked AS by_list FROM b""",
)
def c11(spark, sf_dir):
    policy = Policy(blocked_domains=("example.com",))
    df = mail(spark, sf_dir)
    lists = threads.threads(df).select(
        F.col("id").alias("thread_id"), thread_blocked(F.col("participants"), policy).alias("by_list")
    )
    return threads.blocked_threads(df, policy).join(lists, "thread_id")


@check(
    "c12_allowed_labels",
    _EVERY + """SELECT label AS id, count(*) AS messages_total FROM (SELECT unnest(labels) AS label FROM m)
    WHERE lower(label) IN ('inbox', 'starred') GROUP BY ALL""",
)
def c12(spark, sf_dir):
    policy = Policy(allowed_folders=("Inbox", "STARRED"))
    return threads.allowed_labels(threads.label_stats(mail(spark, sf_dir)), policy).select("id", "messages_total")


_LABEL_SQL = f"""WITH {MAIL_SQL}, s AS (SELECT label, count(*) AS n, count(*) FILTER (is_unread) AS u FROM (SELECT unnest(labels) AS label, is_unread FROM m) GROUP BY ALL),
  d AS (SELECT unnest([{', '.join(map(q, SYSTEM_LABELS))}]) AS label)
  SELECT coalesce(s.label, d.label) AS id, coalesce(s.label, d.label) AS name, CASE WHEN d.label IS NULL THEN 'user' ELSE 'system' END AS type,
  coalesce(n, 0) AS messages_total, coalesce(u, 0) AS messages_unread FROM s FULL JOIN d ON s.label = d.label"""


def _label_dim(spark):
    return spark.createDataFrame([(x, x, "system") for x in SYSTEM_LABELS], "id string, name string, type string")


@check("g6_label_stats", _LABEL_SQL)
def g6(spark, sf_dir):
    return threads.label_stats(mail(spark, sf_dir), _label_dim(spark))


@check("b21_label_view", _LABEL_SQL)
def b21(spark, sf_dir):
    return requests.list_labels(mail(spark, sf_dir), dim=_label_dim(spark))


@check(
    "h5_latest_per_thread",
    _EVERY + """SELECT id, thread_id, subject FROM m QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY date_epoch DESC, uid DESC) = 1""",
)
def h5(spark, sf_dir):
    return threads.latest_per_thread(mail(spark, sf_dir)).select("id", "thread_id", "subject")


@check(
    "h6_thread_page",
    f"""WITH {MAIL_SQL}, {_FACTS}, {_people_sql(_DESC)} SELECT thread_id AS id, latest_subject AS subject, message_count, participants
    FROM t JOIN p USING (thread_id) ORDER BY last_s DESC, thread_id LIMIT 25""",
)
def h6(spark, sf_dir):
    page = threads.thread_page(mail(spark, sf_dir), 25)
    return page.select("id", "subject", "message_count", _listed("participants").alias("participants"))


@check(
    "h7_thread_page_scan_cap",
    f"""WITH {MAIL_SQL}, k AS (SELECT * FROM m ORDER BY uid DESC LIMIT 60), t AS (SELECT thread_id, count(*) AS message_count, max(date_epoch) AS last_s FROM k GROUP BY ALL)
    SELECT thread_id AS id, message_count FROM t ORDER BY last_s DESC, thread_id LIMIT 20""",
)
def h7(spark, sf_dir):
    return threads.thread_page(mail(spark, sf_dir), 20, scan=60).select("id", "message_count")


@check(
    "h7_thread_page_since",
    f"""WITH {MAIL_SQL}, t AS (SELECT thread_id, count(*) AS message_count, max(date_epoch) AS last_s FROM m WHERE date_epoch >= {1767225600 + 30 * 86400} GROUP BY ALL)
    SELECT thread_id AS id, message_count FROM t ORDER BY last_s DESC, thread_id LIMIT 20""",
)
def h7_since(spark, sf_dir):
    return threads.thread_page(mail(spark, sf_dir), 20, since="2026-01-31 00:00:00").select("id", "message_count")


@check(
    "h8_message_position",
    _EVERY + "SELECT id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY date_epoch, uid DESC) AS position FROM m",
)
def h8(spark, sf_dir):
    return threads.with_position(mail(spark, sf_dir)).select("id", "thread_id", "position")


@check(
    "h8_document_position",
    """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id DESC) AS position FROM documents""",
)
def h8_documents(spark, sf_dir):
    """A few very large threads: every source is one."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("source").alias("thread_id"), F.col("doc_id").alias("uid"), F.timestamp_seconds("n_chars").alias("sent_at")
    )
    return threads.with_position(docs, part_rows=500).select("doc_id", "source", "position")


# --- search and pages ------------------------------------------------------
def _search(name: str, query: str, where: str, **options) -> None:
    @check(name, _EVERY + f"SELECT id FROM m WHERE {where}")
    def run(spark, sf_dir):
        return search.search(mail(spark, sf_dir), query, **options).select("id")


_IN = "list_contains(labels, 'INBOX')"
_search("c13_search_from", "from:USER1", f"{_IN} AND contains(lower(concat(from_name, ' <', from_email, '>')), 'user1')")
_search("c13_search_to_unread", "to:user4@ is:unread", f"{_IN} AND is_unread AND contains(to_email, 'user4@')")
_search(
    "c13_search_dates",
    "in:sent after:2026/02/01 before:2026-06-15 before:2026/13/77",
    "(folder = 'SENT') AND date_epoch >= 1769904000 AND date_epoch < 1781481600",
)
_search("c13_search_flagged_read", "is:starred is:read is:odd", f"{_IN} AND uid % 7 = 0 AND NOT is_unread")
_search("c13_search_last_wins", "subject:nothing subject:topic", f"{_IN} AND contains(lower(subject), 'topic')")
_search("c14_search_free_text", "Topic 1", f"{_IN} AND contains(lower(subject), 'topic 1')")
_search("c14_search_unknown_op", 'subject:re: has:attachment', f"{_IN} AND contains(lower(subject), 're: has:attachment')")
_search("c14_search_unknown_found", "Re: Fwd: Project", f"{_IN} AND contains(lower(subject), 're: fwd: project')")
_search("c15_search_quotes_found", "subject:\"Fwd: Project\" 'plan'", f"{_IN} AND contains(lower(subject), 'fwd: project plan')")
_search("c15_search_quotes", "subject:\"Re: Fwd\" 'Project", f"{_IN} AND contains(lower(subject), 're: fwd project')")
_search("c16_search_folder", "label:CATEGORY_PROMOTIONS", "folder = 'CATEGORY_PROMOTIONS'")
_search("c16_search_everywhere", "in:all", "true", paths=[])
_search(
    "c17_search_wide",
    "has:attachment filename:.PDF larger:100K body:an",
    f"{_IN} AND n_attachments = 1 AND uid * 1000 > 102400 AND contains(lower(body), 'an')",
    wide=True,
)


@check(
    "c16_resolve_folders",
    """WITH b AS (SELECT concat('c', CAST(c_custkey % 50 AS VARCHAR)) AS connection_id, c_custkey AS position,
      CASE WHEN c_custkey % 50 = 7 AND c_custkey % 7 <= 3 THEN concat('F', CAST(c_custkey AS VARCHAR)) ELSE CASE c_custkey % 7 WHEN 0 THEN 'sent items' WHEN 1 THEN 'Work' WHEN 2 THEN 'Sent Messages' WHEN 3 THEN 'Out' ELSE concat('F', CAST(c_custkey AS VARCHAR)) END END AS path,
      CASE WHEN c_custkey % 7 = 3 AND c_custkey % 50 < 10 AND c_custkey % 50 <> 7 THEN '\\Sent' END AS special_use FROM customer),
    r AS (SELECT *, CASE WHEN special_use = '\\Sent' THEN 0 WHEN lower(path) = 'sent' THEN 1 WHEN lower(path) = 'sent messages' THEN 2
      WHEN lower(path) = 'sent items' THEN 3 END AS rank FROM b)
    SELECT connection_id, coalesce(arg_min(path, [rank, position]) FILTER (rank IS NOT NULL), 'Sent') AS path FROM r GROUP BY ALL""",
)
def c16(spark, sf_dir):
    k = F.col("c_custkey")
    other = F.concat(F.lit("F"), k.cast("string"))
    boxes = table(spark, sf_dir, "customer").select(  # the connection c7 has no folder of the kind
        F.concat(F.lit("c"), (k % 50).cast("string")).alias("connection_id"),
        k.alias("position"),
        F.when((k % 50 == 7) & (k % 7 <= 3), other).when(k % 7 == 0, "sent items").when(k % 7 == 1, "Work").when(k % 7 == 2, "Sent Messages").when(k % 7 == 3, "Out")
        .otherwise(other).alias("path"),
        F.when((k % 7 == 3) & (k % 50 < 10) & (k % 50 != 7), r"\Sent").alias("special_use"),
    )
    return search.resolve_folders(boxes, "sent")


@check("h2_newest", _EVERY + "SELECT id, uid FROM m ORDER BY uid DESC LIMIT 50")
def h2(spark, sf_dir):
    return paging.newest(mail(spark, sf_dir), 50).select("id", "uid")


@check(
    "h3_keyset_page",
    _EVERY + """, p AS (SELECT id, uid, row_number() OVER (ORDER BY uid DESC) AS page_row FROM m WHERE uid <= 900)
    SELECT id, uid, CAST(page_row AS INTEGER) AS page_row, page_row = 31 AS starts_next FROM p WHERE page_row <= 31""",
)
def h3(spark, sf_dir):
    page = paging.keyset_page(mail(spark, sf_dir).select("id", "uid"), 30, token="900")
    return page.rows.unionAll(page.ahead.drop("page_token")).withColumn("starts_next", F.col("page_row") == 31)


@check(
    "h4_offset_page",
    _EVERY + """, p AS (SELECT id, uid, row_number() OVER (ORDER BY uid DESC) - 20 AS page_row FROM m)
    SELECT id, CAST(page_row AS INTEGER) AS page_row FROM p WHERE page_row BETWEEN 1 AND 50""",
)
def h4(spark, sf_dir):
    page = paging.offset_page(mail(spark, sf_dir).select("id", "uid"), F.desc("uid"), n=paging.SCRIPT_PAGE, offset=20)
    return page.rows.select("id", "page_row")


@check(
    "g10_result_sizes",
    _EVERY + """SELECT (SELECT count(*) FROM m) AS exact, least((SELECT count(*) FROM m), 31) AS at_least,
    (SELECT count(*) FROM m) > 30 AS has_more""",
)
def g10(spark, sf_dir):
    df = mail(spark, sf_dir).select("uid")
    seen = paging.offset_total(paging.offset_page(df, F.desc("uid"), n=10, offset=20), 20)
    return requests.side_by_side(df.agg(F.count("*").alias("exact")), seen.withColumnRenamed("total", "at_least"))


@check(
    "a9_search_page_view",
    f"""WITH {RUN_SQL}, p AS (SELECT * FROM e WHERE list_contains(labels, 'INBOX') ORDER BY uid DESC LIMIT 40)
    SELECT id, subject, snippet, {_NAME.format('from_name')} AS "from" FROM p WHERE action = 'pass'""",
)
def a9_page(spark, sf_dir):
    return requests.search_emails(mail(spark, sf_dir), "", n=40).select("id", "subject", "snippet", "from")


@check(
    "a9_search_response",
    f"""WITH {RUN_SQL}, fd AS (SELECT * FROM e WHERE list_contains(labels, 'INBOX')),
    pg AS (SELECT * FROM fd ORDER BY uid DESC LIMIT 40),
    rw AS (SELECT to_json(list(json_object('id', id, 'thread_id', thread_id, 'subject', subject, 'from', {_NAME.format('from_name')}, 'date', date,
      'snippet', snippet, 'is_unread', is_unread, 'labels', labels, 'has_attachments', false) ORDER BY uid DESC)) AS rows FROM pg WHERE action = 'pass')
    SELECT concat('{{"results":', CAST(rows AS VARCHAR), ',"total_results":', CAST((SELECT count(*) FROM fd) AS VARCHAR), ',"next_page_token":"',
    CAST((SELECT uid FROM fd ORDER BY uid DESC LIMIT 1 OFFSET 40) AS VARCHAR), '","filtered_count":',
    CAST((SELECT count(*) FROM pg WHERE action = 'block') AS VARCHAR), '}}') AS response FROM rw""",
)
def a9(spark, sf_dir):
    return requests.search_response(mail(spark, sf_dir), "", n=40)


@check(
    "a9_message_json",
    f"""WITH {RUN_SQL} SELECT id, CAST(json_object('id', id, 'thread_id', thread_id, 'subject', subject, 'from', {_NAME.format('from_name')}, 'date', date,
    'snippet', snippet, 'is_unread', is_unread, 'labels', labels, 'has_attachments', false) AS VARCHAR) AS response FROM e WHERE action = 'pass'""",
)
def a9_each(spark, sf_dir):
    return requests.to_response(views.search_view(gateway.passed(mail(spark, sf_dir))))


# --- drafts ----------------------------------------------------------------
@check(
    "a7_list_drafts",
    _EVERY + """SELECT id, id AS message_id, concat(to_name, '<', to_email, '>') AS "to", subject, snippet, date AS updated_at
    FROM m WHERE uid % 4 = 1 ORDER BY uid DESC LIMIT 60""",
)
def a7(spark, sf_dir):
    return drafts.list_drafts(mail(spark, sf_dir), 60).withColumn("to", _listed("to"))


@check(
    "b21_draft_view",
    _EVERY + """SELECT id, id AS message_id, concat(to_name, ' <', to_email, '>') AS "to", subject, snippet, date AS updated_at
    FROM m WHERE uid % 4 = 1 ORDER BY uid DESC LIMIT 20""",
)
def b21_drafts(spark, sf_dir):
    shown = requests.list_drafts(mail(spark, sf_dir), Policy(email_redaction=False))
    return shown.withColumn("to", F.array_join("to", ","))


def _draft_requests(spark, sf_dir):
    """One request per document: some name recipients, some reply to a thread."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("request_id"),
        F.when(n % 3 == 0, F.array(F.lit("a@x.org"), F.format_string("u%d@x.org", n))).alias("to"),
        F.substring("text", 1, 30).alias("subject"),
        F.col("text").alias("body"),
        F.when(n % 3 == 1, F.concat(F.lit("t"), (n % 120).cast("string"))).alias("in_reply_to"),
    )


_DRAFT_SQL = f"""WITH {MAIL_SQL}, {_people_sql(_ASC)}, d AS (SELECT doc_id AS request_id, substr(text, 1, 30) AS subject, text AS body,
  CASE WHEN doc_id % 3 = 0 THEN ['a@x.org', concat('u', CAST(doc_id AS VARCHAR), '@x.org')] ELSE coalesce(emails, []) END AS recipients
  FROM documents LEFT JOIN p ON doc_id % 3 = 1 AND p.thread_id = concat('t', CAST(doc_id % 120 AS VARCHAR))),
  w AS (SELECT *, concat('To: ', array_to_string(recipients, ', '), chr(13), chr(10), 'Subject: ', subject, chr(13), chr(10),
    'Content-Type: text/plain; charset="UTF-8"', chr(13), chr(10), chr(13), chr(10), body) AS mime FROM d)"""


@check(
    "f3_draft_recipients",
    _DRAFT_SQL + f""" SELECT request_id, array_to_string(recipients, ',') AS recipients,
    CASE WHEN len(recipients) = 0 THEN {q(drafts.NO_RECIPIENTS)} END AS error FROM d""",
)
def f3(spark, sf_dir):
    out = drafts.resolve_recipients(_draft_requests(spark, sf_dir), mail(spark, sf_dir))
    return out.select("request_id", F.array_join("recipients", ",").alias("recipients"), "error")


@check(
    "a8_build_drafts",
    _DRAFT_SQL + f""" SELECT request_id, CASE WHEN len(recipients) > 0 THEN mime END AS mime,
    CASE WHEN len(recipients) > 0 THEN rtrim(translate(to_base64(encode(mime)), '+/', '-_'), '=') END AS raw,
    CASE WHEN len(recipients) > 0 THEN {q(drafts.CREATED)} END AS status FROM w""",
)
def a8(spark, sf_dir):
    out = drafts.build_drafts(drafts.resolve_recipients(_draft_requests(spark, sf_dir), mail(spark, sf_dir)))
    return out.select("request_id", "mime", "raw", "status")


# --- reports ---------------------------------------------------------------
@check(
    "l1_top_senders",
    _EVERY + """SELECT from_email AS email, count(*) AS n_messages, count(*) FILTER (is_unread) AS n_unread FROM m GROUP BY ALL
    ORDER BY n_messages DESC, email LIMIT 10""",
)
def l1(spark, sf_dir):
    return analyses.top_senders(mail(spark, sf_dir), 10)


@check(
    "l1_label_distribution",
    _EVERY + """SELECT label, count(*) AS n_messages, count(*) FILTER (is_unread) AS n_unread FROM (SELECT unnest(labels) AS label, is_unread FROM m) GROUP BY ALL""",
)
def l1_labels(spark, sf_dir):
    return analyses.label_distribution(mail(spark, sf_dir))


@check(
    "l2_awaiting_reply",
    _EVERY + """SELECT id, thread_id FROM m a WHERE folder = 'SENT' AND NOT EXISTS
    (SELECT 1 FROM m b WHERE b.thread_id = a.thread_id AND b.folder <> 'SENT' AND b.date_epoch > a.date_epoch)""",
)
def l2(spark, sf_dir):
    return analyses.awaiting_reply(mail(spark, sf_dir)).select("id", "thread_id")


@check(
    "l3_unanswered",
    _EVERY + """, x AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY date_epoch DESC, uid DESC) = 1)
    SELECT thread_id, id, from_email AS email FROM x WHERE folder <> 'SENT' AND split_part(lower(from_email), '@', 2) = 'example.com'
    AND date_epoch >= 1767225600 AND date_epoch < 1772323200""",
)
def l3(spark, sf_dir):
    from datetime import datetime, timezone

    since, until = datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 3, 1, tzinfo=timezone.utc)
    return analyses.unanswered(mail(spark, sf_dir), "example.com", since, until).select("thread_id", "id", "email")


@check(
    "l4_history",
    _EVERY + "SELECT id, date FROM m WHERE split_part(lower(from_email), '@', 2) IN ('chase.com', 'alerts.chase.com')",
)
def l4(spark, sf_dir):
    return analyses.history(mail(spark, sf_dir), "chase.com").select("id", "date")


@check(
    "l5_subscriptions",
    _EVERY + """SELECT from_email AS email, count(*) AS n_messages, count(*) FILTER (is_unread) AS n_unread, max(date_epoch) AS last_s
    FROM m WHERE folder = 'CATEGORY_PROMOTIONS' GROUP BY ALL""",
)
def l5(spark, sf_dir):
    return analyses.subscriptions(mail(spark, sf_dir)).select(
        "email", "n_messages", "n_unread", F.unix_seconds("last_sent_at").alias("last_s")
    )


@check(
    "l6_transcripts",
    _EVERY + """SELECT thread_id, CAST(0 AS BIGINT) AS part, count(*) AS n_messages,
    string_agg(concat(CASE WHEN from_name = '' THEN from_email ELSE from_name END, ': ', body), concat(chr(10), chr(10)) ORDER BY date_epoch, uid DESC) AS transcript
    FROM m GROUP BY thread_id""",
)
def l6(spark, sf_dir):
    return analyses.transcripts(mail(spark, sf_dir))


@check(
    "g1_list_threads",
    f"""WITH {MAIL_SQL}, t AS (SELECT thread_id, arg_max(subject, [date_epoch, uid]) AS subject, max(date_epoch) AS last_s,
      bool_and({domain_hit("split_part(lower(from_email), '@', 2)", sql_list(FINANCIAL_DOMAINS))} AND {domain_hit("split_part(lower(to_email), '@', 2)", sql_list(FINANCIAL_DOMAINS))}) AS gone FROM m WHERE folder = 'INBOX' GROUP BY ALL)
    SELECT thread_id AS id, subject FROM t WHERE NOT gone ORDER BY last_s DESC, thread_id LIMIT 30""",
)
def g1_page(spark, sf_dir):
    return requests.list_threads(mail(spark, sf_dir), n=30).select("id", "subject")


_SHUT = Policy(blocked_domains=("example.com", "notchase.com"))
_SHUT_THREADS = f"""{MAIL_SQL}, w AS (SELECT thread_id AS id, count(*) AS message_count, max(date_epoch) AS last_s, bool_and(split_part(lower(from_email), '@', 2) <> '') AS gone
    FROM m WHERE folder = 'INBOX' GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY last_s DESC, id) AS n FROM w)"""


@check("c11_list_threads_blocked", f"WITH {_SHUT_THREADS} SELECT id, message_count FROM o WHERE n <= 30 AND NOT gone")
def c11_blocked(spark, sf_dir):
    """Threads whose every participant is on a blocked domain are left out."""
    return requests.list_threads(mail(spark, sf_dir), "", _SHUT, n=30).select("id", "message_count")


@check(
    "a9_threads_response",
    f"""WITH {_SHUT_THREADS} SELECT (SELECT string_agg(id || ':' || message_count, ',' ORDER BY n) FROM o WHERE n <= 30 AND NOT gone) AS threads,
    (SELECT count(*) FROM o) AS total_results, (SELECT '[' || last_s || '000000,"' || id || '"]' FROM o WHERE n = 30 AND (SELECT count(*) FROM o) > 30) AS next_page_token,
    (SELECT nullif(count(*), 0) FROM o WHERE n <= 30 AND gone) AS filtered_count""",
)
def a9_threads(spark, sf_dir):
    answer = requests.threads_response(mail(spark, sf_dir), "", _SHUT, n=30)
    read = "threads array<struct<id:string,message_count:long>>, total_results long, next_page_token string, filtered_count long"
    parsed = answer.select(F.from_json("response", read).alias("r")).select("r.*")
    return parsed.withColumn("threads", F.array_join(F.transform("threads", lambda t: F.concat(t["id"], F.lit(":"), t["message_count"])), ","))


@check(
    "a9_thread_response",
    f"""WITH {RUN_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY date, uid DESC) - 1 AS place FROM e WHERE thread_id = 't7')
    SELECT place // 2 AS part, 't7' AS thread_id, (SELECT count(*) FROM t) AS message_count, coalesce(string_agg(id, ',' ORDER BY place) FILTER (action = 'pass'), '') AS ids,
      coalesce(string_agg(body, ',' ORDER BY place) FILTER (action = 'pass'), '') AS bodies, (SELECT nullif(count(*), 0) FROM t WHERE action = 'block') AS filtered_count
    FROM t GROUP BY ALL""",
)
def a9_thread(spark, sf_dir):
    answer = requests.thread_response(mail(spark, sf_dir), "t7", part_size=2)
    read = "thread_id string, message_count long, messages array<struct<id:string,body:string>>, filtered_count long"
    parsed = answer.select("part", F.from_json("response", read).alias("r")).select("part", "r.*")
    ids, bodies = (F.array_join(F.transform("messages", lambda m: m[c]), ",").alias(name) for c, name in (("id", "ids"), ("body", "bodies")))
    return parsed.select("part", "thread_id", "message_count", ids, bodies, "filtered_count")
