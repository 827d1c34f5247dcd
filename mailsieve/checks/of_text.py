"""Text functions over all documents, mail bodies and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsieve.checks.corpus import MAIL_SQL, TEXTS_SQL, mail, table, texts
from mailsieve.checks.oracle import PII, html_to_text, labels, pii, pii_step, strip, warned
from mailsieve.checks.registry import check
from mailsieve.functions import injection as inj
from mailsieve.functions.redact import redact, redact_kind, redact_pii
from mailsieve.functions.sanitize import body_or_html, strip_invisible
from mailsieve.functions.sanitize import html_to_text as to_text
from mailsieve.plans.gateway import flag_injections, redact_columns, strip_attachments
from mailsieve.policy import Policy


def _one_kind(name: str, kind: str) -> None:
    sql = f"WITH {TEXTS_SQL} SELECT id, {pii_step('text', kind)} AS redacted FROM x"

    @check(name, sql)
    def run(spark, sf_dir):
        return texts(spark, sf_dir).select("id", redact_kind(F.col("text"), kind).alias("redacted"))


for _i, _kind in enumerate(PII, 1):
    _one_kind(f"d{_i}_{_kind}", _kind)


@check("d15_redact_all", f"WITH {TEXTS_SQL} SELECT id, {pii('text')} AS redacted FROM x")
def d15(spark, sf_dir):
    return texts(spark, sf_dir).select("id", redact_pii(F.col("text")).alias("redacted"))


@check(
    "d16_redact_action",
    f"""WITH {MAIL_SQL}, r AS (SELECT id, body, subject, snippet, {pii('body')} AS b2, {pii('subject')} AS s2,
    {pii('snippet')} AS n2 FROM m)
    SELECT id, CASE WHEN body <> b2 OR subject <> s2 OR snippet <> n2 THEN 'redact' ELSE 'pass' END AS action,
    CASE WHEN body <> b2 OR subject <> s2 OR snippet <> n2 THEN 'PII patterns redacted' END AS reason FROM r""",
)
def d16(spark, sf_dir):
    done = redact_columns(mail(spark, sf_dir), Policy())
    return done.select(
        "id",
        F.when(F.col("pii_redacted"), "redact").otherwise("pass").alias("action"),
        F.when(F.col("pii_redacted"), "PII patterns redacted").alias("reason"),
    )


@check("d17_redact_master_off", f"WITH {TEXTS_SQL} SELECT id, text AS redacted FROM x")
def d17(spark, sf_dir):
    off = Policy(pii_redaction=False)
    return texts(spark, sf_dir).select("id", redact(F.col("text"), off).alias("redacted"))


@check(
    "d18_redact_partial",
    f"WITH {TEXTS_SQL} SELECT id, {pii('text', emails='false', dollars='false')} AS redacted FROM x",
)
def d18(spark, sf_dir):
    some = Policy(email_redaction=False, dollar_amount_redaction=False)
    return texts(spark, sf_dir).select("id", redact(F.col("text"), some).alias("redacted"))


@check(
    "d19_strip_attachments",
    f"""WITH {MAIL_SQL} SELECT id, CAST(0 AS INTEGER) AS n_default,
    CAST(n_attachments AS INTEGER) AS n_kept FROM m""",
)
def d19(spark, sf_dir):
    df = mail(spark, sf_dir)
    kept = strip_attachments(df, Policy(attachment_filtering=False)).select("id", F.size("attachments").alias("n_kept"))
    return strip_attachments(df, Policy()).select("id", F.size("attachments").alias("n_default")).join(kept, "id")


@check(
    "d20_strip_invisible",
    f"WITH {TEXTS_SQL} SELECT id, {strip('text')} AS stripped, length({strip('text')}) AS n_chars FROM x",
)
def d20(spark, sf_dir):
    out = strip_invisible(F.col("text"))
    return texts(spark, sf_dir).select("id", out.alias("stripped"), F.length(out).cast("bigint").alias("n_chars"))


@check("d21_html_to_text", f"SELECT page_id, {html_to_text('html')} AS text FROM pages")
def d21(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", to_text(F.col("html")).alias("text"))


@check(
    "d22_body_fallback",
    f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE {html_to_text('html')} END AS body FROM pages",
)
def d22(spark, sf_dir):
    plain = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, "")
    return table(spark, sf_dir, "pages").select("page_id", body_or_html(plain, F.col("html")).alias("body"))


@check("d23_html_to_text_unwrapped", f"SELECT page_id, {html_to_text('html', None)} AS text FROM pages")
def d23(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", to_text(F.col("html"), None).alias("text"))


@check("d24_injection_labels", f"WITH {TEXTS_SQL} SELECT id, {labels('text')} AS labels FROM x")
def d24(spark, sf_dir):
    found = inj.injection_labels(F.col("text"))
    return texts(spark, sf_dir).select("id", F.array_join(found, ", ").alias("labels"))


@check(
    "d25_label_counts",
    f"""WITH {MAIL_SQL}, f AS (SELECT unnest(string_split({labels("concat(subject, chr(10), body)")}, ', ')) AS label FROM m)
    SELECT label, count(*) AS n_messages FROM f WHERE label <> '' GROUP BY label""",
)
def d25(spark, sf_dir):
    found = inj.injection_labels(inj.scanned_text(F.col("subject"), F.col("body")))
    return mail(spark, sf_dir).select(F.explode(found).alias("label")).groupBy("label").agg(F.count("*").alias("n_messages"))


@check(
    "d26_injection_warning",
    f"""WITH {MAIL_SQL}, f AS (SELECT id, body, {labels("concat(subject, chr(10), body)")} AS found FROM m)
    SELECT id, {warned('body', 'found')} AS body,
    CASE WHEN found <> '' THEN concat('Injection patterns detected: ', found) END AS reason FROM f""",
)
def d26(spark, sf_dir):
    out = flag_injections(mail(spark, sf_dir), Policy())
    return out.select("id", "body", inj.injection_reason(F.col("injection_labels")).alias("reason"))


@check(
    "d26_injection_off",
    f"WITH {MAIL_SQL} SELECT id, body FROM m",
)
def d26_off(spark, sf_dir):
    return flag_injections(mail(spark, sf_dir), Policy(injection_detection=False)).select("id", "body")


