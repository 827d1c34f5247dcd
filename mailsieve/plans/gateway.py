"""The ordered policy run over messages: folder gate, blocklist, clean-up,
redaction, injection warning, user stages, attachment strip.

Every step is a projection or a filter, so the run adds no shuffle and works on
a stream as it does on a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.injection import injection_labels, injection_reason, scanned_text, with_warning
from mailsieve.functions.redact import redact
from mailsieve.functions.sanitize import body_or_html, strip_invisible
from mailsieve.operators.blocklist import with_verdict
from mailsieve.operators.rule_index import indexed_policies
from mailsieve.operators.tenants import join_policies
from mailsieve.policy import Policy, PolicyColumns, guarded
from mailsieve.schema import ATTACHMENTS, MESSAGE

TEXT = ("body", "subject", "snippet")
AUDIT = ("pii_redacted", "injection_labels", "stage_reason")


STAGE_RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("action", "reason", "body", "subject", "snippet")]
)


@dataclass(frozen=True)
class ColumnStage:
    """A user stage in terms of columns: where `block` holds the message is
    blocked with `reason`; `changes` replaces columns of the others."""

    block: Column | None = None
    reason: Column | None = None
    changes: dict[str, Column] | None = None


@dataclass(frozen=True)
class UdfStage:
    """A user stage as a pandas_udf of (subject, body, snippet) returning
    STAGE_RESULT."""

    udf: Callable[..., Column]


Stage = Callable[[DataFrame], DataFrame] | ColumnStage | UdfStage


def _texts(only: Column | None = None) -> Column:
    """The text columns as one array, so that each step over them is a single
    expression. Null, and therefore free, for rows that `only` leaves out."""
    texts = F.array(
        body_or_html(F.col("body"), F.col("html_body")),
        F.coalesce("subject", F.lit("")),
        F.coalesce("snippet", F.lit("")),
    )
    return texts if only is None else F.when(only, texts)


def _unpacked(texts: Column) -> dict[str, Column]:
    return {c: F.get(texts, F.lit(i)) for i, c in enumerate(TEXT)}


def sanitize(df: DataFrame) -> DataFrame:
    """Body from HTML where there is no plain one, HTML dropped, invisible
    characters removed."""
    done = df.withColumn("_texts", F.transform(_texts(), strip_invisible))
    gone = {"html_body": F.lit(None).cast("string")}
    return done.withColumns(_unpacked(F.col("_texts")) | gone).drop("_texts")


def redact_columns(df: DataFrame, policy: Policy | PolicyColumns) -> DataFrame:
    """Redacts the text columns; `pii_redacted` tells whether any changed."""
    texts = F.array(*TEXT)
    done = df.withColumn("_texts", F.transform(texts, lambda t: redact(t, policy)))
    return done.withColumns({"pii_redacted": F.col("_texts") != texts} | _unpacked(F.col("_texts"))).drop("_texts")


def _labels(subject: Column, body: Column, policy: Policy | PolicyColumns) -> Column:
    none = F.array().cast("array<string>")
    return guarded(policy.injection_detection, injection_labels(scanned_text(subject, body)), none)


def flag_injections(df: DataFrame, policy: Policy | PolicyColumns) -> DataFrame:
    found = df.withColumn("injection_labels", _labels(F.col("subject"), F.col("body"), policy))
    return found.withColumn(
        "body", with_warning(F.col("body"), F.col("injection_labels"), policy.warning_prefix)
    )


def _kept_attachments(policy: Policy | PolicyColumns) -> Column:
    return guarded(policy.attachment_filtering, F.array().cast(ATTACHMENTS), F.col("attachments"))


def strip_attachments(df: DataFrame, policy: Policy | PolicyColumns) -> DataFrame:
    return df.withColumn("attachments", _kept_attachments(policy))


def apply_stage(df: DataFrame, stage: Stage) -> DataFrame:
    """Runs one user stage. Rows it blocks carry `stage_reason`; later stages
    leave that reason as it is."""
    if isinstance(stage, UdfStage):
        # Not to be moved or repeated: a filter on its outcome would otherwise be
        # rewritten to call it once more, further down.
        once = stage.udf.asNondeterministic()
        out = df.withColumn("_out", once("subject", "body", "snippet"))
        blocked = F.when(F.col("_out.action") == "block", F.coalesce("_out.reason", F.lit("Blocked")))
        return (
            out.withColumn("stage_reason", F.coalesce("stage_reason", blocked))
            .withColumns({c: F.col(f"_out.{c}") for c in TEXT})
            .drop("_out")
        )
    if isinstance(stage, ColumnStage):
        if stage.block is not None:
            reason = F.coalesce(stage.reason if stage.reason is not None else F.lit(None), F.lit("Blocked"))
            df = df.withColumn("stage_reason", F.coalesce("stage_reason", F.when(stage.block, reason)))
        return df.withColumns(stage.changes) if stage.changes else df
    return stage(df)


def clean(
    df: DataFrame,
    policy: Policy | PolicyColumns,
    stages: Iterable[Stage] = (),
    only: Column | None = None,
) -> DataFrame:
    """Everything behind the verdict, for messages that passed it: `sanitize`,
    `redact_columns`, `flag_injections`, user stages, `strip_attachments`. The
    built-in steps are put into as few projections as their order allows. Rows
    outside `only` come out with null texts."""
    stripped = df.withColumn("_clean", F.transform(_texts(only), strip_invisible))
    redacted = stripped.withColumn("_safe", F.transform("_clean", lambda t: redact(t, policy)))
    safe = _unpacked(F.col("_safe"))
    out = redacted.withColumn("injection_labels", _labels(safe["subject"], safe["body"], policy))
    labels = F.col("injection_labels")
    out = out.withColumns(
        safe
        | {
            "body": with_warning(safe["body"], labels, policy.warning_prefix),
            "html_body": F.lit(None).cast("string"),
            "pii_redacted": F.coalesce(F.col("_safe") != F.col("_clean"), F.lit(False)),
            "stage_reason": F.lit(None).cast("string"),
        }
    )
    for stage in stages:
        out = apply_stage(out, stage)
    return strip_attachments(out, policy)


def _message_columns(df: DataFrame) -> list[str]:
    own = set(MESSAGE.fieldNames())
    return [c for c in df.columns if c in own or c == "connection_id"]


def process(
    df: DataFrame, policy: Policy | PolicyColumns | None = None, stages: Iterable[Stage] = (), carry: Iterable[str] = ()
) -> DataFrame:
    """One row per message with `action` and `reason`: passed rows cleaned,
    blocked rows as they came. Audit columns keep what was changed. Columns in
    `carry` go along beside those of a message.

    The texts of blocked rows are null on their way through, so they skip the
    costly expressions while the scan stays single. User stages see them so."""
    policy = policy or Policy()
    passes = F.col("action") == "pass"
    kept = (*TEXT, "html_body", "attachments")
    judged = with_verdict(df, policy).withColumn("_original", F.struct(*kept))
    out = clean(judged, policy, stages, only=passes)
    stopped = ~passes | F.col("stage_reason").isNotNull()
    final = {c: F.when(stopped, F.col(f"_original.{c}")).otherwise(F.col(c)) for c in kept}
    final |= {
        "reason": F.coalesce("reason", "stage_reason"),
        "action": F.when(stopped, "block").otherwise("pass"),
        "pii_redacted": ~stopped & F.col("pii_redacted"),
        "injection_labels": F.when(stopped, F.array().cast("array<string>")).otherwise(F.col("injection_labels")),
    }
    own = [F.col(c) for c in _message_columns(df) if c not in final]
    shown = [v.alias(c) for c, v in final.items()]
    carry = list(carry)
    order = [*_message_columns(df), "action", "reason", "pii_redacted", "injection_labels", *carry]
    return out.select(*own, *shown, *carry).select(*order)


def passed(df: DataFrame, policy: Policy | PolicyColumns | None = None, stages: Iterable[Stage] = ()) -> DataFrame:
    """Only the cleaned messages: blocked rows leave the plan right after the
    scan, before any costly expression."""
    policy = policy or Policy()
    kept = with_verdict(df, policy).filter("action = 'pass'").drop("action", "reason")
    return clean(kept, policy, stages).filter("stage_reason is null").select(*_message_columns(df))


def blocked(df: DataFrame, policy: Policy | PolicyColumns | None = None, stages: Iterable[Stage] = ()) -> DataFrame:
    """Only the blocked messages, untouched, with their reason. Without user
    stages just the verdict columns are computed."""
    columns = [*_message_columns(df), "reason"]
    if not list(stages):
        return with_verdict(df, policy or Policy()).filter("action = 'block'").select(*columns)
    return process(df, policy, stages).filter("action = 'block'").select(*columns)


def split(df: DataFrame, policy: Policy | PolicyColumns | None = None, stages: Iterable[Stage] = ()):
    return passed(df, policy, stages), blocked(df, policy, stages)


def write_split(df: DataFrame, path: str, policy=None, stages: Iterable[Stage] = ()) -> None:
    """Both halves from one scan, as partitions action=pass and action=block."""
    process(df, policy, stages).write.mode("append").partitionBy("action").parquet(path)


def process_tenants(messages: DataFrame, policies: DataFrame, stages: Iterable[Stage] = (), indexed: bool = False) -> DataFrame:
    """`process` with each connection's own policy."""
    return tenant_run(messages, policies, stages, indexed)[0].drop("_policy")


def tenant_run(messages: DataFrame, policies: DataFrame, stages: Iterable[Stage] = (), indexed: bool = False) -> tuple[DataFrame, PolicyColumns]:
    """The same with the policy beside each message, and the handle that views
    and counts take in place of a single policy. `indexed` judges custom rules beforehand, each
    distinct sender and subject once; for large tables with many rules, not for streams."""
    joined, policy = (indexed_policies if indexed else join_policies)(messages, policies)
    return process(joined, policy, stages, carry=[policy.qualifier]), policy


def final_action(df: DataFrame) -> DataFrame:
    """What happened to each message, redaction included: the run itself only
    tells pass from block."""
    touched = F.col("pii_redacted") | (F.size("injection_labels") > 0)
    return df.withColumn(
        "audit_action", F.when(F.col("action") == "block", "block").when(touched, "redact").otherwise("pass")
    ).withColumn(
        "audit_reason",
        F.coalesce(
            "reason",
            injection_reason(F.col("injection_labels")),
            F.when(F.col("pii_redacted"), "PII patterns redacted"),
        ),
    )


def filtered_count(judged: DataFrame, show: bool | Column = True, keys: Iterable[str] = ()) -> DataFrame:
    """How many rows were blocked; null when none were or the policy hides it. A
    column as `show` must be the same in all rows of a group, as a connection's is."""
    n = F.count_if(F.col("action") == "block")
    shown = F.bool_and(show) if isinstance(show, Column) else F.lit(show)
    return judged.groupBy(*keys).agg(F.when((n > 0) & shown, n).alias("filtered_count"))
