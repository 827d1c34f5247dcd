"""Secret scan that links the parts of a credential.

Three kinds are reported wherever they occur: assignments of a secret, access
identifiers, long runs of hexadecimal digits. Three more are weak by
themselves: short secrets, identifiers, endpoints. An interval join inside each
document links every secret with the identifiers and endpoints that begin
within `scope` characters of it, and a weak candidate is reported only when it is so
linked to a complementary part.

All work is done by SQL functions. Texts without a secret of any kind are left
by one pattern; positions come from the lengths of matches and of what lies
between them, summed over narrow rows. The join is dealt by document and
stretch of text, so its rows are bounded by the scope.

A null text is an empty one. Positions count code points, ends are exclusive.
Rows are known by doc_id and text: repeated rows get equal results. No rows
give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.shared import settled

SCOPE = 200
_VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?"
# Kinds in the order in which spans that begin together are listed: pattern,
# group whose length counts, least length.
PATTERNS: dict[str, tuple[str, int, int]] = {
    "assign": (f"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("(AKIA[A-Z0-9]+)", 1, 18),
    "hex": ("([0-9a-f]{16,})", 1, 16),
    "weak": (f"(?i)\\b(pwd|pass|passphrase|credential|auth|private_?key){_VALUE}([A-Za-z0-9+/_.=!@#%^*-]+)", 2, 6),
    "ident": (f"(?i)\\b(user(?:_?name)?|login|account|client_?id|key_?id){_VALUE}([A-Za-z0-9._@-]+)", 2, 3),
    "endpoint": ("((?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\x00-\\x20\"'<>]+|\\b[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?::[0-9]{1,5})?\\b)", 1, 7),
}
BASE = ("assign", "access", "hex")
SECRETS = ("assign", "hex", "weak")
PARTNERS = ("access", "ident", "endpoint")
# What a text with any secret or access identifier matches.
_ANY = "(?i:(?:password|passwd|secret|token|api_?key|pwd|pass|passphrase|credential|auth|private_?key)[\"']?\\x20*[:=])|AKIA|[0-9a-f]{16}"


def _matches(kind: str) -> Column:
    """(kind, length before it since the last match, its length, length that counts)
    of every match, in order."""
    pattern, group, _ = PATTERNS[kind]
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("before"), found.alias("match"), counted.alias("counted"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["before"]).alias("gap"), F.length(z["match"]).alias("size"), F.length(z["counted"]).alias("counted")),
    )
    return F.when(F.col("text").rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind: string, i: int, gap: int, size: int, counted: int>>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce("text", F.lit("")).alias("text"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, _text, kind, start and end of every match of any kind in documents
    that have a secret or an access identifier."""
    found = _keyed(docs).where(F.col("text").rlike(_ANY))
    rows = found.select("doc_id", "_text", F.explode(F.concat(*map(_matches, PATTERNS))).alias("_m")).select("doc_id", "_text", "_m.*").distinct()
    upto = Window.partitionBy("doc_id", "_text", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    enough = reduce(lambda a, b: a | b, [(F.col("kind") == kind) & (F.col("counted") >= least) for kind, (_, _, least) in PATTERNS.items()])
    return placed.where(enough).select("doc_id", "_text", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Every secret with every identifier and endpoint that begins within `scope`
    characters of it: doc_id, _text, and kind, start and end of both."""
    reach = F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope), F.floor((F.col("end") + scope) / scope))
    secrets = found.where(F.col("kind").isin(*SECRETS)).withColumn("_bin", F.explode(reach))
    partners = found.where(F.col("kind").isin(*PARTNERS))
    partners = partners.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), F.col("kind").alias("partner_kind"), F.col("start").alias("partner_start"), F.col("end").alias("partner_end"), F.floor(F.col("start") / scope).alias("_b"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")) & (F.col("_bin") == F.col("_b"))
    near = F.col("partner_start").between(F.col("start") - scope, F.col("end") + scope)
    apart = (F.col("partner_end") <= F.col("start")) | (F.col("partner_start") >= F.col("end"))
    return secrets.join(partners, same & near & apart).drop("_d", "_t", "_b", "_bin")


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, _text, kind, start and end of what is reported."""
    found = settled(candidates(docs))  # narrow, and needed by every part of the join
    linked = links(found, scope)
    weak = linked.select("doc_id", "_text", "kind", "start", "end").union(linked.select("doc_id", "_text", "partner_kind", "partner_start", "partner_end"))
    return found.where(F.col("kind").isin(*BASE)).union(weak.where(~F.col("kind").isin(*BASE)).distinct())


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, the number of matches of each base kind, a checksum of their spans,
    and all spans reported, of every document."""
    order = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("kind"))
    one = F.struct("start", order.alias("order"), "kind", "end")
    base = F.col("kind").isin(*BASE)
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    by_document = spans(docs, scope).groupBy("doc_id", "_text").agg(*counts, F.collect_list(F.when(base, one)).alias("_base"), F.collect_list(one).alias("_all"))
    found = by_document.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), *(f"n_{k}" for k in BASE), _listed(F.col("_base")).alias("_listed"), _listed(F.col("_all")).alias("spans"))
    all_rows = docs.select("doc_id", F.xxhash64("text").alias("_text")).join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
    return all_rows.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE), F.sha2(F.coalesce("_listed", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def report_sql(scope: int = SCOPE) -> str:
    """The report over `documents` as SQL for DuckDB."""

    def matches(order: int, kind: str) -> str:
        pattern, group, least = PATTERNS[kind]
        quoted = pattern.replace("'", "''")
        return f"""SELECT r, {order} AS o, '{kind}' AS kind, least_end - length(x[i]) AS start, least_end AS "end" FROM (
  SELECT r, x, i, CAST(list_sum(list_transform(p[1:i], lambda s: length(s))) + list_sum(list_transform(x[1:i], lambda s: length(s))) AS BIGINT) AS least_end, g FROM (
    SELECT r, x, p, g, unnest(range(1, len(x) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, '{quoted}') AS x, regexp_split_to_array(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}', {group}) AS g FROM d)))
WHERE length(g[i]) >= {least}"""

    def listed(kinds: tuple[str, ...]) -> str:
        chosen = ", ".join(f"'{k}'" for k in kinds)
        return f"coalesce(string_agg(concat(kind, ':', start, ':', \"end\"), ',' ORDER BY start, o, \"end\") FILTER (kind IN ({chosen})), '')"

    def isin(kinds: tuple[str, ...]) -> str:
        return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"

    found = "\nUNION ALL\n".join(matches(i, k) for i, k in enumerate(PATTERNS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
l AS (SELECT s.r, s.o, s.kind, s.start, s."end", p.o AS po, p.kind AS pk, p.start AS ps, p."end" AS pe FROM f s JOIN f p ON s.r = p.r
  WHERE s.kind IN {isin(SECRETS)} AND p.kind IN {isin(PARTNERS)} AND p.start BETWEEN s.start - {scope} AND s."end" + {scope} AND (p."end" <= s.start OR p.start >= s."end")),
a AS (SELECT * FROM f WHERE kind IN {isin(BASE)}
  UNION ALL SELECT DISTINCT * FROM (SELECT r, o, kind, start, "end" FROM l UNION ALL SELECT r, po, pk, ps, pe FROM l) WHERE kind NOT IN {isin(BASE)})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, sha256({listed(BASE)}) AS base_sha256, {listed(tuple(PATTERNS))} AS spans
FROM d LEFT JOIN a USING (r) GROUP BY r, doc_id
"""
