"""URL filters by dated lists: every capture against the entries of its day.

A list is a history of entries, each adding or removing a domain on a day. Per
list and domain they become validity intervals. A capture is judged by the intervals
that hold on its day for its host or a parent domain: the most specific domain
decides, and between a block and an allow list of the same domain the latter.

Captures are first reduced to distinct (host, day) pairs, so a host that has a
third of all captures is judged once a day. Intervals are dealt by domain and
year, of which one has as many as the year has days, and joined as of the day.
Nothing leaves the JVM.

A URL without a host, a null URL and a capture without a day are unlisted.
Entries without a domain, day or known action are left out. On one day an addition
counts before a removal. Repeated rows are judged alike. No captures give no rows,
no entries leave all unlisted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailsieve.llm.shared import settled, unused


def host(url: Column) -> Column:
    """Host of a URL in lower case without port, user and closing dot; null if
    there is none."""
    found = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    bare = F.regexp_replace(found, "[.]+$", "")
    return F.when(bare != "", bare)


def parents(name: Column) -> Column:
    """A host and all domains above it."""
    labels = F.split(name, "[.]")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since and until (not included; null: still listed) from
    entries of list, domain, day and action (add, remove)."""
    known = entries.where("domain IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    states = known.groupBy("list", F.lower("domain").alias("domain"), "day").agg(F.max(F.col("action") == "add").alias("active"))
    history = Window.partitionBy("list", "domain").orderBy("day")
    before = F.coalesce(F.lag("active").over(history), F.lit(False))
    changes = states.withColumn("_before", before).where("active != _before")
    return changes.withColumn("until", F.lead("day").over(history)).where("active").select("list", "domain", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures` (with url and day) plus host, verdict (blocked, allowed,
    unlisted), and the domain and first day (since) of the interval that decided.
    Columns of these names are replaced."""
    hosted = captures.drop("verdict", "domain", "since").withColumn("host", host(F.col("url")))
    pairs = settled(hosted.select("host", "day").where("host IS NOT NULL AND day IS NOT NULL").distinct())
    last_year = pairs.agg(F.max(F.year("day"))).first()[0] or 0
    valid = intervals(entries)
    years = F.sequence(F.year("since"), F.year(F.coalesce(F.date_sub("until", 1), F.greatest("since", F.make_date(F.lit(last_year or 1970), F.lit(12), F.lit(31))))))
    dealt = valid.withColumn("_year", F.explode(years))
    asked = pairs.withColumn("domain", F.explode(parents(F.col("host")))).withColumn("_year", F.year("day"))
    met = asked.join(dealt, ["domain", "_year"]).where("since <= day AND (until IS NULL OR day < until)")
    rank = F.struct(F.length("domain").alias("length"), (F.col("list") == "allow").alias("allow"), "domain", "since")
    best = met.groupBy("host", "day").agg(F.max(rank).alias("_best"))
    best = settled(best.select(F.col("host").alias("_host"), F.col("day").alias("_day"), F.col("_best").alias(made := unused(hosted, "best"))))
    found = hosted.join(best, (hosted["host"] == best["_host"]) & (hosted["day"] == best["_day"]), "left")
    won = best[made]
    verdict = F.when(won.isNull(), "unlisted").when(won["allow"], "allowed").otherwise("blocked")
    own = [hosted[c] for c in hosted.columns]
    return found.select(*own, verdict.alias("verdict"), won["domain"].alias("domain"), won["since"].alias("since"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures of two years: page_id, url and a day made of page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 730).cast("int")).alias("day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list history made of the pages' hosts: a third of all hosts, and some of
    the domains above them, are added, removed and added again on days that follow from a
    checksum of the name."""
    hosts = pages.select(host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    above = F.regexp_replace("host", "^[^.]*[.]", "")
    names = hosts.select("host", F.lit(0).alias("k")).union(hosts.select(above, F.lit(1))).distinct()
    names = names.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"))
    names = names.withColumn("list", F.when(F.col("n") % 4 == 0, "allow").otherwise("block")).where("(k = 0 AND n % 3 = 0) OR (k = 1 AND n % 5 = 0)")
    start = F.date_add(F.lit("2023-06-01").cast("date"), (F.col("n") % 400).cast("int"))
    one = lambda after, action: F.struct(F.date_add(start, after.cast("int")).alias("day"), F.lit(action).alias("action"))
    steps = F.array(one(F.lit(0), "add"), one(30 + F.col("n") % 200, "remove"), one(300 + F.col("n") % 90, "add"))
    return names.select("list", F.col("host").alias("domain"), F.explode(F.slice(steps, 1, (1 + F.col("n") % 3).cast("int"))).alias("e")).select("list", "domain", "e.day", "e.action")


JUDGED_SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS r, page_id, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 730 AS INTEGER) AS DATE) AS day,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '[.]+$', ''), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
n AS (
  SELECT *, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS n
  FROM (SELECT host, 0 AS k FROM h UNION SELECT regexp_replace(host, '^[^.]*[.]', ''), 1 FROM h)),
e AS (
  SELECT CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END AS list, host AS domain,
    CAST(DATE '2023-06-01' + CAST(n % 400 AS INTEGER) + CAST(CASE i WHEN 1 THEN 0 WHEN 2 THEN 30 + n % 200 ELSE 300 + n % 90 END AS INTEGER) AS DATE) AS day,
    i <> 2 AS active
  FROM (SELECT *, unnest(range(1, n % 3 + 2)) AS i FROM n WHERE (k = 0 AND n % 3 = 0) OR (k = 1 AND n % 5 = 0))),
s AS (SELECT list, domain, day, bool_or(active) AS active FROM e GROUP BY ALL),
x AS (SELECT * FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY list, domain ORDER BY day), false) AS before FROM s) WHERE active <> before),
v AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM x) WHERE active),
m AS (
  SELECT c.r, v.list, v.domain, v.day AS since,
    row_number() OVER (PARTITION BY c.r ORDER BY length(v.domain) DESC, v.list = 'allow' DESC, v.domain DESC, v.day DESC) AS place
  FROM c JOIN v ON (c.host = v.domain OR ends_with(c.host, '.' || v.domain)) AND v.day <= c.day AND (v.until IS NULL OR c.day < v.until))
SELECT page_id, host, CAST(c.day AS VARCHAR) AS day,
  CASE WHEN m.r IS NULL THEN 'unlisted' WHEN m.list = 'allow' THEN 'allowed' ELSE 'blocked' END AS verdict,
  domain, CAST(since AS VARCHAR) AS since
FROM c LEFT JOIN m ON c.r = m.r AND m.place = 1
"""
