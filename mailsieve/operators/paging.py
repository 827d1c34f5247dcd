"""Pages. Each keeps at most n+1 rows, found by a distributed top-k."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailsieve.operators.positions import PART_ROWS, numbered

MAX_PAGE = 200
SCRIPT_PAGE = 50


def page_size(n: int, most: int = MAX_PAGE) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"page size must be 1..{most}, got {n}")
    return n


# What comes behind the page's own key, so that no two messages are equal.
TIES = ("sent_at", "connection_id", "id")


def _keys(df: DataFrame, key: str) -> list[str]:
    return [key, *(c for c in TIES if c in df.columns and c != key)]


def newest_first(df: DataFrame, key: str = "uid") -> list[Column]:
    """A total order, as far as messages differ: by the key, then by time, connection and id, all
    descending, and what is missing last."""
    return [F.desc_nulls_last(c) for c in _keys(df, key)]


def newest(df: DataFrame, n: int = 20, key: str = "uid") -> DataFrame:
    return df.orderBy(*newest_first(df, key)).limit(page_size(n))


@dataclass(frozen=True)
class Page:
    """Rows in page order plus `page_row`; `ahead` is the row that starts the
    next page, with its `page_token`, empty on the last one. `both` is the one
    before they are told apart, of `n` rows and perhaps one more."""

    rows: DataFrame
    ahead: DataFrame
    both: DataFrame

    def next_token(self) -> str | None:
        """Asks for the single token value."""
        first = self.ahead.select("page_token").head()
        return None if first is None else first[0]


def _plain(c: str, df: DataFrame) -> Column:
    """A key as text; times as microseconds."""
    return (F.unix_micros(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c)).cast("string")


def _from(df: DataFrame, keys: list[str], values: list[str | None]) -> Column:
    """Rows at or behind the given one, newest first."""
    if not values:
        return F.lit(True)
    key, value, rest = keys[0], values[0], _from(df, keys[1:], values[1:])
    if value is None:
        return F.col(key).isNull() & rest
    kind = "bigint" if dict(df.dtypes)[key] == "timestamp" else dict(df.dtypes)[key]
    own = F.unix_micros(key) if dict(df.dtypes)[key] == "timestamp" else F.col(key)
    at = F.lit(value).cast(kind)
    return own.isNull() | (own < at) | ((own == at) & rest)


def keyset_page(df: DataFrame, n: int = 20, token: str | int | None = None, key: str = "uid") -> Page:
    """Newest first. The token is the key of the page's first row; where a page
    begins among rows of one key, or of none, it is the JSON list of all that the
    order goes by."""
    keys = _keys(df, key)
    if token is not None:
        text = str(token)
        values = json.loads(text) if text.startswith("[") else [text]
        df = df.filter(_from(df, keys, values))
    order = newest_first(df, key)
    few = df.orderBy(*order).limit(page_size(n) + 1)
    # n + 1 rows at the most, so one task for the numbering is right.
    in_page = W.partitionBy(F.lit(1)).orderBy(*order)
    shared = F.col(key).isNull() | F.lag(key).over(in_page).eqNullSafe(F.col(key))
    full = F.to_json(F.array(*(_plain(c, df) for c in keys)), {"ignoreNullFields": "false"})
    numbered = few.withColumn("page_token", F.when(shared, full).otherwise(F.col(key).cast("string"))).withColumn("page_row", F.row_number().over(in_page))
    return Page(numbered.filter(F.col("page_row") <= n).drop("page_token"), numbered.filter(F.col("page_row") > n), numbered)


def paged(df: DataFrame, n: int = 20, key: str = "uid", part_rows: int = PART_ROWS) -> DataFrame:
    """All rows with the `page` (from 0) of `keyset_page` that they are on and their
    `page_row`. Rows are numbered in parts, so all pages are made at once."""
    # Ascending with nulls first is the order of pages read backwards.
    keys = _keys(df, key)
    placed = numbered(df, [], [F.col(c) for c in keys], "page_row", "page", part_rows)
    place = F.col("page") - F.col("page_row")
    return placed.withColumns({"page": F.floor(place / n), "page_row": (place % n + 1).cast("long")})


def directory(df: DataFrame, n: int = 20, key: str = "uid", part_rows: int = PART_ROWS) -> DataFrame:
    """Every page's number, the `token` that `keyset_page` takes for it, and n_rows:
    two rows of each page are looked at, however many pages there are."""
    keys = _keys(df, key)
    rows = paged(df.select(keys), n, key, part_rows)
    counts = rows.groupBy("page").agg(F.count("*").alias("n_rows"))
    first = rows.where("page_row = 1").drop("page_row").join(counts, "page")
    before = rows.where(F.col("page_row") == n).select((F.col("page") + 1).alias("page"), F.col(key).alias("_before"), F.lit(True).alias("_has"))
    shared = F.col(key).isNull() | (F.col("_has").isNotNull() & F.col("_before").eqNullSafe(F.col(key)))
    full = F.to_json(F.array(*(_plain(c, df) for c in keys)), {"ignoreNullFields": "false"})
    token = F.when(shared, full).otherwise(F.col(key).cast("string"))
    return first.join(before, "page", "left").select("page", token.alias("token"), "n_rows")


def on_pages(df: DataFrame, n: int = 20, key: str = "uid", part_rows: int = PART_ROWS) -> DataFrame:
    """For each row the pages whose range of keys, from a page's first row up to that of
    the next, it lies in: the row's keys and `page`. A range join of rows with the page that its place says and
    those beside it, so a wrong order or a torn page would show."""
    keys = _keys(df, key)
    rows = paged(df.select(keys), n, key, part_rows)
    first = rows.where("page_row = 1").select("page", F.struct(*keys).alias("_first"))
    bounds = first.join(first.select((F.col("page") - 1).alias("page"), F.col("_first").alias("_next")), "page", "left")
    near = rows.withColumn("page", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    own = F.struct(*keys)
    inside = (own <= F.col("_first")) & (F.col("_next").isNull() | (own > F.col("_next")))
    return near.join(bounds, "page").where(inside).select(*keys, "page")


def offset_page(df: DataFrame, *order: Column, n: int = 10, offset: int = 0) -> Page:
    """Script-style page of at most 50 rows, one more read to learn whether there
    are any left. The token is the offset of the first row that is not on the page."""
    n = page_size(n, SCRIPT_PAGE)
    page = _numbered(df.orderBy(*order).offset(offset).limit(n + 1), n, *order)
    return Page(page.rows, page.ahead.withColumn("page_token", F.lit(str(offset + n))), page.both)


def _numbered(few: DataFrame, n: int, *order: Column) -> Page:
    # n + 1 rows at the most, so one task for the numbering is right.
    numbered = few.withColumn("page_row", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)))
    return Page(numbered.filter(F.col("page_row") <= n), numbered.filter(F.col("page_row") > n), numbered)


def offset_total(page: Page, offset: int) -> DataFrame:
    """Result size as the script reports it, a lower bound: one more than what
    was seen when rows are left."""
    counted = page.rows.select(F.lit(0).alias("more")).unionAll(page.ahead.select(F.lit(1).alias("more")))
    return counted.agg(
        (F.lit(offset) + F.count("*")).alias("total"), (F.coalesce(F.sum("more"), F.lit(0)) > 0).alias("has_more")
    )
