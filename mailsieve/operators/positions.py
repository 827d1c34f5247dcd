"""Places of rows in their groups, however large a group is.

A window numbers a group in one task. Here a group of more than `part_rows` rows
is cut at quantiles first: a fixed share of its order keys, chosen by their hash, are
the borders of parts. Rows are numbered inside their part, and a part begins
where the counts of those before it end. Only large groups pay for that: for others, all
there is beyond the window is one narrow count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PART_ROWS = 200_000
# Borders of one group at the most, which are held in one row: beyond that, parts grow
# with their group, to about a thousandth of it.
MOST_BORDERS = 10_000
_SENT_ENTRIES = 200_000


def _free(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _below(borders: Column, key: Column) -> Column:
    """How many of the sorted borders are lower than the key, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        lower = F.get(borders, middle) < key
        return F.when(acc["lo"] >= acc["hi"], acc).when(lower, F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(MOST_BORDERS * 4)) + 1))
    return F.aggregate(steps, start, halve, lambda acc: acc["lo"])


def _share(part_rows: int) -> int:
    return max(1, part_rows // 8)


def _borders(narrow: DataFrame, large: DataFrame, g: str, k: str, many: str, borders: str, part_rows: int) -> DataFrame:
    """The sorted borders of every large group: one of so many order keys that a part has
    about eight of them, but MOST_BORDERS of a group."""
    sparse = F.greatest(F.lit(_share(part_rows)), F.ceil(F.col(many) / MOST_BORDERS))
    chosen = narrow.join(large, g).where(F.pmod(F.xxhash64(k), sparse) == 0)
    found = chosen.groupBy(g).agg(F.sort_array(F.collect_set(k)).alias(borders))
    # A large group without any border is one part.
    none = F.array().cast(dict(found.dtypes)[borders])
    return large.select(g).join(found, g, "left").withColumn(borders, F.coalesce(F.col(borders), none))


def numbered(df: DataFrame, group: list[Column], order: list[Column], name: str = "position", size: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """`df` with `name`, 1 for the first row of its group in ascending order, and
    with `size`, the rows of the group, if that is asked for. Nulls come first and are equal to each
    other; without `group` all rows are one. Rows whose order keys are all equal come in any order and stay in one part,
    so the order should end in something that tells rows apart.

    The group sizes are counted when this is called."""
    g, k, part, borders, rank, start, many = _free(df, "_group", "_key", "_part", "_borders", "_rank", "_start", "_size")
    keyed = df.withColumns({g: F.struct(*group) if group else F.struct(F.lit(0)), k: F.struct(*order)})
    counts = keyed.groupBy(g).agg(F.count("*").alias(many))
    large = counts.where(F.col(many) > part_rows)
    n_large, n_rows = large.agg(F.count("*"), F.coalesce(F.sum(many), F.lit(0))).first()
    if not n_large:
        out = keyed.withColumn(name, F.row_number().over(W.partitionBy(g).orderBy(k)).cast("bigint"))
        if size is not None:
            out = out.withColumn(size, F.count("*").over(W.partitionBy(g)))
        return out.drop(g, k)

    few = n_rows // _share(part_rows) <= _SENT_ENTRIES
    sent = F.broadcast if few else (lambda x: x)
    narrow = keyed.select(g, k)
    cuts = _borders(narrow, sent(large), g, k, many, borders, part_rows)
    place = F.when(F.col(borders).isNull(), F.lit(0)).otherwise(_below(F.col(borders), F.col(k)))
    in_parts = narrow.join(sent(cuts), g).withColumn(part, place).groupBy(g, part).agg(F.count("*").alias(rank))
    before = W.partitionBy(g).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # at most MOST_BORDERS rows or so
    starts = in_parts.select(g, part, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(start))
    placed = keyed.join(sent(cuts.select(g, borders)), g, "left").withColumn(part, place).drop(borders)
    ranked = placed.withColumn(rank, F.row_number().over(W.partitionBy(g, part).orderBy(k)))
    out = ranked.join(sent(starts), [g, part], "left").withColumn(name, (F.coalesce(F.col(start), F.lit(0)) + F.col(rank)).cast("bigint"))
    if size is not None:
        if few:
            small = F.count("*").over(W.partitionBy(g, part))
            out = out.join(F.broadcast(large), g, "left").withColumn(size, F.coalesce(F.col(many), small)).drop(many)
        else:
            out = out.join(counts, g).withColumnRenamed(many, size)
    return out.select(*df.columns, name, *([size] if size is not None else []))
