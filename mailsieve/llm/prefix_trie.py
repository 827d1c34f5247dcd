"""Prefix trie of conversations, rolled up by centroid decomposition.

A node stands for a distinct sequence of first turns and is named by its smallest
conversation and its depth. Prefixes are told apart by 128 bits: the exclusive or of
the hashes of (place, role, text) of their turns, which can be summed up piece by
piece, so a conversation of any length is spread over tasks.

Totals of subtrees go up the forest of parent edges by centroid decomposition. A component
is split at its centroid, the deepest node that holds more than half of its weight;
the nodes of more than half are just the way from the centroid to the top, as only one
branch can hold so much. What hangs below the centroid becomes components of their
own, and their total goes to every node of that way. Every split halves the weight, so
chains and bushes take equally few rounds. A node weighs the number of conversations
through it, as the weight of its subtree is then known beforehand: the turns of its
conversations from its depth on. Large components are split by joins, one round for
all of them; those of at most `local_nodes` nodes are finished by the same steps
inside of tasks.

Null roles and texts are empty strings. Rows of one turn number, and rows without
one, which come first, are ordered by role and text. Rows without a conversation id
belong to none and are no part of the trie. Repeated rows are turns like others. No
rows give no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from mailsieve.llm.shared import settled
from mailsieve.operators.positions import PART_ROWS, numbered

LOCAL_NODES = 20_000
_PIECE = 4096  # turns of a conversation, or ids of a digest, worked on at a time
WORDS = r"[^\x20\x09-\x0D]+"


def turns_in_order(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, pos from 1, size (turns of the conversation), role and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", empty("role"), empty("text"))
    placed = numbered(rows, [F.col("conv_id")], [F.col(c) for c in ("turn", "role", "text")], "pos", "size", part_rows)
    return placed.select("conv_id", "pos", "size", "role", "text")


def fingerprints(turns: DataFrame) -> DataFrame:
    """What the trie needs of each turn: two hashes, x and y, of role and text, and
    words, those of its text. Kept in the shared folder, so that texts are read once."""
    salted = [F.xxhash64(F.lit(salt), "role", "text").alias(name) for salt, name in (("one", "x"), ("two", "y"))]
    return settled(turns.where("conv_id IS NOT NULL").select("conv_id", "pos", "size", *salted, F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")))


def spliced(turns: DataFrame, most: int = 4, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: conversation c takes its first h turns from
    the one at c - c % every, and goes on with its own after as many; h is the
    checksum of its number modulo `most`. Gives (turns, ids), as a conversation may
    end up without turns."""
    kept = [c for c in turns.columns if c not in ("conv_id", "pos", "size")]
    ids = turns.groupBy("conv_id").agg(F.first("size").alias("size"))
    wanted = ids.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("size").alias("given"))
    plan = wanted.join(sizes, "base", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0))))
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", *kept)
    opening = plan.where("given > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), F.col("given").cast("long"))).alias("pos"))
    taken = opening.join(heads, ["base", "pos"]).select("conv_id", "pos", *kept)
    own = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("pos"), *kept)
    return taken.unionByName(own), ids.select("conv_id")


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for every conversation and depth from 0: h (of the prefix), before (of the
    one a turn shorter), left (how many depths from here on) and words of the last text."""
    placed = [F.xxhash64(F.lit(salt), "pos", "x", "y").alias(name) for salt, name in (("one", "x"), ("two", "y"))]
    rows = turns.select("conv_id", "pos", F.floor((F.col("pos") - 1) / _PIECE).alias("piece"), *placed, "words")
    of_piece = rows.groupBy("conv_id", "piece").agg(F.bit_xor("x").alias("px"), F.bit_xor("y").alias("py"), F.count("*").alias("n"))
    earlier, later = (W.partitionBy("conv_id").orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("piece"), F.desc("piece")))
    total = lambda c, w: F.coalesce(c.over(w), F.lit(0))
    of_piece = of_piece.select("conv_id", "piece", "n", total(F.bit_xor("px"), earlier).alias("px"), total(F.bit_xor("py"), earlier).alias("py"), total(F.sum("n"), later).alias("after"))
    inside = W.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy("conv_id", "piece").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({"sx": F.bit_xor("x").over(inside), "sy": F.bit_xor("y").over(inside), "here": F.count("*").over(rest)}).join(of_piece, ["conv_id", "piece"])
    hx, hy = F.col("sx").bitwiseXOR(F.col("px")), F.col("sy").bitwiseXOR(F.col("py"))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    whole = of_piece.where("piece = 0").select("conv_id", (F.col("n") + F.col("after")).alias("size"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = ids.join(whole, "conv_id", "left").select("conv_id", zero.alias("depth"), pair(zero, zero).alias("h"), pair(none, none).alias("before"), (F.coalesce("size", zero) + 1).alias("left"), zero.alias("words"))
    return summed.select(
        "conv_id",
        F.col("pos").alias("depth"),
        pair(hx, hy).alias("h"),
        pair(hx.bitwiseXOR(F.col("x")), hy.bitwiseXOR(F.col("y"))).alias("before"),
        (F.col("here") + F.col("after")).alias("left"),
        "words",
    ).unionByName(roots)


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of prefixes. nodes: rep and depth, their name; h; parent, the parent's
    rep; n_convs, n_children, words of the last text and weight of the subtree. ways:
    the rep and the parent of each prefix of the conversations that name a node."""
    facts = settled(rows.groupBy("depth", "h").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.sum("left").alias("weight"), F.first("before").alias("before"), F.first("words").alias("words")))
    above = facts.select((F.col("depth") + 1).alias("depth"), F.col("h").alias("before"), F.col("rep").alias("parent"))
    linked = settled(facts.join(above, ["depth", "before"], "left").drop("before"))
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = linked.join(children, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    naming = linked.select(F.col("rep").alias("conv_id")).distinct()
    steps = rows.where("depth > 0").select("conv_id", "depth", "h").join(naming, "conv_id", "left_semi")
    return settled(nodes), steps.join(linked.select("depth", "h", "rep", "parent"), ["depth", "h"]).select("conv_id", "depth", "rep", "parent")


def subtree_totals(nodes: DataFrame, ways: DataFrame, values: dict[str, Column], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """rep, depth and the totals of `values` over each node's subtree."""
    names = list(values)
    own, got = [f"own_{n}" for n in names], [f"got_{n}" for n in names]
    component = ["top", "top_depth"]  # a component is named by its top, the first one by nothing
    name = F.lit("0").cast(nodes.schema["rep"].dataType)
    state = settled(nodes.select("rep", "depth", "parent", "weight", name.alias("top"), F.lit(-1).cast("long").alias("top_depth"), *(v.cast("long").alias(f"own_{n}") for n, v in values.items()), *(F.lit(0).cast("long").alias(g) for g in got)))
    done, looked_up = [], None
    while True:
        sizes = state.groupBy(*component).agg(F.count("*").alias("n"), F.max("weight").alias("whole"))
        large = settled(sizes.where(F.col("n") > local_nodes))
        if not large.head(1):
            break
        looked_up = settled(ways) if looked_up is None else looked_up
        state = settled(state.join(large, component, "left").withColumn("on_way", F.col("weight") * 2 > F.col("whole")))
        done.append(_finished_in_tasks(state.where("n IS NULL"), names))
        centre = state.where("on_way").groupBy(*component).agg(F.max_by(F.struct("rep", "depth", "weight"), "depth").alias("c"))
        inside = state.where("n IS NOT NULL").join(centre, component)
        # The prefix one turn longer than the centroid tells whether a node hangs below it, and under which child.
        step = looked_up.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("at"), F.col("rep").alias("child"), F.col("parent").alias("of"))
        aside = inside.where("NOT on_way").withColumn("at", F.col("c.depth")).join(step, ["rep", "at"], "left")
        aside = aside.withColumn("child", F.when(F.col("of") == F.col("c.rep"), F.col("child"))).drop("at", "of")
        is_centre = (F.col("rep") == F.col("c.rep")) & (F.col("depth") == F.col("c.depth"))
        split = settled(aside.withColumn("centre", F.lit(False)).unionByName(inside.where("on_way").withColumns({"child": F.lit(None).cast(nodes.schema["rep"].dataType), "centre": is_centre})))
        totals = split.where("centre OR child IS NOT NULL").groupBy(*component).agg(*(F.sum(o).alias(f"sum_{n}") for o, n in zip(own, names)))
        added = {f"got_{n}": F.col(f"got_{n}") + F.when(F.col("on_way"), F.col(f"sum_{n}")).otherwise(0) for n in names}
        split = split.join(totals, component).withColumns(added)
        done.append(split.where("centre").select("rep", "depth", *(F.col(g).alias(n) for g, n in zip(got, names))))
        below = F.col("child").isNotNull()
        state = settled(
            split.where("NOT centre").select(
                "rep",
                "depth",
                "parent",
                F.when(F.col("on_way"), F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"),
                F.when(below, F.col("child")).otherwise(F.col("top")).alias("top"),
                F.when(below, F.col("c.depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
                *own,
                *got,
            )
        )
    out = _finished_in_tasks(state, names)
    for part in done:
        out = out.unionByName(part)
    return out


def _finished_in_tasks(state: DataFrame, names: list[str]) -> DataFrame:
    """Totals of components that each have few nodes."""
    kind = dict(state.dtypes)["rep"]
    columns = ["rep", "depth", "parent", "weight", "top", "top_depth", *(f"own_{n}" for n in names), *(f"got_{n}" for n in names)]
    types = {"rep": state.schema["rep"].dataType}
    k = len(names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[4:6] != current:
                    out += _rolled_up(rows, k)
                    current, rows = row[4:6], []
                rows.append(row)
            if out:
                yield _arrow(out)
        if rows:
            yield _arrow(_rolled_up(rows, k))

    rep = to_arrow_type(types["rep"])

    def _arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, rep if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))], names=["rep", "depth", *names])

    dealt = state.select(columns).repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth")
    return dealt.mapInArrow(finish, f"rep {kind}, depth long, " + ", ".join(f"`{n}` long" for n in names))


def _rolled_up(rows: list[tuple], k: int) -> list[tuple]:
    """rep, depth and totals of one component's nodes, which come by depth."""
    places = {row[:2]: i for i, row in enumerate(rows)}
    parents = [places.get((row[2], row[1] - 1), -1) for row in rows]
    children: list[list[int]] = [[] for _ in rows]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    totals = decomposed(children, [row[3] for row in rows], [row[6 : 6 + k] for row in rows])
    return [(*row[:2], *(a + b for a, b in zip(row[6 + k :], total))) for row, total in zip(rows, totals)]


def decomposed(children: list[list[int]], weights: list[int], values: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Totals over subtrees of a tree with node 0 on top; `weights` are those of
    subtrees and greater than those of any part."""
    if not values:
        return []
    weights, gone = list(weights), [False] * len(values)
    splits: list[tuple[list[int], int, bool]] = []  # way to the centroid, split it is a part of, whether below
    tops = [(0, -1, False)]
    while tops:
        top, split, below = tops.pop()
        way, whole = [top], weights[top]
        while True:
            heavy = next((u for u in children[way[-1]] if not gone[u] and 2 * weights[u] > whole), None)
            if heavy is None:
                break
            way.append(heavy)
        centre = way.pop()
        gone[centre] = True
        for v in way:
            weights[v] -= weights[centre]
        made = len(splits)
        splits.append(([*way, centre], split, below))
        tops += [(u, made, True) for u in children[centre] if not gone[u]]
        if way:
            tops.append((top, made, False))
    sums = []
    for j in range(len(values[0])):
        under, rest, total = [0] * len(splits), [0] * len(splits), [0] * len(values)
        for i in range(len(splits) - 1, -1, -1):  # parts come after what they are parts of
            way, split, below = splits[i]
            here = under[i] + values[way[-1]][j]
            for v in way:
                total[v] += here
            if split >= 0:
                if below:
                    under[split] += here + rest[i]
                else:
                    rest[split] += here + rest[i]
        sums.append(total)
    return list(zip(*sums))


def digests(members: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and ends_sha256, of the ids of their members, ascending and joined by
    commas. Ids are joined in runs of bounded length, and one digest reads the runs in
    order, so it holds one of them at a time."""
    slot = F.floor(F.col("conv_id") / _PIECE)
    runs = members.groupBy(*keys, slot.alias("slot")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("run"))
    fields = ", ".join(f"`{k}` {dict(members.dtypes)[k]}" for k in keys)
    types = [to_arrow_type(members.schema[k].dataType) for k in keys]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:-1] == current:
                    state.update(b"," + row[-1].encode())
                else:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = row[:-1], hashlib.sha256(row[-1].encode())
            if out:
                yield made(out)
        if current is not None:
            yield made([(*current, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*types, pa.string()])], names=[*keys, "ends_sha256"])

    dealt = runs.repartition(*keys).sortWithinPartitions(*keys, "slot").select(*keys, "run")
    return dealt.mapInArrow(read, f"{fields}, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """A row for every node of the conversations `ids`, of which `turns` (conv_id, pos
    from 1 without gaps, x, y, words) has the turns: conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that need not be
    kept once more for every other conversation through a node, summed over the subtree)
    and ends_sha256, of the conversations that end there."""
    rows = settled(prefixes(turns, settled(ids)))
    nodes, ways = nodes_of(rows)
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    totals = subtree_totals(nodes, ways, values, local_nodes)
    ends = digests(rows.where("left = 1").select("depth", "h.x", "h.y", "conv_id"), ["depth", "x", "y"])
    ends = ends.select("depth", F.struct("x", "y").alias("h"), "ends_sha256")
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, ["rep", "depth"])
        .join(ends, ["depth", "h"], "left")
        .select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )


_CRC_STEPS = "list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
TRIE_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  i AS (SELECT conv_id, count(*) AS size FROM t GROUP BY conv_id),
  h AS (SELECT conv_id, xor({_CRC_STEPS}, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM i),
  p AS (SELECT h.*, least(h.h, coalesce(i.size, 0)) AS given FROM h LEFT JOIN i ON i.conv_id = h.base),
  r AS (SELECT p.conv_id, t.pos, t.role, t.text FROM p JOIN t ON t.conv_id = p.base AND t.pos <= p.given
    UNION ALL SELECT p.conv_id, p.given + t.pos - p.h, t.role, t.text FROM p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
  s AS (SELECT conv_id, pos, text, list(role || chr(1) || text) OVER (PARTITION BY conv_id ORDER BY pos) AS way FROM r
    UNION ALL SELECT conv_id, 0, '', [] FROM i),
  n AS (SELECT way, min(conv_id) AS conv_id, pos AS depth, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words FROM s GROUP BY way, pos),
  e AS (SELECT n.conv_id, n.depth, string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) AS ids FROM s JOIN n ON n.way = s.way
    JOIN (SELECT conv_id, max(pos) AS pos FROM s GROUP BY conv_id) l ON l.conv_id = s.conv_id AND l.pos = s.pos GROUP BY ALL),
  k AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n u ON u.way = n.way[:-2] AND n.depth > 0),
  c AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
  a AS (SELECT k.way, k.depth, k.n_convs, k.words, c.n_children FROM k LEFT JOIN c ON c.parent_conv_id = k.conv_id AND c.depth = k.depth),
  x AS (SELECT a.*, unnest(range(0, depth + 1)) AS d FROM a),
  y AS (SELECT way[:d] AS way, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM x GROUP BY way[:d])
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, CAST(y.n_leaves AS BIGINT) AS n_leaves,
  CAST(y.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM k JOIN y ON y.way = k.way LEFT JOIN c ON c.parent_conv_id = k.conv_id AND c.depth = k.depth LEFT JOIN e ON e.conv_id = k.conv_id AND e.depth = k.depth"""
