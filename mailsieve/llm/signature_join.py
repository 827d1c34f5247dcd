"""Jaccard self-join on word shingles with signature trees.

Texts with equal shingle sets are one class. A class can only be linked to
another by shingles that occur in several classes, so first the document
frequency of every shingle is found, from packed rows dealt by hash. Shingles
that a bounded sample shows to be hot are not counted but ranked last, so a
passage or a group of near copies that holds a third of all rows meets in no
task. Ordered from rare to frequent, two sets of the wanted similarity share a shingle among
the first n - ceil(t n) + 1 of each; a class of which those are all its own is
done. The few that are left, reduced to their shared shingles, are put together
wherever their prefixes meet.

Each such cluster is joined with a signature tree. A node holds the OR of its
members' token bitmaps, their range of set sizes and the most tokens that share
a bit in one member. Common tokens of two members set common bits, so

    overlap <= popcount(OR & OR') + min(collisions, collisions')

bounds every pair below two nodes, and pairs of nodes that cannot reach
3/7 (|a| + |b|), which is a similarity of 0.75, are never opened, nor are pairs
whose members are already joined. What is left is verified by exact
intersection. Large clusters are cut into blocks that are joined in tasks of their
own, first each with a few anchors of the cluster, then with what is left over.

A null text, and one without a word, has an empty set, is linked with nothing
and is its own component. A text of fewer words than a shingle has one shingle,
all its words. Repeated rows, also of one doc_id, are in the same class. Null
ids never name a component that has others. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.components import components
from mailsieve.llm.shared import partitions, settled, stored, unused
from mailsieve.llm.text import Chunk, chunks, inside_document, mix, shingle_hashes

WORDS = 5
# Similarity as a fraction; links need OVER * |a ∩ b| >= ABOVE * |a ∪ b|.
ABOVE, OVER = 75, 100
# Shingles in a bucket or shard, and classes and their shared shingles in a block:
# what a task holds.
BUCKET_TOKENS = 1_500_000
BLOCK_CLASSES = 1_024
BLOCK_TOKENS = 2_000_000
# A shingle in so many of so many sampled documents is hot.
HOT_SAMPLE, HOT_LEAST = 20_000, 16
_HOT_RANK = 255
# Of a block's worth of classes, one in so many is an anchor of its cluster.
_ANCHOR_SHARE = 16
_FANOUT = 8
_HELD_TOKENS = 1_000_000
_REPLY = np.dtype([("cls", "<i8"), ("token", "<u8"), ("n", "<u4"), ("rank", "u1")])


def _sets(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) pairs of a chunk, sorted, each once."""
    starts, stops, owners = chunk.words()
    hashes = chunk.spans_hash(starts, stops)
    whole = np.flatnonzero(inside_document(owners, words))
    tokens, of = shingle_hashes(hashes, words)[whole], owners[whole]
    counts = np.bincount(owners, minlength=len(chunk))
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        first = np.searchsorted(owners, few)
        extra = np.zeros(len(few), dtype=np.uint64)
        for k in range(words - 1):
            has = counts[few] > k
            at = np.minimum(first + k, len(hashes) - 1)
            extra += np.where(has, mix(hashes[at] + np.uint64(k + 1)), np.uint64(0)) * np.uint64(2 * k + 1)
        tokens = np.concatenate([tokens, mix(extra ^ np.uint64(0xA5A5A5A5A5A5A5A5))])
        of = np.concatenate([of, few])
    order = np.lexsort((tokens, of))
    tokens, of = tokens[order], of[order]
    keep = np.ones(len(tokens), dtype=bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    return of[keep], tokens[keep]


def _classes(of: np.ndarray, tokens: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, class) of every document; the class is a hash of the set."""
    sizes = np.bincount(of, minlength=documents)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(tokens + np.uint64(0x51)))])
    ends = np.cumsum(sizes)
    return sizes, mix((sums[ends] - sums[ends - sizes]) ^ sizes.astype(np.uint64)).view(np.int64)


def shingle_classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles and class (null for an empty set) of every
    document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), lower=True):
                sizes, cls = _classes(*_sets(chunk, words), len(chunk))
                known = [batch.column(0)[chunk.rows], batch.column(1)[chunk.rows]]
                yield pa.RecordBatch.from_arrays([*known, pa.array(sizes.astype(np.int64)), pa.array(cls, mask=sizes == 0)], names=["doc_id", "text_hash", "n_shingles", "class"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_shingles long, class long")


def _packed_rows(bucket: np.ndarray, cls: np.ndarray, size: np.ndarray, tokens: np.ndarray, width: int) -> list[tuple]:
    """One row for each bucket: its classes, their set sizes and numbers of tokens
    in it, and the low `width` bytes of the tokens."""
    order = np.lexsort((cls, bucket))
    cls, size, tokens, bucket = cls[order], size[order], tokens[order], bucket[order]
    new = np.ones(len(cls), dtype=bool)
    new[1:] = (cls[1:] != cls[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(cls))).astype("<u4")
    starts = np.append(first, len(cls))
    present = np.unique(bucket)
    cuts = np.append(np.searchsorted(bucket[first], present), len(first))
    low = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    rows = []
    for b, i, j in zip(present, cuts, cuts[1:]):
        rows.append((int(b), cls[first[i:j]].astype("<i8").tobytes(), size[first[i:j]].astype("<u4").tobytes(), counts[i:j].tobytes(), low[starts[i] : starts[j]].tobytes()))
    return rows


def _postings(docs: DataFrame, words: int, buckets: int, hot: np.ndarray | None = None) -> DataFrame:
    """bucket, and the tokens in it by class, packed: class (8 bytes), set size and
    number of tokens (4 each), and 6 bytes of every token. A token is the low 16 bits of
    the number of its bucket and 48 bits of its hash. Tokens in `hot` need no counting: they
    go, whole, to buckets behind the others that are dealt without regard to them."""
    hot = np.zeros(0, dtype=np.uint64) if hot is None else hot

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cls, size, hashes = (np.concatenate(x) for x in zip(*held))
        bucket = (hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
        tokens = hashes & np.uint64((1 << 48) - 1) | bucket << np.uint64(48)
        known = np.zeros(len(tokens), dtype=bool)
        if len(hot):
            known = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
        rest = ~known
        rows = _packed_rows(bucket[rest].astype(np.int64), cls[rest], size[rest], tokens[rest], 6)
        dealt = buckets + np.mod(cls[known], buckets)
        rows += _packed_rows(dealt, cls[known], size[known], tokens[known], 8)
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "classes", "sizes", "counts", "tokens"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, seen = [], 0, set()
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                of, tokens = _sets(chunk, words)
                sizes, cls = _classes(of, tokens, len(chunk))
                fresh = np.zeros(len(chunk), dtype=bool)
                for i in np.flatnonzero(sizes):  # copies within what is held are sent once
                    if cls[i] not in seen:
                        seen.add(cls[i])
                        fresh[i] = True
                keep = fresh[of]
                if keep.any():
                    held.append((cls[of[keep]], sizes[of[keep]], tokens[keep]))
                    waiting += int(keep.sum())
                if waiting >= _HELD_TOKENS:
                    yield flush(held)
                    held, waiting, seen = [], 0, set()
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(work, "bucket int, classes binary, sizes binary, counts binary, tokens binary")


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=kind)


def _bucket_rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, set size, token) of a bucket, by token and class, each once."""
    counts = _joined(table, "counts", "<u4")
    cls = np.repeat(_joined(table, "classes", "<i8"), counts)
    size = np.repeat(_joined(table, "sizes", "<u4"), counts)
    raw = _joined(table, "tokens", np.uint8).reshape(-1, width)
    tokens = np.zeros((len(raw), 8), dtype=np.uint8)
    tokens[:, :width] = raw
    tokens = tokens.view("<u8").ravel()
    if width < 8:
        tokens = tokens | np.uint64(table.column("bucket")[0].as_py()) << np.uint64(48)
    order = np.lexsort((cls, tokens))
    cls, size, tokens = cls[order], size[order], tokens[order]
    once = np.ones(len(cls), dtype=bool)
    once[1:] = (cls[1:] != cls[:-1]) | (tokens[1:] != tokens[:-1])
    return cls[once], size[once], tokens[once]


def _frequencies(tokens: np.ndarray) -> np.ndarray:
    """How often each of the sorted tokens occurs."""
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = tokens[1:] != tokens[:-1]
    found = np.bincount(np.cumsum(first) - 1) if len(tokens) else np.zeros(0, dtype=np.int64)
    return np.repeat(found, found)


def _hot_tokens(docs: DataFrame, rows: int, words: int, buckets: int, sample: int, least: int) -> np.ndarray:
    """Tokens of at least `least` classes in a sample of about `sample` of the
    `rows` documents. There are at most as many as the sample has tokens, divided
    by `least`, however large the corpus: few enough to be sent to every task."""
    share = min(1.0, sample / max(rows, 1))
    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def frequent(table: pa.Table) -> pa.Table:
        _, _, tokens = _bucket_rows(table, 6)
        return pa.table({"tokens": pa.array([np.unique(tokens[_frequencies(tokens) >= least]).astype("<u8").tobytes()], pa.binary())})

    found = _postings(few, words, buckets).groupBy("bucket").applyInArrow(frequent, "tokens binary").collect()
    return np.sort(np.concatenate([np.frombuffer(bytes(r.tokens), dtype="<u8") for r in found] + [np.zeros(0, dtype="<u8")]))


def _shared_tokens(postings: DataFrame, buckets: int, shards: int) -> DataFrame:
    """shard (of classes) and packed replies: every token that occurs in several
    classes, with its frequency as a rank of one byte; hot ones rank last."""

    def count(table: pa.Table) -> pa.Table:
        is_hot = table.column("bucket")[0].as_py() >= buckets
        cls, size, tokens = _bucket_rows(table, 8 if is_hot else 6)
        frequency = np.full(len(tokens), _HOT_RANK) if is_hot else np.minimum(_frequencies(tokens), _HOT_RANK - 1)
        several = frequency > 1
        reply = np.zeros(int(several.sum()), dtype=_REPLY)
        reply["cls"], reply["n"] = cls[several], size[several]
        reply["token"], reply["rank"] = tokens[several], frequency[several]
        shard = np.mod(reply["cls"], shards)
        order = np.argsort(shard, kind="stable")
        reply, cuts = reply[order], np.searchsorted(shard[order], np.arange(shards + 1))
        parts = np.flatnonzero(np.diff(cuts))
        return pa.table({"shard": pa.array(parts, pa.int32()), "replies": pa.array([reply[cuts[s] : cuts[s + 1]].tobytes() for s in parts], pa.binary())})

    return postings.groupBy("bucket").applyInArrow(count, "shard int, replies binary")


def _suspects(replies: DataFrame) -> DataFrame:
    """class, n, tokens (shared ones, packed and sorted) and prefix of every class
    whose prefix has a shared token."""

    def choose(table: pa.Table) -> pa.Table:
        reply = _joined(table, "replies", _REPLY)
        reply = reply[np.lexsort((reply["token"], reply["rank"], reply["cls"]))]
        # Copies of a class in several tasks repeat its hot tokens.
        once = np.ones(len(reply), dtype=bool)
        once[1:] = (reply["cls"][1:] != reply["cls"][:-1]) | (reply["token"][1:] != reply["token"][:-1])
        reply = reply[once]
        cls, first = np.unique(reply["cls"], return_index=True)
        ends = np.append(first[1:], len(reply))
        n = reply["n"][first].astype(np.int64) if len(reply) else np.zeros(0, np.int64)
        own = n - (ends - first)  # tokens that no other class has come first
        wanted = n - (ABOVE * n + OVER - 1) // OVER + 1 - own
        chosen = np.flatnonzero(wanted > 0)
        tokens = [np.sort(reply["token"][first[i] : ends[i]]).astype("<u8").tobytes() for i in chosen]
        prefix = [reply["token"][first[i] : min(first[i] + wanted[i], ends[i])].view(np.int64) for i in chosen]
        return pa.table(
            {"class": pa.array(cls[chosen], pa.int64()), "n": pa.array(n[chosen], pa.int64()), "tokens": pa.array(tokens, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64()))}
        )

    return replies.groupBy("shard").applyInArrow(choose, "class long, n long, tokens binary, prefix array<long>")


class SignatureTree:
    """A balanced tree over sets in the order of their sizes."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], bits: int):
        self.sizes, self.sets = sizes, sets
        signatures = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, tokens in enumerate(sets):
            places = (tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
            np.bitwise_or.at(signatures[i], places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        self.spare = np.array([len(s) for s in sets]) - np.bitwise_count(signatures).sum(axis=1).astype(np.int64)
        # Levels from the members up: (OR bitmap, least size, most size, most collisions).
        self.levels = [(signatures, sizes, sizes, self.spare)]
        while len(self.levels[-1][0]) > 1:
            bitmap, least, most, spare = self.levels[-1]
            cuts = np.arange(0, len(bitmap), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), np.maximum.reduceat(spare, cuts)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * _FANOUT, min((node + 1) * _FANOUT, len(self.levels[level - 1][0])))

    def members(self, level: int, node: int) -> slice:
        width = _FANOUT**level
        return slice(node * width, min((node + 1) * width, len(self.sets)))

    def can_link(self, level: int, a: np.ndarray, other: SignatureTree, other_level: int, b: np.ndarray) -> np.ndarray:
        """Matrix of the node pairs that may hold a link."""
        bitmap, least, most, spare = (x[a] for x in self.levels[level])
        bitmap2, least2, most2, spare2 = (x[b] for x in other.levels[other_level])
        common = np.bitwise_count(bitmap[:, None, :] & bitmap2[None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(spare[:, None], spare2[None, :])
        enough = (OVER + ABOVE) * common >= ABOVE * (least[:, None] + least2[None, :])
        return enough & (OVER * most[:, None] >= ABOVE * least2[None, :]) & (OVER * most2[None, :] >= ABOVE * least[:, None])


def _bits(tokens: int) -> int:
    """Bits of a bitmap for sets of so many tokens. At most 16 KB: for larger sets
    the bound is looser, as more tokens share a bit, but as safe."""
    return min(1 << 17, max(256, 1 << max(0, 4 * tokens - 1).bit_length()))


def linked_labels(sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None, joined: np.ndarray | None = None) -> np.ndarray:
    """For every set the least index that it is joined to by links. With `side`
    (0 or 1), links within a side are left to other tasks; sets of one value in
    `joined` are known to be joined."""
    order = np.argsort(sizes, kind="stable")
    label = np.arange(len(sets))
    if joined is not None:
        _, first, place = np.unique(joined, return_index=True, return_inverse=True)
        label = first[place]

    def link(i: int, j: int) -> None:
        if label[i] != label[j]:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if (OVER + ABOVE) * common >= ABOVE * (sizes[i] + sizes[j]):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low

    parts = [order] if side is None else [order[side[order] == 0], order[side[order] == 1]]
    if any(len(p) == 0 for p in parts):
        return label
    bits = _bits(max((len(s) for s in sets), default=1))
    trees = [SignatureTree(sizes[p], [sets[i] for i in p], bits) for p in parts]
    one, two, of_one, of_two = trees[0], trees[-1], parts[0], parts[-1]
    top, top2 = len(one.levels) - 1, len(two.levels) - 1
    stack = [(top, 0, top2, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        same = label[of_one[one.members(la, a)]], label[of_two[two.members(lb, b)]]
        if same[0].min() == same[0].max() == same[1].min() == same[1].max():
            continue  # one member with itself, or all joined already
        if la == lb == 0:
            link(of_one[a], of_two[b])
            continue
        # The higher of the two nodes is opened, or both.
        open_one, open_two = la >= lb, lb >= la
        down = one.children(la, a) if open_one else np.array([a])
        down2 = two.children(lb, b) if open_two else np.array([b])
        la, lb = la - open_one, lb - open_two
        pairs = np.argwhere(one.can_link(la, down, two, lb, down2))
        if one is two and a == b:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        # What is put last is looked at first: nodes near in size, which are likeliest to join.
        pairs = pairs[np.argsort(-np.abs(down[pairs[:, 0]] - down2[pairs[:, 1]]), kind="stable")]
        stack.extend((la, int(down[x]), lb, int(down2[y])) for x, y in pairs)
    return label


def _tree_joins(dealt: DataFrame) -> DataFrame:
    """Links a, b between classes, enough to connect what is linked, from tasks of
    root, block, part, side (-1: all with all), class, n, tokens and joined."""
    rows, held = dealt.agg(F.count("*"), F.coalesce(F.sum(F.length("tokens") / 8), F.lit(0))).first()
    # About half a block in a slot, so few get a second large one.
    slots = max(partitions(dealt.sparkSession), math.ceil(2 * rows / BLOCK_CLASSES), math.ceil(2 * held / BLOCK_TOKENS))

    def join(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(c).to_numpy() for c in ("root", "block", "part")], axis=1) if len(table) else np.zeros((0, 3), np.int64)
        cls, n, side, joined = (table.column(c).to_numpy() for c in ("class", "n", "side", "joined"))
        order = np.lexsort((cls, keys[:, 2], keys[:, 1], keys[:, 0]))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(order))
        a, b, packed = [], [], table.column("tokens")
        for s, e in zip(starts, starts[1:]):
            rows = order[s:e]
            sets = [np.frombuffer(packed[int(r)].as_py(), dtype="<u8") for r in rows]
            label = linked_labels(n[rows], sets, None if side[rows[0]] < 0 else side[rows], joined[rows])
            moved = np.flatnonzero(label != np.arange(len(label)))
            a.append(cls[rows[moved]])
            b.append(cls[rows[label[moved]]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a + none), pa.int64()), "b": pa.array(np.concatenate(b + none), pa.int64())})

    keyed = dealt.withColumn("slot", F.pmod(F.xxhash64("root", "block", "part"), F.lit(slots)))
    return keyed.groupBy("slot").applyInArrow(join, "a long, b long")


def _named(stars: DataFrame) -> DataFrame:
    """node and component of links a, b that lead from each node to the least of its
    component."""
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())


def _linked(suspects: DataFrame, clusters: DataFrame, block: int) -> DataFrame:
    """node and component of the classes in clusters (node, component) that are
    linked to another.

    A cluster of more than `block` classes, or of more than BLOCK_TOKENS shared shingles,
    is cut into blocks. Each is joined by
    itself together with a few anchors from the whole cluster, which mostly
    connects all that is linked. What is then outside a cluster's largest component
    is held against every block; the members of that component have no more to
    find among themselves. So a task has two blocks at the most, and there are as many as
    the cluster has blocks, times those of what is left over."""
    lengths = suspects.select(F.col("class").alias("node"), (F.length("tokens") / 8).alias("held"))
    by_size = F.greatest(F.count("*") / block, F.sum("held") / BLOCK_TOKENS)
    sizes = clusters.join(lengths, "node").groupBy("component").agg(F.ceil(by_size).cast("int").alias("blocks"))
    members = settled(clusters.join(sizes, "component").select(F.col("node").alias("class"), F.col("component").alias("root"), "blocks"))
    placed = members.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    anchor = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("class", F.lit("anchor")), F.col("blocks") * _ANCHOR_SHARE) == 0)
    everywhere = F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.select("root", F.explode(everywhere).alias("block"), "class").join(suspects.select("class", "n", "tokens"), "class")
    joined = settled(_tree_joins(first.select("root", "block", F.lit(0).alias("part"), F.lit(-1).alias("side"), "class", "n", "tokens", F.col("class").alias("joined"))))
    large = settled(placed.where("blocks > 1").select("root", "block", "blocks", "class"))
    if large.isEmpty():
        return _named(joined)
    # Within one block a class is linked to the least one it is joined to. Only
    # blocks of one cluster have to be brought together.
    in_large = joined.join(large.select(F.col("class").alias("a")), "a", "left_semi")
    small = joined.join(large.select(F.col("class").alias("a")), "a", "left_anti")
    found = components(in_large)
    large = large.join(found.withColumnRenamed("node", "class"), "class", "left")
    large = settled(large.select("root", "block", "blocks", "class", F.coalesce("component", "class").alias("joined")))
    counts = large.groupBy("root", "joined").count()
    main = counts.groupBy("root").agg(F.max_by("joined", F.struct("count", "joined")).alias("main"))
    rest = settled(large.join(main, "root").where("joined != main").drop("main"))
    if rest.isEmpty():
        return _named(small).union(found)
    parts = rest.join(lengths, rest["class"] == lengths["node"]).groupBy("root").agg(F.ceil(by_size).cast("int").alias("parts"))
    rest = rest.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    against = rest.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", F.lit(1).alias("side"), "class", "joined")
    blocks = large.join(parts, "root").select("root", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "class", "joined")
    tasks = blocks.union(against).join(suspects.select("class", "n", "tokens"), "class")
    more = _tree_joins(tasks.select("root", "block", "part", "side", "class", "n", "tokens", "joined"))
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return _named(small).union(found)


def linked_classes(
    docs: DataFrame, words: int = WORDS, bucket_tokens: int = BUCKET_TOKENS, block: int = BLOCK_CLASSES, hot_sample: int = HOT_SAMPLE, hot_least: int = HOT_LEAST
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles and class of every document; node and component
    of every class that is linked to another)."""
    classes = stored(shingle_classes(docs, words), "classes")
    tokens, rows = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    # The top 24 bits of a token's hash choose its bucket.
    buckets = min(1 << 24, max(1, math.ceil(tokens / bucket_tokens)))
    hot = _hot_tokens(docs, rows, words, buckets, hot_sample, hot_least)
    replies = _shared_tokens(_postings(docs, words, buckets, hot), buckets, max(1, math.ceil(buckets / 4)))
    suspects = stored(_suspects(replies), "suspects")
    prefix = suspects.select("class", F.explode("prefix").alias("token"))
    least = prefix.groupBy("token").agg(F.min("class").alias("b"), F.count("*").alias("_n")).where("_n > 1").select("token", "b")
    met = prefix.join(least, "token").where("class != b").select(F.col("class").alias("a"), "b")
    return classes, _linked(suspects, components(met), block)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, n_shingles, class and component_id, the least doc_id
    reachable by links, of every document."""
    classes, linked = linked_classes(docs, **options)
    named = classes.join(linked, classes["class"] == linked["node"], "left")
    named = settled(named.select("doc_id", "text_hash", "n_shingles", "class", F.coalesce("component", "class").alias("_component")))
    least = named.where("_component IS NOT NULL").groupBy("_component").agg(F.min("doc_id").alias("_least"))
    found = named.join(least.withColumnRenamed("_component", "_c"), F.col("_component") == F.col("_c"), "left")
    return found.select("doc_id", "text_hash", "n_shingles", "class", F.when(F.col("_component").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents, as they are, without those that are linked to a document of
    a lesser doc_id; of rows that repeat one doc_id and text, one stays. Documents
    without a word all stay."""
    found = near_duplicates(docs, **options).where("n_shingles > 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "component_id")
    stays = (F.col("_d") == F.col("component_id")) | (F.col("_d").isNull() & F.col("component_id").isNull())
    gone = settled(found.where(~F.coalesce(stays, F.lit(False))).select("_d", "_h").distinct())
    twice = settled(found.where(F.coalesce(stays, F.lit(False))).groupBy("_d", "_h").count().where("count > 1").select("_d", "_h"))
    leave = gone.union(twice)

    def same(keys: DataFrame):
        return docs["doc_id"].eqNullSafe(keys["_d"]) & (F.xxhash64(docs["text"]) == keys["_h"])

    text_hash = unused(docs, "text_hash")
    keyed = docs.join(twice, same(twice), "left_semi").withColumn(text_hash, F.xxhash64("text"))
    once = keyed.dropDuplicates(["doc_id", text_hash]).select(docs.columns)
    return docs.join(leave, same(leave), "left_anti").union(once)


COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
