"""Shards of near equal bytes by a k-d tree over document metadata.

Each node holding several shards is split along its widest dimension (its range relative to
the whole table's) at the weighted quantile that gives each side the bytes of its shards: the
median, or a third where three shards are left.  All nodes of a level are cut together.  A
cut is found by narrowing: one aggregate counts bytes in equal bins of each node's interval,
the bin that holds the quantile becomes the next interval.  So the driver sees numbers only,
at most 32 * `BINS` a round (16 a node, where nodes are more), however many documents there
are.  Tasks hold the tree as arrays, a few numbers a node, and rows walk down it a batch at a
time; they aggregate before anything is shuffled.

Where one value of the dimension holds too many bytes, the cut goes on by a hash of the text
within that value, and within one text by a hash of the row.  Dimensions are functions of the
text, so copies of a text are never parted unless their group alone outweighs the tolerance.

Defined cases: a null text weighs the fixed overhead; ties and repeated rows are told apart by
a stored row hash; a document larger than a shard's share makes its shard larger; an empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import column, numbered, read, saved

OVERHEAD = 8
#: Bins of a node's interval, and a 32nd of those of all nodes of a level together.
BINS = 1024
#: A dimension, then the text's hash, then the row's.
KEYS = 3
TOLERANCE = 0.002
TOP = (1 << 62) - 1
DIMENSIONS = ("d_bytes", "d_wide", "d_lines")


def points(docs: DataFrame) -> DataFrame:
    """One small stored row per document: id, weight, dimensions and the two tie keys."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    size = F.octet_length(text) + OVERHEAD
    scaled = lambda c, by: F.floor(c * by).cast("long")
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    rows = docs.select(
        column(docs, "doc_id", "long").alias("doc_id"), size.cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        scaled(F.log2(size), 1000).alias("d_bytes"),
        scaled((size - OVERHEAD) / F.greatest(F.length(text), F.lit(1)), 10000).alias("d_wide"),
        scaled(F.log2(lines + 1), 1000).alias("d_lines"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("k_text"),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), column(docs, "doc_id", "long")), 2).alias("k_row"),
        F.spark_partition_id().alias("part"))
    return saved(rows, "points")


@dataclass
class Node:
    """A tree node: how many shards it holds, and its cut once that is known."""
    shards: int
    first: int
    weight: int = 0
    axis: int = 0
    cut: tuple[int, ...] = ()
    children: tuple["Node", ...] = ()
    #: While the cut is sought: the interval, and the bytes known to lie left of it.
    low: int = 0
    high: int = TOP
    before: int = 0
    done: bool = field(default=False)

    @property
    def target(self) -> float:
        return self.weight * (self.shards // 2) / self.shards

    def width(self, bins: int) -> int:
        return (self.high - self.low) // bins + 1

    def narrow(self, bins: list[tuple[int, int, int, int]], slack: float) -> None:
        """Take in (bin, bytes, least key, greatest key) of the interval's bins that have rows."""
        reached = self.before
        for at, weight, least, greatest in sorted(bins):
            if reached + weight >= self.target or at == max(b[0] for b in bins):
                break
            reached += weight
        fits, last = weight <= slack, len(self.cut) + 1 == KEYS
        if fits or (least == greatest and last):
            # The boundary nearer to the target, on this side of the bin or the other.
            self.cut += (least if self.target - reached < reached + weight - self.target else greatest + 1,)
            self.done = True
        elif least == greatest:
            self.cut, self.low, self.high, self.before = (*self.cut, least), 0, TOP, reached
        else:
            self.low, self.high, self.before = least, greatest, reached


class Walk:
    """The tree as arrays, a few numbers a node, along which a batch of rows goes down together."""

    def __init__(self, root: Node, marks: dict[int, int]):
        nodes = [root]
        for node in nodes:  # grows as it goes
            nodes += node.children
        number = {id(n): i for i, n in enumerate(nodes)}
        self.axis = np.array([n.axis for n in nodes])
        # A cut that needs fewer keys is closed by one that no key is below.
        self.cut = np.array([(*n.cut, *[-1] * (KEYS - len(n.cut))) for n in nodes])
        self.child = np.array([[number[id(c)] for c in n.children] or [-1, -1] for n in nodes])
        self.mark = np.array([marks.get(id(n), -1) for n in nodes])

    def __call__(self, batch: pa.RecordBatch, dimensions: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark of the node reached, its dimensions, its other keys) of every row."""
        values = np.stack([batch.column(d).to_numpy() for d in dimensions], axis=1)
        ties = np.stack([batch.column(c).to_numpy() for c in ("k_text", "k_row")], axis=1)
        at = np.zeros(len(values), np.int64)
        while len(inner := np.flatnonzero(self.child[at, 0] >= 0)):
            keys = np.concatenate([values[inner, self.axis[at[inner]]][:, None], ties[inner]], axis=1)
            cut = self.cut[at[inner]]
            left = keys[:, 2] < cut[:, 2]
            for k in (1, 0):
                left = (keys[:, k] < cut[:, k]) | ((keys[:, k] == cut[:, k]) & left)
            at[inner] = self.child[at[inner], np.where(left, 0, 1)]
        return self.mark[at], values, ties


def _per_key(key: np.ndarray, sums: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums, least and greatest rows of `values`)."""
    order = np.argsort(key, kind="stable")
    found, start = np.unique(key[order], return_index=True)
    return (found, np.add.reduceat(sums[order], start), np.minimum.reduceat(values[order], start), np.maximum.reduceat(values[order], start))


def _extents(rows: DataFrame, walk: Walk, dimensions: tuple[str, ...]) -> list:
    """A row for each marked node: its bytes, and the least and greatest of each dimension."""
    names = ["node", "weight", *[f"low_{d}" for d in dimensions], *[f"high_{d}" for d in dimensions]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, values, _ = walk(batch, dimensions)
            if (mine := mark >= 0).any():
                node, weight, low, high = _per_key(mark[mine], batch.column("size").to_numpy()[mine], values[mine])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, weight, *low.T, *high.T)], names=names)
    seen = rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))
    return seen.groupBy("node").agg(F.sum("weight").alias("weight"), *[F.min(f"low_{d}").alias(f"low_{d}") for d in dimensions],
                                    *[F.max(f"high_{d}").alias(f"high_{d}") for d in dimensions]).collect()


def _histograms(rows: DataFrame, walk: Walk, seeking: list[tuple[int, Node]], dimensions: tuple[str, ...], bins: int) -> dict[int, list]:
    """For each node that seeks its cut the bins of its interval that have rows."""
    size = max(i for i, _ in seeking) + 1
    known = np.full((size, KEYS - 1), -1)
    stage, axis, low, high, width = (np.zeros(size, np.int64) for _ in range(5))
    stage[:] = -1
    for i, n in seeking:
        known[i, :len(n.cut)] = n.cut
        stage[i], axis[i], low[i], high[i], width[i] = len(n.cut), n.axis, n.low, n.high, n.width(bins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, values, ties = walk(batch, dimensions)
            mine = np.flatnonzero((mark >= 0) & (mark < size))
            mine = mine[stage[mark[mine]] >= 0]
            node = mark[mine]
            keys = np.concatenate([values[mine, axis[node]][:, None], ties[mine]], axis=1)
            x = keys[np.arange(len(mine)), stage[node]]
            inside = (x >= low[node]) & (x <= high[node])
            for k in range(KEYS - 1):  # equal to the cut so far
                inside &= (stage[node] <= k) | (keys[:, k] == known[node, k])
            node, x, weight = node[inside], x[inside], batch.column("size").to_numpy()[mine[inside]]
            if len(node):
                key, weight, least, most = _per_key(node * bins + (x - low[node]) // width[node], weight, x)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key // bins, key % bins, weight, least, most)],
                                                 names=["node", "bin", "w", "a", "b"])
    found: dict[int, list] = {}
    for r in (rows.mapInArrow(work, "node long, bin long, w long, a long, b long").groupBy("node", "bin")
              .agg(F.sum("w").alias("w"), F.min("a").alias("a"), F.max("b").alias("b")).collect()):
        found.setdefault(r["node"], []).append((r["bin"], r["w"], r["a"], r["b"]))
    return found


def kd_tree(rows: DataFrame, shards: int, dimensions: tuple[str, ...] = DIMENSIONS, tolerance: float = TOLERANCE) -> Node:
    """The tree with `shards` leaves; each cut is off by at most `tolerance` of a shard where documents allow it.

    The driver holds the tree and, of a level at a time, at most about `BINS` numbers.
    """
    root = Node(shards, 0)
    level, whole, slack = [root], None, 0.0
    while level:
        walk = Walk(root, {id(n): i for i, n in enumerate(level)})
        seen = {r["node"]: r for r in _extents(rows, walk, dimensions)}
        if not seen:
            return root
        width = lambda r, d: r[f"high_{d}"] - r[f"low_{d}"]
        if whole is None:
            whole = {d: max(1, width(seen[0], d)) for d in dimensions}
            slack = tolerance * seen[0]["weight"] / shards
        seeking = []
        for i, node in enumerate(level):
            if (r := seen.get(i)) is None:
                node.cut = (0,)  # no rows: any cut will do
                continue
            widest = max(dimensions, key=lambda d: width(r, d) / whole[d])
            node.weight, node.axis = r["weight"], dimensions.index(widest)
            node.low, node.high = r[f"low_{widest}"], r[f"high_{widest}"]
            seeking.append((i, node))
        while seeking:
            bins = max(16, min(BINS, 32 * BINS // len(seeking)))
            found = _histograms(rows, walk, seeking, dimensions, bins)
            for i, node in seeking:
                node.narrow(found[i], slack)
            seeking = [(i, n) for i, n in seeking if not n.done]
        for node in level:
            left = node.shards // 2
            node.children = (Node(left, node.first), Node(node.shards - left, node.first + left))
        level = [c for n in level for c in n.children if c.shards > 1]
    return root


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` (from `points`) with `shard` and a gapless `slot` in it.

    A slot is the row's number within its stored part and shard, after the rows of the parts
    before: no task sees a whole shard.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    tree = kd_tree(rows, shards) if shards > 1 else Node(1, 0)
    leaves, todo = {}, [tree]
    while todo:
        node = todo.pop()
        todo += node.children
        if not node.children:
            leaves[id(node)] = node.first
    walk = Walk(tree, leaves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = walk(batch, DIMENSIONS)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())])
    return numbered(rows.mapInArrow(work, schema), ["shard"], "k_row", "slot")


def shards_for(rows: DataFrame, target_bytes: int) -> int:
    """How many shards of about `target_bytes` the documents need."""
    whole = rows.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-whole // target_bytes))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    out = sharded(points(read(spark, sf_dir, "documents")), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
