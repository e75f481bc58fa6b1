"""A Merkle manifest of a table of documents, in blocks of van Emde Boas layout.

A document's leaf is a digest of its fields.  The leaves of a source, in order of doc_id, are
the leaves of a tree of fan-out `FAN`; the sources' roots, in order of source, are those of
the tree above.  Trees are stored as aligned subtrees of `HEIGHT` levels, one row each, whose
nodes lie in van Emde Boas order: a subtree is split at half its height, the upper part comes
first, then the lower ones from left to right, each laid out the same way.  So a path from a
leaf up touches few places whatever the size of a cache line, and `address` finds any node
by arithmetic alone, for building a block as for reading siblings.  Block roots are the leaves
of the next tier of blocks, until one block is left in every tree.

Leaves get their place by range partitions of (source, doc_id): counts per partition and source
give the offsets, so a source with a third of all rows fills a third of the partitions.  A task
builds one block after the other, `FAN ** HEIGHT` leaves at most.  Proofs come from the top
down: a block hands the siblings above each of its leaves to the block below it, and the last
tier writes one proof a document.  A document travels as its digests, never as its text.

Defined cases: null fields hash as `-`; a null source is a source of its own and comes first,
null ids come first in theirs; rows equal in doc_id lie in order of their leaf, equal rows each
have a leaf of their own; texts are hashed whole; a tree of one leaf has that leaf as its root
and an empty proof; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import column, dealt, read, removed, saved

FAN = 16
HEIGHT = 3
FIELDS = (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string"))
TAMPER_STEP = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ layout
def subtree_size(height: int, fan: int = FAN) -> int:
    """Nodes of a full subtree that has `height` levels below its root."""
    return (fan ** (height + 1) - 1) // (fan - 1)


def address(height: int, depth: int, index: np.ndarray, fan: int = FAN) -> np.ndarray:
    """The places of nodes `index` of level `depth` in a subtree of that height, in van Emde Boas order."""
    index = np.asarray(index, np.int64)
    if height == 0:
        return np.zeros_like(index)
    upper = (height + 1) // 2  # levels of the upper part
    if depth < upper:
        return address(upper - 1, depth, index, fan)
    below = fan ** (depth - upper)
    lower = address(height - upper, depth - upper, index % below, fan)
    return subtree_size(upper - 1, fan) + index // below * subtree_size(height - upper, fan) + lower


DIGEST = 64  # bytes of a digest, which is kept and hashed as hex text


def node_digest(children: list[bytes]) -> bytes:
    """H of digests, which are hashed as their hex text."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


class Block:
    """One aligned subtree: its hex digests in van Emde Boas order."""

    def __init__(self, height: int, leaves: int, nodes: bytearray, fan: int = FAN):
        self.height, self.leaves, self.nodes, self.fan = height, leaves, nodes, fan

    def width(self, depth: int) -> int:
        """Nodes of a level; the last run of each level may be short."""
        return -(-self.leaves // self.fan ** (self.height - depth))

    def level(self, depth: int) -> list[bytes]:
        at = address(self.height, depth, np.arange(self.width(depth)), self.fan).tolist()
        return [bytes(self.nodes[DIGEST * a:DIGEST * (a + 1)]) for a in at]

    @classmethod
    def built(cls, height: int, leaves: list[bytes], fan: int = FAN) -> Block:
        # Places up to the last one in use: lower parts come from left to right.
        own = cls(height, len(leaves), bytearray(), fan)
        last = max(int(address(height, d, np.array([own.width(d) - 1]), fan)[0]) for d in range(height + 1))
        own.nodes = bytearray(DIGEST * (last + 1))
        below = leaves
        for depth in range(height, -1, -1):
            if depth < height:
                below = [node_digest(below[i:i + fan]) for i in range(0, len(below), fan)]
            for a, node in zip(address(height, depth, np.arange(len(below)), fan).tolist(), below):
                own.nodes[DIGEST * a:DIGEST * (a + 1)] = node
        return own

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[:DIGEST])

    def paths(self) -> Iterator[list[tuple[bytes, bytes]]]:
        """For each leaf its siblings level by level, those to its left and those to its right."""
        levels = [self.level(d) for d in range(self.height + 1)]
        fan = self.fan
        for i in range(self.leaves):
            path = []
            for depth in range(self.height, 0, -1):
                run = i - i % fan
                own = levels[depth][run:run + fan]
                path.append((b"".join(own[:i - run]), b"".join(own[i - run + 1:])))
                i //= fan
            yield path


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for left, right in path:
        leaf = node_digest([left, leaf, right])
    return leaf


def height_of(n: Column, fan: int = FAN) -> Column:
    """Levels above `n` leaves: the least h with fan ** h >= n."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0), lambda h, i: h + (F.pow(F.lit(fan), i) < n).cast("int"))


# ------------------------------------------------------------------ leaves
def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, changed) stored; `changed` is the leaf that `tampered` texts give, null where equal."""
    values = [column(docs, *f) for f in FIELDS]
    other = F.lit(None).cast("string") if tampered is None else F.when(
        tampered, leaf_digest([*values[:-1], F.translate(values[-1], UPPER, LOWER)]))
    return dealt(docs).select(values[1].alias("source"), values[0].alias("doc_id"), leaf_digest(values).alias("leaf"), other.alias("changed"))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` stored with `rank`, gapless from 0 in each group, and the group's size `n`."""
    first = saved(rows, "leaves")
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    ranged = saved(first.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "ranged")
    # One row a partition and group: a group in few partitions has few rows, a hot one as many as it fills.
    counts = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    starts = counts.select(F.col(group).alias("_g"), F.col("part").alias("_p"), F.sum("_n").over(whole).alias("n"),
                           (F.sum("_n").over(whole.orderBy("part")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("part", group).orderBy(*keys[1:])) - 1
    joined = ranged.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
    out = saved(joined.select(*rows.columns, (F.col("_start") + F.col("_inside")).cast("long").alias("rank"), "n"), "placed")
    removed(first, ranged)
    return out


# ------------------------------------------------------------------ blocks
BLOCK = "tree string, block long, levels int, height int, leaves int, nodes binary, root string"
_BLOCK = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
FLUSH_BYTES = 8 << 20


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)],
                                      names=[f.split()[0] for f in schema.split(", ")])


def built(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The blocks above leaves (tree, rank, digest, levels); `levels` counts the tree's levels above a leaf."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, out, size = None, [], [], 0

        def close() -> int:
            block = Block.built(min(held[2], height), own, fan)
            out.append((*held, block.height, len(own), bytes(block.nodes), block.root.decode()))
            return len(block.nodes)
        for batch in batches:
            for tree, at, levels, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "levels", "digest"))):
                if held is None or (tree, at) != held[:2]:
                    size += close() if held else 0
                    if size > FLUSH_BYTES:
                        yield _batch(out, _BLOCK, BLOCK)
                        out, size = [], 0
                    held, own = (tree, at, levels), []
                own.append(digest.encode())
        if held:
            close()
        if out:
            yield _batch(out, _BLOCK, BLOCK)
    rows = nodes.withColumn("block", F.floor(F.col("rank") / fan ** height).cast("long"))
    lined = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return lined.select("tree", "block", "levels", "digest").mapInArrow(work, BLOCK)


def tiers(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> list[DataFrame]:
    """The stored tiers of blocks above leaves (tree, rank, digest, n), lowest first; no leaf, no tier."""
    level = nodes.select("tree", "rank", "digest", height_of(F.col("n"), fan).alias("levels"))
    left = nodes.agg(F.max(height_of(F.col("n"), fan))).first()[0]
    out: list[DataFrame] = []
    while left is not None and (left > 0 or not out):
        out.append(saved(built(level, fan, height), "blocks"))
        left -= height
        # Trees whose one block is built drop out.
        level = out[-1].filter(F.col("levels") > height).select(
            "tree", F.col("block").alias("rank"), F.col("root").alias("digest"), (F.col("levels") - height).alias("levels"))
    return out


def roots(blocks: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The blocks of one tier that are the last of their tree."""
    return blocks.filter(F.col("levels") <= height)


# ------------------------------------------------------------------ proofs
PATH = "array<struct<l:binary,r:binary>>"
_PATH = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
ABOVE = f"tree string, rank long, path {PATH}, subroot string, root string"
_ABOVE = (pa.string(), pa.int64(), _PATH, pa.string(), pa.string())


def _above_blocks(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each block with what stands above it."""
    up = above.select(F.col("tree").alias("_t"), F.col("rank").alias("_b"), "path", "subroot", F.col("root").alias("whole"))
    return blocks.join(up, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).drop("_t", "_b")


def handed_down(blocks: DataFrame, above: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """What stands above each leaf of the blocks: all siblings on its path, lowest level first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                first, out = row["block"] * fan ** height, []
                for i, path in enumerate(Block(row["height"], row["leaves"], row["nodes"], fan).paths()):
                    own = [{"l": a, "r": b} for a, b in path]
                    out.append((row["tree"], first + i, own + row["path"], row["subroot"], row["whole"]))
                    if len(out) == 256:
                        yield _batch(out, _ABOVE, ABOVE)
                        out = []
                yield _batch(out, _ABOVE, ABOVE)
    return _above_blocks(blocks, above).mapInArrow(work, ABOVE)


PROOF = ("doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
         "verified boolean, proof array<string>")
_PROOF = (pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.list_(pa.string()))


def proved(rows: DataFrame, blocks: DataFrame, above: DataFrame, with_proof: bool = False, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The proof of every document (tree, rank, doc_id, digest, changed) of the lowest tier."""
    held = _above_blocks(blocks, above).select("tree", "block", F.lit(-1).cast("long").alias("rank"), "height", "leaves", "nodes", "path", "subroot",
                                               F.col("whole").alias("root"), F.lit(None).cast("long").alias("doc_id"),
                                               F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("changed"))
    own = rows.select("tree", F.floor(F.col("rank") / fan ** height).cast("long").alias("block"), "rank", "doc_id", "digest", "changed")
    # In a sorted partition each block comes right before its documents.
    lined = held.unionByName(own, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("rank", "tree", "doc_id", "digest", "changed")))
            for i, (rank, tree, doc_id, digest, changed) in enumerate(keys):
                if rank < 0:
                    row = batch.slice(i, 1).to_pylist()[0]
                    paths = Block(row["height"], row["leaves"], row["nodes"], fan).paths()
                    up = [(p["l"], p["r"]) for p in row["path"]]
                    subroot, root = row["subroot"], row["root"]
                    continue
                path = [*next(paths), *up]
                siblings = [left + right for left, right in path]
                again = folded((digest if changed is None else changed).encode(), path).decode()
                out.append((doc_id, tree, digest, subroot, root, hashlib.sha256(b"".join(siblings)).hexdigest(), again, again == root,
                            [s.decode() for s in siblings] if with_proof else None))
                if len(out) == 512:
                    yield _batch(out, _PROOF, PROOF)
                    out = []
            yield _batch(out, _PROOF, PROOF)
    lined_batches = lambda batches: work(batches)
    out = lined.mapInArrow(lined_batches, PROOF)
    return out if with_proof else out.drop("proof")


class Manifest:
    """The stored manifest of a table of documents: leaves, blocks of the sources' trees and of the tree over them."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None, fan: int = FAN, height: int = HEIGHT):
        self.fan, self.height = fan, height
        self.leaves = placed(leaves(docs, tampered), "source", ["doc_id", "leaf"]).select(
            F.col("source").alias("tree"), "rank", "n", "doc_id", F.col("leaf").alias("digest"), "changed")
        self.source_tiers = tiers(self.leaves, fan, height)
        self.over_sources = None
        if self.source_tiers:
            own = [roots(t, height).select(F.col("tree").alias("source"), F.col("root").alias("subroot")) for t in self.source_tiers]
            subroots = own[0]
            for more in own[1:]:
                subroots = subroots.unionByName(more)
            self.over_sources = placed(subroots.withColumn("tree", F.lit("")), "tree", ["source"])
        self.top_tiers = tiers(self.over_sources.withColumnRenamed("subroot", "digest"), fan, height) if self.source_tiers else []

    @property
    def root(self) -> str | None:
        """The digest of the whole table; None for an empty one."""
        return self.top_tiers[-1].first()["root"] if self.top_tiers else None

    def proofs(self, with_proof: bool = False) -> DataFrame:
        """A row for each document: its leaf, the roots, its proof, and what a changed leaf folds to."""
        spark = self.leaves.sparkSession
        if not self.top_tiers:
            out = spark.createDataFrame([], PROOF)
            return out if with_proof else out.drop("proof")
        above = spark.createDataFrame([("", 0, [], None, self.root)], ABOVE)
        for tier in reversed(self.top_tiers):
            above = handed_down(tier, above, self.fan, self.height)
        # From here on a tree is a source, and its last block stands below its place among the sources.
        of_sources = above.join(self.over_sources.select("rank", "source", F.col("subroot").alias("own")), "rank").select(
            F.col("source").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", F.col("own").alias("subroot"), "root")
        above = None
        for tier in reversed(self.source_tiers):
            ending = _semi(of_sources, roots(tier, self.height))
            above = ending if above is None else ending.unionByName(above)
            if tier is not self.source_tiers[0]:
                above = saved(handed_down(tier, above, self.fan, self.height), "above")
        return proved(self.leaves, self.source_tiers[0], above, with_proof, self.fan, self.height)


def _semi(above: DataFrame, ending: DataFrame) -> DataFrame:
    named = ending.select(F.col("tree").alias("_t"))
    return above.join(named, F.col("tree").eqNullSafe(F.col("_t")), "left_semi")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, proof and check of every document; those whose id's checksum 5 divides are tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_STEP == 0
    found = Manifest(read(spark, sf_dir, "documents"), tampered).proofs()
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _level_sql(k: int, prefix: str) -> str:
    """Level k of the trees `prefix`: what each node of the level before has beside it, and the nodes above."""
    run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
    return f"""
{prefix}b{k} AS (SELECT tree, idx, hash, count(*) OVER (PARTITION BY tree) AS cnt,
  coalesce(string_agg(hash, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(hash, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {prefix}n{k - 1}),
{prefix}n{k} AS (SELECT tree, idx // 16 AS idx, CASE WHEN any_value(cnt) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY idx)) END AS hash
  FROM {prefix}b{k} GROUP BY tree, idx // 16)"""


def _climb_sql(k: int, prefix: str) -> str:
    """Each document's proof and fold one level further up."""
    return f"""
{prefix}d{k} AS (SELECT d.* EXCLUDE (idx, proof, fold), d.idx // 16 AS idx, CASE WHEN b.cnt = 1 THEN proof ELSE proof || b.l || b.r END AS proof,
  CASE WHEN b.cnt = 1 THEN fold ELSE sha256(b.l || fold || b.r) END AS fold FROM {prefix}d{k - 1} d JOIN {prefix}b{k} b USING (tree, idx))"""


#: Levels that the SQL writes out: up to 16 ** 5 documents a source and 16 ** 4 sources.
_SOURCE_LEVELS, _TOP_LEVELS = 5, 4
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}, '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars"))
#: DuckDB has no CRC-32: eight shifts for each character of the id.
_CRC = ("xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
        "lambda x, c: list_reduce([xor(x, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, i: xor(y >> 1, (y & 1) * 3988292384))))")
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

OP11_SQL = f"""
WITH leaves AS (SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN sha256({_LEAF} || {_FIELD.format(_LOWERED)}) ELSE sha256({_LEAF} || {_FIELD.format('text')}) END AS fold
  FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source COLLATE "binary" NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaves)),
sd0 AS (SELECT doc_id, leaf, fold, '' AS proof, s.tree,
    row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
sn0 AS (SELECT tree, idx, leaf AS hash FROM sd0),
{",".join(_level_sql(k, "s") + "," + _climb_sql(k, "s") for k in range(1, _SOURCE_LEVELS + 1))},
tn0 AS (SELECT 0 AS tree, tree AS idx, hash FROM sn{_SOURCE_LEVELS}),
td0 AS (SELECT d.* EXCLUDE (tree, idx), 0 AS tree, d.tree AS idx, n.hash AS subroot FROM sd{_SOURCE_LEVELS} d JOIN sn{_SOURCE_LEVELS} n USING (tree)),
{",".join(_level_sql(k, "t") + "," + _climb_sql(k, "t") for k in range(1, _TOP_LEVELS + 1))}
SELECT doc_id, leaf, subroot, n.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = n.hash AS verified
FROM td{_TOP_LEVELS} CROSS JOIN tn{_TOP_LEVELS} n"""
