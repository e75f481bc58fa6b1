"""Nearest neighbours by inner product over one small-world graph per shard.

Vectors are dealt to shards of about `SHARD_ROWS` by a hash.  A shard's graph has layers, each
holding about a `DEGREE`-th of the one below; it is stored as flat arrays of neighbours, one row
of the index table a shard.  Layers are built from the top: the first nodes are linked exactly,
the others come in batches that search the graph so far, choose diverse neighbours (a
candidate is taken if it is nearer to the node than to those taken before) and link back.
Inner product becomes distance by one more coordinate that gives all vectors of a shard the
same norm.

Queries run through all shards: a shard's graph and the query vectors meet in one sorted
partition, where the graph is loaded once and queries stream past it in blocks.  Each shard
gives its best candidates with scores recomputed in double precision on the original vectors;
a ranked merge keeps the best per query.

Defined cases: null, zero and non-finite vectors and those with null components take no part;
vectors only meet vectors of their own dimension; equal vectors are indexed once, with as many
of their smallest ids as any result can hold, so copies never crowd a graph; ties go to the
smaller vec_id; null ids and repeated rows: rows without an id take no part, rows equal in id
and vector count once, each vector of an id that has several is a query and a candidate of its
own; magnitudes are scaled for the graphs, scores that leave the range are infinite, and one
that is not a number ranks last; with too few candidates all are returned; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import column, read, saved

NEAREST = 20
QUERY_STEP = 20
SHARD_ROWS = 8192
DEGREE, BEAM_BUILD, BEAM_SEARCH = 16, 48, 96
BATCH = 512


def beam(vectors: np.ndarray, links: np.ndarray, wanted: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness), best first, -1 padded: what a beam of `width` finds for each wanted vector from its entries."""
    count, n = len(wanted), len(vectors)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # stands for no node
    nodes = np.full((count, width), n, np.int64)
    like = np.full((count, width), -np.inf, np.float32)
    done = np.ones((count, width), bool)

    def take(rows: np.ndarray, fresh: np.ndarray) -> None:
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        fresh = np.where(seen[rows[:, None], fresh], n, fresh)
        seen[rows[:, None], fresh] = True
        got = np.einsum("qkd,qd->qk", vectors[np.minimum(fresh, n - 1)], wanted[rows])
        got[fresh == n] = -np.inf
        all_like = np.concatenate([like[rows], got], axis=1)
        best = np.argsort(-all_like, axis=1, kind="stable")[:, :width]
        line = np.arange(len(rows))[:, None]
        nodes[rows] = np.concatenate([nodes[rows], fresh], axis=1)[line, best]
        done[rows] = np.concatenate([done[rows], fresh == n], axis=1)[line, best]
        like[rows] = all_like[line, best]
    take(np.arange(count), entry.astype(np.int64))
    while len(rows := np.flatnonzero(~done.all(axis=1))):
        # The two best nodes not yet looked at.
        ahead = np.argsort(done[rows], axis=1, kind="stable")[:, :2]
        line = rows[:, None]
        open_ = ~done[line, ahead]
        chosen = np.where(open_, nodes[line, ahead], n)
        done[line, ahead] = True
        around = np.where((chosen < n)[:, :, None], links[np.minimum(chosen, n - 1)], -1).reshape(len(rows), -1)
        take(rows, np.where(around < 0, n, around))
    return np.where(nodes == n, -1, nodes), like


def diverse(vectors: np.ndarray, own: np.ndarray, nodes: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to `most` that lie nearer to the row's vector than to each other."""
    count, width = nodes.shape
    out = np.full((count, most), -1, np.int64)
    used = np.zeros(count, np.int64)
    passed = np.zeros((count, width), bool)
    for k in range(width):
        node = nodes[:, k]
        other = np.einsum("cmd,cd->cm", vectors[np.maximum(out, 0)], vectors[np.maximum(node, 0)])
        near = ((other > like[:, k, None]) & (out >= 0)).any(axis=1)
        ok = (node >= 0) & (node != own) & (used < most)
        good = ok & ~near
        out[good, used[good]] = node[good]
        used += good
        passed[:, k] = ok & near
    for k in range(width):  # empty places go to the best passed over
        fill = passed[:, k] & (used < most)
        if fill.any():
            out[fill, used[fill]] = nodes[fill, k]
            used += fill
    return out


def link_back(vectors: np.ndarray, links: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Add source to each target's neighbours; where they are too many the diverse ones stay."""
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    who, start, counts = np.unique(targets, return_index=True, return_counts=True)
    most = links.shape[1]
    for a in range(0, len(who), 1024):
        own, first, number = who[a:a + 1024], start[a:a + 1024], counts[a:a + 1024]
        fresh = np.full((len(own), int(number.max())), -1, np.int64)
        line = np.repeat(np.arange(len(own)), number)
        place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        fresh[line, place] = sources[np.repeat(first, number) + place]
        nodes = np.concatenate([links[own], fresh], axis=1)
        like = np.einsum("cmd,cd->cm", vectors[np.maximum(nodes, 0)], vectors[own])
        like[nodes < 0] = -np.inf
        best = np.argsort(-like, axis=1, kind="stable")
        nodes, like = np.take_along_axis(nodes, best, 1), np.take_along_axis(like, best, 1)
        full = (nodes >= 0).sum(axis=1) > most
        links[own[~full]] = nodes[~full, :most]
        if full.any():
            links[own[full]] = diverse(vectors, own[full], nodes[full], like[full], most)


def levels(n: int, degree: int = DEGREE, seed: int = 7) -> np.ndarray:
    """The top layer of each node, the nodes in descending order of it."""
    drawn = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(degree)).astype(np.int64)
    return -np.sort(-drawn)


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BEAM_BUILD) -> list[np.ndarray]:
    """Neighbour arrays of the layers, top first.  A layer's nodes are the first so many of all."""
    n = len(vectors)
    height = levels(n, degree)
    layers: list[np.ndarray] = []
    for level in range(int(height[0]) if n else 0, -1, -1):
        size = int((height >= level).sum())
        own = vectors[:size]
        most = degree * 2 if level == 0 else degree
        links = np.full((size, most), -1, np.int64)
        done = 0
        while done < size:
            batch = np.arange(done, min(size, max(64, done * 2), done + BATCH))
            like = vectors[batch] @ vectors[batch].T
            like[np.arange(len(batch)), np.arange(len(batch))] = -np.inf
            best = np.argsort(-like, axis=1, kind="stable")[:, :degree]
            nodes, like = batch[best], np.take_along_axis(like, best, 1)
            nodes = np.where(np.isinf(like), -1, nodes)
            if done:
                entry = descend(vectors, layers, vectors[batch])
                old, old_like = beam(own[:done], links[:done], vectors[batch], np.minimum(entry, done - 1), width)
                nodes, like = np.concatenate([nodes, old], axis=1), np.concatenate([like, old_like], axis=1)
                best = np.argsort(-like, axis=1, kind="stable")
                nodes, like = np.take_along_axis(nodes, best, 1), np.take_along_axis(like, best, 1)
            chosen = diverse(vectors, batch, nodes, like, degree)
            links[batch, :degree] = chosen
            line, place = np.nonzero(chosen >= 0)
            link_back(vectors, links, batch[line], chosen[line, place])
            done = int(batch[-1]) + 1
        layers.append(links)
    return layers


def descend(vectors: np.ndarray, layers: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Entry nodes for the layer below `layers`: each layer's nearest is where the next one starts."""
    entry = np.zeros((len(wanted), 1), np.int64)
    for links in layers:
        entry = np.maximum(beam(vectors[:len(links)], links, wanted, entry, 4)[0][:, :2], 0)
    return entry


def even_norm(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled, with one more coordinate that gives all of them norm one."""
    # The largest component is divided out first: squares of tiny or huge ones would leave the range.
    vectors = vectors / np.abs(vectors).max()
    scaled = vectors / np.sqrt((vectors ** 2).sum(axis=1)).max()
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled ** 2).sum(axis=1)))
    return np.concatenate([scaled, rest[:, None]], axis=1).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, summed from the first component on, in double precision."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(a.shape[-1]):
            out += a[..., d] * b[..., d]
    return out


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    v = column(table, "embedding", "array<double>")
    fit = F.size("v") > 0
    fit &= F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit &= F.exists("v", lambda x: x != 0)
    return (table.select(column(table, "vec_id", "long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fit))


def index(rows: DataFrame, shard_rows: int = SHARD_ROWS, copies: int = NEAREST + 1) -> tuple[DataFrame, dict[int, int]]:
    """The stored graphs, one row (shard, graph) each, and the number of shards by dimension."""
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.distinct().withColumn("turn", turn).filter(F.col("turn") <= copies)
    distinct = saved(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = {d: -(-n // shard_rows) for d, n in distinct.groupBy(F.size("v")).count().collect()}
    dim = F.size("v")
    number = F.lit(1)
    for d, n in shards.items():
        number = F.when(dim == d, F.lit(n)).otherwise(number)
    dealt = distinct.withColumn("shard", F.concat_ws("-", dim, F.pmod(F.xxhash64(F.col("ids")[0]), number)))

    def graph(table: pa.Table) -> pa.Table:
        vectors = np.array(table.column("v").to_pylist(), np.float64)
        ids = table.column("ids").to_pylist()
        order = np.argsort([i[0] for i in ids])
        vectors, ids = vectors[order], [ids[i] for i in order]
        layers = [links.astype(np.int32) for links in build(even_norm(vectors))]
        packed = pickle.dumps((ids, vectors, layers), protocol=5)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "graph": pa.array([packed], pa.binary())})
    return saved(dealt.groupBy("shard").applyInArrow(graph, "shard string, graph binary"), "graphs"), shards


def searched(graphs: DataFrame, wanted: DataFrame, shards: dict[int, int], most: int) -> DataFrame:
    """(query, vec_id, score): each shard's `most` best for each wanted (query, v)."""
    listed = F.array().cast("array<string>")
    for d, n in shards.items():
        names = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat_ws("-", F.size("v"), i))
        listed = F.when(F.size("v") == d, names).otherwise(listed)
    asked = wanted.select(F.explode(listed).alias("shard"), F.lit(1).alias("kind"), "query", "v", F.lit(None).cast("binary").alias("graph"))
    held = graphs.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"),
                         F.lit(None).cast("array<double>").alias("v"), "graph")
    # In a sorted partition each graph comes right before its queries.
    lined = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    return lined.mapInArrow(lambda batches: _search(batches, most), "query long, vec_id long, score double")


def _search(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    ids = vectors = even = layers = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        at = 0
        while at < len(kinds):
            if kinds[at] == 0:
                ids, vectors, layers = pickle.loads(batch.column("graph")[at].as_py())
                even = even_norm(vectors)
                at += 1
                continue
            end = at + 1
            while end < len(kinds) and kinds[end] == 1 and end - at < BATCH // 2:
                end += 1
            part = batch.slice(at, end - at)
            query, wanted = part.column("query").to_numpy(), np.array(part.column("v").to_pylist(), np.float64)
            unit = wanted / np.abs(wanted).max(axis=1, keepdims=True)
            unit = (unit / np.sqrt((unit ** 2).sum(axis=1, keepdims=True))).astype(np.float32)
            unit = np.concatenate([unit, np.zeros((len(unit), 1), np.float32)], axis=1)
            entry = descend(even, layers[:-1], unit)
            nodes, _ = beam(even, layers[-1].astype(np.int64), unit, entry, BEAM_SEARCH)
            score = products(vectors[np.maximum(nodes, 0)], wanted[:, None, :])
            score = np.where(np.isnan(score), -np.inf, score)  # opposite infinities: no order among them
            out: list[tuple[int, int, float]] = []
            for q, row, own in zip(query.tolist(), nodes.tolist(), score.tolist()):
                found = sorted(((-s, i) for n, s in zip(row, own) if n >= 0 for i in ids[n]))[:most]
                out += [(q, i, -s) for s, i in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.float64()))],
                                             names=["query", "vec_id", "score"])
            at = end


def nearest(table: DataFrame, asked: DataFrame, most: int = NEAREST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `most` nearest rows of `table` for each row of `asked`, itself left out."""
    rows = usable(table)
    graphs, shards = index(rows, shard_rows, most + 1)
    queries = usable(asked).distinct().withColumnRenamed("vec_id", "query_id")
    # A vector asked by many ids is searched once; its number stands for it, as ids need not be unique.
    wanted = saved(queries.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"), "wanted")
    order = [F.desc("score"), F.col("vec_id")]
    best = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    merged = searched(graphs, wanted, shards, most + 1).withColumn("turn", best).filter(F.col("turn") <= most + 1).drop("turn")
    named = queries.join(wanted, "v").select("query_id", "query")
    own = named.join(merged, "query").filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(*order))
    return own.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))
