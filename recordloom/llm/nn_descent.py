"""Near-duplicate vectors by NN-descent: links, their components, and one vector kept of each.

Distinct unit vectors of one label and dimension are the nodes of a neighbour graph; equal ones
are one node with its number of copies.

1. Every node starts with neighbours from the order along random projections, and with pivots of
   its group where it has too few.
2. A round joins neighbours of neighbours: the nodes that share a neighbour meet there, with
   their vectors in half precision, pairs that have not met are compared, and both ends are
   offered what beats the last of their list and keep the best `k`.  Descent ends when next to
   nothing changes.
3. A list is saturated when its last entry is still near enough to link.  Saturated places are
   thinned rather than written out: of nodes within half the linking angle of each other, one
   leads (least hash first, by rounds of local minima) and the others join its ball if their own
   angle to it, in double precision, is at most half the linking angle.  So all members of a ball
   are linked with each other and are counted, never paired.  Descent goes on among the leaders,
   from the lists of all members; lists that are saturated at the angle at which two balls can
   still hold a link are enlarged and descended again, until none is.
4. Leaders that near are decided by their exact angle and the balls' radii: all members linked,
   none, or open.  Only members of open pairs are compared one by one, in double precision, in
   blocks of `BLOCK` members.  Balls with a link are joined to components.
5. The result is audited: a bounded sample of nodes is compared with all nodes by brute force.
   While less than `RECALL` of its links were found, all lists are doubled and descent goes on.

Nothing grows in one task: hubs hand on a sample (limited before the shuffle), lists are bounded
by `k`, members meet in blocks; the driver sees counts and the audit's sample.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
those without a label, link with nothing; vectors meet only those of their own label and
dimension; any finite magnitude counts, by scaling first; repeated rows, and rows that share an
id, are vectors of their own; a component without any id has a null id, and rows without an id
are never kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.shuffle import lookup_join
from .common import column, dealt, read, removed, saved
from .components import components

THRESHOLD = 0.93
NEIGHBOURS = 16
#: Followers that meet at a node in a round.
SAMPLE = 40
#: Descent ends when so small a share of all list places changed, or after so many rounds.
SETTLED, ROUNDS = 0.001, 15
#: More than the cosine of two unit vectors can change by rounding both to half precision.
MARGIN = 0.002
#: Slack of angles that are compared with bounds.
SLACK = 1e-7
BLOCK = 1024
#: Rounds of thinning saturated places.
LEVELS = 8
AUDIT_NODES, RECALL, WIDENINGS = 1024, 0.99, 3


# ------------------------------------------------------------------ nodes
def fit(v: Column) -> Column:
    """True for vectors that can link."""
    real = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & real & F.exists(v, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of norm one; the largest component is divided out first, so squares stay in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True)) + 0.0  # no negative zeros


def _rows(column: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


VECTORS = "vec_id long, key binary, grp string, unit array<double>"


def keyed(table: DataFrame) -> DataFrame:
    """(vec_id, key, grp, unit) stored: a digest of group and unit vector, the group (dimension and label); null where nothing can link."""
    v, label = column(table, "embedding", "array<double>"), column(table, "label", "string")
    rows = table.select(column(table, "vec_id", "long").alias("vec_id"), label.alias("label"),
                        F.when(fit(v) & label.isNotNull(), v).alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, labels = batch.column("v"), batch.column("label").to_pylist()
            sizes = v.value_lengths().fill_null(0).to_numpy()
            keys, groups, out = ([None] * len(v) for _ in range(3))
            for size in set(sizes.tolist()) - {0}:
                at = np.flatnonzero(sizes == size)
                for i, unit in zip(at.tolist(), units(_rows(v.take(pa.array(at))))):
                    groups[i], out[i] = f"{size}:{labels[i]}", unit
                    keys[i] = hashlib.md5(groups[i].encode() + b":" + unit.tobytes()).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(groups, pa.string()),
                                              pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "key", "grp", "unit"])
    return saved(dealt(rows).mapInArrow(work, VECTORS), "vectors")


GRAPH = "node long, k int, half binary, ids array<long>, sims array<float>, fresh array<boolean>"
_GRAPH = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()))
_NAMES = [f.split()[0] for f in GRAPH.split(", ")]


def halves(column: pa.Array) -> np.ndarray:
    """A binary column of half-precision vectors as rows of single precision, padded with zeros."""
    sizes = column.fill_null(b"").to_pylist()
    width = max((len(s) for s in sizes), default=0) // 2
    out = np.zeros((len(sizes), width), np.float32)
    for i, s in enumerate(sizes):
        out[i, :len(s) // 2] = np.frombuffer(s, np.float16)
    return out


def _nested(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _candidates(node: np.ndarray, sizes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """Rows of `GRAPH` that offer neighbours to nodes."""
    n = len(node)
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), _nested(sizes, pa.array(ids, pa.int64())),
         _nested(sizes, pa.array(sims, pa.float32())), _nested(sizes, pa.array(np.ones(len(ids), bool)))], names=_NAMES)


# ------------------------------------------------------------------ one round
def merged(rows: DataFrame, label: str = "graph") -> DataFrame:
    """The stored graph after offers: each node's row, and the best `k` of all that it holds and is offered."""
    def fold(table: pa.Table) -> pa.RecordBatch:
        node = _col(table, "node").to_numpy()
        own = np.flatnonzero(_col(table, "k").is_valid().to_numpy(zero_copy_only=False))
        lists = {c: _col(table, c) for c in ("ids", "sims", "fresh")}
        who = np.repeat(node, lists["ids"].value_lengths().to_numpy())
        ids, sims = (lists[c].flatten().to_numpy() for c in ("ids", "sims"))
        fresh = lists["fresh"].flatten().to_numpy(zero_copy_only=False).astype(bool)
        # What is held already counts before what is offered.
        order = np.lexsort((fresh, ids, who))
        who, ids, sims, fresh = who[order], ids[order], sims[order], fresh[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
        who, ids, sims, fresh = who[first], ids[first], sims[first], fresh[first]
        order = np.lexsort((ids, -sims, who))
        who, ids, sims, fresh = who[order], ids[order], sims[order], fresh[order]
        nodes, k = node[own], _col(table, "k").take(pa.array(own, pa.int64())).to_numpy()
        start = np.searchsorted(who, nodes)
        size = np.minimum(np.searchsorted(who, nodes, side="right") - start, k)
        pick = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        half = _col(table, "half").take(pa.array(own, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(k, pa.int32()), half, _nested(size, pa.array(ids[pick])), _nested(size, pa.array(sims[pick], pa.float32())),
             _nested(size, pa.array(fresh[pick]))], names=_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "node"):
            yield fold(table)
    lined = rows.select(*_NAMES).repartition("node").sortWithinPartitions("node")
    return saved(lined.mapInArrow(work, GRAPH), label)


def _runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Sorted batches regrouped, about `least` rows at a time, so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # where the last run of this batch begins
        if cut and sum(p.num_rows for p in held) >= least:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _col(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def local_joins(members: DataFrame) -> DataFrame:
    """Offers from comparing the members (w, node, fresh, k, floor, half) of every `w` with each other, new ones with all.

    A member is offered the best `k` of a group that beat the last of its list: more could not enter.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "w"):
            w, node, k, floor = (_col(table, c).to_numpy() for c in ("w", "node", "k", "floor"))
            fresh = _col(table, "fresh").to_numpy().astype(bool)
            order = np.lexsort((~fresh, node, w))
            first = np.ones(len(w), bool)
            first[1:] = (w[order][1:] != w[order][:-1]) | (node[order][1:] != node[order][:-1])
            order = order[first]
            w, node, k, floor, fresh = w[order], node[order], k[order], floor[order], fresh[order]
            vectors = halves(_col(table, "half"))[order]
            group, size = np.unique(w, return_counts=True)
            start = np.cumsum(size) - size
            for many in np.unique(size):
                if many < 2:
                    continue
                same = start[size == many]
                step = max(1, (4 << 20) // int(many * max(many, vectors.shape[1])))
                for a in range(0, len(same), step):
                    at = same[a:a + step, None] + np.arange(many)
                    yield from _compared(node[at], k[at], floor[at], fresh[at], vectors[at])
    return members.mapInArrow(work, GRAPH)


def _compared(node: np.ndarray, k: np.ndarray, floor: np.ndarray, fresh: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    sims = vectors @ vectors.transpose(0, 2, 1)
    new = fresh[:, :, None] | fresh[:, None, :]
    new[:, np.arange(node.shape[1]), np.arange(node.shape[1])] = False
    sims = np.where(new & (sims > floor[:, :, None]), sims, -np.inf)
    best = np.argsort(-sims, axis=2, kind="stable")[:, :, :int(k.max())]
    found = np.take_along_axis(sims, best, 2)
    good = np.isfinite(found) & (np.arange(best.shape[2]) < k[:, :, None])
    count = good.sum(axis=2)
    some = count > 0
    if some.any():
        ids = np.broadcast_to(node[:, None, :], sims.shape)
        ids = np.take_along_axis(ids, best, 2)
        yield _candidates(node[some], count[some], ids[good], found[good])


def members(graph: DataFrame, turn: int, sample: int = SAMPLE) -> DataFrame:
    """(w, node, fresh, k, floor, half) in order of `w`: the nodes that have `w` in their list, and itself.

    A node takes its vector along to each of its neighbours, so a round has one shuffle to the
    meeting places and one back.
    """
    last = F.when(F.size("ids") >= F.col("k"), F.try_element_at("sims", F.lit(-1))).otherwise(F.lit(-2.0).cast("float"))
    own = F.array(F.struct(F.col("node").alias("ids"), F.lit(False).alias("fresh")))
    sent = graph.select("node", "k", last.alias("floor"), "half", F.explode(F.concat(own, F.arrays_zip("ids", "fresh"))).alias("e")).select(
        F.col("e.ids").alias("w"), "node", F.col("e.fresh").cast("int").alias("fresh"), "k", "floor", "half")
    # Limited before the shuffle, so a hub's followers never all meet; new ones come first, others by turns.
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("w", "node", F.lit(turn)), "node"))
    few = sent.withColumn("place", place).filter(F.col("place") <= sample)
    return few.withColumn("news", F.max("fresh").over(Window.partitionBy("w"))).filter("news > 0").drop("place", "news")


def descend(graph: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """The graph after rounds of neighbours-of-neighbours joins, until next to nothing changes."""
    for turn in range(rounds):
        known = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
        after = merged(known.unionByName(local_joins(members(graph, turn))))
        removed(graph)
        graph = after
        changed, places = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum("k")).first()
        if (changed or 0) <= settled * (places or 0):
            break
    return graph


# ------------------------------------------------------------------ start
def started(nodes: DataFrame, k: int = NEIGHBOURS, projections: int = 2) -> DataFrame:
    """The first graph: neighbours along random projections, and pivots of the group."""
    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v) for v in batch.column("unit").to_pylist()]
            packed = [v.astype(np.float16).tobytes() for v in vectors]
            lines = {n: np.random.default_rng(n).standard_normal((projections, n)) for n in {len(v) for v in vectors}}
            at = [(lines[len(v)] @ v).tolist() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("grp"), pa.array(packed, pa.binary()),
                                              pa.array(at, pa.list_(pa.float64()))], names=["node", "grp", "half", "at"])
    points = saved(nodes.select("node", "grp", "unit").mapInArrow(prepared, "node long, grp string, half binary, at array<double>"), "points")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vectors = batch.column("node").to_numpy(), halves(batch.column("half"))
            group = np.unique(np.array(batch.column("grp").to_pylist(), object), return_inverse=True)[1]
            steps = [s for d in range(1, k // (2 * projections) + 1) for s in (-d, d)]
            at = np.arange(len(node))[:, None] + np.array(steps)
            ok = (at >= 0) & (at < len(node))
            at = np.clip(at, 0, max(0, len(node) - 1))
            ok &= group[at] == group[:, None]
            sims = np.einsum("nkd,nd->nk", vectors[at], vectors)
            yield _candidates(node, ok.sum(axis=1), node[at][ok], sims[ok])
    rows = points.select("node", F.lit(k).alias("k"), "half", F.array().cast("array<long>").alias("ids"),
                         F.array().cast("array<float>").alias("sims"), F.array().cast("array<boolean>").alias("fresh"))
    for p in range(projections):
        lined = points.withColumn("at", F.col("at")[p]).repartitionByRange("grp", "at").sortWithinPartitions("grp", "at")
        rows = rows.unionByName(lined.select("node", "grp", "half").mapInArrow(near, GRAPH))
    # The same few nodes for all of a group: who has no neighbour in its stretch of the order meets the others there.
    turn = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("node"), "node"))
    pivots = points.withColumn("turn", turn).filter(F.col("turn") <= k // 2).select("grp", "node", "half")
    listed = pivots.groupBy("grp").agg(F.collect_list(F.struct("node", "half")).alias("p"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, vectors = batch.column("node").to_numpy(), halves(batch.column("half"))
            count = batch.column("p").value_lengths().to_numpy()
            others = batch.column("p").flatten()
            ids, theirs = others.field("node").to_numpy(), halves(others.field("half"))
            own = np.repeat(np.arange(len(node)), count)
            width = min(vectors.shape[1], theirs.shape[1]) if len(ids) else 0
            sims = np.einsum("nd,nd->n", vectors[own, :width], theirs[:, :width])
            ok = ids != node[own]
            yield _candidates(node, np.bincount(own[ok], minlength=len(node)), ids[ok], sims[ok])
    met = lookup_join(points.select("node", "grp", "half"), listed, "grp", ["node"]).select("node", "half", "p")
    out = merged(rows.unionByName(met.mapInArrow(meet, GRAPH)))
    removed(points)
    return out


# ------------------------------------------------------------------ balls
def dot(a: str, b: str) -> Column:
    """The inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def led(graph: DataFrame, tight: float) -> DataFrame | None:
    """(ball, target): leaders that give way to one at least `tight` near, by rounds of local minima; None if none does."""
    near = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e")).filter(F.col("e.sims") >= tight)
    pairs = near.select(F.col("node").alias("u"), F.col("e.ids").alias("v"))
    edges = saved(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "tight")
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    out = None
    while not edges.isEmpty():
        low = edges.groupBy("u").agg(F.min(ranked("v")).alias("low"))
        first = low.filter(ranked("u") < F.col("low")).select("u")
        taken = saved(edges.join(first.select(F.col("u").alias("v")), "v").groupBy("u").agg(F.min(ranked("v")).alias("t"))
                      .select(F.col("u").alias("ball"), F.col("t.id").alias("target")), "taken")
        out = taken if out is None else out.unionByName(taken)
        gone = taken.select(F.col("ball").alias("u"))
        # All that stand beside a first one are taken, so an edge is left only between two that are neither.
        left = edges.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v")
        after = saved(left.join(first, "u", "left_anti"), "tight")
        removed(edges)
        edges = after
    return out


def gathered(balls: DataFrame, moves: DataFrame, nodes: DataFrame, widest: float) -> DataFrame:
    """`balls` (node, ball, angle) after moves: who is too far from the new leader leads itself."""
    marked = lookup_join(balls, moves, "ball", ["node"], row_bytes=64)
    moving = marked.filter(F.col("target").isNotNull()).select("node", "target")
    units_ = nodes.select("node", "unit")
    own = moving.join(units_, "node")
    both = lookup_join(own, units_.select(F.col("node").alias("target"), F.col("unit").alias("lead")), "target", ["node"])
    far = angle(dot("unit", "lead"))
    moved = both.select("node", "target", far.alias("angle")).select(
        "node", F.when(F.col("angle") <= widest, F.col("target")).otherwise(F.col("node")).alias("ball"),
        F.when(F.col("angle") <= widest, F.col("angle")).otherwise(0.0).alias("angle"))
    return saved(marked.filter(F.col("target").isNull()).select("node", "ball", "angle").unionByName(moved), "balls")


def leaders_graph(graph: DataFrame, others: DataFrame, balls: DataFrame, k: int) -> DataFrame:
    """The graph of the leaders alone, started from the lists of all their members."""
    entries = lambda g: g.select(F.col("node").alias("u"), F.explode("ids").alias("v"))
    pairs = entries(graph).unionByName(entries(others))
    for side in ("u", "v"):
        named = balls.select(F.col("node").alias(side), F.col("ball").alias(f"b{side}"))
        pairs = pairs.join(named, side)
    pairs = pairs.filter("bu <> bv").select("bu", "bv").distinct()
    half = graph.select("node", "half")
    joined = pairs.join(half.select(F.col("node").alias("bu"), F.col("half").alias("hu")), "bu").join(
        half.select(F.col("node").alias("bv"), F.col("half").alias("hv")), "bv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = halves(batch.column("hu")), halves(batch.column("hv"))
            yield _candidates(batch.column("bu").to_numpy(), np.ones(len(a), np.int64), batch.column("bv").to_numpy(),
                              np.einsum("nd,nd->n", a, b[:, :a.shape[1]]))
    leaders = balls.filter("node = ball").select("node")
    none = {"k": F.lit(k), "ids": F.array().cast("array<long>"), "sims": F.array().cast("array<float>"), "fresh": F.array().cast("array<boolean>")}
    rows = graph.join(leaders, "node", "left_semi").withColumns(none).select(*_NAMES)
    return merged(rows.unionByName(joined.select("bu", "bv", "hu", "hv").mapInArrow(work, GRAPH)), "leaders")


def saturated(bound: float) -> Column:
    return (F.size("ids") >= F.col("k")) & (F.try_element_at("sims", F.lit(-1)) >= bound)


# ------------------------------------------------------------------ links
def _decided(balls: DataFrame, graph: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, more): links of each node outside its ball; (u, v): the pairs of balls that hold a link."""
    theta = math.acos(threshold)
    spans = saved(balls.join(nodes.select("node", "copies"), "node").groupBy("ball").agg(
        F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size"), F.sum("copies").alias("copies")), "spans")
    near = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e")).filter(F.col("e.sims") >= math.cos(min(2 * theta, math.pi)) - MARGIN)
    pairs = near.select(F.least("node", "e.ids").alias("u"), F.greatest("node", "e.ids").alias("v")).distinct()
    for side in ("u", "v"):
        facts = spans.join(nodes.select("node", "unit"), spans["ball"] == nodes["node"]).select(
            F.col("ball").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("radius", "size", "copies", "unit")])
        pairs = pairs.join(facts, side)
    pairs = pairs.withColumn("cos", dot("unit_u", "unit_v")).drop("unit_u", "unit_v").withColumn("angle", angle(F.col("cos")))
    reach = F.col("radius_u") + F.col("radius_v")
    lone = (F.col("size_u") == 1) & (F.col("size_v") == 1)
    state = (F.when(lone, F.when(F.col("cos") >= threshold, "all").otherwise("none"))
             .when(F.col("angle") + reach <= theta - SLACK, "all").when(F.col("angle") - reach > theta + SLACK, "none").otherwise("open"))
    pairs = saved(pairs.withColumn("state", state).filter("state <> 'none'"), "pairs")
    sure = pairs.filter("state = 'all'")
    whole = sure.select(F.col("u").alias("ball"), F.col("copies_v").alias("more")).unionByName(
        sure.select(F.col("v").alias("ball"), F.col("copies_u").alias("more"))).groupBy("ball").agg(F.sum("more").alias("more"))
    of_whole = lookup_join(balls.select("node", "ball"), whole, "ball", ["node"], row_bytes=64).filter("more IS NOT NULL").select("node", "more")
    compared = saved(_one_by_one(pairs.filter("state = 'open'"), balls, nodes, threshold), "compared")
    more = of_whole.unionByName(compared.select("node", "more")).groupBy("node").agg(F.sum("more").alias("more"))
    links = sure.select("u", "v").unionByName(compared.select("u", "v")).distinct()
    return more, links


def _one_by_one(pairs: DataFrame, balls: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, node, more): links of members of open pairs of balls, block by block."""
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    blocks = pairs.select("u", "v", parts("size_u").alias("pu"), parts("size_v").alias("pv")).select(
        "u", "v", "pu", "pv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pu") - 1)).alias("bu")).select(
        "u", "v", "pu", "pv", "bu", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pv") - 1)).alias("bv"))
    held = balls.join(nodes.select("node", "unit", "copies"), "node").select("node", "ball", "unit", "copies")
    sides, keys = [], ["u", "v", "bu", "bv"]
    for i, side in enumerate("uv"):
        own = pairs.select(F.col(side).alias("ball"), parts(f"size_{side}").alias("n")).distinct()
        placed = held.join(own, "ball").withColumn("b", F.pmod(F.xxhash64("node"), F.col("n"))).select(
            F.col("ball").alias(side), F.col("b").alias(f"b{side}"), "node", "unit", "copies")
        sides.append(blocks.join(placed, [side, f"b{side}"]).select("u", "v", "bu", "bv", F.lit(i).alias("side"), "node", "unit", "copies"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "run"):
            run, side, node, copies, u, v, bu, bv = (_col(table, c).to_numpy() for c in ("run", "side", "node", "copies", *keys))
            key, vectors = np.stack([run, u, v, bu, bv], axis=1), _col(table, "unit")
            breaks = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for own in np.split(np.arange(len(run)), breaks):
                a, b = own[side[own] == 0], own[side[own] == 1]
                if not len(a) or not len(b):
                    continue
                hit = _rows(vectors.take(pa.array(a))) @ _rows(vectors.take(pa.array(b))).T >= threshold
                more = np.concatenate([hit @ copies[b], hit.T @ copies[a]])
                both = np.concatenate([a, b])[more > 0]
                yield pa.RecordBatch.from_arrays([pa.array(u[both]), pa.array(v[both]), pa.array(node[both]), pa.array(more[more > 0])],
                                                 names=["u", "v", "node", "more"])
    lined = sides[0].unionByName(sides[1]).withColumn("run", F.xxhash64(*keys))
    lined = lined.repartition("run").sortWithinPartitions("run", *keys, "side")
    return lined.mapInArrow(work, "u long, v long, node long, more long")


# ------------------------------------------------------------------ the whole
class Links:
    """The links of a table of vectors: stored nodes with `n_links` and `component`, and the audited recall."""

    def __init__(self, table: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, audit: int = AUDIT_NODES):
        self.threshold, self.audit_nodes = threshold, audit
        self.rows = keyed(table)
        one_each = self.rows.filter("key IS NOT NULL").groupBy("key").agg(
            F.first("grp").alias("grp"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        self.nodes = saved(one_each.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
        graph = started(self.nodes, neighbours)
        for _ in range(WIDENINGS):
            graph = descend(graph)
            self.found = self._resolved(graph, neighbours)
            self.recall = self._audited()
            if self.recall >= RECALL:
                break
            neighbours *= 2
            wider = saved(graph.withColumn("k", F.lit(neighbours)).withColumn("fresh", F.transform("fresh", lambda _: F.lit(True))), "graph")
            removed(graph)
            graph = wider

    def _resolved(self, graph: DataFrame, k: int) -> DataFrame:
        """(node, n_links, component) of every node."""
        theta = math.acos(self.threshold)
        widest = theta / 2 - SLACK
        linked = saved(graph.filter(F.get("sims", F.lit(0)) >= self.threshold - MARGIN), "linked")
        balls = saved(linked.select("node", F.col("node").alias("ball"), F.lit(0.0).alias("angle")), "balls")
        near, tight = math.cos(min(2 * theta, math.pi)) - MARGIN, math.cos(widest) + MARGIN
        graph = linked
        # Thinning may end early: what is not gathered yet is compared pair of balls by pair of balls.
        for _ in range(LEVELS):
            moves = led(graph, tight)
            if moves is None:
                break
            after = gathered(balls, moves, self.nodes, widest)
            removed(balls)
            balls = after
            graph = descend(leaders_graph(linked, graph, balls, k), 2)
        while not graph.filter(saturated(near)).isEmpty():
            k *= 2
            wider = saved(graph.withColumns({"k": F.lit(k), "fresh": F.transform("fresh", lambda _: F.lit(True))}), "graph")
            graph = descend(wider)
        more, pairs = _decided(balls, graph, self.nodes, self.threshold)
        roots = components(pairs).select(F.col("node").alias("ball"), "root")
        inside = balls.join(self.nodes.select("node", "copies", "least"), "node").groupBy("ball").agg(
            F.sum("copies").alias("inside"), F.min("least").alias("least"))
        whole = inside.join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
        least = whole.groupBy("root").agg(F.min("least").alias("component"))
        of_ball = whole.join(least, "root").select("ball", "inside", "component")
        own = lookup_join(balls.select("node", "ball"), of_ball, "ball", ["node"], row_bytes=64).select("node", "inside", "component")
        out = self.nodes.select("node", "copies", "least").join(own, "node", "left").join(more, "node", "left")
        return saved(out.select("node", (F.coalesce("inside", "copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                                F.when(F.col("inside").isNull(), F.col("least")).otherwise(F.col("component")).alias("component")), "links")

    def _audited(self) -> float:
        """The share of the links of a sample of nodes, by brute force over all nodes, that was found."""
        sample = (self.nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(self.audit_nodes)
                  .join(self.found, "node").select("node", "grp", "unit", "copies", "n_links").collect())
        if not sample:
            return 1.0
        groups: dict[str, list] = {}
        for r in sample:
            groups.setdefault(r["grp"], []).append(r)
        held = {g: (np.array([r["unit"] for r in own]), np.array([r["node"] for r in own])) for g, own in groups.items()}
        threshold = self.threshold

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grp, unit = np.array(batch.column("grp").to_pylist(), object), batch.column("unit")
                for g in set(grp.tolist()) & set(held):
                    at = np.flatnonzero(grp == g)
                    theirs, nodes = held[g]
                    n = (_rows(unit.take(pa.array(at))) @ theirs.T >= threshold).T @ batch.column("copies").to_numpy()[at]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n, pa.int64())], names=["node", "n"])
        true = {r["node"]: r["n"] for r in self.nodes.select("grp", "unit", "copies").mapInArrow(work, "node long, n long")
                .groupBy("node").agg(F.sum("n").alias("n")).collect()}
        wanted = {r["node"]: max(0, true[r["node"]] - 1) for r in sample}
        total = sum(wanted.values())
        return sum(min(r["n_links"], wanted[r["node"]]) for r in sample) / total if total else 1.0

    def per_vector(self) -> DataFrame:
        """(vec_id, n_links, component_id, kept) of every row."""
        facts = self.nodes.join(self.found, "node").select("key", "n_links", "component")
        own = lookup_join(self.rows.filter("key IS NOT NULL").select("vec_id", "key"), facts, "key", ["vec_id"], row_bytes=64)
        alone = self.rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
        out = own.select("vec_id", "n_links", "component").unionByName(alone)
        return out.select("vec_id", "n_links", F.col("component").alias("component_id"),
                          F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links, its component, and whether it stands for it."""
    return Links(read(spark, sf_dir, "embeddings")).per_vector()
