"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import removed, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v): the root is the least node of the component.

    Hubs are reduced by an aggregate and joined back, so no task gathers the links of a hub.
    Every round is written to the shared folder; the driver sees one count and one checksum.
    """
    edges = saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                  "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(down.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        removed(edges)
        edges = after
        state, before = _state(edges), state
        if state == before:
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    own = edges.select(F.col("v").alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.unionByName(own.select("node", F.col("node").alias("root")))
