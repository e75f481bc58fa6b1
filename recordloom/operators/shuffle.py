"""Building blocks that keep hot keys out of single tasks and broadcasts bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import pinned

BROADCAST_BYTES = 64 * 1024 * 1024
SLICE = "_slice"
_LOCAL_BITS = (1 << 33) - 1


def measured_bytes(df: DataFrame) -> int:
    """The size of the rows of `df`, near enough, from one distributed aggregate."""
    def width(field):
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            return F.coalesce(F.size(field.name), F.lit(0)) * 8 + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(field.name))) + 16
        return F.lit(16)
    total = reduce(lambda a, b: a + b, (width(f) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(total)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES,
                       row_bytes: int | None = None) -> DataFrame:
    """`df` marked for broadcast when its size allows, else left to a shuffle join.

    The size is measured, or taken as rows times `row_bytes` where rows of a stored table
    have a known bound: counting those reads no column.
    """
    size = measured_bytes(df) if row_bytes is None else df.count() * row_bytes
    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """A scan of a few splits dealt out over all cores; larger scans are left as they are.

    Only meant for stored tables with heavy per-row work: a small file is one split,
    however many cores wait.  With `task_rows`, for the heaviest work, no task is dealt many
    more rows than that, so more rows mean more tasks.  Counting rows of a stored table reads
    no column.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if task_rows is not None:
        tasks = max(tasks, -(-df.count() // task_rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() * 4 <= tasks else df


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first `k` rows of each group with their rank from 1.

    The rank filter lets Spark keep `k` rows per group and task before the shuffle
    (WindowGroupLimit), so a hot group never travels whole.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


HOT_SHARE = 64


def lookup_join(rows: DataFrame, table: DataFrame, key: str, salt_on: list[str],
                salts: int = 32, max_bytes: int = BROADCAST_BYTES,
                row_bytes: int | None = None) -> DataFrame:
    """`rows` left-joined to a `table` that holds each key at most once.

    A small table is broadcast.  With a large one, the keys holding more than one in
    `HOT_SHARE` of the rows (so fewer than `HOT_SHARE` keys) are spread: their rows over
    `salts` parts by a hash of `salt_on`, their table row copied to each part.  Rows without
    a key find nothing and are spread likewise.
    """
    small = broadcast_if_small(table, max_bytes, row_bytes)
    if small is not table:
        return rows.join(small, key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = F.broadcast(counts.filter(F.col("_n") * HOT_SHARE > total).select(key, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(*salt_on), F.lit(salts))).otherwise(0).cast("int")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread_rows = rows.join(hot, key, "left").withColumn("_part", part).drop("_hot")
    spread_table = table.join(hot, key, "left").withColumn("_part", F.explode(copies)).drop("_hot")
    return spread_rows.join(spread_table, [key, "_part"], "left").drop("_part")


def sliced(df: DataFrame, by: list[str], slices: int | None = None) -> DataFrame:
    """`df` cut into equal sorted slices along `by`, pinned in a reliable checkpoint.

    Range partitioning samples the rows, so a key holding a third of them spreads over a
    third of the slices.  Partition i of the result is slice i, in order.
    """
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return pinned(ranged.sortWithinPartitions(*by).withColumn(SLICE, F.spark_partition_id()))


def number_rows(df: DataFrame, by: list[str], name: str = "row_no",
                slices: int | None = None) -> DataFrame:
    """A gapless row number from 1 along `by`, without a single-task window.

    The position inside a slice comes from the pinned partition order, the offset from
    the row counts of the slices before it (one row per slice).
    """
    cut = sliced(df, by, slices)
    counts = cut.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(SLICE, F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))
    return (cut.withColumn("_local", local)
            .join(F.broadcast(offsets), SLICE)
            .withColumn(name, F.col("_before") + F.col("_local") + 1)
            .drop(SLICE, "_local", "_before"))


def running_sum(df: DataFrame, key: str, by: list[str], value: str, name: str,
                slices: int | None = None) -> DataFrame:
    """The running sum of `value` per `key` along `by`, with hot keys spread over slices.

    A key is contiguous in the slices: it can only continue from one slice as that
    slice's last key into the next as its first.  So a slice needs one carried-in total,
    the sum of `value` over earlier slices that ended in its first key.
    """
    cut = sliced(df, [key, *by], slices)
    edges = cut.groupBy(SLICE).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    tails = (cut.join(F.broadcast(edges), SLICE).filter(F.col(key) == F.col("_last"))
             .groupBy(SLICE).agg(F.sum(value).alias("_tail")))
    # One row per slice from here on.
    until = Window.partitionBy("_last").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    totals = edges.join(tails, SLICE).withColumn("_total", F.sum("_tail").over(until))
    step = Window.orderBy(SLICE)
    carried = (totals.select(SLICE, F.col("_first").alias(key),
                             F.lag("_last").over(step).alias("_prev"),
                             F.lag("_total").over(step).alias("_carry"))
               .filter(F.col("_prev") == F.col(key)).drop("_prev"))
    inside = Window.partitionBy(SLICE, key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return (cut.withColumn("_local", F.sum(value).over(inside))
            .join(F.broadcast(carried), [SLICE, key], "left")
            .withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0)))
            .drop(SLICE, "_local", "_carry"))
