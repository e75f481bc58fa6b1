"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import fresh_path

#: What separates words: space and the ASCII control spaces.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column of `df`, or a null of that type where the table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")


def digest(*parts: Column) -> Column:
    """16 bytes that stand for the values of `parts`, nulls told from empty strings."""
    tagged = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat_ws("\x1f", *tagged)))


#: The tables written in each open `scratch` block.
_SCRATCH: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that `saved` writes within are deleted at the end, but for those to `keep`, which the block around inherits.

    Nothing that leaves the block may still read them: results are written (`saved(..., keep=True)`) before it ends.
    """
    outer = _SCRATCH.get()
    tables: list[DataFrame] = []
    token = _SCRATCH.set((*outer, tables))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        removed(*tables)


def saved(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """`df` written once, compressed well, below the shared folder and read back."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    blocks = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if blocks:
        blocks[-1].append(out)
    return out


def removed(*tables: DataFrame) -> None:
    """Delete what `saved` wrote for these tables, once all that read them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores dealt out over all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def packed(df: DataFrame, name: str = "text") -> DataFrame:
    """`df` with a string column as compressed bytes, for texts that have to travel; nulls stay null."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == name else f for f in df.schema.fields])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        texts = pa.array([None if t is None else pack(t.encode()) for t in batch.column(name).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if c == name else batch.column(c) for c in batch.schema.names], names=batch.schema.names)
    return by_batch(df, work, schema, name, 1 << 20)


def unpacked(column: pa.Array) -> list[bytes | None]:
    """The bytes of texts that `packed` compressed."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if t is None else unpack(t) for t in column.to_pylist()]


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType | str,
             bytes_column: str | None = None, most: int = 8 << 20) -> DataFrame:
    """`work` on Arrow batches, each cut further so that `bytes_column` holds about `most` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, bytes_column, most):
                yield from work(part)
    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, bytes_column: str | None, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of a string or binary column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc
    if bytes_column is None or batch.num_rows == 0:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(bytes_column)), 0).to_numpy(zero_copy_only=False)
    turn = np.cumsum(sizes, dtype=np.int64) // most
    starts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def numbered(df: DataFrame, groups: list[str], order: str, name: str, part: str = "part") -> DataFrame:
    """`df` with a gapless number from 0 in each group, for rows that carry a stored `part`.

    A row's number is its number within its part and group, after all rows of the group in the
    parts before: no task sees more of a group than one part holds.
    """
    from pyspark.sql import Window
    counts = df.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*groups, part).orderBy(order)) - 1
    joined = df.withColumn("_inside", inside).join(starts, [*groups, part])
    return joined.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_start", "_inside")


def running(df: DataFrame, value: str, order: str, name: str, part: str = "part") -> DataFrame:
    """`df` with the sum of `value` over all rows before, by stored `part` and `order` within it."""
    from pyspark.sql import Window
    sums = df.groupBy(part).agg(F.sum(value).alias("_n"))
    # One row per part.
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, part)
    return joined.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_start", "_inside")
