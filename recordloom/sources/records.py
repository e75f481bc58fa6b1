"""Reading and writing record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.text import is_blank, normalize, unify_separators
from ..operators.shuffle import number_rows
from ..plans.corpus import in_column_order

FORMATS = ("parquet", "csv", "json", "orc")


def load(spark: SparkSession, path: str | list[str], fmt: str = "parquet", multi_line: bool = True) -> DataFrame:
    """One table in any of the supported formats.

    CSV cells may hold line breaks; then a file is one task.  With `multi_line=False` files are
    cut into splits, and cells may not.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, escape='"')
    return reader.format(fmt).load(path)


def as_records(df: DataFrame, clean: bool = True) -> DataFrame:
    """The ten record columns of a loosely headed table.

    Headers are trimmed and lower-cased, missing columns and NULLs become empty, rows
    without a title go.  Other columns ride along.  `clean=False` keeps the cell text as
    it is, as the seeding and backfill jobs want it.
    """
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    have = set(df.columns)
    cell = normalize if clean else (lambda c: F.coalesce(c.cast("string"), F.lit("")))
    records = [cell(F.col(c) if c in have else F.lit(None)).alias(c) for c in fv.RECORD_COLUMNS]
    others = [F.col(c) for c in df.columns if c not in fv.RECORD_COLUMNS]
    return df.select(*others, *records).filter(~is_blank(F.col("job_title")))


def read_records(spark: SparkSession, path: str, fmt: str = "parquet", clean: bool = True, multi_line: bool = True) -> DataFrame:
    """S1 from a path."""
    return as_records(load(spark, path, fmt, multi_line), clean)


def _headers(spark: SparkSession, paths: list[str], fmt: str) -> dict[tuple[str, ...] | str, list[str]]:
    """The files by their column names, found in one job for CSV; a file without a line has none."""
    if fmt != "csv":
        found = {path: tuple(load(spark, path, fmt).columns) for path in paths}
    else:
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
        found = {r["path"]: r["line"] for r in lines.groupBy("path").agg(F.min_by("value", "at").alias("line")).collect()}
    groups: dict[tuple[str, ...] | str, list[str]] = {}
    for path, header in found.items():
        groups.setdefault(header, []).append(path)
    if not groups:
        raise FileNotFoundError(f"no rows in {paths[0]} and the like")
    return groups


def union_batches(spark: SparkSession, glob: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """All files of a glob, columns united by name, order kept in two columns.

    Files with one header are one read, however many they are; the driver sees paths and
    headers only.  `source_file` sorts as the files' paths do and `source_pos` as the rows of
    one file.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(glob)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = sorted(str(f.getPath()) for f in (found or []))
    if not paths:
        raise FileNotFoundError(glob)
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    out = None
    for _, same in sorted(_headers(spark, paths, fmt).items(), key=lambda x: min(x[1])):
        part = load(spark, sorted(same), fmt, multi_line)
        part = part.select("*", F.col("_metadata.file_path").alias("source_file"),
                           F.struct(F.col("_metadata.file_block_start").alias("block"), row.alias("row")).alias("source_pos"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_translated(spark: SparkSession, glob: str, fmt: str = "csv", columns=fv.LIST_COLUMNS) -> DataFrame:
    """S2 + F15: batches of translated records as one table in file and row order (`row_no` from 1).

    Separators are repaired in the list columns, told by their trimmed lower-case names; in
    prose a comma stays one.
    """
    rows = union_batches(spark, glob, fmt)
    lists = [c for c in rows.columns if c.strip().lower() in columns]
    repaired = rows.withColumns({c: unify_separators(F.col(f"`{c}`").cast("string")) for c in lists})
    return number_rows(repaired, ["source_file", "source_pos"], "row_no").drop("source_file", "source_pos")


def assign_batches(df: DataFrame, order: list[str], rows: int = fv.BATCH_ROWS,
                   slices: int | None = None) -> DataFrame:
    """S3: consecutive batches of `rows` rows along `order`; `batch_id` counts from 1."""
    numbered = number_rows(df, order, "row_no", slices)
    return numbered.withColumn("batch_id", F.floor((F.col("row_no") - 1) / rows).cast("long") + 1)


def write_batches(df: DataFrame, path: str, order: list[str], rows: int = fv.BATCH_ROWS,
                  fmt: str = "parquet", folders: bool = True) -> None:
    """S3: write the batches to a replaced target, a folder each.

    With `folders=False` consecutive batches share files: `batch_id` is a column, files hold
    whole stretches of batches in order, and their number follows the bytes, not the batches.
    """
    batched = assign_batches(df, order, rows).drop("row_no")
    if folders:
        (batched.repartition("batch_id").sortWithinPartitions("batch_id", *order)
         .write.mode("overwrite").partitionBy("batch_id").format(fmt).save(path))
    else:
        batched.repartitionByRange("batch_id").sortWithinPartitions("batch_id", *order).write.mode("overwrite").format(fmt).save(path)


def seed_if_empty(target: DataFrame | None, source: DataFrame) -> DataFrame | None:
    """The rows to insert into an empty target, all approved; None when it has rows."""
    if target is not None and not target.isEmpty():
        return None
    rows = as_records(source, clean=False).select(*fv.RECORD_COLUMNS)
    return rows.withColumn("status", F.lit("approved"))


def approved_snapshot(jobs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The approved rows, ten columns (and `keep`), NULL as empty."""
    approved = jobs.filter(F.col("status") == "approved")
    return approved.select(*keep, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fv.RECORD_COLUMNS])


def write_master(df: DataFrame, path: str, columns=fv.MASTER_COLUMNS, fmt: str = "parquet") -> None:
    """The master table in its fixed column order."""
    in_column_order(df, columns).write.mode("overwrite").format(fmt).save(path)
