"""The vector store: content key -> vector, in versions under one folder."""

from __future__ import annotations

import logging
import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed_values as fv
from ..functions.identity import ordered_digest, text_key
from ..operators.shuffle import broadcast_if_small

SCHEMA = "key string, model string, vector array<float>"
# More than a key and a vector of 4,000 dimensions take.
ROW_BYTES = 20_000
_FOLDER = re.compile(r"^([vd])=(\d+)$")
_GONE, _AT = "_gone", "_at"
#: Deltas are folded into a new base when they hold more than this share of its rows (so many at least), or are this many.
FOLD_SHARE, FOLD_COUNT, FOLD_LEAST = 0.25, 12, 1000
#: Rows of a table in folders up to which they are gathered by folder; more are written by the tasks that hold them.
FEW_ROWS = 1 << 16
#: Bases kept beside the one in force, for jobs that still read them.
KEPT_BASES = 1


class VersionedTable:
    """A table below one folder, as a base and the deltas written since.

    Base N lies in `v=N`, delta N in `d=N`, numbered together; each counts once its commit
    marker is there, so a job that dies while writing leaves the version before in force.
    A delta holds rows, and keys without rows (`_gone`): all rows of its keys in older folders
    are hidden.  So a change costs what it holds.  Deltas are folded into a new base when they
    have grown to a share of the old one, and folders that no version in force reads are
    deleted after that.  Without a `key`, deltas only add.  There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, rebuildable: bool = False, key: str | None = None,
                 layout: tuple[list[str], list[str]] | None = None):
        self.spark, self.root, self.schema, self.rebuildable = spark, root.rstrip("/"), schema, rebuildable
        self.key, self.layout = key, layout
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        path = self._hadoop.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- folders
    def _folders(self, committed: bool = True) -> list[tuple[int, str]]:
        """(number, kind) in order."""
        root = self._hadoop.Path(self.root)
        if not self._fs.exists(root):
            return []
        found = []
        for status in self._fs.listStatus(root):
            name = _FOLDER.match(status.getPath().getName())
            if name and (not committed or self._fs.exists(self._hadoop.Path(status.getPath(), "_SUCCESS"))):
                found.append((int(name.group(2)), name.group(1)))
        return sorted(found)

    def version(self) -> int:
        """The version in force; 0 when there is none."""
        return max((n for n, _ in self._folders()), default=0)

    def in_force(self) -> tuple[int, list[int]]:
        """The number of the base (0 for none) and those of the deltas after it."""
        folders = self._folders()
        base = max((n for n, kind in folders if kind == "v"), default=0)
        return base, [n for n, kind in folders if kind == "d" and n > base]

    def _next(self) -> int:
        return max((n for n, _ in self._folders(committed=False)), default=0) + 1

    def _write(self, df: DataFrame, path: str, rows: int | None = None) -> None:
        """`rows`, where known, tells how many rows there are at most."""
        if self.layout is None:
            df.write.parquet(path)
            return
        folders, order = self.layout
        if rows is None or rows <= FEW_ROWS:
            # One shuffle by folder; those that hold much are split at run time, each piece sorted.
            df = df.hint("rebalance", *[F.col(c) for c in folders])
        df.sortWithinPartitions(*order).write.partitionBy(*folders).parquet(path)

    def _open(self, folder: str, deltas: bool = False) -> DataFrame | None:
        """The rows of one folder, in the table's types; None where it counts as empty."""
        fields = [*self._fields(), *([T.StructField(_GONE, T.BooleanType())] if deltas else [])]
        if self.layout is not None and not self._data_files(folder):
            return None
        try:
            found = self.spark.read.parquet(f"{self.root}/{folder}")
            return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        except PySparkException as fault:
            if not self.rebuildable:
                raise
            logging.getLogger(__name__).warning("%s of %s cannot be read and counts as empty: %s", folder, self.root, fault)
            return None

    def _fields(self) -> list[T.StructField]:
        return T.DataType.fromDDL(self.schema).fields

    def _data_files(self, folder: str) -> bool:
        """False for a table in folders of which none was needed."""
        found = self._fs.listStatus(self._hadoop.Path(f"{self.root}/{folder}"))
        return any(not f.getPath().getName().startswith(("_", ".")) for f in found)

    # ------------------------------------------------------------- reading
    def read(self, where: Column | None = None) -> DataFrame:
        """The table in force (see `rows`)."""
        return self.rows(where)

    def rows(self, where: Column | None = None) -> DataFrame:
        """The rows in force as they are kept; none yet is an empty table.  `where` narrows what is read.

        A folder that cannot be opened raises, unless its rows can be made again
        (`rebuildable`): then it counts as empty and is logged.
        """
        names = [f.name for f in self._fields()]
        base, deltas = self.in_force()
        held = self._open(f"v={base}") if base else None
        held = self.spark.createDataFrame([], self.schema) if held is None else held
        held = held if where is None else held.filter(where)
        changes = None
        for number in deltas:
            rows = self._open(f"d={number}", True)
            if rows is not None:
                rows = rows.withColumn(_AT, F.lit(number))
                changes = rows if changes is None else changes.unionByName(rows)
        if changes is None:
            return held
        news = changes.filter(~F.col(_GONE))
        news = news if where is None else news.filter(where)
        if self.key is not None:
            # Which folder has the last word on each key that any delta names.
            last = broadcast_if_small(changes.groupBy(self.key).agg(F.max(_AT).alias(_AT)))
            news = news.join(last, [self.key, _AT], "left_semi")
            held = held.join(last, self.key, "left_anti")
        return held.select(*names).unionByName(news.select(*names))

    def set_damaged_aside(self) -> list[str]:
        """Read every page of what is in force; folders of a rebuildable table that fail no longer count, and are returned."""
        base, deltas = self.in_force()
        damaged = []
        for folder in [*([f"v={base}"] if base else []), *(f"d={n}" for n in deltas)]:
            try:
                rows = self.spark.read.parquet(f"{self.root}/{folder}")
                rows.agg(F.max(F.xxhash64(*rows.columns))).collect()
            except Exception as fault:  # whatever it is, the folder cannot be relied on
                if not self.rebuildable:
                    raise
                logging.getLogger(__name__).warning("%s of %s is damaged: %s", folder, self.root, fault)
                self._fs.delete(self._hadoop.Path(f"{self.root}/{folder}/_SUCCESS"), False)
                damaged.append(folder)
        return damaged

    # ------------------------------------------------------------- writing
    def replace(self, df: DataFrame, count: int | None = None) -> int:
        """Write `df` (of at most `count` rows, where known) as the next base and return its number."""
        number = self._next()
        self._write(df, f"{self.root}/v={number}", count)
        return number

    def upsert(self, rows: DataFrame, replaced: DataFrame | None = None, keys: DataFrame | None = None,
               count: int | None = None) -> int:
        """Write rows that take the place of all older rows of their keys; return the number.

        Keys of `replaced` that have no row here are taken out.  `keys` may name those that have
        one, where that is cheaper than to make the rows again, and `count` tell how many rows
        there are at most.
        """
        if self.key is None:
            raise ValueError("changes need a key")
        fields = self._fields()
        if self.in_force() == (0, []):
            return self.replace(rows.select(*[f.name for f in fields]), count)
        out = rows.select(*[f.name for f in fields], F.lit(False).alias(_GONE))
        if replaced is not None:
            gone = replaced.select(self.key).distinct().join((rows if keys is None else keys).select(self.key), self.key, "left_anti")
            out = out.unionByName(gone.select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name)
                                                for f in fields], F.lit(True).alias(_GONE)))
        number = self._delta(out, count)
        base, deltas = self.in_force()
        least = max(FOLD_LEAST, FOLD_SHARE * self._rows([f"v={base}"] if base else []))
        return self.fold() if len(deltas) > FOLD_COUNT or self._rows(f"d={n}" for n in deltas) > least else number

    def append(self, rows: DataFrame) -> int:
        """Write rows beside all others; return the number."""
        return self._delta(rows.select(*[f.name for f in self._fields()], F.lit(False).alias(_GONE)))

    def _delta(self, rows: DataFrame, count: int | None = None) -> int:
        number = self._next()
        self._write(rows, f"{self.root}/d={number}", count)
        return number

    def _rows(self, folders) -> int:
        """Rows by the files' footers."""
        opened = [self._open(folder) for folder in folders]
        return sum(found.count() for found in opened if found is not None)

    def fold(self) -> int:
        """Write base and deltas as one new base, and delete what is no longer read."""
        base, deltas = self.in_force()
        number = self.replace(self.rows(), self._rows([*([f"v={base}"] if base else []), *(f"d={n}" for n in deltas)]))
        self.vacuum()
        return number

    def vacuum(self, kept: int = KEPT_BASES) -> None:
        """Delete folders older than the last `kept` bases before the one in force."""
        folders = self._folders()
        bases = [n for n, kind in folders if kind == "v"]
        oldest = bases[-1 - kept] if len(bases) > kept else 0
        for number, kind in folders:
            if number < oldest:
                self._fs.delete(self._hadoop.Path(f"{self.root}/{kind}={number}"), True)


def vector_store(spark: SparkSession, root: str) -> VersionedTable:
    """The embedding store below `root`: a cache, so an unreadable version is made anew."""
    return VersionedTable(spark, root, SCHEMA, rebuildable=True, key="key")


def store_vectors(store: VersionedTable, known: DataFrame, fresh: DataFrame) -> int:
    """The fresh vectors beside the known ones, as a change of the store.

    A fresh vector replaces a known one of the same key.  Callers skip the write when
    nothing is fresh.
    """
    return store.upsert(fresh.select("key", "model", "vector"))


def import_legacy(store: VersionedTable, texts: DataFrame, legacy: DataFrame, legacy_name: str,
                  model: str = fv.DEFAULT_MODEL) -> DataFrame:
    """Vectors `(key, model, vector)` taken over from a whole-corpus archive.

    `texts` is `(grp, seq, text)` and `legacy` `(grp, seq, vector)`, one row per array
    position.  Nothing is taken when the store already knows every text, when the name's
    digest is not that of these texts, or when a group differs in length.
    """
    keyed = texts.withColumn("key", text_key(F.col("text"), model))
    empty = store.spark.createDataFrame([], SCHEMA)
    if keyed.join(store.read(), "key", "left_anti").isEmpty():
        return empty
    if legacy_name != ordered_digest(texts, "grp", "seq", "text", model):
        return empty
    sizes = (texts.groupBy("grp").agg(F.count(F.lit(1)).alias("n_texts"))
             .join(legacy.groupBy("grp").agg(F.count(F.lit(1)).alias("n_vectors")), "grp", "full"))
    if not sizes.filter(~F.col("n_texts").eqNullSafe(F.col("n_vectors"))).isEmpty():
        return empty
    return (keyed.join(legacy, ["grp", "seq"])
            .select("key", F.lit(model).alias("model"), "vector").dropDuplicates(["key"]))
