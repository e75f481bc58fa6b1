"""Repeated lines removed across all documents, the earliest kept.

Lines are normalised (lower case, runs of ASCII white space as one space, trimmed) and grouped
by digest over the whole table; the occurrence that ranks first, by doc_id (nulls last), row
digest and line number, stays and all others go.  Lines are cut and hashed once and stored as
digests; grouping them aggregates on the map side, so a line that a third of all rows share
reaches the reducer once a task.  Texts travel once, compressed, to meet what they lose.
Every line that is not blank is a unit; `min_words` lets a caller spare lines of fewer words,
blank lines always stay.

Defined cases: a null text has no lines and stays null; of rows equal in doc_id and text one
counts as earliest, and the others lose every unit; texts are cut whole, however long; a
document may lose all its lines and keeps an empty text; an empty table gives an empty result;
extra columns pass through `deduplicated` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import GAP, HAS_WORD, by_batch, column, digest, packed, read, saved, scratch, unpacked


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, row_key): the document's other columns packed, beside what the operator reads."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("string").alias("none")]
    return docs.select(F.struct(*others).alias("row"), column(docs, "doc_id", "long").alias("doc_id"),
                       column(docs, "text", "string").alias("text")).withColumn("row_key", digest(F.col("doc_id"), F.col("text")))


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def repeats(rows: DataFrame, min_words: int = 1) -> DataFrame:
    """(row_key, cuts) stored: the numbers of the lines to remove with the document that keeps each."""
    with scratch():
        lines = rows.select("row_key", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
        counts = (F.col("plain") != "") & (F.size(F.split("plain", " ")) >= min_words if min_words > 1 else F.lit(True))
        units = saved(lines.withColumn("plain", normal(F.col("raw"))).filter(counts)
                      .select(F.unhex(F.md5("plain")).alias("unit"),
                              F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "line").alias("at")), "units")
        first = (units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("keeper"))
                 .filter("n > 1").select("unit", "keeper"))
        lost = units.join(first, "unit").filter(F.col("at") != F.col("keeper"))
        # A document's own lines: bounded by its text.
        own = lost.groupBy("at.row_key").agg(
            F.sort_array(F.collect_set(F.struct(F.col("at.line").alias("line"), F.col("keeper.doc_id").alias("kept_in"),
                                                F.col("keeper.line").alias("kept_line")))).alias("cuts"))
        return saved(own, "cuts", keep=True)


SPANS = "array<struct<start:long,length:long,kept_in:long,kept_line:int>>"


def with_removals(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """`row` (the document's other columns) with `kept_text`, `n_lines` and `spans` in characters of the original text."""
    rows = keyed(docs)
    cuts = repeats(rows, min_words)
    # Equal rows lie together here: the first keeps what no other row has, the others keep nothing.
    turn = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    joined = packed(rows).join(cuts, "row_key", "left").withColumn("turn", turn).select("row", "doc_id", "text", "cuts", "turn")
    schema = T.StructType([joined.schema["row"], T.StructField("kept_text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("spans", T.DataType.fromDDL(SPANS))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kept_in", pa.int64()),
                                    ("kept_line", pa.int32())]))
    unit = re.compile(HAS_WORD)

    def is_unit(line: str) -> bool:
        return bool(unit.search(line)) and (min_words < 2 or len([w for w in re.split(GAP, line) if w]) >= min_words)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept, counts, spans = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "cuts", "turn")]
        for text, doc_id, cuts, turn in zip(unpacked(batch.column("text")), *columns):
            text = None if text is None else text.decode()
            lines = [] if text is None else text.split("\n")
            counts.append(len(lines))
            gone = {c["line"]: (c["kept_in"], c["kept_line"]) for c in cuts or ()}
            if turn > 1:  # what the first of equal rows keeps is kept there
                gone = {i: (doc_id, i) for i, line in enumerate(lines) if is_unit(line)} | gone
            start, found = 0, []
            for i, line in enumerate(lines if gone else ()):
                if i in gone:
                    found.append({"start": start, "length": len(line), "kept_in": gone[i][0], "kept_line": gone[i][1]})
                start += len(line) + 1
            spans.append(found)
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(counts, pa.int64()),
                                          pa.array(spans, span_type)], names=["row", "kept_text", "n_lines", "spans"])
    return by_batch(joined, work, schema, "text", 1 << 18)


def deduplicated(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """The documents, their own columns, with repeated lines taken out of the text."""
    out = with_removals(docs, min_words)
    return out.select(*[F.col("kept_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str, min_words: int = 1) -> DataFrame:
    """Every document without its repeated lines; `removed` lists start:length:keeper of what went."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_removals(docs, min_words)
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["length"], s["kept_in"]))
    return out.select("row.doc_id", F.col("kept_text").alias("text"), "n_lines",
                      F.size("spans").cast("long").alias("n_removed"), F.array_join(shown, ";").alias("removed"))


OP2_SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS line FROM split),
units AS (SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(raw) - 1 AS start,
    trim(regexp_replace(lower(raw), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS plain FROM numbered),
ranked AS (SELECT *, plain <> '' AS counts,
    row_number() OVER (PARTITION BY plain ORDER BY doc_id, line) AS turn,
    first_value(doc_id) OVER (PARTITION BY plain ORDER BY doc_id, line) AS keeper FROM units),
marked AS (SELECT *, counts AND turn > 1 AS gone FROM ranked)
SELECT doc_id, CASE WHEN count(*) FILTER (NOT gone) = 0 THEN '' ELSE string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone) END AS text,
  count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(start::BIGINT || ':' || length(raw) || ':' || keeper, ';' ORDER BY line) FILTER (gone), '') AS removed
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0, '' FROM documents WHERE text IS NULL"""
