"""Keeping the served corpus current as records are approved.

Records, vectors and postings are versioned tables that take changes as deltas, so a pass
writes what its changes hold, whatever the size of the corpus.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import fixed_values as fv
from ..functions import display
from ..functions.identity import text_key
from ..functions.text import normalize
from ..operators.embedding import missing_texts
from ..operators.lexical_index import LexicalIndex
from ..operators.shuffle import lookup_join
from ..session import stored
from ..sources.vectors import ROW_BYTES, VersionedTable, store_vectors, vector_store

CORPUS = ("record_id long, " + ", ".join(f"{c} string" for c in fv.RECORD_COLUMNS)
          + ", combined_text string, title_text string, seq long, served boolean")


class EmptyCorpus(ValueError):
    """A pass would have left nothing to serve."""


@dataclass
class ServedCorpus:
    """The versioned tables behind search: records with their texts, vectors by content, postings by record.

    A record keeps the `seq` of the change it stems from, and one taken out stays as a row
    that is not `served`, so a late change never undoes a newer one.
    """

    spark: SparkSession
    root: str
    model: str = fv.DEFAULT_MODEL

    @property
    def records(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/records", CORPUS, key="record_id")

    @property
    def index(self) -> LexicalIndex:
        """The postings of the combined texts of the records in force."""
        return LexicalIndex(self.spark, f"{self.root}/index")

    @property
    def vectors(self) -> VersionedTable:
        return vector_store(self.spark, f"{self.root}/vectors")

    def search_table(self) -> DataFrame:
        """The records in force with `full_vec` and `title_vec`, joined by content key."""
        held = self.vectors.read()
        out = self.records.read().filter("served").drop("seq", "served")
        for text, vec in (("combined_text", "full_vec"), ("title_text", "title_vec")):
            part = held.select(F.col("key").alias("_key"), F.col("vector").alias(vec))
            keyed = out.withColumn("_key", text_key(F.col(text), self.model))
            out = lookup_join(keyed, part, "_key", ["record_id"], row_bytes=ROW_BYTES).drop("_key")
        return out


def served_rows(records: DataFrame) -> DataFrame:
    """Approved rows as served: cells normalised, both texts attached."""
    rows = records.select(F.col("id").cast("long").alias("record_id"), *[c for c in ("seq", "status") if c in records.columns],
                          *[normalize(F.col(c)).alias(c) for c in fv.RECORD_COLUMNS])
    return rows.filter(F.col("job_title") != "").withColumns({
        "combined_text": display.combined_text(), "title_text": display.title_alias_text()})


def refresh(corpus: ServedCorpus, changes: DataFrame, udf, force: bool = False) -> int:
    """One pass: encode unknown texts, then publish the records with the changes applied.

    `changes` are record rows with `id`, `status`, ten columns and `seq`; the row of an id with
    the largest `seq` counts, also against what is served already, and a row that is not
    approved takes the record out.  Vectors are published first, then postings, then records,
    each as a delta: a failure at any point leaves the previous records whole, and the pass can
    be run again.  A corpus without records is refused.
    """
    latest = changes.groupBy("id").agg(F.max_by(F.struct("status", "seq", *fv.RECORD_COLUMNS), "seq").alias("r"))
    latest = latest.select(F.col("id").cast("long").alias("id"), "r.*")
    held = corpus.records.read()
    known_seq = held.select(F.col("record_id").alias("id"), F.col("seq").alias("held_seq"))
    news = latest.join(known_seq, "id", "left").filter(F.col("held_seq").isNull() | (F.col("seq") > F.col("held_seq"))).drop("held_seq")
    good = served_rows(news.filter(F.col("status") == "approved")).drop("status").withColumn("served", F.lit(True))
    names = good.columns
    out = news.join(good.select(F.col("record_id").alias("id")), "id", "left_anti").select(
        F.col("id").alias("record_id"), "seq", F.lit(False).alias("served"), *fv.RECORD_COLUMNS).withColumns(
        {"combined_text": F.lit(""), "title_text": F.lit("")})
    kept = held.join(news.select(F.col("id").alias("record_id")), "record_id", "left_anti").select(*names)
    if kept.filter("served").isEmpty() and good.isEmpty():
        raise EmptyCorpus("no record would be served; the previous version stays")
    to_encode = (kept.unionByName(good) if force else good).filter("served")
    texts = (to_encode.select(F.col("combined_text").alias("text"))
             .unionByName(to_encode.select(F.col("title_text").alias("text"))))
    known = corpus.vectors.read()
    todo = missing_texts(texts, "text", known, corpus.model, force)
    if not todo.isEmpty():
        store_vectors(corpus.vectors, known, todo.select(
            "key", F.lit(corpus.model).alias("model"), udf(F.col("text")).alias("vector")))
    # Written once: what is held changes below while these rows are still read.
    changed = stored(good.unionByName(out.select(*names)), "changes")
    corpus.index.change(changed.filter("served"), "record_id", "combined_text",
                        changed.filter("NOT served").select(F.col("record_id").alias("doc_id")))
    return corpus.records.upsert(changed)


#: A change that fails this many passes in a row, with every other, ends the stream.
PASSES = 5


def _settle(corpus: ServedCorpus, due: DataFrame, udf, force: bool, bit: int = 0) -> tuple[int, list[tuple[int, str]]]:
    """(passes that succeeded, ids that fail alone and why): a failing pass is halved by id until the fault is alone."""
    try:
        refresh(corpus, due, udf, force)
        return 1, []
    except EmptyCorpus:
        raise
    except Exception as fault:  # whatever went wrong, only its own change is to suffer
        reason = f"{type(fault).__name__}: {fault}"[:500]
        ids = due.select("id").distinct().limit(2).collect()
        if len(ids) < 2:
            return 0, [(ids[0]["id"], reason)]
    side = F.shiftright(F.xxhash64("id"), bit).bitwiseAND(F.lit(1)) == 0
    done, failed = 0, []
    for half in (due.filter(side), due.filter(~side)):
        if not half.isEmpty():
            more, faults = _settle(corpus, half, udf, force, bit + 1)
            done, failed = done + more, failed + faults
    return done, failed


def refresh_stream(changes: DataFrame, corpus: ServedCorpus, udf, checkpoint: str,
                   force: str | None = None) -> DataStreamWriter:
    """Refresh the corpus from a stream of record changes.

    Changes arriving during a pass wait for the next micro-batch and are served by one
    pass together; a request to re-encode (`force` names a boolean column) holds for the
    whole batch when any row asks for it.  A pass that fails leaves the previous version in
    force and is halved: changes that fail while others pass go to `aside` below the corpus
    with their reason.  Where nothing passes, all wait in `waiting`, the next pass takes them
    along, a damaged vector cache is set aside, and after `PASSES` such passes the stream fails.
    """
    fields = changes.schema.simpleString()[7:-1]
    waiting = VersionedTable(corpus.spark, f"{corpus.root}/waiting", fields)
    aside = VersionedTable(corpus.spark, f"{corpus.root}/aside", f"{fields},reason:string")

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        held = waiting.read()
        passes = len(waiting.in_force()[1])
        due = batch.select(*held.columns).unionByName(held).persist()
        try:
            strongest = bool(force) and bool(due.agg(F.max(F.col(force))).first()[0])
            done, failed = _settle(corpus, due, udf, strongest)
            if not done:
                raise RuntimeError(failed[0][1] if failed else "nothing could be served")
        except Exception as fault:  # the changes must not be lost
            logging.getLogger(__name__).warning("pass %d failed, its changes wait for the next: %s", number, fault)
            waiting.append(batch)
            if not isinstance(fault, EmptyCorpus):
                corpus.vectors.set_damaged_aside()
                if passes + 1 >= PASSES:
                    raise
        else:
            if failed:
                reasons = corpus.spark.createDataFrame(failed, "id long, reason string")
                aside.append(due.join(F.broadcast(reasons), "id"))
            if not held.isEmpty():
                waiting.replace(due.limit(0))
                waiting.vacuum()
        finally:
            due.unpersist()

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
