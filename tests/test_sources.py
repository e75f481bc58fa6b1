import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.functions.identity import ordered_digest
from recordloom.operators import lists
from recordloom.operators.embedding import embed, encoder_udf, text_normalizer
from recordloom.functions.text import normalize
from recordloom.plans.corpus import assemble_master
from recordloom.sources import records as R
from recordloom.sources.vectors import SCHEMA, import_legacy, store_vectors, vector_store
from recordloom.streaming.refresh import EmptyCorpus, ServedCorpus, refresh, refresh_stream


def _csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


def test_read_records_is_tolerant(spark, tmp_path):
    _csv(tmp_path / "r.csv", [" Job_Title", "SKILLS "], [["  a\nb ", "x | y"], ["  ", "z"], ["c", ""]])
    rows = R.read_records(spark, str(tmp_path / "r.csv"), "csv").orderBy("job_title").collect()
    assert [(r["job_title"], r["skills"], r["tools"]) for r in rows] == [("a b", "x | y", ""), ("c", "", "")]
    with pytest.raises(ValueError):
        R.load(spark, "x", "xlsx")


def test_union_batches_keeps_file_and_row_order(spark, tmp_path):
    _csv(tmp_path / "b_2.csv", ["t", "extra"], [["3", "e"]])
    _csv(tmp_path / "b_1.csv", ["t"], [["1"], ["2"]])
    rows = R.union_batches(spark, str(tmp_path / "b_*.csv")).orderBy("source_file", "source_pos").collect()
    assert [(r["t"], r["extra"]) for r in rows] == [("1", None), ("2", None), ("3", "e")]
    with pytest.raises(FileNotFoundError):
        R.union_batches(spark, str(tmp_path / "none_*.csv"))


def test_write_batches_replaces_its_target(spark, tmp_path):
    out = str(tmp_path / "batches")
    R.write_batches(spark.range(25).withColumnRenamed("id", "v"), out, ["v"])
    R.write_batches(spark.range(12).withColumnRenamed("id", "v"), out, ["v"])
    rows = spark.read.parquet(out).collect()
    assert sorted((r["batch_id"], r["v"]) for r in rows) == [(1, i) for i in range(10)] + [(2, 10), (2, 11)]


def test_seed_and_snapshot(spark):
    src = spark.createDataFrame([("a", None), (" ", "x")], "job_title string, tools string")
    seeded = R.seed_if_empty(None, src)
    assert [(r["job_title"], r["tools"], r["status"]) for r in seeded.collect()] == [("a", "", "approved")]
    assert R.seed_if_empty(seeded, src) is None
    jobs = seeded.unionByName(seeded.withColumn("status", F.lit("pending")))
    assert R.approved_snapshot(jobs).count() == 1


def test_master_table(spark, tmp_path):
    base = spark.createDataFrame([("11-1", "T1", "D1"), ("22-2", "T2", None)], "code string, title string, description string")
    facts = spark.createDataFrame([
        ("11-1", "low", 1, "IM", 2.0, None, None), ("11-1", "Two|x", 2, "IM", 4.0, "N", None), ("11-1", "one ", 3, "IM", 5.0, None, "N"),
        ("11-1", "ONE", 4, "IM", 4.5, None, None), ("11-1", "gone", 5, "IM", 5.0, "Y", None), ("11-1", "other", 6, "LV", 5.0, None, None),
        ("11-1", " ", 7, "IM", 5.0, None, None)],
        "code string, element string, seq int, scale_id string, data_value double, recommend_suppress string, not_relevant string")
    titles = spark.createDataFrame([("22-2", "b", 1), ("22-2", "a", 2), ("22-2", "B ", 3), ("11-1", None, 4)], "code string, element string, seq int")
    zones = spark.createDataFrame([("11-1", 3), ("11-1", 4)], "code string, job_zone int")
    rows = assemble_master(base, {"hard_skills": facts, "aliases": titles}, zones)
    assert rows.columns == list(fv.MASTER_COLUMNS)
    got = {(r["job_code"], r["level"]): r for r in rows.collect()}
    assert set(got) == {("11-1", "3"), ("11-1", "4"), ("22-2", "")}
    one = got["11-1", "3"]
    assert (one["hard_skills"], one["soft_skills"], one["aliases"], one["industry"]) == ("one | Two/x", "one | Two/x", "", "صنعت کد 11")
    assert got["22-2", ""]["aliases"] == "a | b" and got["22-2", ""]["description"] == ""
    R.write_master(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    filled = {r["column"]: r for r in lists.fill_profile(rows, ["hard_skills", "aliases"]).collect()}
    assert (filled["hard_skills"]["filled"], filled["hard_skills"]["distinct_values"], filled["hard_skills"]["avg_items"]) == (2, 2, 2.0)


def _counting(seen):
    def encode(texts):
        with open(seen, "a", encoding="utf-8") as f:
            f.writelines(t + "\n" for t in texts)
        return np.array([[len(t), 1.0] for t in texts])
    return encode


def test_embed_encodes_only_unknown_texts(spark, tmp_path):
    seen = str(tmp_path / "seen.txt")
    store = vector_store(spark, str(tmp_path / "store"))
    udf = encoder_udf(_counting(seen))
    texts = lambda *ts: spark.createDataFrame([(t,) for t in ts], "t string")
    out = embed(texts("a", "bb", "a"), "t", store, udf).collect()
    assert len(out) == 3 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in out)
    assert store.version() == 1
    embed(texts("a", "ccc"), "t", store, udf).collect()
    assert sorted(open(seen, encoding="utf-8").read().split()) == ["a", "bb", "ccc"] and store.version() == 2
    embed(texts("a", "ccc"), "t", store, udf).collect()
    assert store.version() == 2
    embed(texts("a"), "t", store, udf, force=True).collect()
    assert store.version() == 3 and store.read().count() == 3


def test_unfinished_or_unreadable_versions_do_not_count(spark, tmp_path):
    store = vector_store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    fresh = spark.createDataFrame([("k", "m", [1.0])], SCHEMA)
    store_vectors(store, store.read(), fresh)
    (tmp_path / "s" / "v=2").mkdir()
    assert store.version() == 1 and store.read().count() == 1
    assert store.replace(fresh) == 3
    (tmp_path / "s" / "v=9").mkdir()
    (tmp_path / "s" / "v=9" / "_SUCCESS").touch()
    assert store.version() == 9 and store.read().count() == 0


def _changes(spark, *rows):
    schema = "id long, status string, seq long, " + ", ".join(f"{c} string" for c in fv.RECORD_COLUMNS)
    return spark.createDataFrame([(i, s, q, t, *["c"] * (len(fv.RECORD_COLUMNS) - 1)) for i, s, q, t in rows], schema)


def _titles(corpus):
    return {r["record_id"]: r["job_title"] for r in corpus.search_table().collect()}


def test_refresh_keeps_the_newest_and_never_empties(spark, tmp_path):
    udf = encoder_udf(lambda ts: np.array([[len(t), 1.0] for t in ts]))
    corpus = ServedCorpus(spark, str(tmp_path / "c"))
    refresh(corpus, _changes(spark, (1, "approved", 1, "one"), (2, "approved", 9, "two")), udf)
    refresh(corpus, _changes(spark, (2, "approved", 3, "old two"), (1, "rejected", 5, "one")), udf)
    assert _titles(corpus) == {2: "two"}
    refresh(corpus, _changes(spark, (1, "approved", 4, "late one"), (3, "approved", 1, "three")), udf)
    assert _titles(corpus) == {2: "two", 3: "three"}
    version = corpus.records.version()
    with pytest.raises(EmptyCorpus):
        refresh(corpus, _changes(spark, (2, "rejected", 20, ""), (3, "rejected", 20, "")), udf)
    assert corpus.records.version() == version and _titles(corpus) == {2: "two", 3: "three"}


def test_damaged_records_raise(spark, tmp_path):
    udf = encoder_udf(lambda ts: np.array([[len(t), 1.0] for t in ts]))
    corpus = ServedCorpus(spark, str(tmp_path / "c"))
    refresh(corpus, _changes(spark, (1, "approved", 1, "one"), (2, "approved", 1, "two")), udf)
    (tmp_path / "c" / "records" / "v=2").mkdir()
    (tmp_path / "c" / "records" / "v=2" / "_SUCCESS").touch()
    with pytest.raises(Exception, match="schema|SCHEMA"):
        refresh(corpus, _changes(spark, (3, "approved", 1, "three")), udf)
    assert corpus.records.version() == 2


def test_failing_pass_waits_for_the_next(spark, tmp_path):
    source, flag = str(tmp_path / "in"), tmp_path / "fail"
    corpus = ServedCorpus(spark, str(tmp_path / "c"))

    def encode(texts, flag=str(flag)):
        import os
        if os.path.exists(flag):
            raise RuntimeError("no encoder")
        return np.array([[len(t), 1.0] for t in texts])

    def run(*rows):
        batch = _changes(spark, *rows)
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        refresh_stream(stream, corpus, encoder_udf(encode), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run((1, "approved", 1, "one"))
    flag.touch()
    run((2, "approved", 2, "two"))
    assert _titles(corpus) == {1: "one"}
    flag.unlink()
    run((3, "approved", 3, "three"))
    assert _titles(corpus) == {1: "one", 2: "two", 3: "three"}


def test_legacy_import(spark, tmp_path):
    store = vector_store(spark, str(tmp_path / "s"))
    texts = spark.createDataFrame([("full", 0, "x"), ("full", 1, "y"), ("title", 0, "x")], "grp string, seq int, text string")
    legacy = spark.createDataFrame([("full", 0, [1.0]), ("full", 1, [2.0]), ("title", 0, [1.0])], "grp string, seq int, vector array<float>")
    name = ordered_digest(texts, "grp", "seq", "text")
    assert import_legacy(store, texts, legacy, "0" * 12).count() == 0
    assert import_legacy(store, texts, legacy.limit(2), name).count() == 0
    taken = import_legacy(store, texts, legacy, name)
    assert sorted(r["vector"] for r in taken.collect()) == [[1.0], [2.0]]
    store_vectors(store, store.read(), taken)
    assert import_legacy(store, texts, legacy, name).count() == 0


def test_normaliser_seam_and_prefix(spark):
    df = spark.createDataFrame([(" aB ",)], "t string")
    assert df.select(normalize(F.col("t"), text_normalizer(str.upper)).alias("n")).first()["n"] == "AB"
    encode = encoder_udf(lambda ts: np.array([[len(t), 0.0 if t.startswith("query: ") else 1.0] for t in ts]), "query", "intfloat/e5-base")
    assert df.select(encode("t").alias("v")).first()["v"] == [1.0, 0.0]


def test_refresh_stream(spark, tmp_path):
    """Two batches of changes: new and edited records encode their own texts, the rest is kept."""
    source, seen = str(tmp_path / "in"), str(tmp_path / "seen.txt")
    schema = "id long, status string, seq long, force boolean, " + ", ".join(f"{c} string" for c in fv.RECORD_COLUMNS)

    def add(*rows):
        full = [(i, s, q, f, t, *["c"] * (len(fv.RECORD_COLUMNS) - 1)) for i, s, q, f, t in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(source)

    corpus = ServedCorpus(spark, str(tmp_path / "corpus"))

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        q = refresh_stream(stream, corpus, encoder_udf(_counting(seen)), str(tmp_path / "cp"), force="force").trigger(availableNow=True).start()
        q.awaitTermination()

    count = lambda: len(open(seen, encoding="utf-8").read().splitlines())
    add((1, "approved", 1, False, "one"), (2, "approved", 2, False, "two"), (3, "pending", 3, False, "three"))
    run()
    assert {r["job_title"] for r in corpus.search_table().collect()} == {"one", "two"} and count() == 4
    add((3, "approved", 4, False, "three"), (2, "rejected", 5, False, "two"), (1, "approved", 6, False, "one"))
    run()
    rows = corpus.search_table().collect()
    assert {r["job_title"] for r in rows} == {"one", "three"} and count() == 6
    assert all(r["full_vec"] and r["title_vec"] for r in rows)
    add((3, "approved", 7, False, "three"), (1, "approved", 8, True, "one"))
    run()
    assert count() == 10 and corpus.records.version() == 3
