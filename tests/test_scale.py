"""How the registered queries read and deal out their tables."""

from pyspark.sql import functions as F

from recordloom.catalog import common, corpus_queries


def test_texts_are_normalised_once(spark, tmp_path):
    docs = [(i, ("a  b", "c", "a b", None)[i % 4]) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_queries.vector_round_trip(spark, str(tmp_path))
    assert not any("documents.parquet" in path for path in found.inputFiles())
    assert sorted(tuple(r) for r in found.collect()) == [(i, 8, 3, 3) for i in range(12)]


def test_vectors_come_to_parts_before_the_texts(spark, tmp_path, monkeypatch):
    made = {
        "part": spark.range(6).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("t").alias("p_type"),
                                      F.lit("b").alias("p_brand"), F.lit(30).alias("p_size")),
        "documents": spark.range(4).select(F.col("id").alias("doc_id"), F.lit("x  y").alias("text"), F.lit("en").alias("lang")),
        "embeddings": spark.range(2).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"))}
    for name, rows in made.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(common, "kept", lambda df, label: df)
    records = common._search_records(spark, str(tmp_path))
    outer = next(line for line in records._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line)
    assert "p_partkey" in outer and "_slot" not in outer
    rows = sorted((r["record_id"], r["description"], r["full_vec"], r["title_vec"]) for r in records.collect())
    assert rows == [(i, "x y" if i < 4 else "", [float(i % 2)], [float((i + 1) % 2)]) for i in range(6)]
