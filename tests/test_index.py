"""The stored index, delta storage and refreshes that write what a change holds."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.operators import dense, lexical, lexical_index
from recordloom.operators.embedding import encoder_udf
from recordloom.operators.lexical_index import LexicalIndex
from recordloom.plans import search
from recordloom.sources import vectors as V
from recordloom.streaming import refresh as S

WORDS = [f"w{i}" for i in range(60)]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "d long, t string")


def _texts(rng, ids):
    return {i: " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for i in ids}


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_after_changes_equals_a_rebuilt_one(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    held = _texts(rng, range(60))
    index = LexicalIndex(spark, str(tmp_path / "a"), 4)
    index.rebuild(_docs(spark, list(held.items())), "d", "t")
    for step in range(3):
        changed = _texts(rng, rng.sample(range(80), 12))
        changed[step] = ""  # loses all its words
        gone = [i for i in rng.sample(sorted(held), 5) if i not in changed]
        index.change(_docs(spark, list(changed.items())), "d", "t", spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        held = {i: t for i, t in {**held, **changed}.items() if i not in gone}
    fresh = LexicalIndex(spark, str(tmp_path / "b"), 7)
    fresh.rebuild(_docs(spark, list(held.items())), "d", "t")
    for name in ("postings", "lengths"):
        columns = ["doc_id", "token", "tf", "len"] if name == "postings" else ["doc_id", "len"]
        assert _rows(getattr(index, name).read().select(*columns)) == _rows(getattr(fresh, name).read().select(*columns))
    asks = spark.createDataFrame([(i, " ".join(rng.choices(WORDS + ["unknown"], k=5))) for i in range(8)] + [(9, "")], "q long, t string")
    also = spark.createDataFrame([(0, i) for i in sorted(held)], "query_id long, doc_id long")
    probe = lambda ix: [(a, b, round(c, 9), d) for a, b, c, d in _rows(lexical.indexed_topk(ix, asks, "q", "t", 6, also).select(
        "query_id", "doc_id", "sparse", F.coalesce("rank", F.lit(0))))]
    scan = lexical.bm25_topk(_docs(spark, list(held.items())), "d", "t", asks, "q", "t", 6, also).select(
        "query_id", "doc_id", "sparse", F.coalesce("rank", F.lit(0)))
    want = [(a, b, round(c, 9), d) for a, b, c, d in _rows(scan)]
    assert probe(index) == probe(fresh) == want
    # The same from many blocks of questions and slices of documents.
    monkeypatch.setattr(lexical, "BLOCK_QUESTIONS", 2)
    monkeypatch.setattr(lexical, "_CELLS", 16)
    assert probe(index) == want
    pairs = {(r["query_id"], r["doc_id"]): round(r["sparse"], 9) for r in
             lexical.score_pairs(_docs(spark, list(held.items())), "d", "t", asks, "q", "t").collect()}
    assert all(pairs[a, b] == pytest.approx(c) for a, b, c, _ in want)


def test_probing_reads_folders_of_the_asked_tokens_and_no_text(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "i"), 16)
    index.rebuild(_docs(spark, [(i, f"{w} common") for i, w in enumerate(WORDS)]), "d", "t")
    terms = index.terms(spark.createDataFrame([("w7",)], "token string"))
    assert [tuple(r) for r in terms.collect()] == [(7, "w7", 1, 2)]
    assert "PartitionFilters: [isnotnull(part" in terms._jdf.queryExecution().executedPlan().toString()
    plan = lexical.indexed_topk(index, spark.createDataFrame([(1, "w7 common")], "q long, t string"), "q", "t")
    assert "split(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("rows", [200, 20_000])
def test_a_change_writes_what_it_holds(spark, tmp_path, rows):
    table = V.VersionedTable(spark, str(tmp_path / "t"), "k long, v string", key="k")
    table.replace(spark.range(rows).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1))
    before = _size(tmp_path)
    table.upsert(spark.createDataFrame([(3, "new"), (rows, "more")], "k long, v string").coalesce(1),
                 spark.createDataFrame([(3,), (5,)], "k long"))
    assert _size(tmp_path) - before < 4000
    held = {r["k"]: r["v"] for r in table.read().filter(F.col("k").isin(3, 4, 5, rows)).collect()}
    assert held[3] == "new" and held[rows] == "more" and 5 not in held and len(held) == 3 and table.read().count() == rows


def test_folding_keeps_the_rows_and_drops_old_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FOLD_COUNT", 3)
    table = V.VersionedTable(spark, str(tmp_path / "t"), "k long, v long", key="k")
    want = {}
    for step in range(11):
        news = {step: step, step % 4: -step}
        table.upsert(spark.createDataFrame(list(news.items()), "k long, v long"), spark.createDataFrame([(step - 5,)], "k long"))
        want = {k: v for k, v in {**want, **news}.items() if k != step - 5 or k in news}
        assert dict(_rows(table.read())) == want
    base, deltas = table.in_force()
    folders = [p for p in os.listdir(tmp_path / "t") if "=" in p]
    assert base > 1 and len(deltas) <= 3 and len([p for p in folders if p.startswith("v=")]) == 2
    assert table.version() == max([base, *deltas])


def test_damaged_pages_of_a_cache_are_set_aside(spark, tmp_path):
    store = V.vector_store(spark, str(tmp_path / "s"))
    V.store_vectors(store, store.read(), spark.createDataFrame([("a", "m", [1.0])], V.SCHEMA).coalesce(1))
    V.store_vectors(store, store.read(), spark.createDataFrame([("b", "m", [2.0] * 500)], V.SCHEMA).coalesce(1))
    assert store.set_damaged_aside() == [] and store.read().count() == 2
    path = next(p for p in (tmp_path / "s" / "d=2").iterdir() if p.suffix == ".parquet")
    data = bytearray(path.read_bytes())
    data[4:60] = bytes(56)  # a page, not the footer
    path.write_bytes(bytes(data))
    crc = path.with_name(f".{path.name}.crc")
    if crc.exists():
        crc.unlink()
    assert store.set_damaged_aside() == ["d=2"] and [r["key"] for r in store.read().collect()] == ["a"]


def _changes(spark, *rows):
    schema = "id long, status string, seq long, " + ", ".join(f"{c} string" for c in fv.RECORD_COLUMNS)
    return spark.createDataFrame([(i, s, q, t, *["c"] * (len(fv.RECORD_COLUMNS) - 1)) for i, s, q, t in rows], schema)


def test_one_bad_change_is_set_aside_and_the_rest_served(spark, tmp_path):
    def encode(texts):
        if any("poison" in t for t in texts):
            raise ValueError("cannot encode")
        return np.array([[len(t), 1.0] for t in texts])
    source, corpus = str(tmp_path / "in"), S.ServedCorpus(spark, str(tmp_path / "c"))

    def run(*rows):
        batch = _changes(spark, *rows)
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        S.refresh_stream(stream, corpus, encoder_udf(encode), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run((1, "approved", 1, "one"), (2, "approved", 2, "poison"), (3, "approved", 3, "three"))
    assert {r["job_title"] for r in corpus.search_table().collect()} == {"one", "three"}
    aside = V.VersionedTable(spark, f"{corpus.root}/aside", _changes(spark).schema.simpleString()[7:-1] + ",reason:string").read().collect()
    assert [(r["id"], "cannot encode" in r["reason"]) for r in aside] == [(2, True)]
    run((2, "approved", 4, "two"), (3, "rejected", 5, "three"))
    assert {r["job_title"] for r in corpus.search_table().collect()} == {"one", "two"}
    # The index holds the texts in force, and only those.
    fresh = LexicalIndex(spark, str(tmp_path / "fresh"))
    fresh.rebuild(corpus.records.read().filter("served"), "record_id", "combined_text")
    assert _rows(corpus.index.postings.read().select("doc_id", "token", "tf", "len")) == _rows(fresh.postings.read().select("doc_id", "token", "tf", "len"))


def test_a_stream_that_serves_nothing_any_more_fails(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PASSES", 2)

    def encode(texts):
        raise RuntimeError("no encoder")
    source, corpus = str(tmp_path / "in"), S.ServedCorpus(spark, str(tmp_path / "c"))

    def run(*rows):
        batch = _changes(spark, *rows)
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        S.refresh_stream(stream, corpus, encoder_udf(encode), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run((1, "approved", 1, "one"))
    with pytest.raises(Exception, match="no encoder"):
        run((2, "approved", 2, "two"))


# ---------------------------------------------------------------- vectors that are missing
def test_missing_and_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, [1.0, None]), (6, []), (7, [0.5, 0.5])]
    records = spark.createDataFrame(rows, "id long, v array<double>").repartition(1)
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.2])], "q long, w array<double>")
    found = dense.dense_topk(records, "id", F.col("v"), asks, "q", "w", 5)
    assert _rows(found.select("query_id", "doc_id", "rank")) == [(1, 1, 1), (1, 3, 3), (1, 7, 2)]
    assert tuple(dense.vector_faults(records, "v", 2).first()) == (1, 2, 1)


def test_a_question_without_candidates_is_out_of_domain(spark):
    cells = {c: F.lit("x") for c in fv.RECORD_COLUMNS}
    records = spark.range(0).select(F.col("id").alias("record_id"), *[v.alias(c) for c, v in cells.items()])
    none = F.array(F.lit(1.0), F.lit(0.0))
    records = search.with_combined_text(records).withColumns({"full_vec": none, "title_vec": none})
    asked = search.classify_questions(spark.createDataFrame([(1, "what is this?"), (2, "شغلی می‌خواهم x")], "query_id long, question string"))
    asked = asked.withColumn("query_vec", none)
    rows = {r["query_id"]: r for r in search.answer_batch(records, asked).collect()}
    assert {i: (r["mode"], r["answer"], r["job"]) for i, r in rows.items()} == {i: ("out_of_domain", fv.OUT_OF_DOMAIN, None) for i in (1, 2)}


def test_postings_need_no_shuffle_by_document(spark):
    docs = _docs(spark, [(1, "a b a"), (2, None), (3, ""), (4, "C c\tb")])
    terms = lexical_index.doc_terms(docs, "d", "t")
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in terms.collect()} == {(1, "a", 2, 3), (1, "b", 1, 3), (4, "c", 2, 3), (4, "b", 1, 3)}


def test_rows_that_share_an_id_are_one_document(spark, monkeypatch):
    monkeypatch.setattr(lexical_index, "CHUNK_TOKENS", 2)
    docs = _docs(spark, [(1, "a b a"), (1, "a c"), (None, "x"), (None, "x y"), (5, "a"), (6, None), (6, "z")])
    rows = [tuple(r) for r in lexical_index.doc_terms(docs, "d", "t").collect()]
    assert sorted(rows, key=repr) == sorted([(1, "a", 3, 3), (1, "b", 1, 3), (1, "c", 1, 2), (None, "x", 2, 2), (None, "y", 1, 2),
                                             (5, "a", 1, 1), (6, "z", 1, 1)], key=repr)
    lexicon = {r["token"]: r["df"] for r in lexical.build_index(docs, "d", "t")["lexicon"].collect()}
    assert lexicon == {"a": 2, "b": 1, "c": 1, "x": 1, "y": 1, "z": 1}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_a_document_is_one_row_of_a_folder(spark, tmp_path, monkeypatch, few):
    """Written without a shuffle, and so also replaced and folded; read as a row a posting, the folder as the probe names it."""
    monkeypatch.setattr(V, "FEW_ROWS", few)
    monkeypatch.setattr(V, "FOLD_LEAST", 2)
    monkeypatch.setattr(V, "FOLD_SHARE", 0.1)
    texts = [(1, "a b a"), (1, "a c"), (None, "x"), (None, "x y"), (5, "a Straße　z"), (6, None), (6, "z"), (7, " \t"), (8, "گل a-b"), (9, None)]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    terms = lambda docs: rows(lexical_index.doc_terms(docs, "d", "t").select("doc_id", "token", "tf", "len"))
    docs = _docs(spark, texts)
    index = LexicalIndex(spark, str(tmp_path / "i"), 4)
    index.rebuild(docs, "d", "t")
    held = index.postings.read()
    assert rows(held.select("doc_id", "token", "tf", "len")) == terms(docs)
    assert held.filter(F.col("part") != lexical_index.token_part("token", 4)).isEmpty()
    packed = index.postings.rows()
    assert packed.count() == packed.select("doc_id", "len", "part").distinct().count() < held.count()
    lengths = [(i, None if t is None else len(t.split())) for i, t in texts]
    assert rows(index.lengths.read()) == sorted(lengths, key=repr)
    later = [(5, "new words"), (8, ""), (10, "a a")]
    index.change(_docs(spark, later), "d", "t", spark.createDataFrame([(6,)], "doc_id long"))
    assert index.postings.in_force() == (3, [])  # folded at once
    now = _docs(spark, [r for r in texts if r[0] not in (5, 6, 8)] + later)
    assert rows(index.postings.read().select("doc_id", "token", "tf", "len")) == terms(now)
    alone = lexical_index.packed_terms(_docs(spark, later), "d", "t", 4)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_lengths_count_the_tokens_of_odd_texts(spark, tmp_path):
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = ["", " ", "a", " a", "a ", "\u200bx", "é\u3000گل", None, "a\x00b c", *(f"a{b}b{b}{b}ç{b}" for b in blanks), *(b for b in blanks), "z" * 5000 + " z"]
    docs = _docs(spark, list(enumerate(texts))).repartition(2)
    index = LexicalIndex(spark, str(tmp_path / "i"), 4)
    index.rebuild(docs, "d", "t")
    want = docs.select("d", F.size(lexical_index.lexical_tokens(F.col("t"))))
    assert _rows(index.lengths.read().select("doc_id", F.coalesce("len", F.lit(-1)))) == _rows(want.na.fill(-1))
