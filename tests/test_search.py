"""Lexical, dense and fused retrieval against brute force."""

import math
import random
import weakref
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.operators import dense, fusion, lexical
from recordloom.operators.embedding import encoder_udf, hashing_encoder
from recordloom.plans import search
from recordloom.plans.reports import evaluate_rankings
from recordloom.session import stored


def _brute_bm25(docs, question):
    tokens = {i: t.lower().split() for i, t in docs}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    asked = set(question.lower().split())
    df = {t: sum(t in d for d in tokens.values()) for t in asked}
    idf = {t: math.log((n - df[t] + .5) / (df[t] + .5) + 1) for t in asked}
    best = sum(idf.values()) * 2.5
    out = {}
    for i, d in tokens.items():
        tf = Counter(d)
        s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * len(d) / avg)) for t in asked if tf[t])
        if s:
            out[i] = s / best
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)] + [(80, "   "), (81, "W1 w1 W1")]
    asks = [(i, " ".join(rng.choices(words + ["unknown"], k=6))) for i in range(9)] + [(9, "unknown"), (10, "")]
    return docs, asks


def test_bm25_scores(spark, corpus):
    docs, asks = corpus
    got = lexical.score_pairs(spark.createDataFrame(docs, "d long, t string"), "d", "t",
                              spark.createDataFrame(asks, "q long, t string"), "q", "t").collect()
    want = {(q, d): s for q, text in asks for d, s in (_brute_bm25(docs, text).items() if text.strip() else ())}
    assert {(r["query_id"], r["doc_id"]) for r in got} == set(want)
    for r in got:
        assert r["sparse"] == pytest.approx(want[r["query_id"], r["doc_id"]], rel=1e-12)


def test_bm25_topk_and_named_pairs(spark, corpus):
    docs, asks = corpus
    d, q = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(asks, "q long, t string")
    also = spark.createDataFrame([(0, i) for i in range(82)], "query_id long, doc_id long")
    rows = lexical.bm25_topk(d, "d", "t", q, "q", "t", 5, also=also).collect()
    want = _brute_bm25(docs, asks[0][1])
    order = sorted(want, key=lambda i: (-round(want[i], 9), i))
    assert {r["doc_id"]: r["rank"] for r in rows if r["query_id"] == 0 and r["rank"]} == {i: n + 1 for n, i in enumerate(order[:5])}
    assert {r["doc_id"] for r in rows if r["query_id"] == 0} == set(want)
    assert len({(r["query_id"], r["doc_id"]) for r in rows}) == len(rows)


def test_bm25_without_broadcast(spark, corpus, monkeypatch):
    docs, asks = corpus
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", -1)
    test_bm25_scores(spark, corpus)


def test_index_tables(spark, corpus):
    docs, _ = corpus
    index = lexical.build_index(spark.createDataFrame(docs, "d long, t string"), "d", "t")
    stats = index["stats"].first()
    lengths = [len(t.split()) for _, t in docs]
    assert stats["n"] == len(docs) and stats["avg_len"] == pytest.approx(sum(lengths) / len(docs))
    assert stats["oov_idf"] == pytest.approx(math.log((len(docs) + .5) / .5 + 1))
    tf = {(r["doc_id"], r["token"]): r["tf"] for r in index["postings"].collect()}
    assert tf[81, "w1"] == 3 and (80, "") not in tf
    assert {r["doc_id"]: r["len"] for r in index["doc_len"].collect()} == {i: n for (i, _), n in zip(docs, lengths)}


def _vectors(n, dim, seed):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_dense_topk(spark, block_rows):
    full, title, asks = _vectors(300, 8, 1), _vectors(300, 8, 2), _vectors(7, 8, 3)
    full[10] = full[200]  # a tie that the smaller id wins
    title[10] = title[200]
    records = spark.createDataFrame([(i, full[i].tolist(), title[i].tolist()) for i in range(300)],
                                    "id long, full_vec array<float>, title_vec array<float>").repartition(5)
    questions = spark.createDataFrame([(i * 3, asks[i].tolist()) for i in range(7)], "q long, v array<float>")
    rows = dense.dense_topk(records, "id", dense.hybrid_vector(), questions, "q", "v", 6, block_rows=block_rows).collect()
    scores = (0.6 * full.astype(float) + 0.4 * title.astype(float)) @ asks.astype(float).T
    for i in range(7):
        order = sorted(range(300), key=lambda d: (-round(scores[d, i], 9), d))[:6]
        assert {r["rank"]: r["doc_id"] for r in rows if r["query_id"] == i * 3} == {n + 1: d for n, d in enumerate(order)}


def test_dense_blocks_are_run_one_at_a_time(spark, monkeypatch):
    records = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_vectors(20, 4, 1))], "id long, v array<float>")
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_vectors(9, 4, 2))], "q long, v array<float>")
    live, most = [], []
    blocks = dense._blocks

    def watched(*args):
        for ids, matrix in blocks(*args):
            live.append(weakref.ref(matrix))
            most.append(sum(r() is not None for r in live))
            yield ids, matrix
            del ids, matrix
    monkeypatch.setattr(dense, "_blocks", watched)
    found = dense.dense_topk(records, "id", F.col("v"), questions, "q", "v", 2, block_rows=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(live) == 9 and max(most) <= 4 and "Union" not in plan and "MapInArrow" not in plan
    assert found.count() == 18


def test_dense_topk_of_few_records(spark):
    records = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    rows = dense.dense_topk(records, "id", F.col("v"), records, "id", "v", 15).collect()
    assert len(rows) == 4


def test_rrf_order_and_ties(spark):
    top = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long, rank int")
    d, s = [(1, 10, 1), (1, 11, 2), (1, 12, 3)], [(1, 11, 1), (1, 10, 2), (1, 13, 3)]
    rows = fusion.rrf_fuse(top(d), top(s)).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [10, 11, 12, 13]
    assert rows[0]["rrf"] == pytest.approx(1 / 61 + 1 / 62)


def _cands(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int, dense double, q string, job_title string")


def _order(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_title_promotion(spark):
    q = "وظایف افسر توپخانه چیست؟"
    rows = [(1, 1, 1, .667, q, "خدمه توپخانه و موشک"), (1, 2, 2, .650, q, "افسران توپخانه و موشک"), (1, 3, 3, .64, q, "دیگر")]
    assert _order(fusion.prefer_title(_cands(spark, rows), "q", "job_title")) == [2, 1, 3]
    far = [(a, b, c, d - (0.1 if b == 2 else 0), e, f) for a, b, c, d, e, f in rows]
    assert _order(fusion.prefer_title(_cands(spark, far), "q", "job_title")) == [1, 2, 3]
    late = [(1, 9, 1, .6, "alpha beta", "x"), *[(1, i, i, .6, "alpha beta", "x") for i in (2, 3, 4)], (1, 5, 5, .6, "alpha beta", "alpha beta")]
    assert _order(fusion.prefer_title(_cands(spark, late), "q", "job_title")) == [9, 2, 3, 4, 5]
    denser = [(1, 1, 1, .5, "alpha beta", "alpha"), (1, 2, 2, .9, "alpha beta", "betas alphas"), (1, 3, 3, .5, "alpha beta", "alpha beta")]
    assert _order(fusion.prefer_title(_cands(spark, denser), "q", "job_title")) == [2, 1, 3]
    none = [(1, 1, 1, .5, "of", "alpha"), (1, 2, 2, .5, "of", "alpha")]
    assert _order(fusion.prefer_title(_cands(spark, none), "q", "job_title")) == [1, 2]


def test_secondary_skips_near_copies(spark):
    rows = [(1, 1, 1, .9, [1.0, 0.0]), (1, 2, 2, .8, [0.99, 0.14]), (1, 3, 3, .7, [0.0, 1.0]), (2, 1, 1, .9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, dense double, v array<float>")
    assert [tuple(r) for r in fusion.secondary(df, "v").collect()] == [(1, 3, .7)]


@pytest.mark.parametrize("d1, s1, d2, explicit, mode", [
    (.48, .14, None, False, "out_of_domain"), (.48, .15, None, False, "single"), (.49, .0, None, False, "single"),
    (.60, .5, .595, False, "interdisciplinary"), (.60, .5, .58, False, "single"), (.495, .5, .495, False, "single"),
    (.60, .5, .45, True, "interdisciplinary"), (.60, .5, .43, True, "single")])
def test_question_mode(one, d1, s1, d2, explicit, mode):
    lit = lambda v: F.lit(v).cast("double")
    assert one(fusion.question_mode(lit(d1), lit(s1), lit(d2), F.lit(explicit))) == mode


@pytest.mark.parametrize("d1, s1, status, mode, reason", [
    (.34, .1, "generated", "out_of_domain", "off_topic"), (.34, .2, "generated", "job_generated", "generated"),
    (.60, .0, "generated", "job_match", "match"), (.5, .0, "not_a_job", "out_of_domain", "not_a_job"), (.5, .0, None, "out_of_domain", "unavailable")])
def test_request_mode(one, d1, s1, status, mode, reason):
    got = one(fusion.request_mode(F.lit(d1), F.lit(s1), F.lit(status).cast("string")))
    assert (got["mode"], got["reason"]) == (mode, reason)


def test_answers_end_to_end(spark):
    """The encoder in the loop: texts, vectors, both channels, fusion and answers."""
    cells = [
        {"job_title": "gardener", "skills": "pruning | planting", "description": "grows flowers and trees in parks"},
        {"job_title": "plumber", "skills": "welding | piping", "tools": "wrench", "description": "repairs water pipes in houses"},
        {"job_title": "florist", "skills": "arranging | selling", "description": "sells flowers in a shop"}]
    table = spark.createDataFrame([{"record_id": i, **{c: r.get(c, "") for c in fv.RECORD_COLUMNS}} for i, r in enumerate(cells)])
    encode = encoder_udf(hashing_encoder(128))
    records = search.with_combined_text(table.withColumn("record_id", F.col("record_id").cast("long")))
    records = stored(records.withColumns({"full_vec": encode("combined_text"), "title_vec": encode("job_title")}), "records")
    asks = [(1, "plumber repairs water pipes in houses"), (2, "zzzz qqqq yyyy xxxx vvvv"), (3, "شغلی می‌خواهم flowers in a shop")]
    questions = search.classify_questions(spark.createDataFrame(asks, "query_id long, question string"))
    questions = stored(questions.withColumn("query_vec", encode("q")), "questions")
    replies = spark.createDataFrame([(3, 'here: {"job_title": "bouquet | binder", "description": "binds"}')], "query_id long, reply string")
    gates = {"question": {"dense_gate": .2}, "request": {"floor": .05, "match": .9}}
    rows = {r["query_id"]: r for r in search.answer_batch(records, questions, replies, gates=gates).collect()}
    assert (rows[1]["mode"], rows[1]["job"]) == ("single", "plumber")
    assert rows[1]["answer"].startswith("📌 plumber\n\n") and rows[1]["details"][0]["job_title"] == "plumber"
    assert (rows[2]["mode"], rows[2]["answer"], rows[2]["details"]) == ("out_of_domain", fv.OUT_OF_DOMAIN, None)
    assert (rows[3]["mode"], rows[3]["job"], rows[3]["intent"]) == ("job_generated", "bouquet، binder", "job_request")
    assert rows[3]["job_draft"]["description"] == "binds" and len(rows[3]["related_jobs"]) == 3
    expected = spark.createDataFrame([(1, "plumber"), (2, None), (3, "florist")], "query_id long, expected string")
    found = spark.createDataFrame([(r["query_id"], r["mode"], r["job"]) for r in rows.values()], "query_id long, mode string, job string")
    assert tuple(evaluate_rankings(found, expected).first()) == (3, 2, 0.5, 1.0)


def test_postings_travel_without_null_lists(spark, corpus, monkeypatch):
    """Arrow takes time by the rows since the last list for each NULL one."""
    docs, asked = corpus

    def seen(batches, k):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column("weights")
            yield pa.RecordBatch.from_pydict({"query_id": [lists.null_count], "doc_id": [batch.num_rows], "sparse": [0.0]})
    monkeypatch.setattr(lexical, "_scored", seen)
    d = spark.createDataFrame(docs, "d long, t string")
    q = spark.createDataFrame(asked, "q long, t string")
    wanted = lexical.question_tokens(q, "q", "t")
    terms, n_docs, avg_len, _ = lexical._text_terms(d, "d", "t", wanted)
    rows = lexical.best_documents(terms, lexical.token_weights(terms, wanted, n_docs), avg_len, 3, 1).collect()
    assert sum(r["doc_id"] for r in rows) > 0 and sum(r["query_id"] for r in rows) == 0


def test_a_scan_reads_the_texts_once(spark, corpus, tmp_path):
    docs, asked = corpus
    texts = str(tmp_path / "texts")
    spark.createDataFrame(docs, "d long, t string").write.parquet(texts)
    q = spark.createDataFrame(asked, "q long, t string")
    found = lexical.bm25_topk(spark.read.parquet(texts), "d", "t", q, "q", "t", 5)
    assert not any("texts" in path for path in found.inputFiles())
