"""Lexical, dense and fused retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import normalize
from ..operators import fusion, lexical
from ..operators.dense import dense_topk, unit
from ..operators.lexical_index import LexicalIndex
from ..plans import search
from ..plans.reports import evaluate_rankings
from ..session import fresh_path, stored
from .common import (SQL_RANKED, SQL_SEARCH, record_index, search_questions, search_records, sql_bm25, sql_normalize, sql_tokens, sql_top,
                     table, text_index)
from .text_queries import LATIN_INTENTS, LATIN_PATTERNS, LATIN_REQUESTS, _sql_any, _SQL_INTENT

GATES = {
    "question": {"dense_gate": 0.58, "sparse_gate": 0.3, "second_min": 0.4, "margin": 0.2},
    "request": {"match": 0.59, "floor": 0.2},
    "secondary": {"near": 0.2},
    "title": {"margin": 0.45},
    "phrases": ("both", "hein "),
}
DEEP = 10


def bm25_topk(spark, sf_dir):
    """From the stored postings of all documents."""
    index = text_index(spark, sf_dir, "documents", lambda: table(spark, sf_dir, "documents"), "doc_id", "text")
    found = lexical.indexed_topk(index, table(spark, sf_dir, "benchmark"), "item_id", "text", DEEP)
    return found.select("query_id", "doc_id", "rank", F.round("sparse", 6).alias("score"))


def bm25_scan(spark, sf_dir):
    """The same without an index, by a scan of the texts."""
    found = lexical.bm25_topk(table(spark, sf_dir, "documents"), "doc_id", "text",
                              table(spark, sf_dir, "benchmark"), "item_id", "text", DEEP)
    return found.select("query_id", "doc_id", "rank", F.round("sparse", 6).alias("score"))


def index_after_changes(spark, sf_dir):
    """Length, distinct tokens and token number of each document in an index that reached the table by three changes.

    It starts with other texts, then a third of the documents is replaced at a time, and the
    labelled ones are taken out at last.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LexicalIndex(spark, fresh_path(spark, "index"), 4)
    index.rebuild(docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1 << 40).otherwise(0)).alias("doc_id"),
                              F.concat(F.lit("old words "), F.reverse("text")).alias("text")), "doc_id", "text")
    for third in range(3):
        gone = docs.filter((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 3 == third)).select((F.col("doc_id") + (1 << 40)).alias("doc_id"))
        index.change(docs.filter(F.col("doc_id") % 3 == third), "doc_id", "text", gone)
    none = docs.limit(0)
    index.change(none, "doc_id", "text", table(spark, sf_dir, "labels").select("doc_id").distinct())
    per_doc = index.postings.read().groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum("tf").alias("found"))
    return index.lengths.read().join(per_doc, "doc_id", "left").select(
        "doc_id", "len", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("found", F.lit(0)).alias("found"))


def bm25_stats(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index["stats"].select("n", F.round("avg_len", 6).alias("avg_len"), F.round("oov_idf", 6).alias("oov_idf"))


def bm25_lexicon(spark, sf_dir):
    index = lexical.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index["lexicon"].select("token", "df", F.round("idf", 6).alias("idf"))


def _centroids(spark, sf_dir):
    """One query vector per label: the unit mean of its vectors."""
    spread = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("slot", "x"))
    means = spread.groupBy("label", "slot").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("slot", "x"))), lambda r: r["x"]).alias("v"))
    return vectors.select(F.col("label").alias("query_id"), unit(F.col("v")).alias("query_vec"))


def dense_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = dense_topk(vectors, "vec_id", F.col("embedding"), _centroids(spark, sf_dir), "query_id", "query_vec", DEEP)
    return found.select("query_id", "doc_id", "rank", F.round("dense", 6).alias("score"))


def _asked(spark, sf_dir):
    return stored(search_questions(spark, sf_dir).withColumn("q", normalize(F.col("question"))), "questions")


def hybrid_topk(spark, sf_dir):
    from ..operators.dense import hybrid_vector
    found = dense_topk(search_records(spark, sf_dir), "record_id", hybrid_vector(),
                       search_questions(spark, sf_dir), "query_id", "query_vec")
    return found.select("query_id", "doc_id", "rank", F.round("dense", 6).alias("score"))


def rrf_fuse(spark, sf_dir):
    ranked = search.rank_candidates(search_records(spark, sf_dir), _asked(spark, sf_dir), index=record_index(spark, sf_dir))
    return ranked.select("query_id", "doc_id", "rank", "rank_d", "rank_s", F.round("rrf", 9).alias("rrf"))


def _candidates(spark, sf_dir):
    records, asked = search_records(spark, sf_dir), _asked(spark, sf_dir).withColumn("is_request", F.lit(False))
    return search.scored_candidates(records, asked, search.rank_candidates(records, asked, index=record_index(spark, sf_dir)))


def title_tiebreak(spark, sf_dir):
    promoted = fusion.prefer_title(_candidates(spark, sf_dir), "q", "job_title", **GATES["title"])
    return promoted.select("query_id", "doc_id", "rank", F.round("dense", 6).alias("dense"))


def secondary_candidate(spark, sf_dir):
    found = fusion.secondary(_candidates(spark, sf_dir), "full_vec", **GATES["secondary"])
    return found.select("query_id", "doc_id2", F.round("dense2", 6).alias("dense2"))


def related_titles(spark, sf_dir):
    found = fusion.related_titles(_candidates(spark, sf_dir), "job_title")
    return found.select("query_id", F.array_join("related", " / ").alias("related"))


def _classified(spark, sf_dir):
    rows = search.classify_questions(search_questions(spark, sf_dir), LATIN_INTENTS, LATIN_REQUESTS, LATIN_PATTERNS)
    return stored(rows, "questions")


def _replies(spark, sf_dir):
    """Generated replies by question, shaped from its part."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    body = (F.when(size < 15, F.lit('{"not_a_job": true}'))
            .when(size < 40, F.concat(F.lit('Sure: {"job_title": "new '), F.col("p_name"),
                                      F.lit('", "description": "made | of "} done'))))
    return part.select(F.col("p_partkey").alias("query_id"), body.alias("reply")).filter(F.col("reply").isNotNull())


def _decided(spark, sf_dir):
    return search.decide(search_records(spark, sf_dir), _classified(spark, sf_dir), _replies(spark, sf_dir), gates=GATES,
                         index=record_index(spark, sf_dir))


def mode_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select(
        "query_id", "is_request", "intent", "mode", "reason", "doc_id1", "doc_id2", F.round("dense1", 6).alias("dense1"),
        F.round("sparse1", 6).alias("sparse1"), F.round("dense2", 6).alias("dense2"),
        F.col("draft")["job_title"].alias("draft_title"), F.array_join("related", " / ").alias("related"))


def _answers(spark, sf_dir):
    return search.answer_batch(search_records(spark, sf_dir), _classified(spark, sf_dir),
                               _replies(spark, sf_dir), gates=GATES, index=record_index(spark, sf_dir))


def answer_batch(spark, sf_dir):
    heads = F.transform("details", lambda d: F.concat_ws(
        ":", d["job_title"], F.array_join(F.transform(
            d["fields"], lambda f: F.concat(f["key"], F.when(f["primary"], "*").otherwise(""))), ",")))
    return _answers(spark, sf_dir).select(
        "query_id", "mode", "intent", "job", F.array_join("jobs", " / ").alias("jobs"), F.round("score", 6).alias("score"),
        F.array_join(F.transform("scores", lambda s: F.format_string("%.4f", s)), " ").alias("scores"),
        F.array_join("related_jobs", " / ").alias("related_jobs"), F.array_join(heads, " ; ").alias("details"), "answer")


def ranking_eval(spark, sf_dir):
    """Each question expects its own part's title, none where that part is large."""
    part = table(spark, sf_dir, "part")
    expected = part.select(F.col("p_partkey").alias("query_id"), F.when(
        F.col("p_size") <= 40, F.concat_ws(" ", "p_name", "p_type")).alias("expected"))
    asked = search_questions(spark, sf_dir).select("query_id").join(expected, "query_id")
    found = _answers(spark, sf_dir).select("query_id", "mode", "job")
    return evaluate_rankings(found, asked).select(
        "questions", "answerable", F.round("hit_rate", 6).alias("hit_rate"), F.round("refusal_rate", 6).alias("refusal_rate"))


QUERIES = {
    "bm25_topk": bm25_topk, "bm25_scan": bm25_scan, "index_after_changes": index_after_changes, "bm25_stats": bm25_stats, "bm25_lexicon": bm25_lexicon, "dense_topk": dense_nearest,
    "hybrid_topk": hybrid_topk, "rrf_fuse": rrf_fuse, "title_tiebreak": title_tiebreak,
    "secondary_candidate": secondary_candidate, "related_titles": related_titles, "mode_decision": mode_decision,
    "answer_batch": answer_batch, "ranking_eval": ranking_eval,
}

# ------------------------------------------------------------------------------- SQL
_STOP = ", ".join(f"'{w}'" for w in fv.QUESTION_WORDS)
_TITLE_WORDS = lambda x: (
    f"list_distinct(list_filter(regexp_split_to_array({x}, '[{fv.WHITESPACE}{fv.TITLE_SEPARATORS}]+'), "
    f"lambda t: length(t) >= {fv.TOKEN_MIN} AND t NOT IN ({_STOP})))")
_g = GATES
def _promote(exempt: str = "", join: str = "") -> str:
    return f"""
lead AS (SELECT query_id, dense AS lead FROM cand WHERE rank = 1),
close AS (SELECT query_id, doc_id, rank, {_TITLE_WORDS('q')} AS qw, {_TITLE_WORDS('job_title')} AS tw
  FROM cand JOIN lead USING (query_id) WHERE rank <= {fv.TITLE_DEPTH} AND lead - dense <= {_g['title']['margin']}),
hits AS (SELECT DISTINCT query_id, doc_id, rank, qt FROM (SELECT query_id, doc_id, rank, qt, unnest(tw) AS tt
    FROM (SELECT *, unnest(qw) AS qt FROM close)) WHERE starts_with(tt, qt) OR starts_with(qt, tt)),
overlap AS (SELECT c.query_id, c.doc_id, c.rank, count(h.qt) AS n FROM close c LEFT JOIN hits h USING (query_id, doc_id)
  GROUP BY ALL),
best AS (SELECT query_id, arg_max(doc_id, n * 100 - rank) AS doc_id, max(n) AS n, max(CASE WHEN rank = 1 THEN n END) AS own
  FROM overlap GROUP BY query_id),
ordered AS (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY
    CASE WHEN {exempt} b.doc_id = c.doc_id AND b.n > b.own THEN 0 ELSE 1 END, c.rank) AS new_rank
  FROM cand c LEFT JOIN best b USING (query_id) {join})"""


def _secondary(source: str, rank: str) -> str:
    return f"""
first_vec AS (SELECT query_id, full_vec AS v1 FROM {source} WHERE {rank} = 1),
second AS (SELECT query_id, arg_min(doc_id, {rank}) AS doc_id2, arg_min(dense, {rank}) AS dense2
  FROM {source} JOIN first_vec USING (query_id) WHERE {rank} BETWEEN 2 AND {fv.SECONDARY_DEPTH + 1}
    AND list_dot_product(full_vec, v1) < {_g['secondary']['near']} GROUP BY query_id)"""


_SQL_DECIDE = SQL_RANKED + f""",
flags AS (SELECT query_id, q, {_sql_any('q', LATIN_REQUESTS)} OR regexp_matches(q, 'an?d .{{0,40}}the')
  OR regexp_matches(q, 'une? .{{0,120}}eau') AS is_request, {_SQL_INTENT} AS first_intent,
  list_distinct(list_filter(string_split(q, ' '), lambda t: t <> '')) AS words FROM asked),
intents AS (SELECT query_id, q, is_request, CASE WHEN is_request THEN 'job_request'
  WHEN first_intent = 'general' AND len(words) <= 4 AND NOT {_sql_any('q', fv.QUESTION_MARKS)} THEN 'description'
  ELSE first_intent END AS intent FROM flags),""" + _promote(
    "NOT f.is_request AND", "JOIN flags f USING (query_id)") + "," + _secondary("ordered", "new_rank") + f""",
rel AS (SELECT query_id, array_agg(job_title ORDER BY new_rank) AS related FROM ordered
  WHERE new_rank <= {fv.REQUEST_RELATED} GROUP BY query_id),
led AS (SELECT i.*, o.doc_id AS doc_id1, o.dense AS dense1, coalesce(s.sparse, 0) AS sparse1, x.doc_id2, x.dense2, related,
    {_sql_any('i.q', _g['phrases'])} AS explicit, p_size, p_name
  FROM intents i JOIN ordered o ON o.query_id = i.query_id AND new_rank = 1
  LEFT JOIN sparse_all s ON s.query_id = i.query_id AND s.doc_id = o.doc_id
  LEFT JOIN second x ON x.query_id = i.query_id LEFT JOIN rel ON rel.query_id = i.query_id JOIN part ON p_partkey = i.query_id),
why AS (SELECT *, CASE WHEN NOT is_request THEN NULL
    WHEN dense1 < {_g['request']['floor']} AND sparse1 < {fv.SPARSE_GATE} THEN 'off_topic'
    WHEN dense1 >= {_g['request']['match']} THEN 'match' WHEN p_size < 15 THEN 'not_a_job'
    WHEN p_size < 40 THEN 'generated' ELSE 'unavailable' END AS reason FROM led),
moded AS (SELECT *, CASE WHEN reason = 'match' THEN 'job_match' WHEN reason = 'generated' THEN 'job_generated'
    WHEN is_request THEN 'out_of_domain'
    WHEN dense1 < {_g['question']['dense_gate']} AND sparse1 < {_g['question']['sparse_gate']} THEN 'out_of_domain'
    WHEN (dense2 >= {_g['question']['second_min']} AND dense1 - dense2 <= {_g['question']['margin']})
      OR (explicit AND dense2 >= {_g['question']['dense_gate']} - {fv.COMBINATION_SLACK}) THEN 'interdisciplinary'
    ELSE 'single' END AS mode FROM why)"""


def _answer_lines(rec: str, fields) -> str:
    return "concat_ws(chr(10), " + ", ".join(
        f"CASE WHEN {rec}.{f} <> '' THEN '{fv.LABELS[f]}: ' || {rec}.{f} END" for f in fields) + ")"


def _by_intent(rec: str, build) -> str:
    return "CASE m.intent " + " ".join(
        f"WHEN '{i}' THEN {build(rec, f)}" for i, f in fv.INTENT_FIELDS.items()) + " END"


def _detail_keys(rec: str, primary) -> str:
    from .common import sql_items, sql_strip
    def usable(k):
        test = f"{rec}.{k} NOT IN ('', '-', '–', '—', '_')"
        return test if k in fv.PROSE_COLUMNS else f"{test} AND len({sql_items(f'{rec}.{k}')}) > 0"
    order = [k for k in fv.DETAIL_FIELDS if k in primary] + [k for k in fv.DETAIL_FIELDS if k not in primary]
    return f"{rec}.job_title || ':' || concat_ws(',', " + ", ".join(
        f"CASE WHEN {usable(k)} THEN '{k}{'*' if k in primary else ''}' END" for k in order) + ")"


_ONE = lambda rec: f"'📌 ' || {rec}.job_title || chr(10) || chr(10) || {_by_intent(rec, _answer_lines)}"
_SECTION = lambda rec: f"'— ' || {rec}.job_title || ':' || chr(10) || {_by_intent(rec, _answer_lines)}"
_BULLETS = "list_aggregate(list_transform(related, lambda t: '- ' || t), 'string_agg', chr(10))"

_SQL_ANSWERS = f"""
WITH {_SQL_DECIDE},
final AS (SELECT m.query_id, mode, m.intent,
  CASE WHEN mode IN ('single', 'job_match') THEN r1.job_title WHEN mode = 'job_generated' THEN 'new ' || p_name END AS job,
  CASE WHEN mode = 'interdisciplinary' THEN r1.job_title || ' / ' || r2.job_title END AS jobs,
  CASE WHEN mode <> 'interdisciplinary' THEN round(dense1, 6) END AS score,
  CASE WHEN mode = 'interdisciplinary' THEN printf('%.4f', dense1) || ' ' || printf('%.4f', dense2) END AS scores,
  CASE WHEN is_request AND reason <> 'off_topic' THEN array_to_string(related, ' / ') END AS related_jobs,
  CASE mode WHEN 'single' THEN {_by_intent('r1', _detail_keys)}
    WHEN 'interdisciplinary' THEN {_by_intent('r1', _detail_keys)} || ' ; ' || {_by_intent('r2', _detail_keys)}
    WHEN 'job_match' THEN {_detail_keys('r1', fv.REQUEST_PRIMARY)}
    WHEN 'job_generated' THEN 'new ' || p_name || ':description*' END AS details,
  CASE WHEN mode = 'single' THEN {_ONE('r1')}
    WHEN mode = 'interdisciplinary' THEN '🔗 {fv.COMBINED_ROLE}: ' || r1.job_title || ' + ' || r2.job_title || chr(10) || chr(10)
      || {_SECTION('r1')} || chr(10) || chr(10) || {_SECTION('r2')}
    WHEN mode = 'job_match' THEN '{fv.MATCH_HEADER}' || chr(10) || chr(10) || '📌 ' || r1.job_title || chr(10) || chr(10)
      || {_answer_lines('r1', fv.SHOWCASE_FIELDS)}
    WHEN mode = 'job_generated' THEN concat_ws(chr(10), '{fv.DRAFT_HEADER}', '', '📌 {fv.LABELS['job_title']}: new ' || p_name,
      '{fv.LABELS['description']}: made، of', '', '{fv.RELATED_LABEL}: ' || array_to_string(related, '، '), '', '{fv.DRAFT_QUESTION}')
    WHEN reason = 'not_a_job' THEN '{fv.DRAFT_NOT_REAL}' || chr(10) || {_BULLETS}
    WHEN reason = 'unavailable' THEN '{fv.DRAFT_UNAVAILABLE}' || chr(10) || {_BULLETS}
    ELSE '{fv.OUT_OF_DOMAIN}' END AS answer
  FROM moded m JOIN corpus r1 ON r1.record_id = doc_id1 LEFT JOIN corpus r2 ON r2.record_id = doc_id2)"""

_SQL_TOPK = (f"WITH {sql_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')} "
             f"SELECT query_id, doc_id, rank, round(sparse, 6) AS score FROM {sql_top('sparse_all', 'sparse', DEEP)}")

ORACLE = {
    "bm25_topk": _SQL_TOPK,
    "bm25_scan": _SQL_TOPK,
    "index_after_changes": f"""
SELECT doc_id, len(t) AS len, len(list_distinct(t)) AS tokens, len(t) AS found
FROM (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))""",
    "bm25_stats": f"WITH {sql_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')} "
                  "SELECT n, round(avg_len, 6) AS avg_len, round(ln((n + 0.5) / 0.5 + 1.0), 6) AS oov_idf FROM doc_stats",
    "bm25_lexicon": f"WITH {sql_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')} "
                    "SELECT token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM lex, doc_stats",
    "dense_topk": f"""
WITH spread AS (SELECT label, generate_subscripts(embedding, 1) AS slot, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, slot, avg(x) AS x FROM spread GROUP BY label, slot),
cents AS (SELECT label::BIGINT AS query_id, array_agg(x ORDER BY slot) AS v, sqrt(sum(x * x)) AS norm FROM means GROUP BY label),
scored AS (SELECT query_id, vec_id AS doc_id, list_dot_product(embedding::DOUBLE[], v) / norm AS dense FROM cents, embeddings)
SELECT query_id, doc_id, rank, round(dense, 6) AS score FROM {sql_top('scored', 'dense', DEEP)}""",
    "hybrid_topk": f"WITH {SQL_SEARCH} SELECT query_id, doc_id, rank, round(dense, 6) AS score "
                   f"FROM {sql_top('dense_all', 'dense')}",
    "rrf_fuse": f"WITH {SQL_RANKED} SELECT query_id, doc_id, rank, rank_d, rank_s, round(rrf, 9) AS rrf FROM ranked",
    "title_tiebreak": f"WITH {SQL_RANKED},{_promote()} "
                      "SELECT query_id, doc_id, new_rank AS rank, round(dense, 6) AS dense FROM ordered",
    "secondary_candidate": f"WITH {SQL_RANKED},{_secondary('cand', 'rank')} "
                           "SELECT query_id, doc_id2, round(dense2, 6) AS dense2 FROM second",
    "related_titles": f"WITH {SQL_RANKED} SELECT query_id, string_agg(job_title, ' / ' ORDER BY rank) AS related "
                      f"FROM cand WHERE rank <= {fv.REQUEST_RELATED} GROUP BY query_id",
    "mode_decision": f"""
WITH {_SQL_DECIDE}
SELECT query_id, is_request, intent, mode, reason, doc_id1, CASE WHEN mode = 'interdisciplinary' THEN doc_id2 END AS doc_id2,
  round(dense1, 6) AS dense1, round(sparse1, 6) AS sparse1,
  CASE WHEN mode = 'interdisciplinary' THEN round(dense2, 6) END AS dense2,
  CASE WHEN mode = 'job_generated' THEN 'new ' || p_name END AS draft_title, array_to_string(related, ' / ') AS related FROM moded""",
    "answer_batch": _SQL_ANSWERS + " SELECT * FROM final",
    "ranking_eval": _SQL_ANSWERS + """,
exp AS (SELECT query_id, mode, job, CASE WHEN p_size <= 40 THEN p_name || ' ' || p_type END AS expected
  FROM final JOIN part ON p_partkey = query_id)
SELECT count(*) AS questions, count(expected) AS answerable,
  round(avg(CASE WHEN expected IS NOT NULL THEN CASE WHEN job = expected THEN 1.0 ELSE 0 END END), 6) AS hit_rate,
  round(avg(CASE WHEN expected IS NULL THEN CASE WHEN mode = 'out_of_domain' THEN 1.0 ELSE 0 END END), 6) AS refusal_rate FROM exp""",
}
