"""Capability profiles against records, over whole tables.

Records are orders (their parts as list cells), profiles are part sizes (what parts of
that size are called).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import display
from ..operators import coverage, lists, validate
from ..operators.shuffle import broadcast_if_small
from ..plans import profiles as P
from ..session import stored
from .common import SQL_PART_RECORDS, kept, part_records, table, with_slot


def _order_records(spark, sf_dir):
    """One record per order: skills and knowledge from its parts, its vector by key modulo their number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    facts = lines.join(part, "l_partkey").withColumn("seq", F.col("l_partkey"))
    skills = lists.ordered_distinct_list(facts, "l_orderkey", "p_name", "skills", "seq")
    kinds = lists.ordered_distinct_list(facts, "l_orderkey", "p_type", "knowledge", "seq")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_slot"), F.col("embedding").alias("full_vec"))
    rows = with_slot(skills.join(kinds, "l_orderkey"), "l_orderkey", vectors).join(broadcast_if_small(vectors), "_slot", "left")
    blank = [F.lit("").alias(c) for c in fv.RECORD_COLUMNS if c not in ("job_title", "skills", "knowledge", "work_context")]
    return rows.select(
        F.col("l_orderkey").alias("record_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("job_title"),
        "skills", "knowledge", F.concat(F.lit("mixed: "), F.replace("skills", F.lit(" | "), F.lit(", "))).alias("work_context"),
        *blank, "full_vec")


def _size_profiles(spark, sf_dir):
    """Per part size: its part names as skills, types as knowledge, one phrase for the context."""
    part = table(spark, sf_dir, "part")
    def rows(field, column):
        return part.select(F.col("p_size").cast("long").alias("profile_id"), F.lit(field).alias("field"),
                           F.col("p_partkey").alias("pos"), column.alias("item"))
    return (rows("skills", F.col("p_name")).unionByName(rows("knowledge", F.col("p_type")))
            .unionByName(rows("work_context", F.concat_ws("/", F.col("p_type"), F.element_at(F.split("p_name", " "), -1))))
            .unionByName(rows("tools", F.col("p_brand"))).unionByName(rows("abilities", F.lit(" - "))))


def _profile_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("query_vec"))


def _inputs(spark, sf_dir):
    return kept(_order_records(spark, sf_dir), "orders"), stored(
        coverage.clean_profiles(_size_profiles(spark, sf_dir)), "profiles"), _profile_vectors(spark, sf_dir)


def profile_clean(spark, sf_dir):
    return coverage.clean_profiles(_size_profiles(spark, sf_dir)).select("profile_id", "field", "pos", "item")


def profile_text(spark, sf_dir):
    cleaned = coverage.clean_profiles(_size_profiles(spark, sf_dir))
    return P.profile_queries(cleaned).select("profile_id", "query_text")


def profile_rank(spark, sf_dir):
    records, profiles, vectors = _inputs(spark, sf_dir)
    return P.profile_rank(records, profiles, vectors).select(
        "profile_id", "doc_id", "rank", F.round("dense", 6).alias("dense"), F.round("coverage", 6).alias("coverage"),
        F.round("score", 6).alias("score"))


def profile_coverage(spark, sf_dir):
    """What each of the best records covers and misses, field by field."""
    records, profiles, vectors = _inputs(spark, sf_dir)
    index = coverage.ProfileIndex(profiles)
    best = stored(P.profile_rank(records, profiles, vectors, index), "best")
    listed = coverage.coverage_fields(best, records, "record_id", profiles, index)
    return listed.select("profile_id", "doc_id", F.explode("fields").alias("f")).select(
        "profile_id", "doc_id", F.col("f.key").alias("field"), F.col("f.label").alias("label"),
        F.array_join("f.matched", "; ").alias("matched"), F.array_join("f.missing", "; ").alias("missing"),
        F.round("f.ratio", 6).alias("ratio"))


def analyze_batch(spark, sf_dir):
    records, profiles, vectors = _inputs(spark, sf_dir)
    found = P.analyze_batch(records, profiles, vectors, dense_only=0.2, clean=False)
    boxes = F.transform("matches", lambda m: F.array_join(F.transform(
        m["detail"]["fields"], lambda f: F.concat(f["key"], F.when(f["primary"], "*").otherwise(""))), ","))
    return found.select("profile_id", "mode", "intent", "job", F.round("score", 6).alias("score"),
                        F.size("matches").alias("n_matches"), F.array_join(boxes, ";").alias("boxes"), "answer")


def profile_context(spark, sf_dir):
    """Each size's profile with what the first two orders of its number cover, as handed to a text generator."""
    records, profiles, _ = _inputs(spark, sf_dir)
    index = coverage.ProfileIndex(profiles)
    numbers = profiles.select("profile_id").distinct()
    pairs = numbers.select("profile_id", F.explode(F.array(F.col("profile_id"), F.col("profile_id") + 32)).alias("doc_id"))
    pairs = stored(pairs.join(records.select(F.col("record_id").alias("doc_id")), "doc_id", "left_semi"), "pairs")
    listed = coverage.coverage_fields(pairs, records, "record_id", profiles, index)
    titled = listed.join(records.select(F.col("record_id").alias("doc_id"), "job_title"), "doc_id")
    match = F.struct("doc_id", "job_title", "fields")
    matches = titled.groupBy("profile_id").agg(F.sort_array(F.collect_list(match)).alias("matches"))
    own = coverage.profile_fields(profiles)
    text = display.profile_context(F.col("fields"), F.col("matches"))
    return own.join(matches, "profile_id").select("profile_id", text.alias("context"))


def profile_validate(spark, sf_dir):
    """Profiles of customers: the parts they ordered, with faults where the data has them."""
    customer = table(spark, sf_dir, "customer")
    lines = (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
             .join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
             .join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"))
    skills = lines.select(F.col("o_custkey").alias("profile_id"), F.lit("skills").alias("field"),
                          F.col("l_orderkey").alias("pos"), F.when(F.col("l_linenumber") > 6, F.lit(" ")).otherwise(F.col("p_name")).alias("item"))
    other = customer.select(
        F.col("c_custkey").alias("profile_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "hobby").otherwise("knowledge").alias("field"), F.lit(1).cast("long").alias("pos"),
        F.when(F.col("c_acctbal") < 0, F.repeat("c_name", 7)).when(F.col("c_acctbal") < 3000, F.lit("")).otherwise(F.col("c_name")).alias("item"))
    return validate.validate_profiles(skills.unionByName(other), customer.select(F.col("c_custkey").alias("profile_id")))


def record_validate(spark, sf_dir):
    return validate.validate_records(part_records(spark, sf_dir), "record_id")


QUERIES = {f.__name__: f for f in (profile_clean, profile_text, profile_rank, profile_coverage, profile_context, analyze_batch,
                                   profile_validate, record_validate)}

# ------------------------------------------------------------------------------- SQL
_SPLIT = f"[{fv.WHITESPACE}{fv.ITEM_SEPARATORS}]+"
_WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{_SPLIT}'), lambda t: length(t) >= {fv.TOKEN_MIN}))"

_SQL_PROFILES = """
raw AS (SELECT p_size::BIGINT AS profile_id, 'skills' AS field, 1 AS field_no, p_partkey AS pos, p_name AS item FROM part
  UNION ALL SELECT p_size, 'knowledge', 2, p_partkey, p_type FROM part
  UNION ALL SELECT p_size, 'work_context', 5, p_partkey, p_type || '/' || list_extract(string_split(p_name, ' '), -1) FROM part),
profiles AS (SELECT profile_id, field, field_no, min(pos) AS pos, arg_min(item, pos) AS item FROM raw
  GROUP BY profile_id, field, field_no, lower(item))"""

_SQL_RECORDS = """
lines AS (SELECT l_orderkey AS id, l_partkey, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
recs AS (SELECT id, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS skills,
  string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS knowledge FROM lines GROUP BY id),
cells AS (SELECT id, 'skills' AS field, unnest(string_split(skills, ' | ')) AS cell FROM recs
  UNION ALL SELECT id, 'knowledge', unnest(string_split(knowledge, ' | ')) FROM recs
  UNION ALL SELECT id, 'work_context', 'mixed: ' || replace(skills, ' | ', ', ') FROM recs)"""

_SQL_COVER = f"""
ritems AS (SELECT DISTINCT field, cell, {_WORDS('cell')} AS w FROM cells),
uforms AS (SELECT DISTINCT field, item, {_WORDS('item')} AS w FROM profiles),
rword AS (SELECT DISTINCT field, unnest(w) AS rt FROM ritems),
uword AS (SELECT DISTINCT field, unnest(w) AS ut FROM uforms),
meet AS (SELECT field, ut, rt FROM uword JOIN rword USING (field) WHERE starts_with(ut, rt) OR starts_with(rt, ut)),
ru AS (SELECT field, cell, item, count(*) AS n, max(nr) AS nr FROM (
    SELECT DISTINCT r.field, r.cell, u.item, r.rt, nr FROM (SELECT field, cell, unnest(w) AS rt, len(w) AS nr FROM ritems) r
      JOIN meet m ON m.field = r.field AND m.rt = r.rt
      JOIN (SELECT field, item, unnest(w) AS ut FROM uforms) u ON u.field = m.field AND u.ut = m.ut) GROUP BY field, cell, item),
by_item AS (SELECT DISTINCT id, c.field, item FROM cells c JOIN ru ON ru.field = c.field AND ru.cell = c.cell AND n = nr),
met AS (SELECT DISTINCT c.id, c.field, ut FROM (SELECT DISTINCT id, field, cell FROM cells) c
  JOIN (SELECT field, cell, unnest(w) AS rt FROM ritems) r ON r.field = c.field AND r.cell = c.cell
  JOIN meet m ON m.field = r.field AND m.rt = r.rt),
by_field AS (SELECT id, met.field, item FROM met JOIN (SELECT field, item, unnest(w) AS ut, len(w) AS nu FROM uforms) u
  ON u.field = met.field AND u.ut = met.ut GROUP BY id, met.field, item, nu HAVING count(*) = nu),
hits AS (SELECT DISTINCT * FROM (SELECT * FROM by_item UNION ALL SELECT * FROM by_field))"""

_SQL_RANK = f"""
WITH {_SQL_PROFILES},{_SQL_RECORDS},{_SQL_COVER},
tot AS (SELECT profile_id, count(*) AS n_items FROM profiles GROUP BY profile_id),
cov AS (SELECT profile_id, id AS doc_id, count(*) AS n FROM hits JOIN profiles USING (field, item) GROUP BY profile_id, id),
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
held AS (SELECT id AS doc_id, v FROM recs LEFT JOIN vecs ON vec_id = id % (SELECT count(*) FROM vecs)),
scored AS (SELECT t.profile_id, h.doc_id, coalesce(list_dot_product(h.v, q.v), 0) AS dense,
    coalesce(n, 0) / n_items AS coverage FROM tot t JOIN vecs q ON q.vec_id = t.profile_id CROSS JOIN held h
  LEFT JOIN cov c ON c.profile_id = t.profile_id AND c.doc_id = h.doc_id),
blend AS (SELECT *, {fv.PROFILE_WEIGHT_DENSE} * dense + {fv.PROFILE_WEIGHT_COVER} * coverage AS score FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM blend QUALIFY rank <= {fv.PROFILE_TOP})"""

_SQL_FIELDS = _SQL_RANK + """,
flagged AS (SELECT b.profile_id, b.doc_id, b.rank, p.field, p.field_no, p.pos, p.item, h.id IS NOT NULL AS hit
  FROM best b JOIN profiles p ON p.profile_id = b.profile_id
  LEFT JOIN hits h ON h.id = b.doc_id AND h.field = p.field AND h.item = p.item)"""

_LABEL = "CASE field " + " ".join(f"WHEN '{f}' THEN '{fv.LABELS[f]}'" for f in fv.PROFILE_FIELDS) + " END"

ORACLE = {
    "profile_clean": f"WITH {_SQL_PROFILES} SELECT profile_id, field, pos, item FROM profiles",
    "profile_text": f"""
WITH {_SQL_PROFILES},
f AS (SELECT profile_id, field_no, {_LABEL} || ': ' || string_agg(item, '، ' ORDER BY pos) AS t FROM profiles
  GROUP BY profile_id, field, field_no)
SELECT profile_id, string_agg(t, ' . ' ORDER BY field_no) AS query_text FROM f GROUP BY profile_id""",
    "profile_rank": _SQL_RANK + " SELECT profile_id, doc_id, rank, round(dense, 6) AS dense, round(coverage, 6) AS coverage, "
                                "round(score, 6) AS score FROM best",
    "profile_coverage": _SQL_FIELDS + f"""
SELECT profile_id, doc_id, field, {_LABEL} AS label, coalesce(string_agg(item, '; ' ORDER BY pos) FILTER (hit), '') AS matched,
  coalesce(string_agg(item, '; ' ORDER BY pos) FILTER (NOT hit), '') AS missing, round(avg(hit::INT), 6) AS ratio
FROM flagged GROUP BY profile_id, doc_id, field""",
    "analyze_batch": _SQL_FIELDS + f""",
gate AS (SELECT profile_id, dense, coverage > 0 OR dense >= 0.2 AS open, score, doc_id FROM best WHERE rank = 1),
flines AS (SELECT profile_id, doc_id, rank, field_no,
    concat_ws(chr(10), {_LABEL} || ' — {fv.PROFILE_COVERED}: ' || string_agg(item, '، ' ORDER BY pos) FILTER (hit),
      {_LABEL} || ' — {fv.PROFILE_UNCOVERED}: ' || string_agg(item, '، ' ORDER BY pos) FILTER (NOT hit)) AS t
  FROM flagged GROUP BY profile_id, doc_id, rank, field, field_no),
blocks AS (SELECT profile_id, rank, chr(10) || '📌 order ' || doc_id || chr(10) || string_agg(t, chr(10) ORDER BY field_no) AS t
  FROM flines GROUP BY profile_id, doc_id, rank),
bodies AS (SELECT profile_id, count(*) AS n, string_agg(t, chr(10) ORDER BY rank) AS t FROM blocks GROUP BY profile_id)
SELECT g.profile_id, CASE WHEN open THEN 'profile_match' ELSE 'out_of_domain' END AS mode, 'profile' AS intent,
  CASE WHEN open THEN 'order ' || doc_id END AS job, round(CASE WHEN open THEN score ELSE dense END, 6) AS score,
  CASE WHEN open THEN n ELSE 0 END AS n_matches,
  CASE WHEN open THEN array_to_string(list_transform(range(n), lambda i: 'skills*,knowledge*,work_context*'), ';') ELSE '' END AS boxes,
  CASE WHEN open THEN '{fv.PROFILE_HEADER}' || chr(10) || t ELSE '{fv.PROFILE_NONE}' END AS answer
FROM gate g JOIN bodies USING (profile_id)""",
    "profile_context": f"""
WITH {_SQL_PROFILES},{_SQL_RECORDS},{_SQL_COVER},
pairs AS (SELECT DISTINCT profile_id, id AS doc_id FROM profiles JOIN recs ON id IN (profile_id, profile_id + 32)),
flagged AS (SELECT b.profile_id, b.doc_id, p.field, p.field_no, p.pos, p.item, h.id IS NOT NULL AS hit
  FROM pairs b JOIN profiles p ON p.profile_id = b.profile_id
  LEFT JOIN hits h ON h.id = b.doc_id AND h.field = p.field AND h.item = p.item),
flines AS (SELECT profile_id, doc_id, field_no, {_LABEL} || ' — {fv.PROFILE_COVERED}: ' || coalesce(string_agg(item, '، ' ORDER BY pos) FILTER (hit), '—')
    || ' / {fv.PROFILE_UNCOVERED}: ' || coalesce(string_agg(item, '، ' ORDER BY pos) FILTER (NOT hit), '—') AS t
  FROM flagged GROUP BY profile_id, doc_id, field, field_no),
jobs AS (SELECT profile_id, doc_id, row_number() OVER (PARTITION BY profile_id ORDER BY doc_id) AS i, string_agg(t, chr(10) ORDER BY field_no) AS t
  FROM flines GROUP BY profile_id, doc_id),
compared AS (SELECT profile_id, string_agg(chr(10) || '{fv.PROFILE_CONTEXT_JOB} ' || i || ': order ' || doc_id || chr(10) || t, chr(10) ORDER BY i) AS t
  FROM jobs GROUP BY profile_id),
f AS (SELECT profile_id, field_no, {_LABEL} || ': ' || string_agg(item, '، ' ORDER BY pos) AS t FROM profiles GROUP BY profile_id, field, field_no),
own AS (SELECT profile_id, string_agg(t, chr(10) ORDER BY field_no) AS t FROM f GROUP BY profile_id)
SELECT profile_id, '{fv.PROFILE_CONTEXT_HEADER}' || chr(10) || own.t || chr(10) || compared.t AS context FROM own JOIN compared USING (profile_id)""",
    "profile_validate": f"""
WITH items AS (SELECT o_custkey AS profile_id, 'skills' AS field, CASE WHEN l_linenumber > 6 THEN ' ' ELSE p_name END AS item
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'hobby' ELSE 'knowledge' END,
    CASE WHEN c_acctbal < 0 THEN repeat(c_name, 7) WHEN c_acctbal < 3000 THEN '' ELSE c_name END FROM customer),
cells AS (SELECT profile_id, field, count(*) AS given, count(*) FILTER (trim(item) <> '') AS kept, max(length(item)) AS longest
  FROM items GROUP BY profile_id, field),
p AS (SELECT c_custkey AS profile_id, count(*) FILTER (field = 'hobby') AS unknown, count(*) FILTER (given > 20) AS crowded,
    count(*) FILTER (longest > 120) AS wordy, coalesce(max(kept) FILTER (field = 'skills'), 0) AS required,
    count(*) FILTER (field <> 'hobby' AND kept > 0) AS filled FROM customer LEFT JOIN cells ON profile_id = c_custkey GROUP BY c_custkey)
SELECT profile_id, 'unknown_field' AS violation FROM p WHERE unknown > 0
UNION ALL SELECT profile_id, 'too_many_items' FROM p WHERE crowded > 0
UNION ALL SELECT profile_id, 'item_too_long' FROM p WHERE wordy > 0
UNION ALL SELECT profile_id, 'required_items' FROM p WHERE required < 2
UNION ALL SELECT profile_id, 'min_fields' FROM p WHERE filled < 2""",
    "record_validate": f"""
WITH {SQL_PART_RECORDS}
SELECT record_id, 'job_title' AS violation FROM records WHERE length(job_title) NOT BETWEEN 2 AND 255
""" + " ".join(f"UNION ALL SELECT record_id, '{c}' FROM records WHERE {c} = ''" for c in fv.RECORD_COLUMNS if c != "job_title"),
}
