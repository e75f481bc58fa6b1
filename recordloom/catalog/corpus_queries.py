"""Corpus assembly, batches, backfills and incremental encoding over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.identity import ordered_digest
from ..functions.text import normalize
from ..operators import embedding, lists, moderation
from ..plans.corpus import assemble_master
from ..session import fresh_path, stored
from ..sources import records as R
from ..sources.vectors import import_legacy, store_vectors, vector_store
from .common import kept, sql_match_key, sql_normalize, table



def _seq():
    """The order in which lines were entered; equal only for lines of one part."""
    return (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey")).alias("seq")


def _facts(spark, sf_dir):
    """Fact rows per part: supplier as element, quantity as score, flags from the line."""
    lines = table(spark, sf_dir, "lineitem")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    return lines.join(names, "l_suppkey").select(
        F.col("l_partkey").alias("code"), F.concat_ws(" | ", "s_name", F.upper("l_returnflag")).alias("element"),
        (F.col("l_orderkey") * 100_000_000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_linestatus") == "O", fv.IMPORTANCE_SCALE).otherwise(fv.CONTEXT_SCALE).alias("scale_id"),
        (F.col("l_quantity") / 10).alias("data_value"),
        F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "N", "N").alias("recommend_suppress"),
        F.when(F.col("l_discount") > 0.08, "Y").alias("not_relevant"))


def scored_filter(spark, sf_dir):
    kept = lists.scored_filter(_facts(spark, sf_dir), fv.IMPORTANCE_SCALE, fv.MIN_IMPORTANCE)
    return kept.select("code", "seq", "element", "data_value")


def scored_lists(spark, sf_dir):
    """Per order the names of its parts by falling quantity, repeats folded."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", _seq(),
                                                    F.col("l_linenumber").alias("no"))
    facts = lines.join(part, "l_partkey").withColumn("element", F.when(F.col("no") > 4, F.upper("p_name")).otherwise(F.col("p_name")))
    return lists.ordered_distinct_list(facts, "l_orderkey", "element", "parts", "seq", "l_quantity")


def plain_lists(spark, sf_dir):
    """Per supplier the types it delivered, alphabetically."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", _seq())
    facts = lines.join(part, "l_partkey").withColumn("element", F.concat_ws("  ", "p_type", "p_brand"))
    return lists.ordered_distinct_list(facts, "l_suppkey", "element", "kinds", "seq")


def _master(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = part.select(F.col("p_partkey").cast("string").alias("code"), F.concat_ws(" ", "p_name", "p_type").alias("title"),
                       F.col("p_brand").alias("description"))
    facts = _facts(spark, sf_dir).withColumn("code", F.col("code").cast("string"))
    plain = facts.select("code", "element", "seq")
    zones = part.filter(F.col("p_type") != "SMALL").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_size").alias("job_zone"))
    return assemble_master(base, {"aliases": plain, "hard_skills": facts, "work_context": facts, "knowledge": facts}, zones)


def master_join(spark, sf_dir):
    return _master(spark, sf_dir)


def fill_profile(spark, sf_dir):
    found = lists.fill_profile(_master(spark, sf_dir), list(fv.MASTER_COLUMNS))
    return found.withColumn("avg_items", F.round("avg_items", 6))


def batch_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return R.assign_batches(rows, ["o_orderdate", "o_orderkey"], 10).select("o_orderkey", "row_no", "batch_id")


def records_read(spark, sf_dir):
    """A loosely headed table read as records."""
    part = table(spark, sf_dir, "part")
    loose = part.select("p_partkey", F.when(F.col("p_size") < 5, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias(" Job_Title "),
                        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("TOOLS"), F.col("p_brand").alias("skills "))
    return R.as_records(loose)


def _jobs(spark, sf_dir):
    """The record table before a backfill: every part but the economy ones."""
    part = table(spark, sf_dir, "part").filter(F.col("p_type") != "ECONOMY")
    status = F.when(F.col("p_type") == "PROMO", "pending").when(F.col("p_type") == "SMALL", "rejected").otherwise("approved")
    title = F.concat("p_name", F.when(F.col("p_size") > 40, F.lit(" |  ")).otherwise(F.lit("، ")), "p_brand")
    cells = {"job_title": title, "description": F.concat_ws("| ", "p_type", "p_brand"),
             "knowledge": F.when(F.col("p_size") < 25, F.lit(" ")).otherwise(F.col("p_brand")),
             "abilities": F.when(F.col("p_size") < 35, F.lit(None)).otherwise(F.col("p_type"))}
    return part.select(F.col("p_partkey").alias("id"), *[cells.get(c, F.lit("")).alias(c) for c in fv.RECORD_COLUMNS], status.alias("status"))


def _source(spark, sf_dir):
    """The dataset to fill from: all parts, titles spelled their own way."""
    title = F.concat_ws(" ،", "p_name", "p_brand")
    cells = {"job_title": title, "knowledge": F.when(F.col("p_size") > 45, F.lit("")).otherwise(F.concat_ws(" ", F.lit("K"), F.col("p_size").cast("string"))),
             "abilities": F.when(F.col("p_size") > 10, F.concat_ws(" ", F.lit("A"), F.col("p_type"))).otherwise(F.lit(""))}
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), *[cells.get(c, F.lit("")).alias(c) for c in fv.RECORD_COLUMNS])


def backfill_plan(spark, sf_dir):
    plan = moderation.backfill_plan(_jobs(spark, sf_dir), _source(spark, sf_dir), "seq")
    return plan.select("seq", "action", "id", "new_knowledge", "new_abilities")


def backfill_overwrite(spark, sf_dir):
    plan = moderation.backfill_plan(_jobs(spark, sf_dir), _source(spark, sf_dir), "seq", overwrite=True)
    return plan.select("seq", "action", "id", "new_knowledge", "new_abilities")


def repair_plan(spark, sf_dir):
    return moderation.repair_plan(_jobs(spark, sf_dir))


def backfill_summary(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return moderation.backfill_summary(moderation.backfill_plan(jobs, _source(spark, sf_dir), "seq"), moderation.repair_plan(jobs))


def backfill_apply(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    plan = moderation.backfill_plan(jobs, _source(spark, sf_dir), "seq")
    return moderation.apply_backfill(jobs, plan, moderation.repair_plan(jobs), "seq").select(
        "id", "job_title", "description", "knowledge", "abilities", "status")


def approved_snapshot(spark, sf_dir):
    return R.approved_snapshot(_jobs(spark, sf_dir), keep=("id",))


def incremental_embed_plan(spark, sf_dir):
    """Texts still to encode when the store holds those of all labelled documents."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    from ..functions.identity import text_key
    store = labelled.select(text_key(normalize(F.col("text"))).alias("key")).distinct()
    texts = docs.select(normalize(F.col("text")).alias("text"))
    return embedding.missing_texts(texts, "text", store)


def _translated(spark, sf_dir):
    """Three batches of translated records as files with differing headers, one folder each; returns their glob."""
    part = table(spark, sf_dir, "part")
    lists = {"skills": F.concat_ws("، ", "p_name", "p_type", "p_brand"), "tools": F.concat(F.lit(" ,"), F.col("p_brand"), F.lit(" | | ")),
             "description": F.concat_ws(", ", "p_name", "p_type")}
    batches = [{" Skills": lists["skills"], "job_title": F.concat_ws(", ", "p_name", "p_brand")},
               {"job_title": F.col("p_name"), "TOOLS": lists["tools"], "description": lists["description"]},
               {" Skills": F.when(F.col("p_size") > 10, lists["skills"]), "TOOLS": lists["tools"], "job_title": F.col("p_name")}]
    root = fresh_path(spark, "translated")
    for n, cells in enumerate(batches):
        rows = part.filter(F.col("p_partkey") % 3 == n).select(F.col("p_partkey").alias("id"), *[c.alias(name) for name, c in cells.items()])
        rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("header", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/batch_{n}")
    return f"{root}/batch_*/*.csv"


def merge_translated(spark, sf_dir):
    merged = R.merge_translated(spark, _translated(spark, sf_dir))
    return merged.select("row_no", F.col("id").cast("long").alias("id"), "job_title", F.col("` Skills`").alias("skills"),
                         F.col("TOOLS").alias("tools"), "description")


def batch_files(spark, sf_dir):
    """Consecutive batches written with shared files, read back."""
    path = fresh_path(spark, "batches")
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    R.write_batches(orders, path, ["o_orderdate", "o_orderkey"], 10, folders=False)
    return spark.read.parquet(path).select("o_orderkey", "batch_id")


def seed_records(spark, sf_dir):
    """An empty target seeded once; a second call finds rows and adds none."""
    part = table(spark, sf_dir, "part")
    loose = part.select(F.when(F.col("p_size") < 5, F.lit(" \t")).otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias(" Job_Title "),
                        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("TOOLS"))
    seeded = stored(R.seed_if_empty(part.limit(0), loose), "seeded")
    again = R.seed_if_empty(seeded, loose)
    held = seeded if again is None else seeded.unionByName(again)
    return held.select("job_title", "tools", "skills", "status")


def legacy_import(spark, sf_dir):
    """Vectors of all documents taken over from an archive by language and position, one store key for equal texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("seq"), "text").filter("text IS NOT NULL")
    archive = docs.select("grp", "seq", F.array(F.length("text").cast("float"), F.ascii("text").cast("float")).alias("vector"))
    store = vector_store(spark, fresh_path(spark, "legacy"))
    name = ordered_digest(docs, "grp", "seq", "text")
    store_vectors(store, store.read(), import_legacy(store, docs, archive, name))
    left = import_legacy(store, docs, archive, name).count()
    return store.read().select("key", "vector", F.lit(left).alias("left"))


def language_normalizer(spark, sf_dir):
    """Normalised texts with a language normaliser in its seam."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", normalize(F.col("text"), embedding.text_normalizer(lambda t: t.replace("e", "é ").strip("."))).alias("text"))


def vector_round_trip(spark, sf_dir):
    """Texts encoded in two goes through the store: the second encodes what the first did not hold, and reads all."""
    # Read several times a go, so normalised once.
    docs = kept(table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("text")), "normalised")
    store = vector_store(spark, fresh_path(spark, "vectors"))
    udf = embedding.encoder_udf(embedding.hashing_encoder(8))
    embedding.embed(docs.filter("doc_id % 3 <> 0"), "text", store, udf).write.format("noop").mode("overwrite").save()
    held = store.read().count()
    both = embedding.embed(docs, "text", store, udf)
    known = store.read().agg(F.count(F.lit(1)).alias("n")).scalar()
    return both.select("doc_id", F.size("vector").alias("dim"), F.lit(held).alias("first"), known.alias("both"))


QUERIES = {f.__name__: f for f in (
    merge_translated, batch_files, seed_records, legacy_import, language_normalizer, vector_round_trip,
    scored_filter, scored_lists, plain_lists, master_join, fill_profile, batch_assign, records_read, backfill_plan,
    backfill_overwrite, repair_plan, backfill_summary, backfill_apply, approved_snapshot, incremental_embed_plan)}

# ------------------------------------------------------------------------------- SQL
_FACTS = """
facts AS (SELECT l_partkey AS code, s_name || ' | ' || l_returnflag AS element, l_orderkey * 100000000 + l_suppkey AS seq,
  CASE WHEN l_linestatus = 'O' THEN 'IM' ELSE 'CX' END AS scale_id, l_quantity / 10 AS data_value,
  CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'N' THEN 'N' END AS recommend_suppress,
  CASE WHEN l_discount > 0.08 THEN 'Y' END AS not_relevant FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""
_KEPT = ("coalesce(recommend_suppress, '') <> 'Y' AND coalesce(not_relevant, '') <> 'Y'")


def _scored(name: str, scale: str, low: float) -> str:
    return f"""
{name}_f AS (SELECT code, replace(element, '|', '/') AS e, arg_min(seq, (-data_value, seq)) AS q, max(data_value) AS v
  FROM facts WHERE scale_id = '{scale}' AND data_value >= {low} AND {_KEPT} GROUP BY code, replace(element, '|', '/')),
{name} AS (SELECT code, string_agg(e, ' | ' ORDER BY v DESC, q) AS cell FROM {name}_f GROUP BY code)"""


_MASTER = f"""
WITH {_FACTS},{_scored('im', 'IM', 3.0)},{_scored('cx', 'CX', 3.5)},
al AS (SELECT code, string_agg(DISTINCT replace(element, '|', '/'), ' | ' ORDER BY replace(element, '|', '/')) AS cell FROM facts GROUP BY code),
master AS (SELECT p_partkey::VARCHAR AS job_code, p_name || ' ' || p_type AS job_title, coalesce(al.cell, '') AS aliases,
  '{fv.MASTER_INDUSTRY_PREFIX}' || substr(p_partkey::VARCHAR, 1, 2) AS industry, '{fv.MASTER_DOMAIN}' AS domains,
  CASE WHEN p_type <> 'SMALL' THEN p_size::VARCHAR ELSE '' END AS level, '{fv.MASTER_DEPARTMENT}' AS department, '' AS tools,
  coalesce(im.cell, '') AS soft_skills, coalesce(im.cell, '') AS hard_skills, coalesce(im.cell, '') AS knowledge, '' AS abilities,
  coalesce(cx.cell, '') AS work_context, '' AS career_path_next, p_brand AS description, '' AS responsibilities
  FROM part LEFT JOIN al ON al.code = p_partkey LEFT JOIN im ON im.code = p_partkey LEFT JOIN cx ON cx.code = p_partkey)"""

_BACKFILL = f"""
jobs AS (SELECT p_partkey AS id, p_name || CASE WHEN p_size > 40 THEN ' |  ' ELSE '، ' END || p_brand AS job_title,
  p_type || '| ' || p_brand AS description, CASE WHEN p_size < 25 THEN ' ' ELSE p_brand END AS knowledge,
  CASE WHEN p_size < 35 THEN NULL ELSE p_type END AS abilities,
  CASE p_type WHEN 'PROMO' THEN 'pending' WHEN 'SMALL' THEN 'rejected' ELSE 'approved' END AS status
  FROM part WHERE p_type <> 'ECONOMY'),
src AS (SELECT p_partkey AS seq, p_name || ' ،' || p_brand AS job_title, CASE WHEN p_size > 45 THEN '' ELSE 'K ' || p_size END AS knowledge,
  CASE WHEN p_size > 10 THEN 'A ' || p_type ELSE '' END AS abilities FROM part),
keyed AS (SELECT *, {sql_match_key('job_title')} AS k FROM jobs),
target AS (SELECT k, arg_min(id, id) AS id, arg_min(coalesce(knowledge, ''), id) AS kn, arg_min(coalesce(abilities, ''), id) AS ab
  FROM keyed WHERE status = 'approved' GROUP BY k),
known AS (SELECT DISTINCT k FROM keyed),
cells AS (SELECT seq, s.job_title, s.knowledge, s.abilities, t.id, kn.k IS NOT NULL AS known,
    CASE WHEN t.id IS NOT NULL AND trim(s.knowledge) <> '' AND (@over OR trim(t.kn) = '') THEN s.knowledge END AS new_knowledge,
    CASE WHEN t.id IS NOT NULL AND trim(s.abilities) <> '' AND (@over OR trim(t.ab) = '') THEN s.abilities END AS new_abilities
  FROM (SELECT *, {sql_match_key('job_title')} AS k FROM src) s LEFT JOIN target t USING (k) LEFT JOIN known kn USING (k)),
plan AS (SELECT *, CASE WHEN id IS NOT NULL THEN CASE WHEN new_knowledge IS NOT NULL OR new_abilities IS NOT NULL THEN 'update' ELSE 'unchanged' END
    WHEN known THEN 'unchanged' ELSE 'insert' END AS action FROM cells),
fix AS (SELECT id, CASE WHEN contains(job_title, '|') THEN trim(regexp_replace(job_title, '[ ]*\\|[ ]*', '، ', 'g')) END AS fixed_job_title,
    CASE WHEN contains(description, '|') THEN trim(regexp_replace(description, '[ ]*\\|[ ]*', '، ', 'g')) END AS fixed_description,
    NULL::VARCHAR AS fixed_work_context FROM jobs WHERE status = 'approved' AND (contains(job_title, '|') OR contains(description, '|')))"""
_FILL = _BACKFILL.replace("@over", "false")

def _sql_list(x: str) -> str:
    """F15 in SQL."""
    spaced = f"regexp_replace({x}, '[{fv.WHITESPACE}]*[،,|][{fv.WHITESPACE}]*', ' | ', 'g')"
    single = f"regexp_replace({spaced}, '([|][{fv.WHITESPACE}]*)+', '| ', 'g')"
    return f"trim({single}, ' |')"


ORACLE = {
    "merge_translated": f"""
SELECT row_number() OVER (ORDER BY p_partkey % 3, p_partkey) AS row_no, p_partkey AS id,
  CASE WHEN p_partkey % 3 = 0 THEN p_name || ', ' || p_brand ELSE p_name END AS job_title,
  CASE WHEN p_partkey % 3 = 0 OR (p_partkey % 3 = 2 AND p_size > 10) THEN {_sql_list("p_name || '، ' || p_type || '، ' || p_brand")} END AS skills,
  CASE WHEN p_partkey % 3 > 0 THEN {_sql_list("' ,' || p_brand || ' | | '")} END AS tools,
  CASE WHEN p_partkey % 3 = 1 THEN p_name || ', ' || p_type END AS description FROM part""",
    "batch_files": """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 10 + 1 AS batch_id FROM orders""",
    "seed_records": """
SELECT ' ' || p_name AS job_title, CASE WHEN p_type <> 'PROMO' THEN p_type ELSE '' END AS tools, '' AS skills, 'approved' AS status
FROM part WHERE p_size >= 5""",
    "legacy_import": f"""
SELECT DISTINCT sha256('{fv.DEFAULT_MODEL}' || chr(31) || text) AS key, [length(text)::FLOAT, ascii(text)::FLOAT] AS vector, 0 AS left
FROM documents WHERE text IS NOT NULL""",
    "language_normalizer": f"SELECT doc_id, trim(trim(replace({sql_normalize('text')}, 'e', 'é '), '.'), ' ') AS text FROM documents",
    "vector_round_trip": f"""
WITH t AS (SELECT doc_id, {sql_normalize('text')} AS text FROM documents)
SELECT doc_id, 8 AS dim, (SELECT count(DISTINCT text) FROM t WHERE doc_id % 3 <> 0) AS first, (SELECT count(DISTINCT text) FROM t) AS both FROM t""",
    "scored_filter": f"WITH {_FACTS} SELECT code, seq, element, data_value FROM facts WHERE scale_id = 'IM' AND data_value >= 3.0 AND {_KEPT}",
    "scored_lists": """
WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber > 4 THEN upper(p_name) ELSE p_name END AS e, l_quantity AS v,
    l_linenumber * 10000000000 + l_partkey AS seq FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, lower(e) ORDER BY v DESC, seq) AS n FROM f QUALIFY n = 1)
SELECT l_orderkey, string_agg(e, ' | ' ORDER BY v DESC, seq) AS parts FROM u GROUP BY l_orderkey""",
    "plain_lists": """
SELECT l_suppkey, string_agg(DISTINCT p_type || ' ' || p_brand, ' | ' ORDER BY p_type || ' ' || p_brand) AS kinds
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey""",
    "master_join": _MASTER + " SELECT * FROM master",
    "fill_profile": _MASTER + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (trim({c}) <> '') AS filled, count(DISTINCT {c}) AS distinct_values, "
        f"coalesce(round(avg(len(list_filter(string_split({c}, '|'), lambda p: trim(p) <> ''))) FILTER (trim({c}) <> ''), 6), 0) AS avg_items FROM master"
        for c in fv.MASTER_COLUMNS),
    "batch_assign": """
SELECT o_orderkey, n AS row_no, (n - 1) // 10 + 1 AS batch_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""",
    "records_read": f"""
SELECT p_partkey, p_name AS job_title, '' AS aliases, CASE WHEN p_type <> 'PROMO' THEN p_type ELSE '' END AS tools, p_brand AS skills,
  '' AS knowledge, '' AS abilities, '' AS work_context, '' AS career_path_next, '' AS description, '' AS responsibilities
FROM part WHERE p_size >= 5""",
    "backfill_plan": f"WITH {_FILL} SELECT seq, action, id, new_knowledge, new_abilities FROM plan",
    "backfill_overwrite": f"WITH {_BACKFILL.replace('@over', 'true')} SELECT seq, action, id, new_knowledge, new_abilities FROM plan",
    "repair_plan": f"WITH {_FILL} SELECT * FROM fix",
    "backfill_summary": f"WITH {_FILL} SELECT action, count(*) AS n FROM (SELECT action FROM plan UNION ALL SELECT 'repair' FROM fix) GROUP BY action",
    "backfill_apply": f"""
WITH {_FILL},
last AS (SELECT id, arg_max(new_knowledge, seq) FILTER (new_knowledge IS NOT NULL) AS k, arg_max(new_abilities, seq) FILTER (new_abilities IS NOT NULL) AS a
  FROM plan WHERE action = 'update' GROUP BY id)
SELECT j.id, coalesce(fixed_job_title, job_title) AS job_title, coalesce(fixed_description, description) AS description,
  coalesce(k, knowledge) AS knowledge, coalesce(a, abilities) AS abilities, status
FROM jobs j LEFT JOIN last USING (id) LEFT JOIN fix USING (id)
UNION ALL SELECT NULL, job_title, '', knowledge, abilities, 'approved' FROM plan WHERE action = 'insert'""",
    "approved_snapshot": f"WITH {_FILL} SELECT id, job_title, '' AS aliases, '' AS tools, '' AS skills, knowledge, coalesce(abilities, '') AS abilities, "
                         "'' AS work_context, '' AS career_path_next, description, '' AS responsibilities FROM jobs WHERE status = 'approved'",
    "incremental_embed_plan": f"""
WITH t AS (SELECT doc_id, {sql_normalize('text')} AS text FROM documents),
k AS (SELECT doc_id, text, sha256('{fv.DEFAULT_MODEL}' || chr(31) || text) AS key FROM t)
SELECT DISTINCT key, text FROM k WHERE key NOT IN (SELECT key FROM k JOIN labels USING (doc_id))""",
}
