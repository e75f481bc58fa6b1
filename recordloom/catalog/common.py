"""How the driver tables stand in for the record, tenancy and event tables.

Each mapping exists twice, as a DataFrame and as the SQL the checks run, and always
covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions import display
from ..functions.text import normalize
from ..operators.lexical_index import LexicalIndex
from ..operators.shuffle import spread
from ..session import fresh_path, stored

WS = fv.WHITESPACE


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, task_rows: int | None = None) -> DataFrame:
    """A driver table; with `task_rows`, dealt out in tasks of so many rows (see `spread`)."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found, task_rows) if name in TEXT_TABLES or task_rows else found


def kept(df: DataFrame, label: str) -> DataFrame:
    """An intermediate table written once, read by all cores."""
    return spread(stored(df, label))


_BUILT: dict[tuple, object] = {}


def built_once(spark: SparkSession, sf_dir: str, name: str, make):
    """What `make()` returns, kept for the session: queries share stored tables as questions share a served corpus."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def text_index(spark: SparkSession, sf_dir: str, name: str, rows, doc_id: str, text: str) -> LexicalIndex:
    """The stored index of the texts of `rows()`."""
    def make() -> LexicalIndex:
        index = LexicalIndex(spark, fresh_path(spark, f"index-{name}"))
        index.rebuild(rows(), doc_id, text)
        return index
    return built_once(spark, sf_dir, f"index-{name}", make)


# ----------------------------------------------------------------- SQL spellings
def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def sql_strip(x: str, extra: str = "") -> str:
    return f"regexp_replace({x}, '^[{WS}{extra}]+|[{WS}{extra}]+$', '', 'g')"


def sql_normalize(x: str) -> str:
    return sql_squeeze(f"translate(coalesce({x}, ''), '{fv.ARABIC_LETTERS}', '{fv.PERSIAN_LETTERS}')")


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[{WS}]+'), lambda t: t <> '')"


def sql_words(x: str, separators: str, lower: bool = False) -> str:
    text = f"lower({x})" if lower else x
    return (f"list_distinct(list_filter(regexp_split_to_array({text}, '[{WS}{separators}]+'), "
            f"lambda t: length(t) >= {fv.TOKEN_MIN}))")


SQL_BLANKS = "(" + ", ".join(f"'{b}'" for b in fv.BLANK_CELLS) + ")"


def sql_items(x: str) -> str:
    return (f"list_filter(list_transform(string_split({x}, '|'), lambda p: {sql_strip('p')}), "
            f"lambda p: p NOT IN {SQL_BLANKS})")


def sql_match_key(x: str) -> str:
    folded = f"translate({x}, '{fv.ARABIC_LETTERS}|', '{fv.PERSIAN_LETTERS}،')"
    return sql_squeeze(f"replace({folded}, '،', ' ، ')")


# ----------------------------------------------------------------- records and questions
def part_records(spark: SparkSession, sf_dir: str, part: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Record cells from `part` and `documents`: title and lists from the part, prose from the text.

    `part` may come with columns of its own, kept where `more` names them.
    """
    part = table(spark, sf_dir, "part") if part is None else part
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), "text", "lang")
    rows = part.join(docs, "p_partkey", "left")
    cells = {
        "job_title": F.concat_ws(" ", "p_name", "p_type"),
        "aliases": F.concat_ws(" | ", "p_brand", "p_type"),
        "tools": F.when(F.col("p_size") > 25, F.lit("-")).otherwise(F.col("p_type")),
        "skills": F.concat_ws(" | ", "p_name", "p_type", F.lit("—")),
        "knowledge": F.when(F.col("p_size") < 25, F.lit("")).otherwise(F.col("p_brand")),
        "abilities": F.coalesce(F.col("lang"), F.lit("")),
        "work_context": F.concat(F.lit("size "), F.col("p_size").cast("string")),
        "career_path_next": F.lit(""),
        "description": F.coalesce(F.col("text"), F.lit("")),
        "responsibilities": F.concat_ws(" | ", "p_brand", "p_name"),
    }
    return rows.select(F.col("p_partkey").alias("record_id"), *[normalize(cells[c]).alias(c) for c in fv.RECORD_COLUMNS], *more)


SQL_PART_RECORDS = f"""
part_cells AS (
  SELECT p_partkey AS record_id, p_name || ' ' || p_type AS job_title, p_brand || ' | ' || p_type AS aliases,
    CASE WHEN p_size > 25 THEN '-' ELSE p_type END AS tools, p_name || ' | ' || p_type || ' | —' AS skills,
    CASE WHEN p_size < 25 THEN '' ELSE p_brand END AS knowledge, coalesce(lang, '') AS abilities,
    'size ' || p_size AS work_context, '' AS career_path_next, coalesce(text, '') AS description,
    p_brand || ' | ' || p_name AS responsibilities
  FROM part LEFT JOIN documents ON doc_id = p_partkey),
records AS (SELECT record_id, {', '.join(f"{sql_normalize(c)} AS {c}" for c in fv.RECORD_COLUMNS)} FROM part_cells)"""


def sql_combined(prefix: str = "") -> str:
    parts = []
    for f in fv.ENCODING_ORDER:
        value = f"replace({prefix}{f}, '|', '،')" if f == "aliases" else f"{prefix}{f}"
        parts.append(f"CASE WHEN {prefix}{f} <> '' THEN '{fv.LABELS[f]}: ' || {value} END")
    return f"concat_ws(' . ', {', '.join(parts)})"


def with_slot(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """`df` with `_slot`, its key modulo the rows of `other`, whose keys count from 0: so every row finds one."""
    return df.withColumn("_slot", F.pmod(F.col(key), F.lit(max(1, other.count()))))


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with vectors: `embeddings` by its key modulo their number, the title vector being the next one."""
    return built_once(spark, sf_dir, "records", lambda: _search_records(spark, sf_dir))


def _search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    parts = with_slot(table(spark, sf_dir, "part"), "p_partkey", vectors)
    count = F.lit(vectors.count())
    paired = vectors.select(F.col("vec_id").alias("_slot"), F.col("embedding").alias("full_vec")).join(
        vectors.select(F.pmod(F.col("vec_id") - 1, count).alias("_slot"), F.col("embedding").alias("title_vec")), "_slot")
    # The vectors come to the short parts, so that the texts are shuffled once, by their own key.
    parts = parts.join(paired, "_slot", "left").drop("_slot")
    rows = part_records(spark, sf_dir, parts, ("full_vec", "title_vec"))
    return kept(rows.withColumn("combined_text", display.combined_text()), "records")


def search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per `benchmark` item: the item's part name and text, with its key's vector."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_slot"), "p_name")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_slot"), "embedding")
    named = with_slot(table(spark, sf_dir, "benchmark"), "item_id", names).join(names, "_slot", "left")
    return (with_slot(named, "item_id", vectors).join(vectors, "_slot", "left")
            .select(F.col("item_id").alias("query_id"),
                    F.concat_ws(" ", "p_name", "text").alias("question"), F.col("embedding").alias("query_vec")))


def record_index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The stored index of the records' combined texts."""
    return text_index(spark, sf_dir, "records", lambda: search_records(spark, sf_dir), "record_id", "combined_text")


SQL_SEARCH = SQL_PART_RECORDS + f""",
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sizes AS (SELECT (SELECT count(*) FROM vectors) AS n_vec, (SELECT count(*) FROM part) AS n_part),
corpus AS (SELECT r.*, {sql_combined('r.')} AS combined_text, a.v AS full_vec, b.v AS title_vec FROM records r CROSS JOIN sizes
  LEFT JOIN vectors a ON a.vec_id = record_id % n_vec LEFT JOIN vectors b ON b.vec_id = (record_id % n_vec + 1) % n_vec),
questions AS (SELECT item_id AS query_id, p_name || ' ' || text AS question, v AS query_vec
  FROM benchmark CROSS JOIN sizes LEFT JOIN part ON p_partkey = item_id % n_part LEFT JOIN vectors ON vec_id = item_id % n_vec),
asked AS (SELECT *, {sql_normalize('question')} AS q FROM questions),
dense_all AS (SELECT query_id, record_id AS doc_id,
    {fv.WEIGHT_FULL} * list_dot_product(full_vec, query_vec) + {fv.WEIGHT_TITLE} * list_dot_product(title_vec, query_vec) AS dense
  FROM asked, corpus)"""


def sql_bm25(docs: str, doc_id: str, text: str, asked: str, query_id: str, question: str) -> str:
    """CTEs ending in `sparse_all(query_id, doc_id, sparse)`."""
    k1, b = fv.BM25_K1, fv.BM25_B
    return f"""
toks AS (SELECT {doc_id} AS doc_id, {sql_tokens(text)} AS t FROM {docs}),
doc_stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM toks),
post AS (SELECT doc_id, token, count(*) AS tf, max(dl) AS dl
  FROM (SELECT doc_id, unnest(t) AS token, len(t) AS dl FROM toks) GROUP BY doc_id, token),
lex AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qtok AS (SELECT DISTINCT {query_id} AS query_id, unnest({sql_tokens(question)}) AS token FROM {asked}),
qw AS (SELECT query_id, token, df, ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1.0) AS idf
  FROM qtok LEFT JOIN lex USING (token), doc_stats),
qbest AS (SELECT query_id, sum(idf) * {k1 + 1} AS best FROM qw GROUP BY query_id),
sparse_all AS (SELECT query_id, doc_id,
    sum(idf * {k1 + 1} / best * tf / (tf + {k1} * ({1 - b} + {b} * dl / avg_len))) AS sparse
  FROM post JOIN qw USING (token) JOIN qbest USING (query_id), doc_stats GROUP BY query_id, doc_id)"""


def sql_top(source: str, score: str, k: int = fv.CHANNEL_DEPTH) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, doc_id) AS rank "
            f"FROM {source} QUALIFY rank <= {k})")


SQL_RANKED = SQL_SEARCH + "," + sql_bm25("corpus", "record_id", "combined_text", "asked", "query_id", "q") + f""",
dense_top AS {sql_top('dense_all', 'dense')},
sparse_top AS {sql_top('sparse_all', 'sparse')},
fused AS (SELECT query_id, doc_id, max(rd) AS rank_d, max(rs) AS rank_s,
    coalesce(1.0::DOUBLE / ({fv.RRF_CONSTANT} + max(rd)), 0) + coalesce(1.0::DOUBLE / ({fv.RRF_CONSTANT} + max(rs)), 0) AS rrf
  FROM (SELECT query_id, doc_id, rank AS rd, NULL AS rs FROM dense_top
        UNION ALL SELECT query_id, doc_id, NULL, rank FROM sparse_top) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY rrf DESC, rank_d NULLS LAST, rank_s NULLS LAST) AS rank FROM fused),
cand AS (SELECT query_id, doc_id, r.rank, d.dense, a.q, c.job_title, c.full_vec
  FROM ranked r JOIN dense_all d USING (query_id, doc_id) JOIN asked a USING (query_id) JOIN corpus c ON c.record_id = doc_id)"""


# ----------------------------------------------------------------- tenancy
def tenancy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Organizations, units and accounts: regions, nations and customers, stored once a session.

    The first customer of all is the super admin, the first of each nation its unit
    admin, the next of each region its organization admin; the rest are users.
    """
    return built_once(spark, sf_dir, "tenancy", lambda: tuple(stored(df, "tenancy") for df in _tenancy(spark, sf_dir)))


def _tenancy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    first_order = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
                   .agg(F.min("o_orderdate").alias("created_at")))
    orgs = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    units = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
                          F.col("n_regionkey").cast("long").alias("organization_id"))
    root = customer.agg(F.min("c_custkey").alias("c_custkey")).withColumn("is_root", F.lit(True))
    others = customer.join(root, "c_custkey", "left_anti")
    heads = others.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey")).select(
        "c_custkey", F.lit(True).alias("is_head"))
    placed = others.join(heads, "c_custkey", "left_anti").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    chiefs = placed.groupBy("n_regionkey").agg(F.min("c_custkey").alias("c_custkey")).select(
        "c_custkey", F.lit(True).alias("is_chief"))
    tagged = (customer.join(root, "c_custkey", "left").join(heads, "c_custkey", "left")
              .join(chiefs, "c_custkey", "left").join(first_order, "c_custkey", "left")
              .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey"))
    role = (F.when(F.col("is_root"), "super_admin").when(F.col("is_head"), "unit_admin")
            .when(F.col("is_chief"), "org_admin").otherwise("user"))
    users = tagged.withColumn("role", role).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), "role",
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.when(F.col("role") == "org_admin", F.col("n_regionkey").cast("long")).alias("organization_id"),
        F.when(F.col("role").isin("unit_admin", "user"), F.col("c_nationkey").cast("long")).alias("unit_id"),
        "created_at")
    # Containers date from the first order placed in them.
    opened = users.groupBy(F.col("unit_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    units = units.join(opened, "id", "left")
    founded = units.groupBy(F.col("organization_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return orgs.join(founded, "id", "left"), units, users


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested records: orders, the customer being the suggester."""
    status = (F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved")
              .otherwise("rejected"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("suggested_by"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"))


SQL_TENANCY = """
root AS (SELECT min(c_custkey) AS k FROM customer),
heads AS (SELECT min(c_custkey) AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM root) GROUP BY c_nationkey),
chiefs AS (SELECT min(c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey
  WHERE c_custkey NOT IN (SELECT k FROM root) AND c_custkey NOT IN (SELECT k FROM heads) GROUP BY n_regionkey),
roles AS (SELECT c_custkey, CASE WHEN c_custkey IN (SELECT k FROM root) THEN 'super_admin'
    WHEN c_custkey IN (SELECT k FROM heads) THEN 'unit_admin'
    WHEN c_custkey IN (SELECT k FROM chiefs) THEN 'org_admin' ELSE 'user' END AS role FROM customer),
users AS (SELECT c.c_custkey AS id, c_name AS username, role, c_acctbal >= 0 AS is_active,
    CASE WHEN role = 'org_admin' THEN n_regionkey::BIGINT END AS organization_id,
    CASE WHEN role IN ('unit_admin', 'user') THEN c_nationkey::BIGINT END AS unit_id,
    (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c.c_custkey) AS created_at
  FROM customer c JOIN roles USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey),
units AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS organization_id,
    (SELECT min(created_at) FROM users WHERE unit_id = n_nationkey) AS created_at FROM nation),
orgs AS (SELECT r_regionkey::BIGINT AS id, r_name AS name,
    (SELECT min(created_at) FROM units WHERE organization_id = r_regionkey) AS created_at FROM region),
jobs AS (SELECT o_orderkey AS id, o_custkey AS suggested_by,
    CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,
    o_orderdate AS created_at FROM orders),
admins AS (SELECT * FROM users WHERE role <> 'user'),
placed AS (SELECT u.*, n.organization_id AS unit_org FROM users u LEFT JOIN units n ON n.id = u.unit_id),
sees AS (SELECT a.id AS actor_id, p.id AS account_id FROM admins a JOIN placed p ON
    a.role = 'super_admin' OR (a.role = 'org_admin' AND p.unit_org = a.organization_id)
    OR (a.role = 'unit_admin' AND p.unit_id = a.unit_id)),
runs AS (SELECT a.id AS actor_id, n.id AS unit_id, n.name, n.created_at FROM admins a JOIN units n ON
    a.role = 'super_admin' OR (a.role = 'org_admin' AND n.organization_id = a.organization_id)
    OR (a.role = 'unit_admin' AND n.id = a.unit_id)),
seen_orgs AS (SELECT a.id AS actor_id, o.id AS organization_id, o.name, o.created_at
  FROM admins a JOIN placed p ON p.id = a.id JOIN orgs o ON
    a.role = 'super_admin' OR o.id = coalesce(a.organization_id, p.unit_org)),
counted AS (SELECT a.id AS actor_id, j.status, j.created_at FROM admins a JOIN jobs j ON a.role = 'super_admin'
    OR j.suggested_by = a.id OR EXISTS (SELECT 1 FROM sees s WHERE s.actor_id = a.id AND s.account_id = j.suggested_by))"""
