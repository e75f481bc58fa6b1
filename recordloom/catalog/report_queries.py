"""Printable reports over the answers to every question."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import validate
from ..plans import reports
from .common import table, with_slot
from .search_queries import _SQL_ANSWERS, _answers
from .text_queries import _FA, _SQL_JALALI


def _issued(spark, sf_dir):
    """Each answer with its issuer: the customer of its number, in its nation and region."""
    customer = table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    people = (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("c_custkey").alias("_slot"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("first_name"),
                      F.lit("").alias("last_name"), F.col("c_name").alias("username"), F.col("r_name").alias("organization"),
                      F.when(F.col("c_nationkey") > 5, F.col("n_name")).alias("unit")))
    when = table(spark, sf_dir, "events").select(F.col("event_id").alias("_slot"), "ts")
    answers = with_slot(_answers(spark, sf_dir), "query_id", customer).join(people, "_slot", "left")
    return with_slot(answers, "query_id", when).join(when, "_slot", "left").drop("_slot")


def report_rows(spark, sf_dir):
    rows = reports.report_rows(_issued(spark, sf_dir), F.col("ts"), keep="\\p{L}\\p{M}\\p{N}\\p{P}$+|=<>^`~")
    return rows.select("query_id", "issued_at", "file_name", "person", "organization", "unit", "matched", "matched_label",
                       "notice", F.array_join("related_jobs", " / ").alias("related"),
                       F.col("answer").contains(fv.PIN_MARK).alias("has_mark"))


def related_minus_matched(spark, sf_dir):
    """Per order the types of its parts less those of its largest line, order and repeats kept."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").join(part, "l_partkey")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type")))
    grouped = lines.groupBy("l_orderkey").agg(
        F.transform(rows, lambda r: r["p_type"]).alias("related"),
        F.max_by("p_type", F.struct("l_extendedprice", "l_partkey")).alias("top"))
    return grouped.select("l_orderkey", F.array_join(
        reports.related_minus_matched(F.col("related"), F.array("top")), ",").alias("rest"))


def report_validate(spark, sf_dir):
    """Conversation turns as posted reports, long texts and lists being the faults."""
    rows = table(spark, sf_dir, "conversations", task_rows=2_000)
    words = F.split("text", "[.,]")
    shaped = rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("report"), F.when(F.col("turn") == 0, F.lit("")).otherwise(F.col("text")).alias("question"),
        F.col("role").alias("mode"), F.repeat("text", 20).alias("answer"), F.get(words, F.lit(0)).alias("job"), words.alias("jobs"),
        F.transform(words, lambda w: F.struct(w.alias("job_title"), F.transform(F.array_repeat(w, 41), lambda v: F.struct(
            F.lit("skills").alias("key"), F.lit("s").alias("label"), v.alias("value"), F.array_repeat(v, 2).alias("items"))).alias("fields"))).alias("details"),
        words.alias("related_jobs"))
    return validate.validate_reports(shaped, "report")


QUERIES = {f.__name__: f for f in (report_rows, related_minus_matched, report_validate)}

# ------------------------------------------------------------------------------- SQL
_MATCHED = "CASE mode " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in fv.REPORT_MATCHED.items()) + " ELSE '' END"
_NOTICE = "CASE mode " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in fv.REPORT_NOTICE.items()) + " END"

ORACLE = {
    "report_rows": _SQL_ANSWERS + f""",
issued AS (SELECT f.*, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE c_name END AS person, r_name AS organization,
    CASE WHEN c_nationkey > 5 THEN n_name END AS unit, ts + INTERVAL 210 MINUTE AS m, (ts + INTERVAL 210 MINUTE)::DATE AS d
  FROM final f LEFT JOIN customer ON c_custkey = query_id % (SELECT count(*) FROM customer)
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN events ON event_id = query_id % (SELECT count(*) FROM events)),
moments AS (SELECT * FROM issued),{_SQL_JALALI}
SELECT query_id, {_FA('jd')} || ' ' || list_extract([{', '.join(f"'{m}'" for m in fv.JALALI_MONTHS)}], jm::BIGINT) || ' ' || {_FA('jy')}
    || ' — {fv.CLOCK_WORD} ' || {_FA("strftime(m, '%H:%M')")} AS issued_at,
  'job-report-' || printf('%04d-%02d-%02d', jy, jm, jd) || '.pdf' AS file_name, regexp_replace(person, '#', '#') AS person, organization, unit,
  CASE WHEN mode IN ('job_match', 'job_generated') THEN job WHEN mode = 'interdisciplinary' THEN replace(jobs, ' / ', '، ') ELSE '' END AS matched,
  {_MATCHED} AS matched_label, {_NOTICE} AS notice,
  coalesce(array_to_string(list_filter(string_split(related_jobs, ' / '), lambda t: t <> coalesce(job, '')), ' / '), '') AS related,
  false AS has_mark FROM jal""",
    "related_minus_matched": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, p_type, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT l_orderkey, arg_max(p_type, (l_extendedprice, l_partkey)) AS top FROM l GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(string_agg(p_type, ',' ORDER BY l_linenumber, l_partkey) FILTER (p_type <> top), '') AS rest
FROM l JOIN g USING (l_orderkey) GROUP BY l_orderkey""",
    "report_validate": """
WITH r AS (SELECT conv_id || '-' || turn AS report, CASE WHEN turn = 0 THEN '' ELSE text END AS question, length(text) * 20 AS answer,
  regexp_split_to_array(text, '[.,]') AS w FROM conversations),
l AS (SELECT *, list_max(list_transform(w, lambda x: length(x))) AS longest FROM r)
SELECT report, 'question' AS violation FROM l WHERE length(question) NOT BETWEEN 1 AND 500
UNION ALL SELECT report, 'answer' FROM l WHERE answer > 20000
UNION ALL SELECT report, 'job' FROM l WHERE length(w[1]) > 255
UNION ALL SELECT report, 'jobs' FROM l WHERE len(w) > 8 OR longest > 255
UNION ALL SELECT report, 'details' FROM l WHERE len(w) > 4 OR longest > 255
UNION ALL SELECT report, 'fields' FROM l
UNION ALL SELECT report, 'items' FROM l WHERE longest > 20000
UNION ALL SELECT report, 'related_jobs' FROM l WHERE len(w) > 20 OR longest > 255""",
}
