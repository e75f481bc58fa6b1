"""Scalar functions over whole text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import calendar, display, identity, intent, text as T
from .common import (SQL_PART_RECORDS, WS, part_records, sql_combined, sql_items, sql_match_key, sql_normalize,
                     sql_squeeze, sql_strip, sql_words, table)

_BAR_COMMA = f"[{WS}]*\\|[{WS}]*"

# Latin word tables: the stock ones are Persian and the driver texts are not.
LATIN_INTENTS = {"responsibilities": ("there", "leau"), "tools": ("with", "des "), "competencies": ("ing",),
                 "career_path": ("tion", "keit"), "description": ("the", "ung")}
LATIN_REQUESTS = ("is the", "und die", "de la")
LATIN_PATTERNS = ("(?Ud)an?d .{0,40}the", "(?Ud)une? .{0,120}eau")


def _texts(spark, sf_dir, column, name, source="documents", key="doc_id"):
    return table(spark, sf_dir, source).select(key, column(F.col("text")).alias(name))


def text_normalize(spark, sf_dir):
    return _texts(spark, sf_dir, T.normalize, "norm")


def markdown_strip(spark, sf_dir):
    return _texts(spark, sf_dir, T.strip_markdown, "plain")


def separator_normalize(spark, sf_dir):
    return _texts(spark, sf_dir, T.unify_separators, "cell")


def prose_repair(spark, sf_dir):
    return _texts(spark, sf_dir, T.repair_prose, "prose")


def item_clean(spark, sf_dir):
    return _texts(spark, sf_dir, T.clean_item, "item")


def match_keys(spark, sf_dir):
    return _texts(spark, sf_dir, T.match_key, "match_key")


def text_keys(spark, sf_dir):
    return _texts(spark, sf_dir, identity.text_key, "key")


def corpus_digest(spark, sf_dir):
    return identity.corpus_digest(table(spark, sf_dir, "documents"), "lang", "text")


def item_split(spark, sf_dir):
    items = T.list_items(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(items).alias("n_items"), F.array_join(items, "\n").alias("items"))


def word_tokens(spark, sf_dir):
    joined = lambda words: F.array_join(F.sort_array(words), " ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", joined(T.title_tokens(F.col("text"))).alias("title_words"),
        joined(T.item_tokens(F.col("text"))).alias("item_words"))


def printable_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.drawable(F.col("text"), "A-Za-z0-9.,").alias("shown"))


def digit_folding(spark, sf_dir):
    shown = T.fold_digits_persian(F.format_string("%d/%s", F.col("o_orderkey"), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", shown.alias("persian"), T.fold_digits_latin(shown).alias("ascii"))


def contact_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit(" +۹۸ ("), F.col("c_nationkey").cast("string"), F.lit(") "),
                 F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).otherwise(F.lit("x")),
                 F.lit("٠٧٨")).alias("raw_phone"),
        F.concat(F.col("c_name"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" at ")).otherwise(F.lit("@")),
                 F.col("c_mktsegment"), F.lit(".Example\n")).alias("raw_email"))
    phone, email = identity.phone(F.col("raw_phone")), identity.email(F.col("raw_email"))
    return rows.select("c_custkey", phone["value"].alias("phone"), phone["is_valid"].alias("phone_ok"),
                       email["value"].alias("email"), email["is_valid"].alias("email_ok"))


def display_names(spark, sf_dir):
    first = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment"))
    last = F.when(F.col("c_acctbal") < 5000, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", identity.full_name(first, last).alias("full_name"),
        identity.display_name(first, last, F.col("c_name")).alias("shown"))


def client_keys(spark, sf_dir):
    hop = F.col("user_id").cast("string")
    forwarded = F.when(F.col("event_type") != "view", F.concat_ws(", ", "event_type", hop))
    host = F.when(F.col("event_type") != "click", F.col("event_type"))
    trusted = identity.client_source(forwarded, host, True)
    name = F.concat(F.lit(" \t"), F.upper("event_type"), F.lit(" "))
    return table(spark, sf_dir, "events").select(
        "event_id", trusted.alias("trusted"), identity.client_source(forwarded, host, False).alias("direct"),
        identity.login_key(trusted, name).alias("login_key"))


_REPLY = """'note: ' || CASE event_type
  WHEN 'view' THEN '{"job_title": "broken"'
  WHEN 'click' THEN '{"job_title": "one"} and {"job_title": "two"}'
  WHEN 'signup' THEN '{"job_title": " Clerk | أ", "description": "| a |b", "tools": "x | y", "props": ' || props || '}'
  WHEN 'error' THEN '{"not_a_job": "True ", "job_title": "x", "props": ' || props || '}'
  ELSE '{"job_title": "Seller  of\n' || props_text || '", "not_a_job": false, "work_context": null}' END || ' end'"""


def json_reply_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events", task_rows=50_000).withColumn("props_text", F.regexp_replace("props", '["{}]', ""))
    reply = F.expr(_REPLY.replace("@NL@", "\\\\n"))
    k = T.object_value(T.parse_object(F.concat(F.lit("x "), F.col("props"), F.lit(" y"))), "k")
    # A column of its own, so that the reply is parsed once for all cells taken from it.
    parsed = events.select("event_id", k.cast("long").alias("k"), display.clean_draft(reply).alias("drafted"))
    return parsed.select("event_id", "k", "drafted.status", *[
        F.col("drafted.draft")[c].alias(c) for c in ("job_title", "description", "work_context", "tools")])


def jalali_dates(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int), 45, 0)")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", calendar.jalali_slug(when).alias("slug"), calendar.jalali_text(when).alias("shown"))


def jalali_monthly(spark, sf_dir):
    j = calendar.jalali(F.to_date("o_orderdate"))
    return (table(spark, sf_dir, "orders").groupBy(j["year"].alias("jy"), j["month"].alias("jm"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


def intent_classify(spark, sf_dir):
    q = T.normalize(F.col("text"))
    found = intent.question_intent(q, LATIN_INTENTS, ("the", "les"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", intent.detect_intent(q, LATIN_INTENTS).alias("first_intent"), found.alias("intent"),
        F.array_join(intent.intent_fields(found), ",").alias("fields"))


def request_classify(spark, sf_dir):
    q = T.normalize(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", intent.is_request(q, LATIN_REQUESTS, LATIN_PATTERNS).alias("wants"),
        intent.is_combination(q, ("both", "les deux", "and ")).alias("combines"))


def record_texts(spark, sf_dir):
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    fields = strings(("skills", "abilities", "career_path_next"))
    return part_records(spark, sf_dir).select(
        "record_id", display.combined_text().alias("combined"), display.title_alias_text().alias("title_alias"),
        display.record_context(fields).alias("context"), display.answer_one(fields).alias("answer"))


def record_details(spark, sf_dir):
    shown = display.detail(F.array(F.lit("knowledge"), F.lit("tools")))
    return part_records(spark, sf_dir).select("record_id", F.posexplode(shown["fields"]).alias("pos", "f")).select(
        "record_id", "pos", F.col("f.key").alias("key"), F.col("f.label").alias("label"),
        F.col("f.value").alias("value"), F.size("f.items").alias("n_items"), F.col("f.primary").alias("is_primary"))


def draft_offers(spark, sf_dir):
    related = F.when(F.col("tools") == "-", F.array().cast("array<string>")).otherwise(F.array("tools", "aliases"))
    return part_records(spark, sf_dir).select("record_id", display.draft_offer(display.record_cells(), related).alias("offer"))


# ------------------------------------------------------------------------------- SQL
_STATES = "CASE WHEN {c} THEN {a} ELSE {b} END"


def _sql_texts(expression: str, name: str) -> str:
    return f"SELECT doc_id, {expression} AS {name} FROM documents"


_SQL_MARKDOWN = "text"
for _mark in (r"\*\*(.*?)\*\*", r"\*(.*?)\*", "`(.*?)`"):
    _SQL_MARKDOWN = f"regexp_replace({_SQL_MARKDOWN}, '{_mark}', '\\1', 'g')"
_SQL_MARKDOWN = sql_strip(f"regexp_replace({_SQL_MARKDOWN}, '#{{1,6}}[{WS}]?', '', 'g')")

_SQL_SEPARATORS = f"regexp_replace(text, '[{WS}]*،[{WS}]*', ' | ', 'g')"
_SQL_SEPARATORS = f"regexp_replace({_SQL_SEPARATORS}, '[{WS}]*,[{WS}]*', ' | ', 'g')"
_SQL_SEPARATORS = f"regexp_replace({_SQL_SEPARATORS}, '{_BAR_COMMA}', ' | ', 'g')"
_SQL_SEPARATORS = f"trim(regexp_replace({_SQL_SEPARATORS}, '(\\|[{WS}]*)+', '| ', 'g'), ' |')"

# A table of year starts from the residues of leap years, and one of month starts, joined by range.
_SQL_JALALI = """
year_days AS (SELECT y, 365 + (y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30))::INT AS n FROM range(979, 1600) t(y)),
year_starts AS (SELECT y AS jy, DATE '1600-03-20' + (sum(n) OVER (ORDER BY y) - n)::INT AS opens,
  DATE '1600-03-20' + (sum(n) OVER (ORDER BY y))::INT AS closes FROM year_days),
month_starts AS (SELECT unnest(range(1, 13)) AS jm, unnest([0, 31, 62, 93, 124, 155, 186, 216, 246, 276, 306, 336]) AS gone,
  unnest([31, 62, 93, 124, 155, 186, 216, 246, 276, 306, 336, 366]) AS next_gone),
jal AS (SELECT moments.*, jy, jm, (d::DATE - opens::DATE) - gone + 1 AS jd FROM moments
  JOIN year_starts ON d >= opens AND d < closes
  JOIN month_starts ON d::DATE - opens::DATE >= gone AND d::DATE - opens::DATE < next_gone)"""
_FA = lambda x: f"translate(({x})::VARCHAR, '{fv.LATIN_DIGITS}', '{fv.PERSIAN_DIGITS}')"


def _sql_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


_SQL_INTENT = "CASE " + " ".join(
    f"WHEN {_sql_any('q', p)} THEN '{i}'" for i, p in LATIN_INTENTS.items()) + " ELSE 'general' END"
_SQL_FIELDS = "CASE intent " + " ".join(
    f"WHEN '{i}' THEN '{','.join(f)}'" for i, f in fv.INTENT_FIELDS.items()) + " END"


def _sql_field_lines(fields) -> str:
    return ("concat_ws(chr(10), " + ", ".join(
        f"CASE WHEN {f} <> '' THEN '{fv.LABELS[f]}: ' || {f} END" for f in fields) + ")")


def _sql_detail(key: str, no: int, primary: bool) -> str:
    prose = key in fv.PROSE_COLUMNS
    items = "0" if prose else f"len({sql_items(key)})"
    value = f"{sql_strip(key)}" if prose else f"array_to_string({sql_items(key)}, '، ')"
    usable = f"{sql_strip(key)} NOT IN ('', '-', '–', '—', '_')" + ("" if prose else f" AND {items} > 0")
    return (f"SELECT record_id, {no} AS no, '{key}' AS key, '{fv.LABELS[key]}' AS label, {value} AS value, "
            f"{items} AS n_items, {str(primary).lower()} AS is_primary FROM records WHERE {usable}")


_CONTEXT = f"""concat_ws(chr(10), '{fv.LABELS['job_title']}: ' || job_title,
  CASE WHEN aliases <> '' THEN '{fv.LABELS['aliases']}: ' || aliases END,
  nullif({_sql_field_lines(('skills', 'abilities', 'career_path_next'))}, ''))"""

QUERIES = {f.__name__: f for f in (
    text_normalize, markdown_strip, separator_normalize, prose_repair, item_clean, match_keys, text_keys,
    corpus_digest, item_split, word_tokens, printable_text, digit_folding, contact_audit, display_names,
    client_keys, json_reply_parse, jalali_dates, jalali_monthly, intent_classify, request_classify,
    record_texts, record_details, draft_offers)}

ORACLE = {
    "text_normalize": _sql_texts(sql_normalize("text"), "norm"),
    "markdown_strip": _sql_texts(_SQL_MARKDOWN, "plain"),
    "separator_normalize": _sql_texts(_SQL_SEPARATORS, "cell"),
    "prose_repair": _sql_texts(
        f"CASE WHEN contains(text, '|') THEN {sql_strip(f'''regexp_replace(text, '{_BAR_COMMA}', '، ', 'g')''')} "
        "ELSE text END", "prose"),
    "item_clean": _sql_texts(sql_squeeze("replace(text, '|', '/')"), "item"),
    "match_keys": _sql_texts(sql_match_key("text"), "match_key"),
    "text_keys": _sql_texts(f"sha256('{fv.DEFAULT_MODEL}' || chr(31) || text)", "key"),
    "corpus_digest": f"""
WITH g AS (SELECT lang AS grp, count(*) AS n, sum(('0x' || substr(sha256(text), 1, 15))::BIGINT) AS h
  FROM documents GROUP BY lang)
SELECT sum(n)::BIGINT AS n_texts, substr(sha256('{fv.DEFAULT_MODEL}' || chr(31) ||
  string_agg(grp || ':' || n || ':' || h, chr(30) ORDER BY grp)), 1, 12) AS digest FROM g""",
    "item_split": f"""SELECT doc_id, len(i) AS n_items, array_to_string(i, chr(10)) AS items
FROM (SELECT doc_id, {sql_items('text')} AS i FROM documents)""",
    "word_tokens": f"""SELECT doc_id, array_to_string(list_sort(list_filter({sql_words('text', fv.TITLE_SEPARATORS)},
  lambda w: w NOT IN ({', '.join(f"'{w}'" for w in fv.QUESTION_WORDS)}))), ' ') AS title_words,
  array_to_string(list_sort({sql_words('text', fv.ITEM_SEPARATORS, True)}), ' ') AS item_words FROM documents""",
    "printable_text": f"""SELECT conv_id, turn, array_to_string(list_transform(string_split(
  regexp_replace(text, '[^{fv.ALWAYS_PRINTABLE}A-Za-z0-9.,]', '', 'g'), chr(10)), lambda l: {sql_strip('l')}), chr(10)) AS shown
FROM conversations""",
    "digit_folding": f"""SELECT o_orderkey, {_FA("o_orderkey || '/' || o_orderpriority")} AS persian,
  o_orderkey || '/' || o_orderpriority AS ascii FROM orders""",
    "contact_audit": f"""
WITH raw AS (SELECT c_custkey, '+98 (' || c_nationkey || ') ' || CASE WHEN c_acctbal > 0 THEN c_custkey::VARCHAR ELSE 'x' END
    || '078' AS p, lower(c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN ' at ' ELSE '@' END || c_mktsegment || '.example') AS e
  FROM customer),
ok AS (SELECT *, regexp_full_match(p, '[0-9+\\-() ]{{7,32}}') AND length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7 AS pv,
  regexp_full_match(e, '[^@{WS}]+@[^@{WS}]+\\.[A-Za-z]{{2,}}') AS ev FROM raw)
SELECT c_custkey, CASE WHEN pv THEN p END AS phone, pv AS phone_ok, CASE WHEN ev THEN e END AS email, ev AS email_ok FROM ok""",
    "display_names": """
WITH n AS (SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS f,
  CASE WHEN c_acctbal < 5000 THEN NULL ELSE c_mktsegment END AS l FROM customer),
j AS (SELECT c_custkey, c_name, CASE WHEN f IS NULL THEN l WHEN l IS NULL THEN f ELSE f || ' ' || l END AS full_name FROM n)
SELECT c_custkey, full_name, coalesce(full_name, c_name) AS shown FROM j""",
    "client_keys": """
WITH s AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN user_id::VARCHAR ELSE event_type END AS trusted,
  CASE WHEN event_type <> 'click' THEN event_type ELSE 'unknown' END AS direct FROM events)
SELECT event_id, trusted, direct, trusted || '|' || event_type AS login_key FROM s""",
    "json_reply_parse": f"""
WITH e AS (SELECT *, regexp_replace(props, '["{{}}]', '', 'g') AS props_text FROM events),
r AS (SELECT event_id, props, {_REPLY.replace("@NL@", chr(92) + "n")} AS reply FROM e),
s AS (SELECT *, regexp_extract(reply, '(?s)\\{{.*\\}}') AS span FROM r),
o AS (SELECT *, CASE WHEN json_valid(span) THEN span::JSON END AS obj FROM s),
f AS (SELECT event_id, props, obj, {sql_normalize("json_extract_string(obj, '$.job_title')")} AS t,
  {sql_normalize("json_extract_string(obj, '$.description')")} AS d, {sql_normalize("json_extract_string(obj, '$.work_context')")} AS w,
  {sql_normalize("json_extract_string(obj, '$.tools')")} AS x,
  lower(trim(coalesce(json_extract_string(obj, '$.not_a_job'), ''))) = 'true' AS bad FROM o),
g AS (SELECT event_id, props, obj, bad, x, {', '.join(f"trim(regexp_replace({c}, '{_BAR_COMMA}', '، ', 'g'), '، ') AS {c}" for c in 'tdw')} FROM f),
h AS (SELECT *, CASE WHEN obj IS NULL THEN 'unavailable' WHEN bad THEN 'not_a_job' WHEN t = '' THEN 'unavailable'
  ELSE 'generated' END AS status FROM g)
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, status, CASE WHEN status = 'generated' THEN t END AS job_title,
  CASE WHEN status = 'generated' THEN d END AS description, CASE WHEN status = 'generated' THEN w END AS work_context,
  CASE WHEN status = 'generated' THEN x END AS tools FROM h""",
    "jalali_dates": f"""
WITH moments AS (SELECT o_orderkey, m, m::DATE AS d FROM (SELECT o_orderkey,
  o_orderdate::TIMESTAMP + to_hours(o_orderkey % 24) + INTERVAL 45 MINUTE + INTERVAL 210 MINUTE AS m FROM orders)),{_SQL_JALALI}
SELECT o_orderkey, printf('%04d-%02d-%02d', jy, jm, jd) AS slug, {_FA('jd')} || ' ' ||
  list_extract([{', '.join(f"'{m}'" for m in fv.JALALI_MONTHS)}], jm::BIGINT) || ' ' || {_FA('jy')} || ' — {fv.CLOCK_WORD} ' ||
  {_FA("strftime(m, '%H:%M')")} AS shown FROM jal""",
    "jalali_monthly": f"""
WITH moments AS (SELECT o_totalprice, o_orderdate::DATE AS d FROM orders),{_SQL_JALALI}
SELECT jy, jm, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM jal GROUP BY jy, jm""",
    "intent_classify": f"""
WITH c AS (SELECT conv_id, turn, {sql_normalize('text')} AS q FROM conversations),
w AS (SELECT *, {_SQL_INTENT} AS first_intent, list_distinct(list_filter(string_split(q, ' '), lambda t: t <> '')) AS words FROM c),
i AS (SELECT *, CASE WHEN first_intent = 'general' AND len(words) <= 4 AND NOT {_sql_any('q', fv.QUESTION_MARKS)}
  AND NOT list_has_any(words, ['the', 'les']) THEN 'description' ELSE first_intent END AS intent FROM w)
SELECT conv_id, turn, first_intent, intent, {_SQL_FIELDS} AS fields FROM i""",
    "request_classify": f"""
WITH c AS (SELECT conv_id, turn, {sql_normalize('text')} AS q FROM conversations)
SELECT conv_id, turn, {_sql_any('q', LATIN_REQUESTS)}
  OR regexp_matches(q, 'an?d .{{0,40}}the') OR regexp_matches(q, 'une? .{{0,120}}eau') AS wants,
  {_sql_any('q', ('both', 'les deux', 'and '))} AS combines FROM c""",
    "record_texts": f"""
WITH {SQL_PART_RECORDS}
SELECT record_id, {sql_combined()} AS combined, trim(job_title || ' ، ' || replace(aliases, '|', '،'), ' ،') AS title_alias,
  {_CONTEXT} AS context,
  '📌 ' || job_title || chr(10) || chr(10) || {_sql_field_lines(('skills', 'abilities', 'career_path_next'))} AS answer FROM records""",
    "record_details": f"""
WITH {SQL_PART_RECORDS},
boxes AS ({' UNION ALL '.join(_sql_detail(k, n, k in ('knowledge', 'tools')) for n, k in enumerate(fv.DETAIL_FIELDS))})
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY is_primary DESC, no) - 1 AS pos, key, label, value,
  n_items, is_primary FROM boxes""",
    "draft_offers": f"""
WITH {SQL_PART_RECORDS}
SELECT record_id, concat_ws(chr(10), '{fv.DRAFT_HEADER}', '', '📌 {fv.LABELS['job_title']}: ' || job_title,
  CASE WHEN description <> '' THEN '{fv.LABELS['description']}: ' || description END,
  CASE WHEN tools <> '-' THEN chr(10) || '{fv.RELATED_LABEL}: ' || tools || '، ' || aliases END,
  '', '{fv.DRAFT_QUESTION}') AS offer FROM records""",
}
