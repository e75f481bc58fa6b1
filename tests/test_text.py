import json
import re

import pytest
from pyspark.sql import Row, functions as F

from recordloom import fixed_values as fv
from recordloom.functions import display, identity, intent, text as T

BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0       　"


@pytest.mark.parametrize("raw, wanted", [
    (None, ""), ("", ""), (f"{BLANKS}ي{BLANKS}ك{BLANKS}", "ی ک"), ("a‌b", "a‌b"), ("  x  y ", "x y")])
def test_normalize(one, raw, wanted):
    assert one(T.normalize(F.lit(raw).cast("string"))) == wanted


@pytest.mark.parametrize("raw, wanted", [
    ("**b** and *i* and `c`", "b and i and c"), ("## head # tail", "head tail"), ("#######x", "x"),
    ("*a\nb*", "*a\nb*"), ("　x\x1f", "x")])
def test_strip_markdown(one, raw, wanted):
    assert one(T.strip_markdown(F.lit(raw))) == wanted


@pytest.mark.parametrize("raw, wanted", [
    ('say {"a": "x"} ok', {"a": "x"}), ('{"a": {"b": 1}}', {"a": '{"b":1}'}), ('{"a": 1} {"b": 2}', None), ('{"a": 1},{"b": 2}', None),
    ("none", None), ("[1]", None), ('{"a":', None), ("{'a': 1}", None), ('x\n{"a":\n"b"}\n', {"a": "b"}), ("", None), (None, None)])
def test_parse_object(one, raw, wanted):
    assert one(T.parse_object(F.lit(raw).cast("string"))) == wanted


def test_repeated_key_takes_the_last(one):
    assert one(T.object_value(T.parse_object(F.lit('{"a": "1", "b": "2", "a": "3"}')), "a")) == "3"
    assert one(T.object_value(T.parse_object(F.lit('{"a": "1"}')), "zz")) is None


@pytest.mark.parametrize("raw, wanted", [
    ("a، b ,c", "a | b | c"), ("a , ، b", "a | b"), ("| a || b |", "a | b"), (",", ""), ("plain", "plain"), (None, None)])
def test_unify_separators(one, raw, wanted):
    assert one(T.unify_separators(F.lit(raw).cast("string"))) == wanted


def test_prose_and_keys(one):
    assert one(T.repair_prose(F.lit(" a |b "))) == "a، b"
    assert one(T.repair_prose(F.lit(" a "))) == " a "
    assert one(T.match_key(F.lit("مدير|كار،  x"))) == "مدیر ، کار ، x"
    assert one(T.clean_item(F.lit("a|b \n c"))) == "a/b c"


def test_list_items(one):
    assert one(T.list_items(F.lit("a | - | — |b||_ | –"))) == ["a", "b"]
    assert one(T.list_items(F.lit(None).cast("string"))) == []
    assert one(T.cell_items("description", F.lit(" a|b "))) == ["a|b"]
    assert one(T.cell_items("description", F.lit(" - "))) == []
    assert one(T.cell_items("description", F.lit("a|b"), prose_whole=False)) == []


def test_tokens(one):
    assert one(T.title_tokens(F.lit("Officer/of (Artillery)–Units چیست Officer"))) == ["Officer", "Artillery", "Units"]
    assert one(T.item_tokens(F.lit("Data.Base; [Tuning]، data—base of"))) == ["data", "base", "tuning"]
    assert one(T.lexical_tokens(F.lit("  The the　CAT "))) == ["the", "the", "cat"]


def test_digits(one):
    assert one(T.fold_digits_latin(F.lit("۰۹٠٩x"))) == "0909x"
    assert one(T.fold_digits_persian(F.lit(1405))) == "۱۴۰۵"


@pytest.mark.parametrize("raw, wanted", [
    ("📌 افسران توپخانه", "افسران توپخانه"), ("🔗 نقش تلفیقی: الف + ب", "نقش تلفیقی: الف + ب"),
    ("می‌شود", "می‌شود"), ("خط اول\nخط دوم", "خط اول\nخط دوم")])
def test_drawable(one, raw, wanted):
    assert one(T.drawable(F.lit(raw), "\\p{L}\\p{P}\\p{N}+")) == wanted


@pytest.mark.parametrize("raw, value, ok", [
    (" +۹۸ (۲۱) 123-4567 ", "+98 (21) 123-4567", True), ("12345", None, False), ("()()()()", None, False), ("  ", None, True),
    (None, None, True), ("1234567x", None, False), ("1" * 33, None, False)])
def test_phone(one, raw, value, ok):
    assert one(identity.phone(F.lit(raw).cast("string"))) == Row(value=value, is_valid=ok)


@pytest.mark.parametrize("raw, value, ok", [
    (" A.B@X.Org ", "a.b@x.org", True), ("a@b", None, False), ("a b@c.de", None, False), ("a@b.c", None, False), ("", None, True)])
def test_email(one, raw, value, ok):
    assert one(identity.email(F.lit(raw))) == Row(value=value, is_valid=ok)


def test_names(one):
    lit = lambda v: F.lit(v).cast("string")
    assert one(identity.full_name(lit("Zahra"), lit("Karimi"))) == "Zahra Karimi"
    assert one(identity.full_name(lit(""), lit("Karimi"))) == "Karimi"
    assert one(identity.full_name(lit(None), lit(""))) is None
    assert one(identity.display_name(lit(None), lit(None), lit("u1"))) == "u1"


def test_client_source_takes_the_last_hop(one):
    lit = lambda v: F.lit(v).cast("string")
    assert one(identity.client_source(lit("1.1.1.1, 2.2.2.2 "), lit("9.9.9.9"), True)) == "2.2.2.2"
    assert one(identity.client_source(lit("1.1.1.1"), lit("9.9.9.9"), False)) == "9.9.9.9"
    assert one(identity.client_source(lit(""), lit(None), True)) == "unknown"
    assert one(identity.login_key(lit("h"), lit("  Ali "))) == "h|ali"


def test_text_key(one):
    import hashlib
    assert one(identity.text_key(F.lit("متن"))) == hashlib.sha256((fv.DEFAULT_MODEL + "\x1f" + "متن").encode()).hexdigest()


def test_ordered_digest(spark):
    digest = lambda rows: identity.ordered_digest(
        spark.createDataFrame(rows, "grp string, seq int, text string"), "grp", "seq", "text")
    base = [("a", 1, "x"), ("a", 0, "y"), ("b", 0, "z")]
    assert digest(base) == digest(base[::-1]) and len(digest(base)) == 12
    assert digest(base) != digest([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")])  # the positions count
    assert digest(base) != digest([("b", 1, "x"), ("a", 0, "y"), ("a", 0, "z")])
    assert digest(base) != digest(base[:2])


def test_corpus_digest_ignores_order_but_not_content(spark):
    base = [("a", "x"), ("a", "y"), ("b", "z")]
    digest = lambda rows: identity.corpus_digest(spark.createDataFrame(rows, "g string, t string"), "g", "t").first()["digest"]
    assert digest(base) == digest(base[::-1])
    assert digest(base) != digest(base + [("b", "z")])
    assert digest(base) != digest([("a", "x"), ("b", "y"), ("b", "z")])


@pytest.mark.parametrize("question, wanted", [
    ("وظایف افسر توپخانه چیست؟", "responsibilities"), ("ابزارهای فرمانده تانک چیست؟", "tools"),
    ("مسیر ارتقای افسر مرکز فرماندهی", "career_path"), ("محیط کاری راننده زره‌پوش چگونه است؟", "work_context"),
    ("مهارت و دانش لازم", "competencies"), ("معلم جغرافیا", "description"), ("معلم جغرافیا؟", "general"),
    ("معلم جغرافیا در شهر بزرگ ما", "general"), ("کدام معلم", "general")])
def test_intent(one, question, wanted):
    assert one(intent.question_intent(F.lit(question))) == wanted


@pytest.mark.parametrize("question, wanted", [
    ("یه کاری که توش با حیوانات کار کنم", True), ("دنبال یک حرفه آرام می‌گردم شغلی", True), ("چه شغلی", True),
    ("شغلی می‌خواهم", True), ("محیط کاری راننده زره‌پوش چگونه است؟", False), ("یک مهندس چه کاری انجام می‌دهد؟", False),
    ("محیط کاری مناسب برای پرستار چیست؟", False)])
def test_request(one, question, wanted):
    assert one(intent.is_request(F.lit(question))) == wanted


def test_intent_fields(one):
    assert one(intent.intent_fields(F.lit("competencies"))) == ["skills", "abilities"]
    assert one(intent.intent_fields(F.lit("nonsense"))) == list(fv.INTENT_FIELDS["general"])
    assert one(intent.is_combination(F.lit("ترکیب دو نقش"))) is True


def _record(spark, **cells):
    return spark.createDataFrame([{c: cells.get(c, "") for c in fv.RECORD_COLUMNS}])


def test_record_texts(spark):
    df = _record(spark, job_title="T", aliases="a | b", skills="s1 | - | s2", description="d|e")
    L = fv.LABELS
    row = df.select(display.combined_text().alias("c"), display.title_alias_text().alias("t"),
                    display.record_context(F.array(F.lit("skills"), F.lit("tools"))).alias("x"),
                    display.answer_one(F.array(F.lit("description"))).alias("a")).first()
    assert row["c"] == f"{L['job_title']}: T . {L['aliases']}: a ، b . {L['description']}: d|e . {L['skills']}: s1 | - | s2"
    assert row["t"] == "T ، a ، b"
    assert row["x"] == f"{L['job_title']}: T\n{L['aliases']}: a | b\n{L['skills']}: s1 | - | s2"
    assert row["a"] == f"📌 T\n\n{L['description']}: d|e"


def test_detail_puts_primary_first_and_keeps_order(spark):
    df = _record(spark, job_title=" T ", aliases="a", skills="s1 | s2", description="d | e", tools=" - ", knowledge="— | -")
    row = df.select(display.detail(F.array(F.lit("skills"), F.lit("aliases"))).alias("d")).first()["d"]
    assert row["job_title"] == "T"
    assert [(f["key"], f["value"], f["items"], f["primary"]) for f in row["fields"]] == [
        ("skills", "s1، s2", ["s1", "s2"], True), ("aliases", "a", ["a"], True), ("description", "d | e", [], False)]


@pytest.mark.parametrize("reply, status, title", [
    ('ok {"job_title": " | Keeper | of bees ،", "not_a_job": "false"}', "generated", "Keeper، of bees"),
    ('{"not_a_job": " TRUE ", "job_title": "x"}', "not_a_job", None), ('{"not_a_job": true}', "not_a_job", None),
    ('{"job_title": "  "}', "unavailable", None), ("no object", "unavailable", None), (None, "unavailable", None)])
def test_clean_draft(one, reply, status, title):
    got = one(display.clean_draft(F.lit(reply).cast("string")))
    assert got["status"] == status
    assert (got["draft"]["job_title"] if got["draft"] else None) == title


def test_profile_answer(one):
    field = lambda label, yes, no: F.struct(F.lit(label).alias("label"), yes.alias("matched"), no.alias("missing"))
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    m = F.array(F.struct(F.lit("J").alias("job_title"), F.array(
        field("S", strings("a", "b"), strings()), field("K", strings(), strings("c"))).alias("fields")))
    assert one(display.profile_answer(m)) == "\n".join([
        fv.PROFILE_HEADER, "", "📌 J", f"S — {fv.PROFILE_COVERED}: a، b", f"K — {fv.PROFILE_UNCOVERED}: c"])
    own = F.array(F.struct(F.lit("skills").alias("key"), strings("a", "c").alias("items")))
    assert one(display.profile_context(own, m)) == "\n".join([
        fv.PROFILE_CONTEXT_HEADER, f"{fv.LABELS['skills']}: a، c", "", f"{fv.PROFILE_CONTEXT_JOB} 1: J",
        f"S — {fv.PROFILE_COVERED}: a، b / {fv.PROFILE_UNCOVERED}: —", f"K — {fv.PROFILE_COVERED}: — / {fv.PROFILE_UNCOVERED}: c"])
    assert one(display.profile_text(own)) == f"{fv.LABELS['skills']}: a، c"


def test_draft_offer(spark):
    df = _record(spark, job_title="T", description="D")
    row = df.select(display.draft_offer(display.record_cells(), F.array(F.lit("x"), F.lit("y"))).alias("o")).first()["o"]
    assert row == "\n".join([fv.DRAFT_HEADER, "", f"📌 {fv.LABELS['job_title']}: T", f"{fv.LABELS['description']}: D", "",
                             f"{fv.RELATED_LABEL}: x، y", "", fv.DRAFT_QUESTION])
