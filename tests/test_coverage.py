"""Item coverage and profile ranking against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom import fixed_values as fv
from recordloom.operators import coverage as C
from recordloom.operators import shuffle, validate
from recordloom.plans import profiles as P

SPLIT = re.compile(r"[\s،,;؛/|()\[\]\-–—.]+")


def tokens(text):
    return {t for t in SPLIT.split(text.lower()) if len(t) >= 4}


def meets(a, b):
    return a.startswith(b) or b.startswith(a)


def covers(small, large):
    return all(any(meets(s, t) for t in large) for s in small)


def pieces(field, cell):
    if field in fv.PROSE_COLUMNS:
        return [cell] if cell.strip() not in fv.BLANK_CELLS else []
    return [p.strip() for p in cell.split("|") if p.strip() not in fv.BLANK_CELLS]


def hit(item, field, cell):
    user = tokens(item)
    own = [tokens(p) for p in pieces(field, cell)]
    if not user:
        return False
    return any(o and covers(o, user) for o in own) or covers(user, set().union(*own))


WORDS = ["data", "database", "databases", "design", "designer", "system", "systems", "operate", "operating", "clothing", "cloth", "of", "ab", "dat"]


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    phrase = lambda: " ".join(rng.choices(WORDS, k=rng.randint(1, 3)))
    records = [(i, " | ".join(phrase() for _ in range(rng.randint(0, 4))), phrase() if rng.random() < .8 else "-") for i in range(60)]
    profiles = [(p, f, n, phrase()) for p in range(6) for f in ("skills", "work_context") for n in range(rng.randint(1, 6))]
    r = spark.createDataFrame(records, "record_id long, skills string, work_context string")
    for c in fv.RECORD_COLUMNS:
        if c not in r.columns:
            r = r.withColumn(c, F.concat(F.lit("t"), F.col("record_id").cast("string")) if c == "job_title" else F.lit(""))
    vec = lambda i: [((i * 7 + k * 3) % 11 - 5) / 16.0 for k in range(4)]
    vr = spark.createDataFrame([(i, vec(i)) for i in range(60)], "record_id long, full_vec array<float>")
    vp = spark.createDataFrame([(p, vec(p + 100)) for p in range(6)], "profile_id long, query_vec array<float>")
    p = spark.createDataFrame(profiles, "profile_id long, field string, pos long, item string")
    return records, profiles, r.join(vr, "record_id"), p, vp, vec


def _expected(records, profiles):
    kept = {}
    for p, f, n, item in profiles:
        kept.setdefault((p, f), {}).setdefault(item.lower(), item)
    out = {}
    for rid, skills, context in records:
        cell = {"skills": skills, "work_context": context}
        for p in {k[0] for k in kept}:
            items = [(f, i) for (q, f), d in kept.items() if q == p for i in d.values()]
            out[p, rid] = [(f, i, hit(i, f, cell[f])) for f, i in items]
    return out


@pytest.mark.parametrize("limit", [shuffle.BROADCAST_BYTES, -1])
def test_ratios(spark, case, monkeypatch, limit):
    records, profiles, r, p, _, _ = case
    monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
    cleaned = C.clean_profiles(p)
    got = {(x["profile_id"], x["doc_id"]): x["coverage"] for x in C.coverage_ratios(r, "record_id", cleaned, C.ProfileIndex(cleaned)).collect()}
    want = {k: sum(h for _, _, h in v) / len(v) for k, v in _expected(records, profiles).items()}
    assert got == pytest.approx({k: v for k, v in want.items() if v})


def test_rank_and_breakdown(spark, case):
    records, profiles, r, p, vp, vec = case
    cleaned = C.clean_profiles(p)
    ranked = P.profile_rank(r, cleaned, vp).collect()
    want = _expected(records, profiles)
    dot = lambda p_, d: sum(a * b for a, b in zip(vec(p_ + 100), vec(d)))
    score = {k: .5 * dot(*k) + .5 * sum(h for _, _, h in v) / len(v) for k, v in want.items()}
    for q in range(6):
        order = sorted(range(60), key=lambda d: (-round(score[q, d], 9), d))[:5]
        assert {x["rank"]: x["doc_id"] for x in ranked if x["profile_id"] == q} == {n + 1: d for n, d in enumerate(order)}
    rows = P.analyze_batch(r, p, vp).collect()
    for row in rows:
        assert row["mode"] == "profile_match" and len(row["matches"]) == 5
        for m in row["matches"]:
            facts = want[row["profile_id"], int(m["job_title"][1:])]
            for f in m["fields"]:
                assert f["matched"] == [i for g, i, h in facts if g == f["key"] and h]
                assert f["missing"] == [i for g, i, h in facts if g == f["key"] and not h]


def test_design_pair_stays_apart(spark):
    r = spark.createDataFrame([(1, "طراحی لباس"), (2, "برنامه‌نویسی پایتون"), (3, "مهارت مکانیکی | برق خودرو")], "record_id long, skills string")
    p = spark.createDataFrame([(1, "skills", 0, "طراحی سیستم"), (1, "skills", 1, "پایتون"), (1, "skills", 2, "مکانیک خودرو")],
                              "profile_id long, field string, pos long, item string")
    cleaned = C.clean_profiles(p)
    got = C.coverage_ratios(r, "record_id", cleaned, C.ProfileIndex(cleaned)).collect()
    assert {x["doc_id"]: x["n_matched"] for x in got} == {2: 1, 3: 1}


def test_a_shared_prefix_makes_no_candidates(spark):
    profiles = spark.range(300).selectExpr("1L AS profile_id", "'skills' AS field", "concat('sharedu', id) AS item")
    index = C.ProfileIndex(profiles)
    own = spark.range(300).selectExpr("id", "'skills' AS field", "concat('sharedr', id) AS own")
    met = index.met_words(own.union(spark.sql("SELECT 300L, 'skills', 'sharedu7'")), "own")
    # The join's own rows: each is a match, and nothing is filtered after it.
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Filter")
    assert {r["met"] for r in met.collect()} == {"sharedu7", *(f"sharedu{i}" for i in range(70, 80))}


def test_gate_and_empty_profiles(spark, case):
    _, _, r, _, vp, _ = case
    p = spark.createDataFrame([(0, "skills", 0, "unheard"), (0, "tools", 1, "data"), (1, "skills", 0, " - ")],
                              "profile_id long, field string, pos long, item string")
    rows = {x["profile_id"]: x for x in P.analyze_batch(r, p, vp).collect()}
    assert rows[0]["mode"] == "out_of_domain" and rows[0]["score"] is not None and rows[0]["matches"] == []
    assert rows[1]["mode"] == "out_of_domain" and rows[1]["score"] is None and rows[1]["answer"] == fv.PROFILE_NONE


def test_clean_profiles(spark):
    p = spark.createDataFrame([(1, "skills", 0, " Python "), (1, "skills", 1, "python"), (1, "skills", 2, "-"), (1, "hobby", 3, "x"), (1, "skills", 4, "كار")],
                              "profile_id long, field string, pos long, item string")
    rows = C.profile_fields(C.clean_profiles(p)).first()["fields"]
    assert [(f["key"], f["items"]) for f in rows] == [("skills", ["Python", "کار"])]


def test_profile_rules(spark):
    rows = [(1, "skills", i, "x") for i in range(2)] + [(1, "knowledge", 0, "k")]
    rows += [(2, "skills", i, " ") for i in range(21)] + [(2, "hobby", 0, "k")]
    rows += [(3, "skills", 0, "a"), (3, "skills", 1, "b" * 121)]
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "profile_id long")
    got = validate.validate_profiles(spark.createDataFrame(rows, "profile_id long, field string, pos long, item string"), ids).collect()
    by = lambda i: {r["violation"] for r in got if r["profile_id"] == i}
    assert by(1) == set()
    assert by(2) == {"unknown_field", "too_many_items", "required_items", "min_fields"}
    assert by(3) == {"item_too_long", "min_fields"}
    assert by(4) == {"required_items", "min_fields"}


@pytest.mark.parametrize("block", [256, 4])
def test_profile_rank_by_blocks(spark, block, monkeypatch):
    """The same ranks from any number of blocks, with no list longer than a block."""
    rng = random.Random(9)
    words = [f"word{c}{d}" for c in "abcdef" for d in "xyz"]
    items = lambda n: " | ".join(" ".join(rng.sample(words, rng.randint(1, 2))) for _ in range(n))
    records = spark.createDataFrame([(i, items(5), [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)],
                                    "record_id long, skills string, full_vec array<double>")
    rows = [(p, "skills", k, item) for p in range(11) for k, item in enumerate(items(4).split(" | "))]
    profiles = C.clean_profiles(spark.createDataFrame(rows, "profile_id long, field string, pos int, item string"))
    vectors = spark.createDataFrame([(p, [rng.gauss(0, 1) for _ in range(4)]) for p in range(11)], "profile_id long, query_vec array<double>")
    longest, lists = [], P.covered_lists
    monkeypatch.setattr(P, "covered_lists", lambda *a, **k: longest.append(
        lists(*a, **k).agg(F.max(F.size("bonus"))).first()[0]) or lists(*a, **k))
    got = {(r["profile_id"], r["rank"]): (r["doc_id"], round(r["score"], 9), r["coverage"])
           for r in P.profile_rank(records, profiles, vectors, top=6, block=block).collect()}
    pairs = {(r["doc_id"], r["profile_id"]): r["coverage"] for r in
             C.coverage_ratios(records, "record_id", profiles, C.ProfileIndex(profiles)).collect()}
    held, asked = {r[0]: r[2] for r in records.collect()}, dict(map(tuple, vectors.collect()))
    for p in range(11):
        score = {d: 0.5 * sum(a * b for a, b in zip(v, asked[p])) + 0.5 * pairs.get((d, p), 0) for d, v in held.items()}
        best = sorted(score, key=lambda d: (-round(score[d], 9), d))[:6]
        assert [got[p, n + 1] for n in range(6)] == [(d, pytest.approx(score[d], abs=1e-8), pytest.approx(pairs.get((d, p), 0), abs=1e-8)) for d in best]
    assert len(longest) == -(-11 // block) and max(longest) <= block


def _odd_records(spark):
    """Odd cells and ids: separators, letters beyond ASCII, blank and missing cells, ids that repeat or are missing."""
    rng = random.Random(5)
    words = [*WORDS, "Straße", "STRASSE", "İstanbul", "ΟΔΟΣ", "οδοσ", "طراحی", "طراح", "x\u2003data", "e-design", "a|b"]
    phrase = lambda: rng.choice([" ", "\t", "\u00a0", ", ", "/"]).join(rng.choices(words, k=rng.randint(1, 3)))
    rows = [(i, rng.choice([None, "", " - ", " | ".join(phrase() for _ in range(3))]), rng.choice([None, "—", phrase()]),
             [rng.gauss(0, 1) for _ in range(3)]) for i in [*range(40), *range(5), 3, None, None]]
    records = spark.createDataFrame(rows, "record_id long, skills string, work_context string, full_vec array<double>").repartition(3)
    items = [(p, f, n, phrase()) for p in range(7) for f in ("skills", "work_context", "knowledge") for n in range(4)]
    return records, C.clean_profiles(spark.createDataFrame(items, "profile_id long, field string, pos long, item string"))


def _ratios(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_covered_in_place_equal_the_joins(spark, monkeypatch):
    records, profiles = _odd_records(spark)
    placed = _ratios(C.coverage_ratios(records, "record_id", profiles, C.ProfileIndex(profiles)))
    vectors = spark.createDataFrame([(p, [p - 3.0, 1.0, 0.5]) for p in range(7)], "profile_id long, query_vec array<double>")
    ranked = lambda **k: _ratios(P.profile_rank(records.filter("record_id IS NOT NULL"), profiles, vectors, **k).withColumn("score", F.round("score", 9)))
    in_place = ranked()
    assert in_place == ranked(block=3) and in_place
    for few in (1, 1 << 22):  # one row at a time, and no table of products
        monkeypatch.setattr(C, "_CELLS", few)
        assert _ratios(C.coverage_ratios(records, "record_id", profiles, C.ProfileIndex(profiles))) == placed
    monkeypatch.setattr(C, "BROADCAST_BYTES", -1)
    assert _ratios(C.coverage_ratios(records, "record_id", profiles, C.ProfileIndex(profiles))) == placed and placed
    assert ranked() == in_place


def test_few_known_words_are_enough():
    forms = [("data", "design"), ("systems",), ("oper",)]
    table = C._FieldForms("skills", forms, [[(0, 2)], [(0, 1), (1, 3)], [(1, 1)]], 2)
    table.most = 2
    cells = [["data | designer"], ["system"], ["operate | x"], [], ["", "designs data systems"]]
    one = [table.hits(C.pa.array([c], C.pa.list_(C.pa.string())))[0].tolist() for c in cells]
    assert one == table.hits(C.pa.array(cells, C.pa.list_(C.pa.string()))).tolist()
    assert one == [[True, False, False], [False, True, False], [False, False, True], [False] * 3, [True, True, False]]
    assert table.matched(C.np.array(one)).tolist() == [[2, 0], [1, 3], [0, 1], [0, 0], [3, 3]]


def test_records_are_covered_without_a_row_per_pair(spark):
    """Neither a shuffle nor a row per record, form and profile: their number grew with records times profiles."""
    records = spark.range(30).selectExpr("id AS record_id", "concat('shared ', id) AS skills", "array(1D) AS full_vec")
    profiles = spark.range(20).selectExpr("id AS profile_id", "'skills' AS field", "1 AS field_no", "0 AS pos", "'shared' AS item")
    index = C.ProfileIndex(profiles)
    lists = P.covered_lists(C.field_texts(records, "record_id", ["skills"], ["full_vec"]), profiles, index, ["skills"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Generate", "Join")) and "MapInArrow" in plan
    assert [len(r["bonus"]) for r in lists.collect()] == [20] * 30


def test_shown_records_are_read_once(spark, case, monkeypatch):
    """Cells are made for the records that are shown, not for all."""
    _, _, r, p, vp, _ = case
    kept, store = {}, P.stored
    monkeypatch.setattr(P, "stored", lambda df, label: kept.setdefault(label, store(df, label)))
    ranked = P.analyze_batch(r, p, vp).collect()
    shown = {m["job_title"] for row in ranked for m in row["matches"]}
    assert {f"t{x['record_id']}" for x in kept["picked"].collect()} == shown and 0 < len(shown) <= 30
