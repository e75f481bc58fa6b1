"""The two-organization world: ten accounts, every role at every level."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.operators import audits, moderation, stats, tenancy as T
from recordloom import fixed_values as fv

IDS = {n: i + 1 for i, n in enumerate(
    ["root", "admin-a", "admin-b", "admin-a1", "admin-a2", "admin-b1", "user-a1", "user-a1b", "user-a2", "user-b1"])}
NAMES = {i: n for n, i in IDS.items()}
DAY = dt.datetime(2026, 1, 2, 3)


@pytest.fixture(scope="module")
def world(spark):
    orgs = spark.createDataFrame([(1, "org-a", DAY), (2, "org-b", None)], "id long, name string, created_at timestamp_ntz")
    units = spark.createDataFrame([(1, "unit-a1", 1, DAY), (2, "unit-a2", 1, DAY), (3, "unit-b1", 2, DAY)],
                                  "id long, name string, organization_id long, created_at timestamp_ntz")
    place = {"root": ("super_admin", None, None), "admin-a": ("org_admin", 1, None), "admin-b": ("org_admin", 2, None),
             "admin-a1": ("unit_admin", None, 1), "admin-a2": ("unit_admin", None, 2), "admin-b1": ("unit_admin", None, 3),
             "user-a1": ("user", None, 1), "user-a1b": ("user", None, 1), "user-a2": ("user", None, 2), "user-b1": ("user", None, 3)}
    users = spark.createDataFrame([(IDS[n], n, r, n != "user-a2", o, u, DAY) for n, (r, o, u) in place.items()],
                                  "id long, username string, role string, is_active boolean, organization_id long, unit_id long, created_at timestamp_ntz")
    return orgs, units, users


def by_actor(df, column="account_id"):
    out = {}
    for r in df.collect():
        out.setdefault(NAMES[r["actor_id"]], set()).add(NAMES[r[column]] if column == "account_id" else r[column])
    return out


@pytest.mark.parametrize("salted", [False, True])
def test_visible_accounts(world, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(T, "broadcast_if_small", lambda df: df)
    orgs, units, users = world
    rows = T.visible_accounts(users, units)
    got = by_actor(rows)
    assert got["root"] == set(IDS)
    assert got["admin-a"] == {"admin-a1", "admin-a2", "user-a1", "user-a1b", "user-a2"}
    assert got["admin-a1"] == {"admin-a1", "user-a1", "user-a1b"}
    assert set(got) == {"root", "admin-a", "admin-b", "admin-a1", "admin-a2", "admin-b1"}
    assert rows.count() == rows.distinct().count()


def test_manageable_accounts(world):
    orgs, units, users = world
    got = by_actor(T.manageable_accounts(users, units))
    assert got["root"] == set(IDS) - {"root"}
    assert got["admin-a"] == {"admin-a1", "admin-a2", "user-a1", "user-a1b", "user-a2"}
    assert got["admin-a1"] == {"user-a1", "user-a1b"}
    assert got["admin-b1"] == {"user-b1"}


def test_containers(world):
    orgs, units, users = world
    assert by_actor(T.managed_units(users, units), "unit_id") == {
        "root": {1, 2, 3}, "admin-a": {1, 2}, "admin-b": {3}, "admin-a1": {1}, "admin-a2": {2}, "admin-b1": {3}}
    assert by_actor(T.managed_units(users, units, organization_id=2), "unit_id") == {"root": {3}, "admin-b": {3}, "admin-b1": {3}}
    assert by_actor(T.managed_organizations(users, orgs), "organization_id") == {"root": {1, 2}, "admin-a": {1}, "admin-b": {2}}
    assert by_actor(T.visible_organizations(users, units, orgs), "organization_id")["admin-a1"] == {1}
    labels = {NAMES[r["actor_id"]]: (r["scope"], r["scope_name"]) for r in T.scope_labels(users, units, orgs).collect()}
    assert labels["root"] == ("global", None) and labels["admin-b"] == ("organization", "org-b") and labels["admin-a2"] == ("unit", "unit-a2")
    blockers = {(r["kind"], r["id"]): (r["units"], r["accounts"]) for r in T.container_blockers(orgs, units, users).collect()}
    assert blockers == {("organization", 1): (2, 1), ("organization", 2): (1, 1), ("unit", 1): (0, 3), ("unit", 2): (0, 2), ("unit", 3): (0, 2)}


def test_account_filters(world):
    orgs, units, users = world
    names = lambda **kw: [r["username"] for r in T.ordered(T.filter_accounts(users, units, **kw), "username").collect()]
    assert names(organization_id=2) == ["admin-b", "admin-b1", "user-b1"]
    assert names(organization_id=1, role="user") == ["user-a1", "user-a1b", "user-a2"]
    assert names(organization_id=1, unit_id=3) == []


def test_totals(world):
    orgs, units, users = world
    got = {NAMES[r["actor_id"]]: tuple(r)[1:] for r in stats.totals(users, units, orgs).collect()}
    assert got["root"] == (2, 3, 10, 9, 1)
    assert got["admin-a"] == (1, 2, 5, 4, 1)
    assert got["admin-a1"] == (1, 1, 3, 3, 0)


def test_roles_and_units_are_zero_filled(world):
    orgs, units, users = world
    roles = {}
    for r in stats.by_role(users, units).collect():
        roles.setdefault(NAMES[r["actor_id"]], {})[r["role"]] = r["accounts"]
    assert [roles["root"][r] for r in fv.ROLES] == [1, 2, 3, 4]
    assert [roles["admin-a1"][r] for r in fv.ROLES] == [0, 0, 1, 2]
    per = {(NAMES[r["actor_id"]], r["name"]): r["accounts"] for r in stats.per_unit(users, units).collect()}
    assert per["admin-a", "unit-a1"] == 3 and per["admin-a", "unit-a2"] == 2 and ("admin-a", "unit-b1") not in per


def test_suggestions_count_the_caller(spark, world):
    orgs, units, users = world
    jobs = spark.createDataFrame(
        [(1, IDS["admin-a"], "pending", DAY), (2, IDS["user-a1"], "approved", DAY), (3, IDS["user-b1"], "pending", None), (4, None, "rejected", DAY),
         (5, IDS["admin-a1"], "rejected", DAY)], "id long, suggested_by long, status string, created_at timestamp_ntz")
    got = {NAMES[r["actor_id"]]: tuple(r)[1:] for r in stats.status_counts(jobs, users, units).collect()}
    assert got["root"] == (2, 1, 2) and got["admin-a"] == (1, 1, 1) and got["admin-a1"] == (0, 1, 1)
    assert got["admin-b"] == (1, 0, 0) and got["admin-a2"] == (0, 0, 0)
    days = {(NAMES[r["actor_id"]], str(r["day"])): r["n"] for r in stats.suggestions_series(jobs, users, units).collect()}
    assert days["root", "2026-01-02"] == 4 and days["admin-a", "2026-01-02"] == 3 and ("admin-b", "2026-01-02") not in days
    assert {(NAMES[r["actor_id"]], r["n"]) for r in stats.organizations_series(users, units, orgs).collect()} == {
        ("root", 1), ("admin-a", 1), ("admin-a1", 1), ("admin-a2", 1)}


def test_freshness(spark):
    jobs = spark.createDataFrame([(1, "approved"), (2, "approved"), (3, "pending")], "id long, status string")
    served = spark.createDataFrame([(2,), (9,)], "id long")
    assert tuple(stats.corpus_freshness(jobs, served).first()) == (2, 2, 1, 1)
    assert tuple(stats.corpus_freshness(jobs, None).first()) == (2, None, 2, None)


def test_audits(spark, world):
    orgs, units, users = world
    assert audits.scope_violations(users).count() == 0
    assert audits.unique_violations(orgs, units, users).count() == 0
    bad = users.filter(F.col("username") == "admin-a").withColumns({"id": F.lit(99).cast("long"), "unit_id": F.lit(7).cast("long")})
    broken = users.unionByName(bad)
    assert [r["id"] for r in audits.scope_violations(broken).collect()] == [99]
    assert {(r["rule"], r["value"], r["n"]) for r in audits.unique_violations(orgs, units, broken).collect()} == {
        ("username", "admin-a", 2), ("org_admin", "1", 2)}
    jobs = spark.createDataFrame([(1, 4, 1000), (2, None, 4)], "id long, suggested_by long, reviewed_by long")
    assert {tuple(r) for r in audits.foreign_key_violations(orgs, units, broken, jobs).collect()} == {
        ("users.unit_id", 99, 7), ("jobs.reviewed_by", 1, 1000)}
    assert {tuple(r) for r in audits.detach_attribution(jobs, users).collect()} == {(1, 4, None), (2, None, 4)}
    assert audits.domain_violations(broken, "role", fv.ROLES).count() == 0
    assert {(r["column"], r["length"]) for r in audits.text_length_violations(users, {"username": 7, "role": 99}).collect()} == {("username", 8)}


def _jobs(spark, rows):
    full = [{**{c: "" for c in fv.RECORD_COLUMNS}, **r} for r in rows]
    names = ["id", "status", *fv.RECORD_COLUMNS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full],
                                 "id long, status string, " + ", ".join(f"{c} string" for c in fv.RECORD_COLUMNS))


def test_backfill(spark):
    jobs = _jobs(spark, [
        {"id": 2, "status": "approved", "job_title": "مدير|كار", "knowledge": " ", "abilities": "has"},
        {"id": 1, "status": "approved", "job_title": "plain", "knowledge": None, "abilities": None},
        {"id": 3, "status": "approved", "job_title": "plain ", "knowledge": "k3"},
        {"id": 4, "status": "pending", "job_title": "waiting"}])
    src = _jobs(spark, [{"id": 1, "job_title": "مدیر ، کار", "knowledge": "K", "abilities": "A"}, {"id": 2, "job_title": "plain", "knowledge": "first"},
                        {"id": 3, "job_title": "plain", "knowledge": "second"}, {"id": 4, "job_title": "waiting", "knowledge": "x"},
                        {"id": 5, "job_title": "new"}, {"id": 6, "job_title": "new"}, {"id": 7, "job_title": "plain", "knowledge": "  "}]).drop("status").withColumnRenamed("id", "seq")
    plan = moderation.backfill_plan(jobs, src, "seq")
    got = {r["seq"]: (r["action"], r["id"], r["new_knowledge"], r["new_abilities"]) for r in plan.collect()}
    assert got == {1: ("update", 2, "K", None), 2: ("update", 1, "first", None), 3: ("update", 1, "second", None), 4: ("unchanged", None, None, None),
                   5: ("insert", None, None, None), 6: ("insert", None, None, None), 7: ("unchanged", 1, None, None)}
    repairs = moderation.repair_plan(jobs)
    assert {r["action"]: r["n"] for r in moderation.backfill_summary(plan, repairs).collect()} == {"update": 3, "insert": 2, "unchanged": 2, "repair": 1}
    after = moderation.apply_backfill(jobs, plan, repairs, "seq").collect()
    cells = {r["id"]: (r["job_title"], r["knowledge"], r["abilities"]) for r in after if r["id"]}
    assert cells[2] == ("مدير، كار", "K", "has") and cells[1][:2] == ("plain", "second") and cells[3][1] == "k3"
    assert [(r["job_title"], r["status"]) for r in after if r["id"] is None] == [("new", "approved")] * 2
    over = {r["seq"]: r["new_abilities"] for r in moderation.backfill_plan(jobs, src, "seq", overwrite=True).collect()}
    assert over[1] == "A"


def test_reviews_and_edits(spark):
    jobs = _jobs(spark, [{"id": 1, "status": "pending", "job_title": "a"}, {"id": 2, "status": "approved", "job_title": "b"}])
    dec = spark.createDataFrame([(10, 1, "rejected", 7, DAY), (11, 1, "approved", 8, DAY + dt.timedelta(1)), (12, 2, "rejected", 7, DAY), (13, 99, "approved", 7, DAY)],
                                "decision_id long, record_id long, decision string, reviewer_id long, ts timestamp_ntz")
    assert {r["decision_id"]: r["outcome"] for r in moderation.review_outcomes(jobs, dec).collect()} == {
        10: "applied", 11: "conflict", 12: "conflict", 13: "not_found"}
    assert {r["id"]: (r["status"], r["reviewed_by"]) for r in moderation.apply_reviews(jobs, dec).collect()} == {1: ("rejected", 7), 2: ("approved", None)}
    edits = spark.createDataFrame([(1, 1, DAY, "new")], "edit_id long, record_id long, ts timestamp_ntz, job_title string")
    edits = edits.unionByName(edits.withColumn("record_id", F.lit(2).cast("long")))
    for c in fv.RECORD_COLUMNS[1:]:
        edits = edits.withColumn(c, F.lit("e"))
    assert {r["id"]: (r["job_title"], r["tools"]) for r in moderation.apply_edits(jobs, edits).collect()} == {1: ("new", "e"), 2: ("b", "")}


def test_scopes_are_split_by_their_share(spark, monkeypatch):
    """Without a broadcast: the same pairs, and no part of a scope holds much more than its share."""
    users = spark.range(3000).select(
        "id", F.when(F.col("id") < 3, "super_admin").when(F.col("id") % 50 == 0, "unit_admin").otherwise("user").alias("role"),
        F.lit(None).cast("long").alias("organization_id"),
        F.when(F.col("id") % 10 < 9, 1).when(F.col("id") % 100 == 19, None).otherwise(F.col("id") % 7 + 2).cast("long").alias("unit_id"))
    units = spark.range(1, 10).select("id", (F.col("id") % 3).alias("organization_id"))
    want = sorted(map(tuple, T.visible_accounts(users, units).collect()))
    monkeypatch.setattr(T, "broadcast_if_small", lambda df, *a, **k: df)
    monkeypatch.setattr(T, "SHARES", 8)
    assert sorted(map(tuple, T.visible_accounts(users, units).collect())) == want and len(want) > 9000
    rows = T.in_scopes(users.select(F.col("id").alias("account_id"), "unit_id"), None, F.col("unit_id"))
    actors = T.admin_scopes(users)
    joined = T._meet(actors, rows, "account_id", 8)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2
