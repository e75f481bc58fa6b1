"""Tenancy, moderation and audits: regions, nations, customers and orders in those roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import audits, moderation, stats, tenancy as T
from .common import SQL_TENANCY, suggestions, table, tenancy


def _day(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def scope_visible(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.visible_accounts(users, units)


def can_manage(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.manageable_accounts(users, units)


def manages_units(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.managed_units(users, units)


def manages_organizations(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.managed_organizations(users, orgs)


def visible_organizations(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.visible_organizations(users, units, orgs)


def scope_labels(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.scope_labels(users, units, orgs)


def resolve_organization(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.resolve_organization(users, units).select("id", "role", "scope_org")


def filter_accounts(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.ordered(T.filter_accounts(users, units, organization_id=2), "username").select("id", "username", "role")


def list_by_status(spark, sf_dir):
    return T.list_by_status(suggestions(spark, sf_dir)).select("id", "suggested_by", "status")


def suggested_by(spark, sf_dir):
    orders = suggestions(spark, sf_dir)
    busiest = orders.groupBy("suggested_by").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "suggested_by").first()
    return T.suggested_by(orders, busiest["suggested_by"]).select("id", "status")


def stats_totals(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return stats.totals(users, units, orgs)


def stats_by_role(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return stats.by_role(users, units)


def stats_per_unit(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return stats.per_unit(users, units)


def stats_status(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return stats.status_counts(suggestions(spark, sf_dir), users, units)


def accounts_series(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return _day(stats.accounts_series(users, units))


def units_series(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return _day(stats.units_series(users, units))


def organizations_series(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return _day(stats.organizations_series(users, units, orgs))


def suggestions_series(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return _day(stats.suggestions_series(suggestions(spark, sf_dir), users, units))


def stats_series(spark, sf_dir):
    return _day(stats.series(suggestions(spark, sf_dir), "created_at"))


def corpus_freshness(spark, sf_dir):
    """Served are the records whose order has a line item."""
    jobs = suggestions(spark, sf_dir)
    served = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id")).distinct()
    return stats.corpus_freshness(jobs, served)


def container_blockers(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return T.container_blockers(orgs, units, users)


def _faulty(spark, sf_dir):
    """The tenancy with faults taken from the data: poor accounts lost their place, names repeat."""
    orgs, units, users = tenancy(spark, sf_dir)
    bal = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment", "c_nationkey")
    poor, rich = F.col("c_acctbal") < 0, F.col("c_acctbal") > 9500
    rows = users.join(bal, "id")
    role = F.when(rich & (F.col("role") == "user"), "unit_admin").otherwise(F.col("role"))
    org = F.when(poor, F.lit(99).cast("long")).otherwise(F.col("organization_id"))
    unit = F.when(F.col("c_mktsegment") == "BUILDING", F.col("unit_id") + 10).otherwise(F.col("unit_id"))
    name = F.when(poor, F.col("c_mktsegment")).otherwise(F.col("username"))
    return orgs, units, rows.select("id", name.alias("username"), role.alias("role"), "is_active", org.alias("organization_id"),
                                    unit.alias("unit_id"), "created_at")


def audit_scope(spark, sf_dir):
    return audits.scope_violations(_faulty(spark, sf_dir)[2]).select("id", "role", "organization_id", "unit_id")


def audit_unique(spark, sf_dir):
    return audits.unique_violations(*_faulty(spark, sf_dir))


def audit_fk(spark, sf_dir):
    orgs, units, users = _faulty(spark, sf_dir)
    active = users.filter("is_active")
    return audits.foreign_key_violations(orgs, units, active, suggestions(spark, sf_dir))


def detach_attribution(spark, sf_dir):
    orgs, units, users = tenancy(spark, sf_dir)
    return audits.detach_attribution(suggestions(spark, sf_dir), users.filter("is_active")).select("id", "suggested_by", "status")


def _decisions(spark, sf_dir):
    """Purchases approve and errors reject the record their value names."""
    return (table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
            .select(F.col("event_id").alias("decision_id"), F.round(F.col("value") * 100).cast("long").alias("record_id"),
                    F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("decision"),
                    F.col("user_id").alias("reviewer_id"), "ts"))


def review_outcomes(spark, sf_dir):
    return moderation.review_outcomes(suggestions(spark, sf_dir), _decisions(spark, sf_dir)).select(
        "decision_id", "record_id", "decision", "outcome")


def apply_reviews(spark, sf_dir):
    return moderation.apply_reviews(suggestions(spark, sf_dir), _decisions(spark, sf_dir)).select("id", "status", "reviewed_by")


def apply_edits(spark, sf_dir):
    jobs = suggestions(spark, sf_dir).select("id", "status", *[F.lit(f"old {c}").alias(c) for c in fv.RECORD_COLUMNS])
    edits = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("edit_id"), F.round(F.col("value") * 100).cast("long").alias("record_id"), "ts",
        *[F.concat_ws(" ", "event_type", F.lit(c)).alias(c) for c in fv.RECORD_COLUMNS])
    return moderation.apply_edits(jobs, edits).select("id", "status", "job_title", "responsibilities")


QUERIES = {f.__name__: f for f in (
    scope_visible, can_manage, manages_units, manages_organizations, visible_organizations, scope_labels,
    resolve_organization, filter_accounts, list_by_status, suggested_by, stats_totals, stats_by_role, stats_per_unit,
    stats_status, accounts_series, units_series, organizations_series, suggestions_series, stats_series, corpus_freshness,
    container_blockers, audit_scope, audit_unique, audit_fk, detach_attribution, review_outcomes, apply_reviews, apply_edits)}

# ------------------------------------------------------------------------------- SQL
_DAY = lambda c: f"strftime({c}, '%Y-%m-%d')"
_FAULTY = SQL_TENANCY + """,
bad AS (SELECT u.id, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE username END AS username,
  CASE WHEN c_acctbal > 9500 AND role = 'user' THEN 'unit_admin' ELSE role END AS role, is_active,
  CASE WHEN c_acctbal < 0 THEN 99 ELSE organization_id END AS organization_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN unit_id + 10 ELSE unit_id END AS unit_id FROM users u JOIN customer ON c_custkey = u.id)"""
_DECISIONS = """
dec AS (SELECT event_id AS decision_id, CAST(round(value * 100) AS BIGINT) AS record_id,
  CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS decision, user_id AS reviewer_id, ts
  FROM events WHERE event_type IN ('purchase', 'error')),
first AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ts, decision_id) = 1)"""

ORACLE = {
    "scope_visible": f"WITH {SQL_TENANCY} SELECT * FROM sees",
    "can_manage": f"""WITH {SQL_TENANCY} SELECT actor_id, account_id FROM sees s JOIN users a ON a.id = actor_id JOIN users t ON t.id = account_id
WHERE actor_id <> account_id AND (a.role <> 'unit_admin' OR t.role = 'user')""",
    "manages_units": f"WITH {SQL_TENANCY} SELECT actor_id, unit_id, name FROM runs",
    "manages_organizations": f"""WITH {SQL_TENANCY} SELECT a.id AS actor_id, o.id AS organization_id FROM admins a JOIN orgs o
ON a.role = 'super_admin' OR (a.role = 'org_admin' AND o.id = a.organization_id)""",
    "visible_organizations": f"WITH {SQL_TENANCY} SELECT actor_id, organization_id, name FROM seen_orgs",
    "scope_labels": f"""WITH {SQL_TENANCY} SELECT a.id AS actor_id, CASE role WHEN 'super_admin' THEN 'global' WHEN 'org_admin' THEN 'organization'
ELSE 'unit' END AS scope, coalesce(o.name, n.name) AS scope_name FROM admins a LEFT JOIN orgs o ON o.id = a.organization_id LEFT JOIN units n ON n.id = a.unit_id""",
    "resolve_organization": f"WITH {SQL_TENANCY} SELECT id, role, coalesce(organization_id, unit_org) AS scope_org FROM placed",
    "filter_accounts": f"WITH {SQL_TENANCY} SELECT id, username, role FROM placed WHERE organization_id = 2 OR unit_org = 2",
    "list_by_status": f"WITH {SQL_TENANCY} SELECT id, suggested_by, status FROM jobs WHERE status = 'pending'",
    "suggested_by": f"""WITH {SQL_TENANCY} SELECT id, status FROM jobs WHERE suggested_by =
(SELECT suggested_by FROM jobs GROUP BY suggested_by ORDER BY count(*) DESC, suggested_by LIMIT 1)""",
    "stats_totals": f"""WITH {SQL_TENANCY} SELECT a.id AS actor_id, (SELECT count(*) FROM seen_orgs x WHERE x.actor_id = a.id) AS organizations,
(SELECT count(*) FROM runs r WHERE r.actor_id = a.id) AS units, count(u.id) AS accounts, count(u.id) FILTER (u.is_active) AS active,
count(u.id) FILTER (NOT u.is_active) AS blocked FROM admins a LEFT JOIN sees s ON s.actor_id = a.id LEFT JOIN users u ON u.id = s.account_id GROUP BY a.id""",
    "stats_by_role": f"""WITH {SQL_TENANCY}, r(role) AS (VALUES ('super_admin'), ('org_admin'), ('unit_admin'), ('user'))
SELECT a.id AS actor_id, r.role, count(u.id) AS accounts FROM admins a CROSS JOIN r
LEFT JOIN (SELECT actor_id, u.id, u.role FROM sees JOIN users u ON u.id = account_id) u ON u.actor_id = a.id AND u.role = r.role GROUP BY a.id, r.role""",
    "stats_per_unit": f"""WITH {SQL_TENANCY} SELECT r.actor_id, r.unit_id, r.name, count(s.id) AS accounts FROM runs r
LEFT JOIN (SELECT actor_id, u.id, u.unit_id FROM sees JOIN users u ON u.id = account_id) s ON s.actor_id = r.actor_id AND s.unit_id = r.unit_id GROUP BY ALL""",
    "stats_status": f"""WITH {SQL_TENANCY} SELECT a.id AS actor_id, count(*) FILTER (c.status = 'pending') AS pending,
count(*) FILTER (c.status = 'approved') AS approved, count(*) FILTER (c.status = 'rejected') AS rejected
FROM admins a LEFT JOIN counted c ON c.actor_id = a.id GROUP BY a.id""",
    "accounts_series": f"""WITH {SQL_TENANCY} SELECT actor_id, {_DAY('created_at')} AS day, count(*) AS n FROM sees JOIN users ON users.id = account_id
WHERE created_at IS NOT NULL GROUP BY ALL""",
    "units_series": f"WITH {SQL_TENANCY} SELECT actor_id, {_DAY('created_at')} AS day, count(*) AS n FROM runs WHERE created_at IS NOT NULL GROUP BY ALL",
    "organizations_series": f"WITH {SQL_TENANCY} SELECT actor_id, {_DAY('created_at')} AS day, count(*) AS n FROM seen_orgs WHERE created_at IS NOT NULL GROUP BY ALL",
    "suggestions_series": f"WITH {SQL_TENANCY} SELECT actor_id, {_DAY('created_at')} AS day, count(*) AS n FROM counted WHERE created_at IS NOT NULL GROUP BY ALL",
    "stats_series": f"SELECT {_DAY('o_orderdate')} AS day, count(*) AS n FROM orders GROUP BY ALL",
    "corpus_freshness": f"""WITH {SQL_TENANCY}, a AS (SELECT id FROM jobs WHERE status = 'approved'),
s AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM a) AS corpus_records, (SELECT count(*) FROM s) AS served_records,
(SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM s)) AS to_add, (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM a)) AS to_drop""",
    "container_blockers": f"""WITH {SQL_TENANCY} SELECT 'organization' AS kind, id, (SELECT count(*) FROM units WHERE organization_id = o.id) AS units,
(SELECT count(*) FROM users WHERE organization_id = o.id) AS accounts FROM orgs o
UNION ALL SELECT 'unit', id, 0, (SELECT count(*) FROM users WHERE unit_id = n.id) FROM units n""",
    "audit_scope": f"""WITH {_FAULTY} SELECT id, role, organization_id, unit_id FROM bad WHERE NOT CASE role
WHEN 'super_admin' THEN organization_id IS NULL AND unit_id IS NULL WHEN 'org_admin' THEN organization_id IS NOT NULL AND unit_id IS NULL
WHEN 'unit_admin' THEN organization_id IS NULL AND unit_id IS NOT NULL ELSE organization_id IS NULL END""",
    "audit_unique": f"""WITH {_FAULTY}
SELECT 'username' AS rule, username AS value, count(*) AS n FROM bad GROUP BY username HAVING n > 1
UNION ALL SELECT 'organization_name', name, count(*) AS n FROM orgs GROUP BY name HAVING n > 1
UNION ALL SELECT 'unit_name', organization_id || '|' || name, count(*) AS n FROM units GROUP BY organization_id, name HAVING n > 1
UNION ALL SELECT 'org_admin', organization_id::VARCHAR, count(*) AS n FROM bad WHERE role = 'org_admin' AND organization_id IS NOT NULL GROUP BY organization_id HAVING n > 1
UNION ALL SELECT 'unit_admin', unit_id::VARCHAR, count(*) AS n FROM bad WHERE role = 'unit_admin' AND unit_id IS NOT NULL GROUP BY unit_id HAVING n > 1""",
    "audit_fk": f"""WITH {_FAULTY}, act AS (SELECT * FROM bad WHERE is_active)
SELECT 'units.organization_id' AS rule, id, organization_id AS missing FROM units WHERE organization_id NOT IN (SELECT id FROM orgs)
UNION ALL SELECT 'users.organization_id', id, organization_id FROM act WHERE organization_id IS NOT NULL AND organization_id NOT IN (SELECT id FROM orgs)
UNION ALL SELECT 'users.unit_id', id, unit_id FROM act WHERE unit_id IS NOT NULL AND unit_id NOT IN (SELECT id FROM units)
UNION ALL SELECT 'jobs.suggested_by', id, suggested_by FROM jobs WHERE suggested_by NOT IN (SELECT id FROM act)""",
    "detach_attribution": f"""WITH {SQL_TENANCY} SELECT id, CASE WHEN suggested_by IN (SELECT id FROM users WHERE is_active) THEN suggested_by END AS suggested_by,
status FROM jobs""",
    "review_outcomes": f"""WITH {SQL_TENANCY},{_DECISIONS} SELECT d.decision_id, d.record_id, d.decision, CASE WHEN j.id IS NULL THEN 'not_found'
WHEN j.status = 'pending' AND f.decision_id = d.decision_id THEN 'applied' ELSE 'conflict' END AS outcome
FROM dec d JOIN first f USING (record_id) LEFT JOIN jobs j ON j.id = d.record_id""",
    "apply_reviews": f"""WITH {SQL_TENANCY},{_DECISIONS} SELECT j.id, CASE WHEN j.status = 'pending' THEN coalesce(f.decision, j.status) ELSE j.status END AS status,
CASE WHEN j.status = 'pending' THEN f.reviewer_id END AS reviewed_by FROM jobs j LEFT JOIN first f ON f.record_id = j.id""",
    "apply_edits": f"""WITH {SQL_TENANCY}, e AS (SELECT CAST(round(value * 100) AS BIGINT) AS id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY ALL)
SELECT j.id, status, CASE WHEN status = 'pending' THEN coalesce(t || ' job_title', 'old job_title') ELSE 'old job_title' END AS job_title,
CASE WHEN status = 'pending' THEN coalesce(t || ' responsibilities', 'old responsibilities') ELSE 'old responsibilities' END AS responsibilities
FROM jobs j LEFT JOIN e USING (id)""",
}
