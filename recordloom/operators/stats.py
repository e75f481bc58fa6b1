"""Dashboard aggregates per admin, computed per scope and then handed to its admins.

Rows are aggregated per `(scope_kind, scope_id)` with map-side combining, so the global
scope costs a few partial rows per task, never a row per account and admin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .tenancy import admin_scopes, in_scopes, resolve_organization, visible_organizations

SCOPE = ["scope_kind", "scope_id"]


def _accounts(users: DataFrame, units: DataFrame) -> DataFrame:
    return in_scopes(resolve_organization(users, units), F.col("unit_org"), F.col("unit_id"))


def _units(units: DataFrame) -> DataFrame:
    return in_scopes(units, F.col("organization_id"), F.col("id"))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def totals(users: DataFrame, units: DataFrame, organizations: DataFrame) -> DataFrame:
    """Per admin the organizations, units and accounts in scope, active and blocked."""
    accounts = _accounts(users, units).groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("accounts"), F.count_if("is_active").alias("active"),
        F.count_if(~F.col("is_active")).alias("blocked"))
    rooms = _units(units).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("units"))
    seen = visible_organizations(users, units, organizations).groupBy("actor_id").agg(
        F.count(F.lit(1)).alias("organizations"))
    return (admin_scopes(users).join(accounts, SCOPE, "left").join(rooms, SCOPE, "left")
            .join(seen, "actor_id", "left")
            .select("actor_id", *[_zero(c) for c in ("organizations", "units", "accounts", "active", "blocked")]))


def by_role(users: DataFrame, units: DataFrame, roles=fv.ROLES) -> DataFrame:
    """Per admin one row per role, zero where nobody holds it."""
    counts = (_accounts(users, units).groupBy(*SCOPE, "role").agg(F.count(F.lit(1)).alias("accounts")))
    wanted = admin_scopes(users).withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    return wanted.join(counts, [*SCOPE, "role"], "left").select("actor_id", "role", _zero("accounts"))


def per_unit(users: DataFrame, units: DataFrame) -> DataFrame:
    """Per admin every unit in scope with the number of its accounts the admin sees.

    A unit's accounts are visible wherever the unit is, so they are counted once per unit.
    """
    from .tenancy import managed_units
    counts = (users.filter(F.col("unit_id").isNotNull()).groupBy("unit_id")
              .agg(F.count(F.lit(1)).alias("accounts")))
    return managed_units(users, units).join(counts, "unit_id", "left").select(
        "actor_id", "unit_id", "name", _zero("accounts"))


def _suggestions(jobs: DataFrame, users: DataFrame, units: DataFrame, measures: list[str]) -> DataFrame:
    """Suggestion counts of `jobs` (already grouped by suggester) handed to each admin.

    A4: an admin's scope is what it sees plus itself; a super admin counts every record,
    attributed or not.
    """
    placed = resolve_organization(users, units).select(
        F.col("id").alias("suggested_by"), "unit_org", "unit_id")
    known = jobs.join(placed, "suggested_by", "left")
    scoped = in_scopes(known, F.col("unit_org"), F.col("unit_id")).select(*SCOPE, *measures, "n")
    actors = admin_scopes(users)
    seen = actors.join(scoped.groupBy(*SCOPE, *measures).agg(F.sum("n").alias("n")), SCOPE)
    # Unit admins are on their own roster and super admins see all; the rest adds itself.
    own = actors.filter(F.col("scope_kind") == "organization").join(
        jobs, F.col("actor_id") == F.col("suggested_by"))
    both = seen.select("actor_id", *measures, "n").unionByName(own.select("actor_id", *measures, "n"))
    return both.groupBy("actor_id", *measures).agg(F.sum("n").alias("n"))


def status_counts(jobs: DataFrame, users: DataFrame, units: DataFrame, statuses=fv.STATUSES) -> DataFrame:
    """Per admin the suggestions in scope by status, zero-filled."""
    grouped = jobs.groupBy("suggested_by", "status").agg(F.count(F.lit(1)).alias("n"))
    counts = _suggestions(grouped, users, units, ["status"])
    wide = counts.groupBy("actor_id").agg(*[
        F.sum(F.when(F.col("status") == s, F.col("n"))).alias(s) for s in statuses])
    return (admin_scopes(users).select("actor_id").join(wide, "actor_id", "left")
            .select("actor_id", *[_zero(s) for s in statuses]))


def _daily(scoped: DataFrame, users: DataFrame, ts: str) -> DataFrame:
    """Per admin one count per calendar day that has rows; NULL times are skipped."""
    days = (scoped.filter(F.col(ts).isNotNull()).groupBy(*SCOPE, F.to_date(ts).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))
    return admin_scopes(users).join(days, SCOPE).select("actor_id", "day", "n")


def accounts_series(users: DataFrame, units: DataFrame) -> DataFrame:
    return _daily(_accounts(users, units), users, "created_at")


def units_series(users: DataFrame, units: DataFrame) -> DataFrame:
    return _daily(_units(units), users, "created_at")


def organizations_series(users: DataFrame, units: DataFrame, organizations: DataFrame) -> DataFrame:
    when = organizations.filter(F.col("created_at").isNotNull()).select(
        F.col("id").alias("organization_id"), F.to_date("created_at").alias("day"))
    return (visible_organizations(users, units, organizations).join(when, "organization_id")
            .groupBy("actor_id", "day").agg(F.count(F.lit(1)).alias("n")))


def suggestions_series(jobs: DataFrame, users: DataFrame, units: DataFrame) -> DataFrame:
    """G15 over the suggestions an admin counts in G14."""
    grouped = (jobs.filter(F.col("created_at").isNotNull())
               .groupBy("suggested_by", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    return _suggestions(grouped, users, units, ["day"])


def series(df: DataFrame, ts: str) -> DataFrame:
    """G15 without scopes: `(day, n)` oldest first."""
    return (df.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("day"))


def corpus_freshness(jobs: DataFrame, served: DataFrame | None, key: str = "id") -> DataFrame:
    """Approved rows, served rows (NULL with nothing served) and what a refresh would change."""
    approved = jobs.filter(F.col("status") == "approved").select(key)
    if served is None:
        none = F.lit(None).cast("long")
        return approved.agg(F.count(F.lit(1)).alias("corpus_records"), none.alias("served_records"),
                            F.count(F.lit(1)).alias("to_add"), none.alias("to_drop"))
    sides = (approved.withColumn("a", F.lit(1)).join(
        served.select(key).withColumn("s", F.lit(1)), key, "full"))
    return sides.agg(F.count("a").alias("corpus_records"), F.count("s").alias("served_records"),
                     F.count_if(F.col("s").isNull()).alias("to_add"),
                     F.count_if(F.col("a").isNull()).alias("to_drop"))
