"""Who may see and manage what in the organization / unit / account hierarchy.

Scopes are written as `(scope_kind, scope_id)`: an admin holds exactly one, a row lies in
up to three (`global`, its organization, its unit).  Every visibility rule is then one
equi-join on the scope instead of a disjunction, and counts need no pairs at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .shuffle import broadcast_if_small, lookup_join

GLOBAL, ORGANIZATION, UNIT = "global", "organization", "unit"
#: A scope that holds more than one in so many rows is split, into parts of about that size.
SHARES = 256


def resolve_organization(users: DataFrame, units: DataFrame) -> DataFrame:
    """Accounts with `unit_org` (through the unit) and `scope_org` (own column first)."""
    lookup = units.select(F.col("id").alias("unit_id"), F.col("organization_id").alias("unit_org"))
    return lookup_join(users, lookup, "unit_id", ["id"], row_bytes=16).withColumn(
        "scope_org", F.coalesce("organization_id", "unit_org"))


def admin_scopes(users: DataFrame) -> DataFrame:
    """One `(actor_id, actor_role, scope_kind, scope_id)` per admin account."""
    role = F.col("role")
    kind = (F.when(role == "super_admin", GLOBAL).when(role == "org_admin", ORGANIZATION)
            .when(role == "unit_admin", UNIT))
    held = (F.when(role == "super_admin", F.lit(0)).when(role == "org_admin", F.col("organization_id"))
            .when(role == "unit_admin", F.col("unit_id")))
    return users.filter(role.isin(*fv.ADMIN_ROLES)).select(
        F.col("id").alias("actor_id"), role.alias("actor_role"), kind.alias("scope_kind"),
        held.cast("long").alias("scope_id"))


def in_scopes(df: DataFrame, organization: Column | None, unit: Column | None) -> DataFrame:
    """`df` repeated for each scope it lies in (global, organization, unit)."""
    spots = [F.struct(F.lit(GLOBAL).alias("scope_kind"), F.lit(0).cast("long").alias("scope_id"))]
    for kind, held in ((ORGANIZATION, organization), (UNIT, unit)):
        if held is not None:
            spots.append(F.when(held.isNotNull(), F.struct(
                F.lit(kind).alias("scope_kind"), held.cast("long").alias("scope_id"))))
    spread = df.withColumn("_scope", F.explode(F.array_compact(F.array(*spots))))
    return spread.select(*df.columns, "_scope.scope_kind", "_scope.scope_id")


def _meet(actors: DataFrame, rows: DataFrame, salt_on: str, shares: int = SHARES) -> DataFrame:
    """Join actors to rows on the scope.

    The global scope holds every row.  Few actors are broadcast and no row moves; too
    many, and each scope is split by its measured share of the rows, so that none lands in one
    task and the actors of small scopes are not copied.
    """
    small = broadcast_if_small(actors)
    if small is not actors:
        return rows.join(small, ["scope_kind", "scope_id"])
    scope = ["scope_kind", "scope_id"]
    counts = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") * shares / counts.agg(F.sum("_n")).scalar()).cast("int")
    # Fewer than `shares` scopes can hold more than one in `shares` rows.
    large = F.broadcast(counts.withColumn("_parts", parts).filter("_parts > 1").select(*scope, "_parts"))
    one = F.coalesce("_parts", F.lit(1))
    spread = actors.join(large, scope, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    salted = rows.join(large, scope, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_on), one).cast("int")).drop("_parts")
    return salted.join(spread, [*scope, "_salt"]).drop("_salt")


def visible_accounts(users: DataFrame, units: DataFrame) -> DataFrame:
    """`(actor_id, account_id)`.

    A super admin sees all; an organization admin the accounts of its units (so neither
    itself nor its peers); a unit admin the roster of its unit, itself included.
    """
    placed = in_scopes(resolve_organization(users, units), F.col("unit_org"), F.col("unit_id"))
    return _meet(admin_scopes(users), placed.withColumnRenamed("id", "account_id"), "account_id").select(
        "actor_id", "account_id")


def manageable_accounts(users: DataFrame, units: DataFrame) -> DataFrame:
    """`(actor_id, account_id)` an admin may act on; never itself, for unit admins only users."""
    placed = in_scopes(resolve_organization(users, units), F.col("unit_org"), F.col("unit_id"))
    pairs = _meet(admin_scopes(users), placed.withColumnRenamed("id", "account_id"), "account_id")
    allowed = (F.col("actor_id") != F.col("account_id")) & (
        (F.col("scope_kind") != UNIT) | (F.col("role") == "user"))
    return pairs.filter(allowed).select("actor_id", "account_id")


def managed_units(users: DataFrame, units: DataFrame, organization_id: int | None = None) -> DataFrame:
    """`(actor_id, unit_id, name)`; an organization filter narrows, never widens."""
    wanted = units if organization_id is None else units.filter(F.col("organization_id") == organization_id)
    placed = in_scopes(wanted, F.col("organization_id"), F.col("id"))
    return _meet(admin_scopes(users), placed, "id").select("actor_id", F.col("id").alias("unit_id"), "name")


def managed_organizations(users: DataFrame, organizations: DataFrame) -> DataFrame:
    """`(actor_id, organization_id)` a super admin or the organization's admin manages."""
    placed = in_scopes(organizations, F.col("id"), None)
    return _meet(admin_scopes(users), placed, "id").select("actor_id", F.col("id").alias("organization_id"))


def visible_organizations(users: DataFrame, units: DataFrame, organizations: DataFrame) -> DataFrame:
    """`(actor_id, organization_id, name)`; below a super admin, the one resolved organization."""
    own = resolve_organization(users, units).filter(F.col("role").isin("org_admin", "unit_admin"))
    scopes = (admin_scopes(users).filter(F.col("scope_kind") == GLOBAL)
              .unionByName(own.filter(F.col("scope_org").isNotNull()).select(
                  F.col("id").alias("actor_id"), F.col("role").alias("actor_role"),
                  F.lit(ORGANIZATION).alias("scope_kind"), F.col("scope_org").cast("long").alias("scope_id"))))
    placed = in_scopes(organizations.select("id", "name"), F.col("id"), None)
    return _meet(scopes, placed, "id").select("actor_id", F.col("id").alias("organization_id"), "name")


def scope_labels(users: DataFrame, units: DataFrame, organizations: DataFrame) -> DataFrame:
    """`(actor_id, scope, scope_name)`; the global scope has no name."""
    names = (organizations.select(F.lit(ORGANIZATION).alias("scope_kind"),
                                  F.col("id").cast("long").alias("scope_id"), F.col("name").alias("scope_name"))
             .unionByName(units.select(F.lit(UNIT).alias("scope_kind"),
                                       F.col("id").cast("long").alias("scope_id"), F.col("name").alias("scope_name"))))
    return (admin_scopes(users).join(names, ["scope_kind", "scope_id"], "left")
            .select("actor_id", F.col("scope_kind").alias("scope"), "scope_name"))


def filter_accounts(users: DataFrame, units: DataFrame, role: str | None = None,
                    unit_id: int | None = None, organization_id: int | None = None) -> DataFrame:
    """Accounts matching every given filter; an organization counts directly or through a unit."""
    out = resolve_organization(users, units)
    if role is not None:
        out = out.filter(F.col("role") == role)
    if unit_id is not None:
        out = out.filter(F.col("unit_id") == unit_id)
    if organization_id is not None:
        out = out.filter((F.col("organization_id") == organization_id) | (F.col("unit_org") == organization_id))
    return out.select(*users.columns)


def ordered(df: DataFrame, by: str) -> DataFrame:
    """A listing by user name or name (code-point order)."""
    return df.orderBy(F.col(by).asc())


def list_by_status(jobs: DataFrame, status: str = "pending") -> DataFrame:
    """Records of one moderation status."""
    return jobs.filter(F.col("status") == status)


def suggested_by(jobs: DataFrame, user_id: int) -> DataFrame:
    """Records one account suggested."""
    return jobs.filter(F.col("suggested_by") == user_id)


def container_blockers(organizations: DataFrame, units: DataFrame, users: DataFrame) -> DataFrame:
    """`(kind, id, units, accounts)` of what still keeps a container from deletion."""
    org_units = units.groupBy(F.col("organization_id").alias("id")).agg(F.count(F.lit(1)).alias("units"))
    org_users = (users.filter(F.col("organization_id").isNotNull())
                 .groupBy(F.col("organization_id").alias("id")).agg(F.count(F.lit(1)).alias("accounts")))
    unit_users = (users.filter(F.col("unit_id").isNotNull())
                  .groupBy(F.col("unit_id").alias("id")).agg(F.count(F.lit(1)).alias("accounts")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    orgs = (organizations.select("id").join(org_units, "id", "left").join(org_users, "id", "left")
            .select(F.lit(ORGANIZATION).alias("kind"), "id", zero(F.col("units")).alias("units"),
                    zero(F.col("accounts")).alias("accounts")))
    rooms = (units.select("id").join(unit_users, "id", "left")
             .select(F.lit(UNIT).alias("kind"), "id", F.lit(0).cast("long").alias("units"),
                     zero(F.col("accounts")).alias("accounts")))
    return orgs.unionByName(rooms)
