"""Integrity rules Spark does not enforce, as queries returning their violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shuffle import lookup_join


def scope_violations(users: DataFrame) -> DataFrame:
    """Accounts whose role does not fit the scope columns they carry."""
    org, unit = F.col("organization_id"), F.col("unit_id")
    fits = (F.when(F.col("role") == "super_admin", org.isNull() & unit.isNull())
            .when(F.col("role") == "org_admin", org.isNotNull() & unit.isNull())
            .when(F.col("role") == "unit_admin", org.isNull() & unit.isNotNull())
            .when(F.col("role") == "user", org.isNull())
            .otherwise(F.lit(False)))
    return users.filter(~fits)


def domain_violations(df: DataFrame, column: str, allowed) -> DataFrame:
    """Rows whose enumerated column holds something else."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def duplicate_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Key values held by more than one row (of those meeting `where`), with `n`.

    As in a unique index, rows with a NULL key part never collide.
    """
    rows = df if where is None else df.filter(where)
    return (rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def unique_violations(organizations: DataFrame, units: DataFrame, users: DataFrame) -> DataFrame:
    """`(rule, value, n)` over every unique and partial unique rule of the schema."""
    def rule(name, df, keys, where=None):
        found = duplicate_keys(df, keys, where)
        return found.select(F.lit(name).alias("rule"),
                            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("value"), "n")
    role = F.col("role")
    return (rule("username", users, ["username"])
            .unionByName(rule("organization_name", organizations, ["name"]))
            .unionByName(rule("unit_name", units, ["organization_id", "name"]))
            .unionByName(rule("org_admin", users, ["organization_id"], role == "org_admin"))
            .unionByName(rule("unit_admin", users, ["unit_id"], role == "unit_admin")))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference has no parent."""
    keys = parent.select(F.col(parent_key).alias(column), F.lit(True).alias("_found")).distinct()
    held = child.filter(F.col(column).isNotNull())
    return lookup_join(held, keys, column, child.columns).filter(F.col("_found").isNull()).drop("_found")


def foreign_key_violations(organizations: DataFrame, units: DataFrame, users: DataFrame,
                           jobs: DataFrame) -> DataFrame:
    """`(rule, id, missing)` over every foreign key of the schema."""
    checks = (("units.organization_id", units, "organization_id", organizations),
              ("users.organization_id", users, "organization_id", organizations),
              ("users.unit_id", users, "unit_id", units),
              ("jobs.suggested_by", jobs, "suggested_by", users),
              ("jobs.reviewed_by", jobs, "reviewed_by", users))
    out = None
    for name, child, column, parent in checks:
        if column not in child.columns:
            continue
        part = orphans(child, column, parent).select(
            F.lit(name).alias("rule"), F.col("id").cast("long").alias("id"),
            F.col(column).cast("long").alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


def detach_attribution(jobs: DataFrame, survivors: DataFrame,
                       columns=("suggested_by", "reviewed_by")) -> DataFrame:
    """References to accounts that are gone become NULL; the records stay."""
    out = jobs
    for column in columns:
        if column not in jobs.columns:
            continue
        alive = survivors.select(F.col("id").alias(column), F.lit(True).alias("_alive"))
        out = (lookup_join(out, alive, column, jobs.columns)
               .withColumn(column, F.when(F.col("_alive"), F.col(column))).drop("_alive"))
    return out.select(*jobs.columns)


def text_length_violations(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows exceeding a declared text length, `(column, length)` appended."""
    over = [F.when(F.char_length(c) > n, F.struct(F.lit(c).alias("column"), F.char_length(c).alias("length")))
            for c, n in limits.items()]
    return (df.withColumn("_o", F.explode(F.array_compact(F.array(*over))))
            .select(*df.columns, "_o.column", "_o.length"))
