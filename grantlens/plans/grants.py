"""Checks on future grants, managed schemas and parent permissions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.functions.identifiers import fqn_type, truncated_database
from grantlens.functions.names import in_user_space, is_system_database
from grantlens.functions.text import missing_level
from grantlens.operators.skew import balanced_join, lookup_join
from grantlens.plans.admin import ACCOUNT_ADMIN, FAILED
from grantlens.plans.check import (
    Audit,
    Check,
    CheckPlan,
    count_of,
    not_collected,
    scalar,
)
from grantlens.workspace import Stage


@dataclass(frozen=True)
class FutureLevels:
    """Distinct future grantees set on databases and on schemas."""

    database: Stage  # db, asset_type, role
    schema: Stage  # schema, db, asset_type, role


def future_levels(audit: Audit) -> FutureLevels:
    grants = audit.workspace.stage(
        audit.snapshot.future_grants.select(
            "set_on",
            truncated_database("set_on").alias("db"),
            (F.coalesce(fqn_type("set_on"), F.lit("")) == "DATABASE").alias("on_database"),
            "asset_type",
            F.col("grantee").alias("role"),
        ).distinct(),
        "future-grantees",
    )
    database = grants.df.filter("on_database").select("db", "asset_type", "role")
    schema = grants.df.filter("not on_database").select(
        F.col("set_on").alias("schema"), "db", "asset_type", "role"
    )
    return FutureLevels(Stage(database, grants.rows), Stage(schema, grants.rows))


def shadowed_roles(audit: Audit, levels: FutureLevels) -> DataFrame:
    """(schema, asset_type, role): database level grantees that a schema overrides.

    Any schema level grant of an asset type hides the database level ones of that
    type; the roles listed are those the schema does not name again. What the join
    makes beyond the answer is no more than the schema level grants themselves.
    """
    workspace = audit.workspace
    key = ["db", "asset_type"]
    overriding = workspace.stage(
        levels.schema.df.select("schema", *key).distinct(), "overriding-schemas"
    )
    expected = balanced_join(
        workspace, overriding, levels.database, key, "inner", "schema", "role"
    )
    return expected.select("schema", "asset_type", "role").join(
        levels.schema.df.select("schema", "asset_type", "role"),
        ["schema", "asset_type", "role"],
        "left_anti",
    )


def shadow_sizes(audit: Audit, levels: FutureLevels) -> DataFrame:
    """(schema, db, asset_type, n_missing) by counting alone, without listing roles."""
    workspace = audit.workspace
    key = ["db", "asset_type"]
    offered = workspace.stage(
        levels.database.df.groupBy(key).agg(F.count(F.lit(1)).alias("n_offered")), "offered"
    )
    repeated = lookup_join(
        workspace,
        levels.schema.df,
        Stage(levels.database.df.withColumn("repeated", F.lit(1)), levels.database.rows),
        [*key, "role"],
        "left",
        spread="schema",
    )
    named = repeated.groupBy("schema", *key).agg(F.count("repeated").alias("n_repeated"))
    both = lookup_join(workspace, named, offered, key, "inner", spread="schema")
    return both.select(
        "schema", *key, (F.col("n_offered") - F.col("n_repeated")).alias("n_missing")
    )


def shadow_future_grants(audit: Audit) -> CheckPlan:
    """Database level future grants that schema level ones silence."""
    if not audit.snapshot.has("future_grants"):
        return not_collected()
    levels = future_levels(audit)
    sizes = shadow_sizes(audit, levels)
    keys = levels.database.df.select("db", "asset_type").unionByName(
        levels.schema.df.select("db", "asset_type")
    )
    score = F.when(F.col("n_keys") == 0, -1.0).otherwise(
        1 - F.try_divide("n_affected_databases", "n_keys")
    )
    return CheckPlan(
        score,
        {
            "n_keys": count_of(keys.distinct()),
            "n_affected_databases": scalar(
                sizes.filter("n_missing > 0"), F.count_distinct("db")
            ),
        },
        {"": audit.kept(shadowed_roles(audit, levels), "shadowed-roles")},
    )


def managed_schemas(audit: Audit) -> CheckPlan:
    """Schemas with managed access, if any."""
    if not audit.snapshot.has("schemas"):
        return not_collected()
    managed = audit.snapshot.schemas.filter("managed_access")
    findings = audit.kept(managed.select(F.col("fqn").alias("schema")), "managed-schemas")
    score = F.when(F.col("n_managed") > 0, 1.0).otherwise(-1.0)
    return CheckPlan(score, {"n_managed": count_of(findings)}, {"": findings})


def blocked_privileges(privileges: DataFrame) -> DataFrame:
    """(grantee, object, schema, missing_level): object privileges that do not work."""
    level = missing_level(F.col("has_db_permission"), F.col("has_schema_permission"))
    return (
        privileges.filter(F.col("grantee") != ACCOUNT_ADMIN)
        .select("grantee", "object", "schema", level.alias("missing_level"))
        .filter(F.col("missing_level").isNotNull())
    )


def inaccessible_objects(audit: Audit) -> CheckPlan:
    """Object privileges that do not work for want of a parent permission.

    What is missing is missing for all of a role's objects in a schema, so that is what is stored, with the
    number of objects. The list of objects stays a filter over the stored privileges, for those who ask.
    """
    if not audit.snapshot.has("privilege_grants"):
        return not_collected()
    blocked = blocked_privileges(audit.object_privileges)
    groups = audit.kept(
        blocked.groupBy("grantee", "schema", "missing_level").agg(F.count(F.lit(1)).alias("n_objects")),
        "inaccessible-schemas",
    )
    total = F.coalesce(F.sum("n_objects"), F.lit(0).cast("bigint"))
    score = F.when(F.col("n_blocked") > 0, FAILED).otherwise(1.0)
    return CheckPlan(
        score,
        {"n_blocked": scalar(groups, total), "n_roles": scalar(groups, F.count_distinct("grantee"))},
        {"": blocked.select("grantee", "object", "missing_level")},
        {"by_schema": groups},
        scalar(groups, total),
    )


def schema_coverage(audit: Audit) -> DataFrame:
    """(schema, asset_types, covered): future grants that apply in each schema.

    Grants set on the schema itself hide those set on its database.
    """
    snapshot = audit.snapshot
    schemas = snapshot.schemas.filter(in_user_space(F.col("fqn"))).select(
        F.col("fqn").alias("schema"), truncated_database("fqn").alias("db")
    )
    # Asset types are a short fixed vocabulary, so one set per asset stays tiny.
    types = F.sort_array(F.collect_set("asset_type"))
    grants = snapshot.future_grants.select("set_on", "asset_type").distinct()
    own = grants.groupBy(F.col("set_on").alias("schema")).agg(types.alias("own_types"))
    inherited = audit.workspace.stage(
        grants.filter(
            (F.col("asset_type") != "SCHEMA") & (fqn_type("set_on") == "DATABASE")
        )
        .groupBy(F.col("set_on").alias("db"))
        .agg(types.alias("db_types")),
        "database-types",
    )
    found = lookup_join(
        audit.workspace,
        schemas.distinct().join(own, "schema", "left"),
        inherited,
        ["db"],
        "left",
        spread="schema",
    )
    applied = F.coalesce("own_types", "db_types", F.array().cast("array<string>"))
    return found.select(
        "schema", applied.alias("asset_types"), (F.size(applied) > 0).alias("covered")
    )


def database_coverage(audit: Audit) -> DataFrame:
    """(db, covered): whether new schemas of a database get grants."""
    snapshot = audit.snapshot
    on_schemas = snapshot.future_grants.filter(F.col("asset_type") == "SCHEMA")
    covered = on_schemas.select(F.col("set_on").alias("db"), F.lit(True).alias("hit")).distinct()
    databases = snapshot.databases.filter(~is_system_database(F.col("name"))).select(
        F.col("fqn").alias("db")
    )
    return databases.distinct().join(covered, "db", "left").select(
        "db", F.coalesce("hit", F.lit(False)).alias("covered")
    )


def future_grant_coverage(audit: Audit) -> CheckPlan:
    """Share of schemas and databases with future grants."""
    if not audit.snapshot.has("schemas", "future_grants"):
        return not_collected()
    schemas = audit.kept(schema_coverage(audit), "schema-coverage")
    databases = audit.kept(database_coverage(audit), "database-coverage")
    covered = F.col("n_covered_schemas") + F.col("n_covered_databases")
    total = F.col("n_schemas") + F.col("n_databases")
    score = F.when(F.col("n_future_grants") == 0, -1.0).otherwise(
        1 - (1 - F.try_divide(covered, total)) / 2
    )
    return CheckPlan(
        score,
        {
            "n_future_grants": count_of(audit.snapshot.future_grants),
            "n_schemas": count_of(schemas),
            "n_covered_schemas": scalar(schemas, F.count_if("covered")),
            "n_databases": count_of(databases),
            "n_covered_databases": scalar(databases, F.count_if("covered")),
        },
        {"schemas": schemas, "databases": databases},
    )


CHECKS = [
    Check(
        "c03_shadow_grants",
        "Shadow Future Grants",
        ("future_grants",),
        shadow_future_grants,
        order=("schema", "asset_type", "role"),
    ),
    Check(
        "c07_managed_schemas",
        "Managed Access Schemas",
        ("schemas",),
        managed_schemas,
        order=("schema",),
    ),
    Check(
        "c08_inaccessible_objects",
        "Inaccessible Tables and Views",
        ("privilege_grants",),
        inaccessible_objects,
        order=("grantee", "schema", "object"),
    ),
    Check(
        "c12_future_grant_coverage",
        "Future Grant Coverage",
        ("future_grants", "schemas", "databases"),
        future_grant_coverage,
        order=("covered", "schema", "db"),
    ),
]
