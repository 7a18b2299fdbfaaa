"""Checks on what is used and who can reach it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.identifiers import truncated_table
from grantlens.functions.names import (
    SYSTEM_SCHEMA,
    in_user_space,
    is_sensitive,
    is_system_database,
)
from grantlens.functions.scoring import INSIGHT
from grantlens.functions.text import counted
from grantlens.operators.ranking import counted as counted_sets
from grantlens.operators.ranking import ranked_objects
from grantlens.operators.skew import lookup_join
from grantlens.operators.usage import TOP, most_used
from grantlens.plans.admin import active_users
from grantlens.plans.check import (
    Audit,
    Check,
    CheckPlan,
    count_of,
    information,
    not_collected,
    scalar,
)
from grantlens.workspace import Stage, Workspace

# Score rules of the sensitive column check.
EXPOSED = 0.89
MIN_THRESHOLD = 3


def _insight(findings: DataFrame, metrics: dict[str, Column] | None = None) -> CheckPlan:
    return CheckPlan(F.lit(INSIGHT), metrics or {}, {"": findings})


def _most_used(audit: Audit, usage: DataFrame | None, name: str) -> CheckPlan:
    if usage is None:
        return information()
    text = F.concat(
        F.lit("used "),
        counted(F.col("usage_count"), "time"),
        F.lit(" by "),
        counted(F.col("n_users"), "user"),
    )
    findings = audit.kept(most_used(usage).withColumn("message", text), name)
    bad = audit.snapshot.unreadable_log_rows
    metrics = {} if bad is None else {"n_unreadable_log_rows": scalar(bad, F.coalesce(F.sum("rows"), F.lit(0)))}
    return _insight(findings, metrics)


def most_used_tables(audit: Audit) -> CheckPlan:
    return _most_used(audit, audit.snapshot.usage_tables, "most-used-tables")


def most_used_columns(audit: Audit) -> CheckPlan:
    return _most_used(audit, audit.snapshot.usage_columns, "most-used-columns")


def least_used_tables(audit: Audit) -> CheckPlan:
    """Tables and views with the fewest uses, unused ones first."""
    snapshot = audit.snapshot
    if snapshot.usage_tables is None or snapshot.entities is None:
        return information()
    kept = (
        F.col("entity_type").isin("TABLE", "VIEW")
        & ~is_system_database(F.col("database"))
        & (F.col("schema") != SYSTEM_SCHEMA)
    )
    tables = snapshot.entities.filter(kept).select(F.col("fqn").alias("object"))
    used = snapshot.usage_tables.groupBy("object").agg(F.sum("usage_count").alias("usage_count"))
    counts = tables.join(used, "object", "left").select(
        "object", F.coalesce("usage_count", F.lit(0).cast("bigint")).alias("usage_count")
    )
    lowest = counts.orderBy("usage_count", "object").limit(TOP)
    return _insight(audit.kept(lowest, "least-used-tables"))


def _ranked(audit: Audit, objects: DataFrame, most: bool) -> DataFrame:
    return ranked_objects(audit.workspace, audit.role_sets, audit.set_bounds, objects, TOP, most).rows


def most_accessible(audit: Audit) -> CheckPlan:
    """Objects that the most users can reach."""
    if not audit.snapshot.has("privilege_grants", "role_grants", "users"):
        return not_collected()
    objects = audit.role_sets.objects.df.select("object").filter(in_user_space(F.col("object")))
    top = _ranked(audit, objects, most=True).filter("n_users > 0")
    return _insight(audit.kept(top, "most-accessible"))


def least_accessible(audit: Audit) -> CheckPlan:
    """Objects that the fewest users can reach, down to none."""
    if not audit.snapshot.has("entities", "privilege_grants", "role_grants", "users"):
        return not_collected()
    objects = audit.snapshot.entities.select(F.col("fqn").alias("object")).distinct()
    objects = objects.filter(in_user_space(F.col("object")))
    bottom = _ranked(audit, objects, most=False)
    return _insight(audit.kept(bottom, "least-accessible"))


def exposure_threshold(users: DataFrame) -> Column:
    """A tenth of the enabled users, and three at least."""
    share = F.floor(F.greatest(F.lit(float(MIN_THRESHOLD)), F.count_if(~F.col("disabled")) / 10))
    return scalar(users, share)


def sensitive_names(workspace: Workspace, columns: DataFrame) -> Stage:
    """(name): the sensitive ones among the columns' names, of which there are far fewer than columns.

    The names are stored before they are looked through, since a filter would otherwise sink below the
    distinct and meet every column.
    """
    names = workspace.stage(columns.select("name").distinct(), "column-names")
    return workspace.stage(names.df.filter(is_sensitive(F.col("name"))), "sensitive-names", at_most=names.rows)


def exposed_columns(audit: Audit) -> DataFrame:
    """(fqn, n_users): unmasked columns with sensitive names that many users reach."""
    snapshot = audit.snapshot
    kept = ~is_system_database(F.col("database")) & (F.col("schema") != SYSTEM_SCHEMA)
    columns = snapshot.columns.filter(kept)
    risky = lookup_join(
        audit.workspace, columns, sensitive_names(audit.workspace, columns), ["name"], "left_semi", spread="fqn"
    ).select("fqn", truncated_table("fqn").alias("object"))
    references = snapshot.masking_policy_references
    if references is not None:
        active = references.filter(F.col("status") == "ACTIVE")
        masked = active.select(F.col("target_fqn").alias("fqn")).distinct()
        risky = risky.join(masked, "fqn", "left_anti")
    # Users are counted only for sets that hold a table with such columns and may have enough of them.
    workspace, sets = audit.workspace, audit.role_sets
    tables = workspace.stage(risky.select("object").distinct(), "risky-tables")
    placed = lookup_join(workspace, sets.objects.df, tables, ["object"], "left_semi", spread="set_id")
    threshold = exposure_threshold(snapshot.users)
    wide = audit.set_bounds.df.filter(F.col("upper") > threshold).select("set_id")
    chosen = workspace.stage(
        wide.join(placed.select("set_id").distinct(), "set_id", "left_semi"), "risky-sets"
    )
    counts = workspace.stage(
        counted_sets(workspace, sets, chosen.df, chosen.rows).filter(F.col("n_users") > threshold),
        "wide-sets",
    )
    members = lookup_join(workspace, placed, counts, ["set_id"], "inner", spread="object")
    reached = workspace.stage(members.select("object", "n_users"), "widely-accessible")
    exposed = lookup_join(workspace, risky, reached, ["object"], "inner", spread="fqn")
    return exposed.select("fqn", "n_users")


def sensitive_columns(audit: Audit) -> CheckPlan:
    if not audit.snapshot.has("columns", "privilege_grants", "role_grants", "users"):
        return not_collected()
    exposed = audit.kept(exposed_columns(audit), "exposed-columns")
    score = F.when(F.col("n_exposed") > 0, EXPOSED).otherwise(1.0)
    return CheckPlan(
        score,
        {
            "n_exposed": count_of(exposed),
            "threshold": exposure_threshold(audit.snapshot.users),
            "n_active": active_users(audit.snapshot.users),
        },
        {"": exposed},
    )


CHECKS = [
    Check(
        "c09_most_used_tables",
        "Most-Used Tables and Views",
        ("usage_tables",),
        most_used_tables,
        order=("ranking", "rank"),
    ),
    Check(
        "c10_most_used_columns",
        "Most-Used Columns",
        ("usage_columns",),
        most_used_columns,
        order=("ranking", "rank"),
    ),
    Check(
        "c11_least_used_tables",
        "Least-Used Tables and Views",
        ("usage_tables", "entities"),
        least_used_tables,
        order=("usage_count", "object"),
    ),
    Check(
        "c13_most_accessible",
        "Most-Accessible Tables and Views",
        ("privilege_grants", "role_grants"),
        most_accessible,
        order=("-n_users", "object"),
    ),
    Check(
        "c14_least_accessible",
        "Least-Accessible Tables and Views",
        ("privilege_grants", "role_grants"),
        least_accessible,
        order=("n_users", "object"),
    ),
    Check(
        "c17_sensitive_columns",
        "Potentially Sensitive Columns",
        ("privilege_grants", "role_grants", "columns", "users"),
        sensitive_columns,
        order=("fqn",),
    ),
]
