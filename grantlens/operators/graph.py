"""The role graph: who holds which role, directly or through other roles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.operators.components import strong_components
from grantlens.operators.skew import balanced_join, lookup_join
from grantlens.workspace import Stage, Workspace

USER = "USER"
ROLE = "ROLE"


def role_edges(role_grants: DataFrame) -> DataFrame:
    """Distinct edges role -> grantee with node types.

    A user and a role of the same name are different nodes; every grantee that is
    not a user counts as a role.
    """
    target_type = F.when(F.col("grantee_type") == USER, USER).otherwise(ROLE)
    return role_grants.select(
        F.col("role").alias("src"),
        F.lit(ROLE).alias("src_type"),
        F.col("grantee").alias("dst"),
        target_type.alias("dst_type"),
    ).distinct()


def direct_roles(role_grants: DataFrame) -> DataFrame:
    """(user, role) as granted."""
    edges = role_edges(role_grants).filter(F.col("dst_type") == USER)
    return edges.select(F.col("dst").alias("user"), F.col("src").alias("role"))


def active_names(users: DataFrame) -> DataFrame:
    """(user): names of the users that are not disabled."""
    return users.filter(~F.col("disabled")).select(F.col("name").alias("user"))


@dataclass(frozen=True)
class CondensedClosure(Stage):
    """(held_by, role) over the graph whose cycles are one node each, named by their smallest role.

    ``cycles`` is (role, component) of the roles on cycles. Roles of one cycle reach each other without rows
    that say so, thus a ring of n roles takes n rows, not n * n.
    """

    cycles: Stage


def role_closure(workspace: Workspace, role_grants: DataFrame) -> Stage:
    """(held_by, role): every role a role reaches through grants.

    Pairs already known are dropped, which ends cycles. Only roles take part, never users.
    """
    return _doubled(workspace, _held_by(role_grants))


def condensed_closure(workspace: Workspace, role_grants: DataFrame) -> CondensedClosure:
    """What a role reaches, with the roles of a cycle taken as one."""
    held = workspace.stage(_held_by(role_grants), "role-edges")
    cycles = strong_components(workspace, held.df.select(F.col("held_by").alias("src"), F.col("role").alias("dst")))
    members = Stage(cycles.df.select(F.col("node").alias("role"), "component"), cycles.rows)
    acyclic = held.df
    if members.rows > 0:
        acyclic = condensed(workspace, acyclic, members, "role", "held_by")
        acyclic = condensed(workspace, acyclic, members, "held_by", "role")
        acyclic = acyclic.filter("held_by <> role").distinct()
    closure = _doubled(workspace, acyclic)
    return CondensedClosure(closure.df, closure.rows, members)


def condensed(workspace: Workspace, rows: DataFrame, cycles: Stage, column: str, spread: str) -> DataFrame:
    """``rows`` with the roles in ``column`` that are on a cycle replaced by the name of their component."""
    names = Stage(cycles.df.select(F.col("role").alias(column), "component"), cycles.rows)
    found = lookup_join(workspace, rows, names, [column], "left", spread=spread)
    return found.withColumn(column, F.coalesce("component", column)).select(rows.columns)


def _held_by(role_grants: DataFrame) -> DataFrame:
    edges = role_edges(role_grants).filter(F.col("dst_type") == ROLE)
    return edges.select(F.col("dst").alias("held_by"), F.col("src").alias("role"))


def _doubled(workspace: Workspace, edges: DataFrame) -> Stage:
    """Semi-naive doubling: each round extends the pairs found last by all pairs known.

    A chain of n roles takes log2(n) rounds.
    """
    known = fresh = workspace.stage(edges, "role-edges")
    while fresh.rows > 0:
        ends = Stage(fresh.df.withColumnRenamed("role", "via"), fresh.rows)
        onward = Stage(known.df.withColumnRenamed("held_by", "via"), known.rows)
        longer = balanced_join(workspace, ends, onward, ["via"], "inner", "held_by", "role")
        found = longer.select("held_by", "role").distinct()
        fresh = workspace.stage(
            found.join(known.df, ["held_by", "role"], "left_anti"), "role-closure"
        )
        known = Stage(known.df.unionByName(fresh.df), known.rows + fresh.rows)
    return known


def user_roles(
    workspace: Workspace, role_grants: DataFrame, users: DataFrame, closure: Stage
) -> DataFrame:
    """(user, role): all roles each enabled user can act with.

    ``closure`` is a ``role_closure``, or a ``condensed_closure``, whose components are opened only here.
    """
    direct = workspace.stage(
        direct_roles(role_grants).join(active_names(users), "user", "left_semi"), "direct-roles"
    )
    cycles = closure.cycles if isinstance(closure, CondensedClosure) else None
    if cycles is not None and cycles.rows > 0:
        merged = condensed(workspace, direct.df, cycles, "role", spread="user").distinct()
        direct = workspace.stage(merged, "direct-components")
    held = Stage(direct.df.withColumnRenamed("role", "held_by"), direct.rows)
    inherited = balanced_join(workspace, held, closure, ["held_by"], "inner", "user", "role")
    reached = direct.df.unionByName(inherited.select("user", "role")).distinct()
    if cycles is None or cycles.rows == 0:
        return reached
    components = workspace.stage(reached.withColumnRenamed("role", "component"), "user-components")
    opened = balanced_join(workspace, components, cycles, ["component"], "inner", "user", "role")
    names = Stage(cycles.df.select("component").distinct(), cycles.rows)
    plain = lookup_join(workspace, components.df, names, ["component"], "left_anti", spread="user")
    return opened.select("user", "role").unionByName(plain.select("user", F.col("component").alias("role")))


def role_members(
    workspace: Workspace, role_grants: DataFrame, roots: Sequence[str]
) -> DataFrame:
    """(root, user): users, disabled ones too, that hold each root role in any way.

    The graph is followed from the roots only, a round per step, and new pairs only.
    """
    spark: SparkSession = workspace.spark
    itself = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("root"))
    edges = workspace.stage(
        role_edges(role_grants)
        .filter(F.col("dst_type") == ROLE)
        .select(F.col("src").alias("role"), F.col("dst").alias("carrier")),
        "role-edges",
    )
    known = fresh = workspace.stage(
        itself.distinct().withColumn("role", F.col("root")), "carriers", at_most=len(roots)
    )
    while fresh.rows > 0:
        onward = balanced_join(workspace, fresh, edges, ["role"], "inner", "root", "carrier")
        found = onward.select("root", F.col("carrier").alias("role")).distinct()
        fresh = workspace.stage(found.join(known.df, ["root", "role"], "left_anti"), "carriers")
        known = Stage(known.df.unionByName(fresh.df), known.rows + fresh.rows)
    # One row per carrying role, so the grants side can be looked up without fan-out.
    by_role = workspace.stage(
        known.df.groupBy("role").agg(F.collect_set("root").alias("roots")),
        "carriers",
        at_most=known.rows,
    )
    held = lookup_join(
        workspace, direct_roles(role_grants), by_role, ["role"], "inner", spread="user"
    )
    return held.select(F.explode("roots").alias("root"), "user").distinct()
