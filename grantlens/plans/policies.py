"""Checks on masking and row access policies."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.functions.scoring import INFO, INSIGHT
from grantlens.plans.check import Audit, Check, CheckPlan, count_of, information, scalar

# Score rules.
MISAPPLIED = 0.48
UNUSED = 0.75


def policy_findings(policies: DataFrame, references: DataFrame | None) -> DataFrame:
    """(kind, policy, target, status).

    Each reference is active or misapplied; a policy without any reference is unused.
    Without reference data the policies are only listed.
    """
    nothing = F.lit(None).cast("string")

    def named(kind: str, names: DataFrame) -> DataFrame:
        return names.select(
            F.lit(kind).alias("kind"),
            F.col("fqn").alias("policy"),
            nothing.alias("target"),
            nothing.alias("status"),
        )

    if references is None:
        return named("listed", policies)
    kind = F.when(F.col("status") == "ACTIVE", "active").otherwise("misapplied")
    applied = references.select(
        kind.alias("kind"), F.col("fqn").alias("policy"), F.col("target_fqn").alias("target"), "status"
    )
    used = references.select("fqn").distinct()
    unused = policies.select("fqn").subtract(used)
    return applied.unionByName(named("unused", unused))


def policy_check(audit: Audit, policies: str, references: str) -> CheckPlan:
    existing: DataFrame | None = getattr(audit.snapshot, policies)
    applied: DataFrame | None = getattr(audit.snapshot, references)
    if existing is None:
        return information()
    findings = audit.kept(policy_findings(existing, applied), policies)
    none_exist = F.col("n_policies") == 0
    metrics = {"n_policies": count_of(existing)}
    if applied is None:
        return CheckPlan(
            F.when(none_exist, INFO).otherwise(INSIGHT), metrics, {"": findings}
        )
    for kind in ("misapplied", "unused", "active"):
        metrics[f"n_{kind}"] = scalar(findings, F.count_if(F.col("kind") == kind))
    score = (
        F.when(none_exist, INFO)
        .when(F.col("n_misapplied") > 0, MISAPPLIED)
        .when(F.col("n_unused") > 0, UNUSED)
        .otherwise(1.0)
    )
    return CheckPlan(score, metrics, {"": findings})


CHECKS = [
    Check(
        "c15_masking_policies",
        "Active Masking Policies",
        ("masking_policies", "masking_policy_references"),
        partial(
            policy_check, policies="masking_policies", references="masking_policy_references"
        ),
        order=("kind", "target", "policy"),
    ),
    Check(
        "c16_row_access_policies",
        "Active Row Access Policies",
        ("row_access_policies", "row_access_policy_references"),
        partial(
            policy_check,
            policies="row_access_policies",
            references="row_access_policy_references",
        ),
        order=("kind", "target", "policy"),
    ),
]
