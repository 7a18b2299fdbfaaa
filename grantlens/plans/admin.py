"""Checks on administrators, logins, users and network policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.names import BUILT_IN_USER
from grantlens.functions.text import percent
from grantlens.plans.check import Audit, Check, CheckPlan, count_of, not_collected, scalar

# The administrator roles.
ACCOUNT_ADMIN = "ACCOUNTADMIN"
SECURITY_ADMIN = "SECURITYADMIN"

# Score rules.
FAILED = 0.49
SMALL_ACCOUNT_USERS = 30
SMALL_ACCOUNT_ADMINS = 3
ADVICE_PERCENT = 5


def active_users(users: DataFrame) -> Column:
    """Number of users that are not disabled."""
    return scalar(users, F.count_if(~F.col("disabled")))


def admin_users(audit: Audit) -> CheckPlan:
    """Users with an administrator role, and their share of the account.

    Disabled users count as administrators but not as account users.
    """
    if not audit.snapshot.has("role_grants", "users"):
        return not_collected()
    members = audit.role_members(ACCOUNT_ADMIN, SECURITY_ADMIN)
    findings = audit.kept(
        members.select(F.col("root").alias("admin_role"), "user"), "admin-users"
    )
    admins, active = F.col("n_admins"), F.col("n_active")
    others = 1 - F.try_divide(admins, active)
    score = F.when(
        active <= SMALL_ACCOUNT_USERS,
        F.when(admins <= SMALL_ACCOUNT_ADMINS, 1.0).otherwise(FAILED),
    ).otherwise(F.when(others > 0.9, 1.0).otherwise(others))
    return CheckPlan(
        score,
        {
            "n_admins": scalar(findings, F.count_distinct("user")),
            "n_active": active_users(audit.snapshot.users),
        },
        {"": findings},
    )


def backup_admin(audit: Audit) -> CheckPlan:
    """A second user should hold the account administrator role."""
    if not audit.snapshot.has("role_grants"):
        return not_collected()
    findings = audit.kept(audit.role_members(ACCOUNT_ADMIN).select("user"), "account-admins")
    score = F.when(F.col("n_account_admins") > 1, 1.0).otherwise(FAILED)
    return CheckPlan(score, {"n_account_admins": count_of(findings)}, {"": findings})


def network_policy(audit: Audit) -> CheckPlan:
    """Some network policy should exist."""
    if audit.snapshot.network_policies is None:
        return not_collected()
    score = F.when(F.col("n_policies") > 0, 1.0).otherwise(FAILED)
    return CheckPlan(score, {"n_policies": count_of(audit.snapshot.network_policies)})


def password_only(audit: Audit) -> CheckPlan:
    """Share of successful logins with a password and no second factor."""
    if not audit.snapshot.has("login_history"):
        return not_collected()
    logins = audit.snapshot.login_history.withColumn(
        "password_only",
        F.col("success")
        & F.coalesce(F.col("first_authentication_factor") == "PASSWORD", F.lit(False))
        & F.col("second_authentication_factor").isNull(),
    )
    findings = audit.kept(
        logins.filter("password_only").select("user").distinct(), "password-only-users"
    )
    share = F.try_divide(F.count_if("password_only"), F.count_if("success"))
    return CheckPlan(
        1 - F.col("password_only_share"),
        {
            "n_logins": scalar(logins, F.count_if("success")),
            "password_only_share": scalar(logins, share),
            "password_only_percent": scalar(logins, percent(share)),
            "needs_password_policy": scalar(logins, (share * 100 > ADVICE_PERCENT).cast("int")),
        },
        {"": findings},
    )


def inactive_users(audit: Audit) -> CheckPlan:
    """Enabled users without a login in 7 days or without table access in 90 days."""
    snapshot = audit.snapshot
    if not snapshot.has("users", "login_history"):
        return not_collected()
    enabled = (
        snapshot.users.filter(~F.col("disabled") & (F.col("name") != BUILT_IN_USER))
        .select(F.col("name").alias("user"))
        .distinct()
    )

    def absent_from(seen: DataFrame, reason: str) -> DataFrame:
        missing = enabled.join(seen.select("user").distinct(), "user", "left_anti")
        return missing.withColumn("reason", F.lit(reason))

    found = absent_from(snapshot.login_history.filter("success"), "no_login_7d")
    if snapshot.usage_tables is not None:
        found = found.unionByName(absent_from(snapshot.usage_tables, "no_access_90d"))
    findings = audit.kept(found, "inactive-users")

    def n(reason: str) -> Column:
        return scalar(findings, F.count_if(F.col("reason") == reason))

    score = (
        F.when(F.col("n_no_access") > 0, 0.25).when(F.col("n_no_login") > 0, 0.75).otherwise(1.0)
    )
    return CheckPlan(
        score,
        {"n_no_login": n("no_login_7d"), "n_no_access": n("no_access_90d")},
        {"": findings},
    )


CHECKS = [
    Check(
        "c01_admin_users",
        "Users with Admin Roles",
        ("role_grants", "users"),
        admin_users,
        order=("admin_role", "user"),
    ),
    Check(
        "c02_backup_admin", "Backup Account Admin", ("role_grants",), backup_admin, order=("user",)
    ),
    Check("c04_network_policy", "Active Network Policies", ("network_policies",), network_policy),
    Check(
        "c05_password_only",
        "Password-Only Logins",
        ("login_history",),
        password_only,
        order=("user",),
    ),
    Check(
        "c06_inactive_users",
        "Inactive Users",
        ("login_history", "users", "usage_tables"),
        inactive_users,
        order=("reason", "user"),
    ),
]
