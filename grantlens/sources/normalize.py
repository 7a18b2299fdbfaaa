"""Raw metadata rows to snapshot rows: projections and filters only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.identifiers import (
    add_missing_quotes,
    clean_identifier,
    fqn,
    future_grant_scope,
)

LOGIN_WINDOW = "INTERVAL 7 DAYS"
ACCESS_DAYS = 90
ACCESS_WINDOW = f"INTERVAL {ACCESS_DAYS} DAYS"


def databases(raw: DataFrame) -> DataFrame:
    return raw.select("name", clean_identifier("owner").alias("owner"), fqn("name").alias("fqn"))


def schemas(raw: DataFrame) -> DataFrame:
    return raw.select(
        "name",
        F.col("database_name").alias("database"),
        clean_identifier("owner").alias("owner"),
        F.coalesce(F.col("options").contains("MANAGED ACCESS"), F.lit(False)).alias(
            "managed_access"
        ),
        fqn("database_name", "name").alias("fqn"),
    )


def entities(raw: DataFrame) -> DataFrame:
    return raw.select(
        "name",
        F.col("database_name").alias("database"),
        F.col("schema_name").alias("schema"),
        clean_identifier("owner").alias("owner"),
        F.col("kind").alias("entity_type"),
        fqn("database_name", "schema_name", "name").alias("fqn"),
    )


def columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("column_name").alias("name"),
        F.col("database_name").alias("database"),
        F.col("schema_name").alias("schema"),
        F.col("table_name").alias("table"),
        fqn("database_name", "schema_name", "table_name", "column_name").alias("fqn"),
    )


def _is_true(name: str) -> Column:
    return F.coalesce(F.col(name) == "true", F.lit(False))


def users(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_identifier("name").alias("name"),
        _is_true("disabled").alias("disabled"),
        clean_identifier("owner").alias("owner"),
        F.col("last_success_login").alias("last_successful_login"),
        _is_true("has_password").alias("has_password"),
    )


def roles(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_identifier("name").alias("name"), clean_identifier("owner").alias("owner")
    )


def role_grants(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_identifier("role").alias("role"),
        clean_identifier("grantee_name").alias("grantee"),
        F.col("granted_to").alias("grantee_type"),
        clean_identifier("granted_by").alias("granted_by"),
    )


def privilege_grants(raw: DataFrame) -> DataFrame:
    """Grants to account roles on anything but a role."""
    kept = raw.filter((F.col("granted_on") != "ROLE") & (F.col("granted_to") == "ROLE"))
    return kept.select(
        add_missing_quotes("name").alias("asset"),
        F.col("granted_on").alias("asset_type"),
        clean_identifier("grantee_name").alias("grantee"),
        "grant_option",
        "privilege",
        clean_identifier("granted_by").alias("granted_by"),
    )


def future_grants(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("name").alias("target"),
        F.col("grant_on").alias("asset_type"),
        clean_identifier("grantee_name").alias("grantee"),
        "grant_option",
        "privilege",
        future_grant_scope("name").alias("set_on"),
    )


def policies(raw: DataFrame) -> DataFrame:
    """Masking and row access policies share one shape."""
    return raw.select(
        "name",
        F.col("database_name").alias("database"),
        F.col("schema_name").alias("schema"),
        clean_identifier("owner").alias("owner"),
        fqn("database_name", "schema_name", "name").alias("fqn"),
    )


def login_history(raw: DataFrame, as_of: Column) -> DataFrame:
    """Logins of the seven days up to ``as_of``."""
    time = F.col("EVENT_TIMESTAMP")
    recent = raw.filter((time > as_of - F.expr(LOGIN_WINDOW)) & (time <= as_of))
    return recent.select(
        clean_identifier("USER_NAME").alias("user"),
        F.col("FIRST_AUTHENTICATION_FACTOR").alias("first_authentication_factor"),
        F.col("SECOND_AUTHENTICATION_FACTOR").alias("second_authentication_factor"),
        F.coalesce(F.col("IS_SUCCESS") == "YES", F.lit(False)).alias("success"),
        F.col("EVENT_TIMESTAMP").alias("event_timestamp"),
    )


def access_log(raw: DataFrame, as_of: Column) -> DataFrame:
    """Access log rows of the ninety days up to ``as_of``, JSON still unparsed."""
    time = F.col("QUERY_START_TIME")
    recent = raw.filter((time > as_of - F.expr(ACCESS_WINDOW)) & (time <= as_of))
    return recent.select(
        clean_identifier("USER_NAME").alias("user"),
        F.col("DIRECT_OBJECTS_ACCESSED").alias("accessed"),
    )


def access_log_by_day(raw: DataFrame, periods: Sequence[tuple[datetime, datetime]]) -> DataFrame:
    """(day, user, accessed) of the log rows in the periods (after, until], JSON still unparsed.

    Like a window, a day does not hold its first instant but the next day's.
    """
    time = F.col("QUERY_START_TIME")
    inside = [(time > F.lit(after)) & (time <= F.lit(until)) for after, until in periods]
    kept = raw.filter(reduce(or_, inside, F.lit(False)))
    return kept.select(
        F.to_date(time - F.expr("INTERVAL 1 MICROSECOND")).alias("day"),
        clean_identifier("USER_NAME").alias("user"),
        F.col("DIRECT_OBJECTS_ACCESSED").alias("accessed"),
    )


def _policy_references(raw: DataFrame, kind: str, target: Column) -> DataFrame:
    return raw.filter(F.col("POLICY_KIND") == kind).select(
        F.col("POLICY_NAME").alias("name"),
        F.col("POLICY_DB").alias("database"),
        F.col("POLICY_SCHEMA").alias("schema"),
        F.col("POLICY_ID").alias("policy_id"),
        target.alias("target_fqn"),
        F.when(
            F.col("TAG_DATABASE").isNotNull(), fqn("TAG_DATABASE", "TAG_SCHEMA", "TAG_NAME")
        ).alias("tag_fqn"),
        F.col("POLICY_STATUS").alias("status"),
        fqn("POLICY_DB", "POLICY_SCHEMA", "POLICY_NAME").alias("fqn"),
    )


def masking_policy_references(raw: DataFrame) -> DataFrame:
    """Masking policies applied to columns."""
    target = fqn("REF_DATABASE_NAME", "REF_SCHEMA_NAME", "REF_ENTITY_NAME", "REF_COLUMN_NAME")
    return _policy_references(raw, "MASKING_POLICY", target)


def row_access_policy_references(raw: DataFrame) -> DataFrame:
    """Row access policies applied to tables."""
    target = fqn("REF_DATABASE_NAME", "REF_SCHEMA_NAME", "REF_ENTITY_NAME")
    return _policy_references(raw, "ROW_ACCESS_POLICY", target)


def network_policies(raw: DataFrame) -> DataFrame:
    return raw.select("name")


# Tables that map one raw table to one snapshot table without a time window.
DIRECT: dict[str, Callable[[DataFrame], DataFrame]] = {
    "databases": databases,
    "schemas": schemas,
    "entities": entities,
    "columns": columns,
    "users": users,
    "roles": roles,
    "role_grants": role_grants,
    "privilege_grants": privilege_grants,
    "future_grants": future_grants,
    "masking_policies": policies,
    "row_access_policies": policies,
    "network_policies": network_policies,
}
