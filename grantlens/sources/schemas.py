"""Schemas (as DDL) of the raw exports and of the normalised snapshot tables."""

from __future__ import annotations

RAW: dict[str, str] = {
    "databases": "name string, owner string",
    "schemas": "name string, database_name string, owner string, options string",
    "entities": (
        "name string, database_name string, schema_name string, owner string, kind string"
    ),
    "columns": (
        "column_name string, database_name string, schema_name string, table_name string"
    ),
    "users": (
        "name string, disabled string, owner string, last_success_login timestamp,"
        " has_password string"
    ),
    "roles": "name string, owner string",
    "role_grants": "role string, granted_to string, grantee_name string, granted_by string",
    "privilege_grants": (
        "privilege string, granted_on string, name string, granted_to string,"
        " grantee_name string, grant_option string, granted_by string"
    ),
    "future_grants": (
        "privilege string, grant_on string, name string, grantee_name string, grant_option string"
    ),
    "masking_policies": "name string, database_name string, schema_name string, owner string",
    "row_access_policies": (
        "name string, database_name string, schema_name string, owner string"
    ),
    "login_history": (
        "USER_NAME string, FIRST_AUTHENTICATION_FACTOR string,"
        " SECOND_AUTHENTICATION_FACTOR string, IS_SUCCESS string, EVENT_TIMESTAMP timestamp"
    ),
    "access_history": (
        "USER_NAME string, DIRECT_OBJECTS_ACCESSED string, QUERY_START_TIME timestamp"
    ),
    "policy_references": (
        "POLICY_KIND string, POLICY_NAME string, POLICY_DB string, POLICY_SCHEMA string,"
        " POLICY_ID bigint, POLICY_STATUS string, REF_DATABASE_NAME string,"
        " REF_SCHEMA_NAME string, REF_ENTITY_NAME string, REF_COLUMN_NAME string,"
        " TAG_DATABASE string, TAG_SCHEMA string, TAG_NAME string"
    ),
    "network_policies": "name string",
}

# Raw tables that need a higher edition or extra privileges; each may be absent.
OPTIONAL_RAW = frozenset(
    {"masking_policies", "row_access_policies", "policy_references", "access_history"}
)

_POLICY = "name string, database string, schema string, owner string, fqn string"
_REFERENCE = (
    "name string, database string, schema string, policy_id bigint, target_fqn string,"
    " tag_fqn string, status string, fqn string"
)
_USAGE = "user string, object string, usage_count bigint"

SNAPSHOT: dict[str, str] = {
    "databases": "name string, owner string, fqn string",
    "schemas": (
        "name string, database string, owner string, managed_access boolean, fqn string"
    ),
    "entities": (
        "name string, database string, schema string, owner string, entity_type string, fqn string"
    ),
    "columns": "name string, database string, schema string, table string, fqn string",
    "users": (
        "name string, disabled boolean, owner string, last_successful_login timestamp,"
        " has_password boolean"
    ),
    "roles": "name string, owner string",
    "role_grants": "role string, grantee string, grantee_type string, granted_by string",
    "privilege_grants": (
        "asset string, asset_type string, grantee string, grant_option string,"
        " privilege string, granted_by string"
    ),
    "future_grants": (
        "target string, asset_type string, grantee string, grant_option string,"
        " privilege string, set_on string"
    ),
    "masking_policies": _POLICY,
    "row_access_policies": _POLICY,
    "login_history": (
        "user string, first_authentication_factor string,"
        " second_authentication_factor string, success boolean, event_timestamp timestamp"
    ),
    "usage_tables": _USAGE,
    "usage_columns": _USAGE,
    "unreadable_log_rows": "user string, rows bigint",
    "masking_policy_references": _REFERENCE,
    "row_access_policy_references": _REFERENCE,
    "network_policies": "name string",
}

# Snapshot tables whose raw table has another name.
_RAW_SOURCE = {
    "usage_tables": "access_history",
    "usage_columns": "access_history",
    "unreadable_log_rows": "access_history",
    "masking_policy_references": "policy_references",
    "row_access_policy_references": "policy_references",
}


def raw_source(table: str) -> str:
    """Raw table that a snapshot table is made from."""
    return _RAW_SOURCE.get(table, table)
