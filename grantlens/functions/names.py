"""Name based predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlens.functions.identifiers import extract_schema, truncated_database

# Databases that belong to the platform, not the account.
SYSTEM_DATABASES = ["SNOWFLAKE", "SNOWFLAKE_SAMPLE_DATA"]
SYSTEM_SCHEMA = "INFORMATION_SCHEMA"
BUILT_IN_USER = "SNOWFLAKE"

# Patterns that mark a column name as potentially sensitive.
SENSITIVE_TERMS = [
    "email",
    "e-mail",
    "cell",
    "fax",
    "phone",
    "^ssn$",
    "birth",
    "born",
    "^age$",
    "^sex$",
    "gender",
    "mailing",
    "address",
    "street",
    "^zip",
    "^cc",
    "credit_card",
    "license_plate",
    "^lat",
    "^long",
    "^ip",
    "_ip$",
    "first_name",
    "last_name",
    "firstname",
    "lastname",
    "^name$",
    "^amount$",
    "^paid$",
]

# Patterns that mark a sensitive name as already protected.
SAFE_TERMS = ["hashed", "masked", "safe"]


def has_sensitive_term(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE_TERMS))


def has_safe_term(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SAFE_TERMS))


def is_sensitive(name: Column) -> Column:
    return has_sensitive_term(name) & ~has_safe_term(name)


def is_system_database(name: Column) -> Column:
    return name.isin(*SYSTEM_DATABASES)


def in_user_space(asset: Column) -> Column:
    """Whether an asset FQN lies outside system databases and the information schema."""
    system = [f'"{name}"' for name in SYSTEM_DATABASES]
    schema = F.coalesce(extract_schema(asset), F.lit(""))
    return ~truncated_database(asset).isin(*system) & (schema != f'"{SYSTEM_SCHEMA}"')
