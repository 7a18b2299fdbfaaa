"""Wording of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plural(word: str, number: Column) -> Column:
    return F.when(number == 1, word).otherwise(word + "s")


def counted(number: Column, word: str) -> Column:
    """``1,234 users``"""
    return F.concat(F.format_number(number, 0), F.lit(" "), plural(word, number))


def percent(share: Column) -> Column:
    """Share of one as a percentage with two places."""
    return F.round(share * 100, 2)


def missing_level(has_database: Column, has_schema: Column) -> Column:
    """Which parent permission is missing; null when neither is."""
    return (
        F.when(~has_database & ~has_schema, "both")
        .when(~has_database, "database")
        .when(~has_schema, "schema")
    )
