"""Batch readers for raw metadata exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from grantlens.sources.schemas import OPTIONAL_RAW, RAW

RawTables = dict[str, DataFrame | None]

# Error conditions of Spark for tables that do not exist.
ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")

# How sources name tables that do not exist or that the reader has no right to.
REFUSALS = (
    "does not exist",
    "not found",
    "no such table",
    "not authorized",
    "permission",
    "privilege",
    "access denied",
    "accesscontrol",
)


def read_raw(
    spark: SparkSession,
    location: str,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> RawTables:
    """Read every raw table from ``location``; a table that is not there is None.

    ``format`` is a file format (parquet, orc, json, csv, avro ...) with one
    folder per table, or ``table`` for catalog tables in the namespace ``location``.
    """
    prefix = f"{location}." if location else ""

    def read(name: str) -> DataFrame:
        if format == "table":
            return spark.table(prefix + name)
        path = f"{location.rstrip('/')}/{name}"
        return spark.read.format(format).options(**(options or {})).schema(RAW[name]).load(path)

    return {name: _unless_absent(name, lambda name=name: read(name)) for name in RAW}


def _unless_absent(name: str, read: Callable[[], DataFrame]) -> DataFrame | None:
    """None for a table that does not exist, or an optional one that may not be read."""
    try:
        return read()
    except (PySparkException, Py4JJavaError) as error:
        if isinstance(error, AnalysisException) and error.getCondition() in ABSENT:
            return None
        if name in OPTIONAL_RAW and _refused(error):
            return None
        raise


def _refused(error: Exception) -> bool:
    """Whether the source says that the table is not there or not allowed, in its own words."""
    words = str(error).lower()
    return any(word in words for word in REFUSALS)


def read_raw_jdbc(
    spark: SparkSession,
    url: str,
    tables: Mapping[str, str],
    properties: Mapping[str, str] | None = None,
    predicates: Mapping[str, Sequence[str]] | None = None,
) -> RawTables:
    """Read raw tables over JDBC.

    ``tables`` maps raw names to source tables or subqueries; names left out are
    None. ``predicates`` splits a table into one task per condition, for example one
    per database. Window filters and column selection are pushed to the source.
    """
    props = dict(properties or {})
    split = predicates or {}
    unknown = sorted(set(tables) - set(RAW))
    if unknown:
        raise ValueError(f"unknown raw tables: {', '.join(unknown)}")

    def read(name: str) -> DataFrame:
        parts = {"predicates": list(split[name])} if name in split else {}
        return spark.read.jdbc(url, tables[name], properties=props, **parts)

    return {
        name: _unless_absent(name, lambda name=name: read(name)) if name in tables else None
        for name in RAW
    }
