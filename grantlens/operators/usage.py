"""Rollups of the access log.

Every log row is one query with a JSON array of the objects it touched. An object
counts once per query, under its quoted name, which is settled inside the row with
array functions; the only shuffle is the final count, combined on the map side, so a
table that everybody queries costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.functions.identifiers import quote_fqn
from grantlens.workspace import Workspace

COLUMNS = "array<struct<columnName:string>>"
ACCESSED = f"array<struct<objectDomain:string,objectName:string,columns:{COLUMNS}>>"
ACCESSED_TABLES = "array<struct<objectDomain:string,objectName:string>>"
ENTRIES = "array<struct<level:string,object:string>>"

# Kinds of object whose use is counted.
COUNTED_DOMAINS = ["Table", "View"]

TOP = 10


def _nameless(entry: Column, schema: str) -> Column:
    """Whether an entry that counts lacks the name of its object or of one of its columns."""
    missing = entry["objectName"].isNull()
    if schema == ACCESSED:
        columns = F.coalesce(entry["columns"], F.array().cast(COLUMNS))
        missing = missing | F.exists(columns, lambda c: c["columnName"].isNull())
    return F.coalesce(entry["objectDomain"].isin(*COUNTED_DOMAINS), F.lit(False)) & missing


def _objects(log: DataFrame, schema: str = ACCESSED, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, user, unreadable, objects): the tables and views of each query, and whether anything is left out."""
    parsed = log.select(*by, "user", "accessed", F.from_json("accessed", schema).alias("parsed"))
    counted = F.filter(
        "parsed",
        lambda o: o["objectDomain"].isin(*COUNTED_DOMAINS) & o["objectName"].isNotNull(),
    )
    unreadable = F.col("accessed").isNotNull() & (
        F.col("parsed").isNull() | F.exists("parsed", lambda o: _nameless(o, schema))
    )
    return parsed.select(*by, "user", unreadable.alias("unreadable"), counted.alias("objects"))


def _entry(level: str, name: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), name.alias("object"))


def _table_entries() -> Column:
    return F.transform(F.col("objects.objectName"), lambda name: _entry("table", quote_fqn(name)))


def _column_entries() -> Column:
    def of(o: Column) -> Column:
        known = F.filter(
            F.coalesce(o["columns"], F.array().cast(COLUMNS)),
            lambda c: c["columnName"].isNotNull(),
        )
        table = quote_fqn(o["objectName"])
        return F.transform(
            known,
            lambda c: _entry("column", F.concat(table, F.lit("."), quote_fqn(c["columnName"]))),
        )

    return F.flatten(F.transform("objects", of))


def _counted(objects: DataFrame, entries: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, level, user, object, usage_count): rows that hold each entry at least once."""
    return (
        objects.select(*by, "user", F.explode(F.array_distinct(entries)).alias("entry"))
        .groupBy(*by, F.col("entry.level").alias("level"), "user", F.col("entry.object").alias("object"))
        .agg(F.count(F.lit(1)).alias("usage_count"))
    )


def usage_rollup(log: DataFrame, level: str) -> DataFrame:
    """(user, object, usage_count): queries per user and table, or per user and column."""
    if level == "table":
        counts = _counted(_objects(log, ACCESSED_TABLES), _table_entries())
    else:
        counts = _counted(_objects(log), _column_entries())
    return counts.select("user", "object", "usage_count")


def unreadable_rows(log: DataFrame) -> DataFrame:
    """(user, rows): log rows that are no JSON array, or have entries without names, which do not count."""
    bad = _objects(log).filter("unreadable")
    return bad.groupBy("user").agg(F.count(F.lit(1)).alias("rows"))


def counted_usage(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, level, user, object, usage_count): all rollups of the log from one parse and one shuffle."""
    nothing = F.array().cast(ENTRIES)
    bad = F.array(_entry("unreadable", F.lit(None).cast("string")))
    entries = F.concat(
        F.coalesce(_table_entries(), nothing),
        F.coalesce(_column_entries(), nothing),
        F.when(F.col("unreadable"), bad).otherwise(nothing),
    )
    return _counted(_objects(log, by=by), entries, by)


def usage_tables(usage: DataFrame) -> dict[str, DataFrame]:
    """The snapshot's usage tables by name, from rows of ``counted_usage``."""

    def of(level: str) -> DataFrame:
        return usage.filter(F.col("level") == level).drop("level")

    return {
        "usage_tables": of("table"),
        "usage_columns": of("column"),
        "unreadable_log_rows": of("unreadable").select(
            "user", F.col("usage_count").alias("rows")
        ),
    }


def staged_usage(log: DataFrame, workspace: Workspace) -> dict[str, DataFrame]:
    """All rollups of the log, stored after one scan."""
    return usage_tables(workspace.stage(counted_usage(log), "usage", partition_by="level").df)


def popularity(usage: DataFrame) -> DataFrame:
    """(object, n_users, usage_count); a user has one usage row per object."""
    return usage.groupBy("object").agg(
        F.count("user").alias("n_users"), F.sum("usage_count").alias("usage_count")
    )


def most_used(usage: DataFrame) -> DataFrame:
    """Top objects by usage and by number of users, ties by name."""
    popular = popularity(usage)
    by_usage = [F.desc("usage_count"), F.desc("n_users"), F.asc("object")]
    by_users = [F.desc("n_users"), F.desc("usage_count"), F.asc("object")]

    def top(ranking: str, order: list[Column]) -> DataFrame:
        best = popular.orderBy(*order).limit(TOP).withColumn("ranking", F.lit(ranking))
        rank = F.row_number().over(Window.partitionBy("ranking").orderBy(*order))
        return best.select("ranking", rank.alias("rank"), "object", "n_users", "usage_count")

    return top("usage", by_usage).unionByName(top("users", by_users))
