"""Usage over a sliding window, from rollups of whole days that are kept between audits.

The window of an audit ends when it is made, so the next day's audit shares all but a day of it. Rollups per
day, user and object are kept in a folder partitioned by day. An audit adds the days that are missing, reads
the rest, and scans the log itself only for the parts of days at the two ends of its window.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.operators.usage import counted_usage, usage_tables
from grantlens.sources.normalize import ACCESS_DAYS, access_log_by_day
from grantlens.workspace import Workspace

STORED = "level string, user string, object string, usage_count bigint, day date"

# The row that says that a day is kept, which may have no others.
KEPT = "kept"


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time(), UTC)


def whole_days(after: datetime, until: datetime) -> list[date]:
    """Days that lie in the window (after, until] with all their instants."""
    first = after.date() if after == _midnight(after.date()) else after.date() + timedelta(days=1)
    return [first + timedelta(days=i) for i in range((until.date() - first).days)]


def stored_days(spark: SparkSession, path: str) -> set[date]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return set()
    # One row per day.
    kept = spark.read.schema(STORED).parquet(path).filter(F.col("level") == KEPT)
    return {row.day for row in kept.select("day").distinct().collect()}


def sliding_usage(
    raw: DataFrame, path: str, as_of: datetime, workspace: Workspace, days: int = ACCESS_DAYS
) -> dict[str, DataFrame]:
    """The snapshot's usage tables for the ``days`` up to ``as_of`` (with a time zone), by way of ``path``.

    ``raw`` is the raw access history. Days are days of UTC, which has to be the session's time zone. A day is
    kept once it has ended; rows that reach the log later than that are not counted, unless the day is removed
    from the folder. Days before the window are removed. The folder must be read by nobody else meanwhile.
    """
    spark = raw.sparkSession
    zone = spark.conf.get("spark.sql.session.timeZone")
    if spark._jvm.java.time.ZoneId.of(zone).normalized().getId() != "Z":
        raise ValueError(f"days of UTC need a session in UTC, not in {zone}")
    until = as_of.astimezone(UTC)
    after = until - timedelta(days=days)
    wanted = whole_days(after, until)
    kept = stored_days(spark, path)
    missing = [day for day in wanted if day not in kept]
    if missing:
        _add(raw, path, missing)
    _remove(spark, path, sorted(day for day in kept if wanted and day < wanted[0]))

    edges = [(after, until)]
    counts = []
    if wanted:
        edges = [(after, _midnight(wanted[0])), (_midnight(wanted[-1] + timedelta(days=1)), until)]
        stored = spark.read.schema(STORED).parquet(path)
        inside = F.col("day").between(F.lit(wanted[0]), F.lit(wanted[-1])) & (F.col("level") != KEPT)
        counts.append(stored.filter(inside).drop("day"))
    edges = [(start, end) for start, end in edges if start < end]
    if edges:
        counts.append(counted_usage(access_log_by_day(raw, edges)))
    every = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    summed = every.groupBy("level", "user", "object").agg(F.sum("usage_count").alias("usage_count"))
    return usage_tables(workspace.stage(summed, "sliding-usage", partition_by="level").df)


def _add(raw: DataFrame, path: str, missing: list[date]) -> None:
    """Roll up the missing days in one scan; a write that fails keeps none of them."""
    spark = raw.sparkSession
    periods: list[tuple[datetime, datetime]] = []
    for day in missing:
        start, end = _midnight(day), _midnight(day + timedelta(days=1))
        if periods and periods[-1][1] == start:
            start = periods.pop()[0]
        periods.append((start, end))
    counted = counted_usage(access_log_by_day(raw, periods), by=("day",))
    days = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(day) for day in missing])).alias("day"))
    nothing = F.lit(None).cast("string")
    marks = days.select(
        F.lit(KEPT).alias("level"), nothing.alias("user"), nothing.alias("object"), F.lit(0).cast("bigint").alias("usage_count"), "day"
    )
    rows = counted.select("level", "user", "object", "usage_count", "day").unionByName(marks)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(path)


def _remove(spark: SparkSession, path: str, days: list[date]) -> None:
    for day in days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/day={day.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
