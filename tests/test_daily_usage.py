import json
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grantlens import Snapshot
from grantlens.sources import daily_usage, normalize
from grantlens.workspace import Workspace
from tests.tables import raw

MIDNIGHT = datetime(2024, 3, 10, tzinfo=UTC)


def log(spark, seed=1, n=300, end=datetime(2024, 3, 14, tzinfo=UTC)):
    """Queries of the last days, some of them exactly at midnight, some unreadable."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        when = end - timedelta(seconds=draw.randrange(12 * 86_400))
        if i % 10 == 0:
            when = datetime(when.year, when.month, when.day, tzinfo=UTC)
        entry = {"objectDomain": "Table", "objectName": f"D.S.T{draw.randrange(4)}", "columns": [{"columnName": f"C{draw.randrange(3)}"}]}
        text = "no json" if i % 17 == 0 else json.dumps([entry])
        rows.append({"QUERY_START_TIME": when, "USER_NAME": f"U{draw.randrange(5)}", "DIRECT_OBJECTS_ACCESSED": text})
    return raw(spark, "access_history", rows)


def full(df, as_of, days):
    """The same tables from the log itself."""
    time = F.col("QUERY_START_TIME")
    window = df.filter((time > F.lit(as_of - timedelta(days=days))) & (time <= F.lit(as_of)))
    return contents(Snapshot.from_raw({"access_history": window}, access_as_of=F.lit(as_of)))


def contents(tables):
    get = tables.get if isinstance(tables, dict) else lambda name: getattr(tables, name)
    names = ("usage_tables", "usage_columns", "unreadable_log_rows")
    return {name: sorted(tuple(r) for r in get(name).select(sorted(get(name).columns)).collect()) for name in names}


def test_whole_days():
    noon = MIDNIGHT + timedelta(hours=12)
    two = [date(2024, 3, 8), date(2024, 3, 9)]
    assert daily_usage.whole_days(MIDNIGHT - timedelta(days=2), MIDNIGHT) == two
    assert daily_usage.whole_days(noon - timedelta(days=2), noon) == [date(2024, 3, 9)]
    assert daily_usage.whole_days(noon - timedelta(hours=3), noon) == []


@pytest.mark.parametrize("shift", [timedelta(0), timedelta(hours=7, seconds=3)], ids=["midnight", "morning"])
def test_sliding_window_equals_the_full_rollup(spark, tmp_path, shift):
    df, path = log(spark), str(tmp_path / "days")
    for day in (0, 1, 2, 4):
        as_of = MIDNIGHT + shift + timedelta(days=day)
        found = daily_usage.sliding_usage(df, path, as_of, Workspace(spark), days=5)
        expected = full(df, as_of, 5)
        assert contents(found) == expected and len(expected["usage_tables"]) > 5 and expected["unreadable_log_rows"]
        kept = daily_usage.stored_days(spark, path)
        assert kept == set(daily_usage.whole_days(as_of - timedelta(days=5), as_of))


def test_the_next_audit_reads_one_day(spark, tmp_path):
    df, path = log(spark), str(tmp_path / "days")
    daily_usage.sliding_usage(df, path, MIDNIGHT, Workspace(spark), days=5)
    old = F.col("QUERY_START_TIME") <= F.lit(MIDNIGHT)
    failing = df.withColumn(
        "DIRECT_OBJECTS_ACCESSED", F.when(old, F.raise_error(F.lit("an old day was parsed"))).otherwise(F.col("DIRECT_OBJECTS_ACCESSED"))
    )
    next_day = MIDNIGHT + timedelta(days=1)
    found = daily_usage.sliding_usage(failing, path, next_day, Workspace(spark), days=5)
    assert contents(found) == full(df, next_day, 5)
    again = daily_usage.sliding_usage(failing.filter(F.lit(False)), path, next_day, Workspace(spark), days=5)
    assert contents(again) == full(df, next_day, 5)


def test_periods_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    log(spark).write.parquet(path)
    df = normalize.access_log_by_day(spark.read.parquet(path), [(MIDNIGHT, MIDNIGHT + timedelta(days=1))])
    df.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "GreaterThan(QUERY_START_TIME" in pushed and "LessThanOrEqual(QUERY_START_TIME" in pushed


def test_days_without_queries_are_kept_too(spark, tmp_path):
    empty, path = log(spark, n=0), str(tmp_path / "days")
    found = daily_usage.sliding_usage(empty, path, MIDNIGHT, Workspace(spark), days=3)
    assert contents(found) == {"usage_tables": [], "usage_columns": [], "unreadable_log_rows": []}
    assert len(daily_usage.stored_days(spark, path)) == 3


def test_snapshots_take_sliding_usage(spark, tmp_path):
    df = log(spark)
    usage = daily_usage.sliding_usage(df, str(tmp_path / "days"), MIDNIGHT, Workspace(spark), days=5)
    made = Snapshot.from_raw({"access_history": df.filter(F.raise_error(F.lit("read")).isNull())}, usage=usage)
    assert made.access_log is None and contents(made) == full(df, MIDNIGHT, 5)


def test_other_time_zones_are_refused(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError):
            daily_usage.sliding_usage(log(spark, n=1), str(tmp_path / "days"), MIDNIGHT, Workspace(spark))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
