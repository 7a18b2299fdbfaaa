"""Joins that make far more rows than they read."""

import pytest
from pyspark.sql import functions as F

from grantlens.operators import skew
from grantlens.workspace import Stage, Workspace


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


def rows_by_task(df):
    counts = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return [n for n in counts if n]


def test_pairs_are_spread_over_tasks(spark, workspace, monkeypatch):
    """Both sides are a few kilobytes, which would be one task, and make 90,000 rows."""
    monkeypatch.setattr(skew, "TASK_PAIRS", 1000)
    monkeypatch.setattr(skew, "CELL_ROWS", 30)
    left = spark.range(300).select(F.lit("R").alias("role"), F.col("id").alias("object"))
    right = spark.range(300).select(F.lit("R").alias("role"), F.col("id").alias("user"))
    # Stored, as such tables are: a constant key would be taken out of the plan.
    left, right = workspace.stage(left, "left"), workspace.stage(right, "right")
    joined = skew.balanced_join(workspace, left, right, ["role"], "inner", "object", "user")
    assert joined.columns == ["role", "object", "user"]
    assert joined.distinct().count() == joined.count() == 90_000
    tasks = rows_by_task(joined)
    assert len(tasks) > 20 and max(tasks) < 15_000


def test_pairs_of_many_small_keys_are_spread_over_tasks(spark, workspace, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 1000)
    left = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    joined = skew.balanced_join(
        workspace, Stage(left, 1000), Stage(left.withColumnRenamed("a", "b"), 1000), ["k"], "inner", "a", "b"
    )
    assert joined.distinct().count() == 20_000
    assert len(rows_by_task(joined)) > 8
