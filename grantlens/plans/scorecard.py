"""All checks as one table, and the grade over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.functions.scoring import STATUSES, grade
from grantlens.plans.check import Audit, Check, result_row
from grantlens.plans.registry import registered_checks
from grantlens.workspace import side_by_side


def check_results(audit: Audit, checks: Sequence[Check] | None = None) -> DataFrame:
    """One row per check, the worst first.

    Checks are independent and many of their jobs are small, so several are submitted
    at a time to keep the cluster busy.
    """
    chosen = checks or registered_checks()
    rows = side_by_side(audit.spark, lambda check: result_row(audit, check), chosen)
    return reduce(DataFrame.unionByName, rows).orderBy("sort_key", "title")


def check_metrics(results: DataFrame) -> DataFrame:
    """(check_id, metric, value): the metrics as rows."""
    return results.select("check_id", F.explode("metrics").alias("metric", "value"))


def status_counts(results: DataFrame) -> DataFrame:
    """One row with the number of checks of each status."""
    return results.agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES]
    )


def scorecard(results: DataFrame) -> DataFrame:
    """One row: mean of the scored checks, its grade, and the status counts.

    Checks that only inform, give an insight or are unknown have no score to average.
    """
    mean = F.avg(F.when(F.col("score") >= 0, F.col("score")))
    summary = results.agg(
        mean.alias("score"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES],
    )
    counts = [f"n_{s.lower()}" for s in STATUSES]
    return summary.select("score", grade(F.col("score")).alias("grade"), *counts)
