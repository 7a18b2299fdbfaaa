"""Write an audit out as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantlens.functions.scoring import STATUSES
from grantlens.plans.check import Audit, Check
from grantlens.plans.registry import registered_checks
from grantlens.plans.scorecard import check_results, scorecard
from grantlens.sources.snapshot import Snapshot
from grantlens.workspace import Workspace, side_by_side


def sections(results: DataFrame) -> DataFrame:
    """Results in report order, with their ``place``: by section, then worst first, then title."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    # A row per check.
    place = F.row_number().over(Window.orderBy("section", "sort_key", "title"))
    return results.withColumn("section", order).withColumn("place", place).orderBy("place")


def order_keys(check: Check, columns: Sequence[str]) -> list[Column]:
    """What the check sorts its findings by, as far as the table has the columns."""
    return [
        F.desc(name[1:]) if name.startswith("-") else F.asc(name)
        for name in check.order
        if name.lstrip("-") in columns
    ]


def in_order(findings: DataFrame, check: Check) -> DataFrame:
    """Findings sorted inside each file; ``findings_order`` in the results says by what to merge them."""
    keys = order_keys(check, findings.columns)
    return findings.sortWithinPartitions(*keys) if keys else findings


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(name) for name in names]).cast("array<string>")


def write_report(
    spark: SparkSession,
    snapshot: Snapshot,
    path: str,
    format: str = "parquet",
    checks: Sequence[Check] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Run the checks and write ``check_results``, ``scorecard``, ``findings_*`` and ``summary_*``.

    Findings are computed once: they are staged, and metrics, results and the report
    read the staged tables.
    """
    chosen = list(checks or registered_checks())
    root = path.rstrip("/")

    def save(df: DataFrame, name: str) -> None:
        df.write.mode(mode).format(format).save(f"{root}/{name}")

    with Workspace(spark) as workspace:
        audit = Audit(spark, snapshot, workspace, keep=True)
        results = workspace.stage(check_results(audit, chosen), "check-results").df
        card = scorecard(results).withColumn(
            "fetch_error", F.lit(snapshot.fetch_error).cast("string")
        )
        orders = F.create_map(*[
            part for check in chosen for part in (F.lit(check.id), _names(check.order))
        ])
        listed = sections(results).withColumn("findings_order", orders[F.col("check_id")])
        tables = {"check_results": listed, "scorecard": card}
        for check in chosen:
            for name, findings in audit.plan(check).findings.items():
                title = "_".join(filter(None, ["findings", check.id, name]))
                tables[title] = in_order(findings, check)
            for name, summary in audit.plan(check).summaries.items():
                tables[f"summary_{check.id}_{name}"] = in_order(summary, check)
        side_by_side(spark, lambda name: save(tables[name], name), tables)
