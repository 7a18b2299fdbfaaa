"""Time the headline queries over raw exports of the sample account.

Prints one JSON line. BENCH_SF_DIR names the test data, BENCH_CPUS the local cores.
The exports are written first, since an audit starts from them; that time is reported
as ``setup_sec`` and is not part of the value.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.operators import access, usage
from grantlens.plans.check import Audit
from grantlens.plans.registry import BUILT_IN
from grantlens.plans.report import write_report
from grantlens.plans.scorecard import check_results
from grantlens.sources.raw import read_raw
from sample_account import ACCESS_AS_OF, LOGIN_AS_OF, SampleAccount
from grantlens.sources.snapshot import Snapshot
from grantlens.workspace import Workspace, side_by_side

CHECKS = {check.id: check for check in BUILT_IN}


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("grantlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{tempfile.mkdtemp(prefix='grantlens-bench-')}/stages")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    timings: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object]) -> None:
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    with Workspace(spark) as workspace:
        exports = f"{workspace.path}/exports"

        start = time.perf_counter()
        sample = SampleAccount(spark, folder).raw()
        side_by_side(spark, lambda name: sample[name].write.parquet(f"{exports}/{name}"), sample)
        setup = round(time.perf_counter() - start, 3)

        def load(staging: Workspace | None = None) -> Snapshot:
            return Snapshot.from_raw(
                read_raw(spark, exports),
                login_as_of=F.lit(LOGIN_AS_OF).cast("timestamp"),
                access_as_of=F.lit(ACCESS_AS_OF).cast("timestamp"),
                workspace=staging,
            )

        lazy = load()
        audit = Audit(spark, lazy, workspace)
        snapshot = lazy

        def counts(plan: str) -> DataFrame:
            return access.object_user_counts(
                workspace,
                audit.role_masks,
                snapshot.role_grants,
                snapshot.users,
                audit.role_closure,
                plan,
            )

        timed("usage_tables", lambda: run(snapshot.usage_tables))
        timed("usage_columns", lambda: run(snapshot.usage_columns))
        timed("usage_top", lambda: run(usage.most_used(snapshot.usage_tables)))
        timed("role_closure", lambda: audit.role_closure)
        timed("user_roles", lambda: run(audit.user_roles))
        timed("object_privileges", lambda: run(audit.object_privileges))
        timed(
            "user_object_access",
            lambda: access.user_object_access(
                workspace, audit.object_privileges, audit.user_roles
            ).count(),
        )
        timed("object_user_counts", lambda: run(counts("profiles")))
        timed("object_user_counts_bitmaps", lambda: run(counts("bitmaps")))
        for check_id in (
            "c01_admin_users",
            "c03_shadow_grants",
            "c05_password_only",
            "c06_inactive_users",
            "c08_inaccessible_objects",
            "c11_least_used_tables",
            "c12_future_grant_coverage",
            "c13_most_accessible",
            "c14_least_accessible",
            "c15_masking_policies",
            "c17_sensitive_columns",
        ):

            def findings(check_id: str = check_id) -> None:
                fresh = Audit(spark, lazy, workspace)
                for df in fresh.plan(CHECKS[check_id]).findings.values():
                    run(df)

            timed(check_id, findings)

        def results() -> None:
            run(check_results(Audit(spark, load(workspace), workspace, keep=True), BUILT_IN))

        timed("check_results", results)
        timed(
            "full_report",
            lambda: write_report(spark, lazy, f"{workspace.path}/report", checks=BUILT_IN),
        )

    spark.stop()
    total = round(sum(timings.values()), 3)
    line = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "setup_sec": setup,
        "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
