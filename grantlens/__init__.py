"""Access-governance analytics as Spark DataFrame jobs."""

from grantlens.plans.check import Audit, Check, CheckPlan
from grantlens.plans.registry import register_check, registered_checks, sql_check
from grantlens.plans.report import write_report
from grantlens.plans.scorecard import check_results, scorecard, status_counts
from grantlens.sources.raw import read_raw, read_raw_jdbc
from grantlens.sources.snapshot import Snapshot, load_snapshot
from grantlens.workspace import Workspace

__all__ = [
    "Audit",
    "Check",
    "CheckPlan",
    "Snapshot",
    "Workspace",
    "check_results",
    "load_snapshot",
    "read_raw",
    "read_raw_jdbc",
    "register_check",
    "registered_checks",
    "scorecard",
    "sql_check",
    "status_counts",
    "write_report",
]
