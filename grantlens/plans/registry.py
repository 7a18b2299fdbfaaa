"""The list of checks and how to add to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.plans import admin, grants, policies, reach
from grantlens.plans.check import Audit, Check, CheckPlan, count_of, not_collected

BUILT_IN: list[Check] = sorted(
    [*admin.CHECKS, *grants.CHECKS, *reach.CHECKS, *policies.CHECKS], key=lambda c: c.id
)
_ADDED: list[Check] = []


def registered_checks() -> list[Check]:
    return [*BUILT_IN, *_ADDED]


def register_check(check: Check) -> None:
    """Add a check to every audit from now on."""
    if any(c.id == check.id for c in registered_checks()):
        raise ValueError(f"check {check.id} exists already")
    _ADDED.append(check)


def unregister_check(check_id: str) -> None:
    """Remove a check added with ``register_check``."""
    _ADDED[:] = [c for c in _ADDED if c.id != check_id]


def sql_check(
    id: str,
    title: str,
    inputs: tuple[str, ...],
    findings_sql: str,
    score_sql: str = "CASE WHEN n_findings = 0 THEN 1.0 ELSE 0.49 END",
) -> Check:
    """A check written in SQL.

    ``findings_sql`` names snapshot tables in braces, as in ``SELECT name FROM {users}``;
    ``score_sql`` is an expression over ``n_findings``. The check is unknown when one of
    its ``inputs`` was not collected.
    """

    def plan(audit: Audit) -> CheckPlan:
        if not audit.snapshot.has(*inputs):
            return not_collected()
        tables = {name: getattr(audit.snapshot, name) for name in inputs}
        findings = audit.kept(audit.spark.sql(findings_sql, **tables), id)
        metrics = {"n_rows": count_of(findings)}
        return CheckPlan(F.expr(score_sql), metrics, {"": findings})

    return Check(id, title, inputs, plan)
