"""Checks, their plans, and the audit that runs them over one snapshot."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from threading import Lock
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.functions.scoring import INFO, sort_key, status
from grantlens.operators import access, graph, ranking
from grantlens.operators.factored import FactoredAccess
from grantlens.sources.snapshot import Snapshot
from grantlens.workspace import Stage, Workspace, side_by_side

T = TypeVar("T")


@dataclass(frozen=True)
class CheckPlan:
    """What a check found.

    ``metrics`` are named scalar columns (scalar subqueries or literals); ``score``
    is an expression over those names. ``findings`` are named tables. ``summaries`` say the
    same in fewer rows; with one at hand, ``n_findings`` gives the number of findings from it.
    """

    score: Column
    metrics: Mapping[str, Column] = field(default_factory=dict)
    findings: Mapping[str, DataFrame] = field(default_factory=dict)
    summaries: Mapping[str, DataFrame] = field(default_factory=dict)
    n_findings: Column | None = None


@dataclass(frozen=True)
class Check:
    """A named check.

    ``inputs`` are the snapshot tables its answer comes from; ``order`` names the columns
    that sort its findings in a report, with a minus for descending.
    """

    id: str
    title: str
    inputs: tuple[str, ...]
    plan: Callable[[Audit], CheckPlan]
    order: tuple[str, ...] = ()


def not_collected() -> CheckPlan:
    """The inputs are missing: status UNKNOWN."""
    return CheckPlan(F.lit(None))


def information() -> CheckPlan:
    """The feature is not in use or not available: status INFO."""
    return CheckPlan(F.lit(INFO))


class Audit:
    """One snapshot with the views that several checks share, each built once.

    Unless ``keep`` is off, usage and findings are written to the workspace too, so that metrics and
    reports read findings back, and the access log is read once, when a check first needs it.
    """

    def __init__(
        self,
        spark: SparkSession,
        snapshot: Snapshot,
        workspace: Workspace | None = None,
        keep: bool = True,
    ) -> None:
        self.spark = spark
        self._given = snapshot
        self.workspace = workspace or Workspace(spark)
        self.keep = keep
        self._guard = Lock()
        self._locks: dict[str, Lock] = {}
        self._views: dict[str, object] = {}
        self._plans: dict[str, CheckPlan] = {}

    def plan(self, check: Check) -> CheckPlan:
        if check.id not in self._plans:
            self._plans[check.id] = check.plan(self)
        return self._plans[check.id]

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return self.workspace.stage(df, name).df if self.keep else df

    def _view(self, name: str, build: Callable[[], T]) -> T:
        """Build a shared view once, also when checks run side by side."""
        with self._guard:
            lock = self._locks.setdefault(name, Lock())
        with lock:
            if name not in self._views:
                self._views[name] = build()
            return self._views[name]

    @property
    def snapshot(self) -> Snapshot:
        if not self.keep:
            return self._given
        return self._view("snapshot", lambda: self._given.on_demand(self.workspace))

    @property
    def role_closure(self) -> graph.CondensedClosure:
        return self._view(
            "role_closure",
            lambda: graph.condensed_closure(self.workspace, self.snapshot.role_grants),
        )

    @property
    def user_roles(self) -> DataFrame:
        return self._view(
            "user_roles",
            lambda: graph.user_roles(
                self.workspace, self.snapshot.role_grants, self.snapshot.users, self.role_closure
            ),
        )

    @property
    def object_privileges(self) -> DataFrame:
        return self._view("object_privileges", lambda: self.role_masks.privileges(self.workspace))

    @property
    def role_masks(self) -> access.RoleMasks:
        """Object privileges, with a bit per role; those that work are what ``role_sets`` merges."""
        return self._view(
            "role_masks", lambda: access.role_masks(self.workspace, self.snapshot.privilege_grants)
        )

    @property
    def role_sets(self) -> access.RoleSets:
        """Objects and users by their roles: the factors of who reaches what."""

        def build() -> access.RoleSets:
            # The role graph takes many small jobs, which fit beside the few large ones of the grants.
            views = ("role_masks", "role_closure")
            grants, closure = side_by_side(self.spark, lambda name: getattr(self, name), views)
            return access.role_sets(
                self.workspace, grants, self.snapshot.role_grants, self.snapshot.users, closure
            )

        return self._view("role_sets", build)

    @property
    def set_bounds(self) -> Stage:
        return self._view("set_bounds", lambda: ranking.set_bounds(self.workspace, self.role_sets))

    @property
    def factored_access(self) -> FactoredAccess:
        return FactoredAccess.of(self.role_sets)

    @property
    def object_user_counts(self) -> DataFrame:
        def build() -> DataFrame:
            counts = access.counts_of_sets(self.workspace, self.role_sets)
            return self.kept(counts, "object-user-counts")

        return self._view("object_user_counts", build)

    def role_members(self, *roots: str) -> DataFrame:
        return graph.role_members(self.workspace, self.snapshot.role_grants, roots)


def count_of(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def scalar(df: DataFrame, aggregate: Column) -> Column:
    return df.agg(aggregate).scalar()


def result_row(audit: Audit, check: Check) -> DataFrame:
    """One row of ``check_results`` for one check."""
    plan = audit.plan(check)
    found = plan.n_findings
    if found is None:
        found = F.lit(0).cast("bigint")
        for df in plan.findings.values():
            found = found + count_of(df)
    metrics = [c.cast("double").alias(name) for name, c in plan.metrics.items()]
    base = audit.spark.range(0, 1, 1, 1).select(found.alias("n_findings"), *metrics)
    scored = base.withColumn("score", plan.score.cast("double"))
    pairs = [part for name in plan.metrics for part in (F.lit(name), F.col(name))]
    empty = F.create_map().cast("map<string,double>")
    return scored.select(
        F.lit(check.id).alias("check_id"),
        F.lit(check.title).alias("title"),
        "score",
        status(F.col("score")).alias("status"),
        "n_findings",
        (F.create_map(*pairs) if pairs else empty).alias("metrics"),
        sort_key(F.col("score")).alias("sort_key"),
        F.array(*[F.lit(name) for name in check.inputs]).cast("array<string>").alias("inputs"),
    )
