"""The snapshot: every normalised table, or None where it was not collected."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import UTC, datetime
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlens.operators.usage import staged_usage, unreadable_rows, usage_rollup
from grantlens.sources import normalize
from grantlens.sources.raw import RawTables
from grantlens.sources.schemas import OPTIONAL_RAW, RAW, SNAPSHOT
from grantlens.workspace import Workspace, side_by_side

# Tables that come from the access log.
USAGE = ("usage_tables", "usage_columns", "unreadable_log_rows")


@dataclass(frozen=True)
class Snapshot:
    """Normalised tables of one account.

    None means the table was not collected; an empty table was collected and has
    no rows. Checks tell the two apart.
    """

    databases: DataFrame | None = None
    schemas: DataFrame | None = None
    entities: DataFrame | None = None
    columns: DataFrame | None = None
    users: DataFrame | None = None
    roles: DataFrame | None = None
    role_grants: DataFrame | None = None
    privilege_grants: DataFrame | None = None
    future_grants: DataFrame | None = None
    masking_policies: DataFrame | None = None
    row_access_policies: DataFrame | None = None
    login_history: DataFrame | None = None
    usage_tables: DataFrame | None = None
    usage_columns: DataFrame | None = None
    unreadable_log_rows: DataFrame | None = None
    masking_policy_references: DataFrame | None = None
    row_access_policy_references: DataFrame | None = None
    network_policies: DataFrame | None = None
    fetch_error: str | None = None
    # The access log behind usage tables that are still plans over it.
    access_log: DataFrame | None = None

    @property
    def has_data(self) -> bool:
        return self.databases is not None

    @property
    def is_enterprise_or_higher(self) -> bool:
        """Higher editions expose row access policies, even if there are none."""
        return self.row_access_policies is not None

    def has(self, *names: str) -> bool:
        """Whether the account was read and all the named tables were collected."""
        return self.has_data and all(getattr(self, name) is not None for name in names)

    def tables(self) -> dict[str, DataFrame]:
        """The collected tables by name."""
        found = {name: getattr(self, name) for name in SNAPSHOT}
        return {name: df for name, df in found.items() if df is not None}

    @classmethod
    def from_raw(
        cls,
        raw: RawTables,
        login_as_of: Column | None = None,
        access_as_of: Column | None = None,
        workspace: Workspace | None = None,
        usage: Mapping[str, DataFrame] | None = None,
    ) -> Snapshot:
        """Normalise raw tables.

        The history windows end at the given times, by default now, fixed once for all
        queries over this snapshot. With a workspace the logs are read once; without one
        they stay plans until ``staged`` or ``write``. ``usage`` (``sliding_usage``) takes the
        place of the access log, which is not read then.
        """
        now = F.lit(datetime.now(UTC))
        made: dict[str, DataFrame] = {}
        for name, mapper in normalize.DIRECT.items():
            if raw.get(name) is not None:
                made[name] = mapper(raw[name])
        if raw.get("login_history") is not None:
            until = now if login_as_of is None else login_as_of
            made["login_history"] = normalize.login_history(raw["login_history"], until)
        if raw.get("policy_references") is not None:
            refs = raw["policy_references"]
            made["masking_policy_references"] = normalize.masking_policy_references(refs)
            made["row_access_policy_references"] = normalize.row_access_policy_references(refs)
        if usage is not None:
            made |= usage
        elif raw.get("access_history") is not None:
            until = now if access_as_of is None else access_as_of
            log = normalize.access_log(raw["access_history"], until)
            made["usage_tables"] = usage_rollup(log, "table")
            made["usage_columns"] = usage_rollup(log, "column")
            made["unreadable_log_rows"] = unreadable_rows(log)
            made["access_log"] = log
        lazy = cls(**made)
        return lazy if workspace is None else lazy.staged(workspace)

    def staged(self, workspace: Workspace) -> Snapshot:
        """The same snapshot with its usage stored, from one scan and one parse of the access log."""
        if self.access_log is None:
            return self
        usage = staged_usage(self.access_log, workspace)
        wanted = {name: df for name, df in usage.items() if getattr(self, name) is not None}
        return replace(self, **wanted, access_log=None)

    def on_demand(self, workspace: Workspace) -> Snapshot:
        """The same snapshot, whose usage is stored when one of its usage tables is first asked for."""
        if self.access_log is None:
            return self
        return _StoredOnDemand(**{f.name: getattr(self, f.name) for f in fields(self)}, workspace=workspace)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Save every collected table as a parquet folder; the access log is read once."""
        if not self.tables():
            return
        spark = next(iter(self.tables().values())).sparkSession
        root = path.rstrip("/")
        with Workspace(spark) as workspace:
            tables = self.staged(workspace).tables()

            def save(name: str) -> None:
                tables[name].write.mode(mode).parquet(f"{root}/{name}")

            side_by_side(spark, save, tables)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Snapshot:
        """Load a saved snapshot; a missing folder is a table not collected."""
        found = {}
        for name, schema in SNAPSHOT.items():
            try:
                found[name] = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}")
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return cls(**found)

    def without(self, *names: str) -> Snapshot:
        """The same snapshot with some tables marked as not collected."""
        return replace(self, **dict.fromkeys(names))


@dataclass(frozen=True)
class _StoredOnDemand(Snapshot):
    """Reads no log until a usage table is read, and then reads it once for all of them."""

    workspace: Workspace | None = None
    _lock: Lock = field(default_factory=Lock, repr=False, compare=False)

    def __getattribute__(self, name: str) -> object:
        value = super().__getattribute__(name)
        if name in USAGE and value is not None:
            return getattr(self._stored(), name)
        return value

    def _stored(self) -> Snapshot:
        found = self.__dict__
        with found["_lock"]:
            if "_usage" not in found:
                found["_usage"] = self._plain().staged(found["workspace"])
            return found["_usage"]

    def _plain(self) -> Snapshot:
        return Snapshot(**{f.name: self.__dict__[f.name] for f in fields(Snapshot)})

    def without(self, *names: str) -> Snapshot:
        return self._plain().without(*names).on_demand(self.workspace)

    def has(self, *names: str) -> bool:
        """Whether the account was read and all the named tables were collected; reads none of them."""
        return self.has_data and all(self.__dict__[name] is not None for name in names)


assert [f.name for f in fields(Snapshot)] == [*SNAPSHOT, "fetch_error", "access_log"]


def load_snapshot(
    reader: Callable[[], RawTables],
    login_as_of: Column | None = None,
    access_as_of: Column | None = None,
    workspace: Workspace | None = None,
) -> Snapshot:
    """Read and normalise an account, tolerating only the optional tables to be missing.

    A source that cannot be opened, or lacks another table, gives an empty snapshot that
    carries the error, so an audit still runs and reports every check as unknown. A job
    that fails later fails the audit.
    """
    try:
        raw = reader()
        missing = sorted(n for n in RAW if n not in OPTIONAL_RAW and raw.get(n) is None)
        if missing:
            raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    except (PySparkException, Py4JJavaError, OSError) as error:
        return Snapshot(fetch_error=f"Unable to read the account: {error}")
    return Snapshot.from_raw(raw, login_as_of, access_as_of, workspace)
