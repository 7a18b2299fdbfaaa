
from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracle
from grantlens.functions import identifiers, names, scoring
from grantlens.operators import access, graph, usage
from grantlens.operators.factored import FactoredAccess
from grantlens.plans.admin import ACCOUNT_ADMIN, SECURITY_ADMIN
from grantlens.plans.check import Audit, Check, count_of, result_row
from grantlens.plans.registry import BUILT_IN, sql_check
from grantlens.plans.report import write_report
from grantlens.plans.scorecard import check_metrics, check_results, scorecard, status_counts
from grantlens.sources.daily_usage import sliding_usage
from grantlens.sources.schemas import OPTIONAL_RAW
from grantlens.sources.snapshot import Snapshot, load_snapshot
from grantlens.workspace import Workspace
from sample_account import ACCESS_AS_OF, SampleAccount

try:
    import grantlens.llm.queries as llm
except ModuleNotFoundError as missing:  # the subpackage and its pipeline may be left out
    if missing.name not in ("grantlens.llm", "corpus_pipeline"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

CHECKS = {check.id: check for check in BUILT_IN}

EXAMPLE_CHECK = sql_check(
    "x01_password_users",
    "Enabled Users with a Password",
    ("users",),
    "SELECT name FROM {users} WHERE has_password AND NOT disabled",
)


# Snapshot tables behind the shared views.
MEMBERS = ("role_grants", "users")
COUNTS = ("privilege_grants", *MEMBERS)

# Snapshot tables each check reads.
READS = {
    "c01_admin_users": MEMBERS,
    "c02_backup_admin": ("role_grants",),
    "c03_shadow_grants": ("future_grants",),
    "c04_network_policy": ("network_policies",),
    "c05_password_only": ("login_history",),
    "c06_inactive_users": ("users", "login_history", "usage_tables"),
    "c07_managed_schemas": ("schemas",),
    "c08_inaccessible_objects": ("privilege_grants",),
    "c09_most_used_tables": ("usage_tables",),
    "c10_most_used_columns": ("usage_columns",),
    "c11_least_used_tables": ("usage_tables", "entities"),
    "c12_future_grant_coverage": ("future_grants", "schemas"),
    "c13_most_accessible": COUNTS,
    "c14_least_accessible": ("entities", *COUNTS),
    "c15_masking_policies": ("masking_policies", "masking_policy_references"),
    "c16_row_access_policies": ("row_access_policies", "row_access_policy_references"),
    "c17_sensitive_columns": ("columns", "masking_policy_references", *COUNTS),
}


# Findings tables of the checks that do not have exactly one.
REPORTED = {"c04_network_policy": (), "c12_future_grant_coverage": ("schemas", "databases")}


def _audit(spark: SparkSession, folder: str, *tables: str) -> Audit:
    return Audit(spark, SampleAccount(spark, folder).snapshot(None, "databases", *tables))


def _full_audit(spark: SparkSession, folder: str) -> Audit:
    """An audit for all checks: shared views and findings are computed once."""
    workspace = Workspace(spark)
    snapshot = SampleAccount(spark, folder).snapshot(workspace)
    return Audit(spark, snapshot, workspace, keep=True)


# --- sources ------------------------------------------------------------------


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return getattr(SampleAccount(spark, folder).snapshot(None, name), name)


def _users(spark: SparkSession, folder: str) -> DataFrame:
    seen = F.date_format("last_successful_login", "yyyy-MM-dd HH:mm:ss")
    return _table(spark, folder, "users").withColumn("last_successful_login", seen)


def _logins(spark: SparkSession, folder: str) -> DataFrame:
    time = F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return _table(spark, folder, "login_history").withColumn("event_timestamp", time)


def _network_flag(spark: SparkSession, folder: str) -> DataFrame:
    policies = _table(spark, folder, "network_policies")
    return policies.agg((F.count(F.lit(1)) > 0).alias("has_network_policy"))


def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per table of a snapshot that was written and loaded again: its rows, and how many differ."""
    workspace = Workspace(spark)
    path = f"{workspace.path}/snapshot"
    written = SampleAccount(spark, folder).snapshot(workspace)
    written.write(path)

    def compared(name: str, loaded: DataFrame) -> DataFrame:
        kept = getattr(written, name)
        both = kept.withColumn("n", F.lit(1)).unionByName(loaded.withColumn("n", F.lit(-1)))
        changed = both.groupBy(*kept.columns).agg(F.sum("n").alias("n")).filter("n <> 0")
        return loaded.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")).select(
            "table_name", "n_rows", count_of(changed).alias("n_changed")
        )

    loaded = Snapshot.read(spark, path).tables()
    return reduce(DataFrame.unionByName, [compared(name, df) for name, df in loaded.items()])


def _availability(spark: SparkSession, folder: str) -> DataFrame:
    """Whether tables of snapshots made from all raw tables, and without the optional ones, are there."""
    raw = SampleAccount(spark, folder).raw()
    required = {name: df for name, df in raw.items() if name not in OPTIONAL_RAW}
    kinds = {"all": raw, "required": required, "partial": {"users": raw["users"]}}
    rows = []
    for kind, tables in kinds.items():
        snapshot = load_snapshot(lambda tables=tables: tables)
        rows.append(
            raw["users"].agg(
                F.lit(kind).alias("kind"),
                F.lit(snapshot.has_data).alias("has_data"),
                F.lit(snapshot.is_enterprise_or_higher).alias("enterprise"),
                F.lit(snapshot.has("usage_tables")).alias("has_usage"),
                F.lit(snapshot.fetch_error is not None).alias("failed"),
                F.count(F.lit(1)).alias("n_users"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def _gated_results(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses of the checks when usage, row access policies and privileges were not collected."""
    workspace = Workspace(spark)
    missing = ("usage_tables", "usage_columns", "row_access_policies", "privilege_grants")
    snapshot = SampleAccount(spark, folder).snapshot(workspace).without(*missing)
    return check_results(Audit(spark, snapshot, workspace), BUILT_IN).select("check_id", "status")


def _written_report(spark: SparkSession, folder: str) -> str:
    workspace = Workspace(spark)
    path = f"{workspace.path}/report"
    write_report(spark, SampleAccount(spark, folder).snapshot(workspace), path, checks=BUILT_IN)
    return path


def _findings_tables() -> list[tuple[Check, str]]:
    """Every findings table of a report with its check."""
    return [
        (check, "_".join(filter(None, [check.id, name])))
        for check in BUILT_IN
        for name in REPORTED.get(check.id, ("",))
    ]


def _report(spark: SparkSession, folder: str) -> DataFrame:
    """The results of a written report, with the place they were stored with."""
    path = _written_report(spark, folder)
    listed = spark.read.parquet(f"{path}/check_results").select("check_id", "section", "place")
    found = []
    for check, title in _findings_tables():
        table = spark.read.parquet(f"{path}/findings_{title}")
        found.append(table.agg(F.lit(check.id).alias("check_id"), F.count(F.lit(1)).alias("n")))
    written = reduce(DataFrame.unionByName, found).groupBy("check_id").agg(F.sum("n").alias("n_written"))
    return listed.join(written, "check_id").select("check_id", "section", "place", "n_written")


def _report_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Of each findings table as it lies in its files: rows, a digest of them, and rows that lie out of order."""
    path = _written_report(spark, folder)
    found = []
    for check, title in _findings_tables():
        table = spark.read.parquet(f"{path}/findings_{title}")
        lists = {name: F.array_join(name, ",") for name, kind in table.dtypes if kind.startswith("array")}
        cells = [F.coalesce(lists.get(name, F.col(name)).cast("string"), F.lit("~")) for name in sorted(table.columns)]
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 8), 16, 10).cast("bigint")
        by = [name for name in check.order if name.lstrip("-") in table.columns]
        key = F.struct(*[-F.col(name[1:]) if name.startswith("-") else F.col(name) for name in by])
        in_file = Window.partitionBy("file").orderBy("row")
        stored = table.select(
            digest.alias("digest"), key.alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        )
        checked = stored.withColumn("late", F.coalesce(F.lag("key").over(in_file) > F.col("key"), F.lit(False)))
        found.append(
            checked.agg(
                F.lit(title).alias("findings"),
                F.count(F.lit(1)).alias("n_rows"),
                F.coalesce(F.sum("digest"), F.lit(0).cast("bigint")).alias("digest"),
                F.count_if("late").alias("n_out_of_order"),
            )
        )
    return reduce(DataFrame.unionByName, found)


# --- functions ----------------------------------------------------------------


def _fqn_parts(spark: SparkSession, folder: str) -> DataFrame:
    columns = _table(spark, folder, "columns")
    dotted = F.concat_ws(".", "database", "schema", "table", "name")
    parts = columns.select(
        "fqn",
        identifiers.truncated_database("fqn").alias("db"),
        identifiers.truncated_schema("fqn").alias("schema_fqn"),
        identifiers.truncated_table("fqn").alias("table_fqn"),
        identifiers.extract_schema("fqn").alias("schema_name"),
        identifiers.quote_fqn(dotted).alias("requoted"),
    )
    return parts.select(
        "*",
        identifiers.fqn_type("db").alias("db_type"),
        identifiers.fqn_type("schema_fqn").alias("schema_type"),
        identifiers.fqn_type("table_fqn", strict=True).alias("table_type"),
    )


def _object_names(account: SampleAccount) -> DataFrame:
    grants = account.privilege_grants().filter(F.col("granted_on").isin("TABLE", "VIEW", "STAGE"))
    return grants.select(F.col("name").alias("raw_name")).distinct()


def _identifier_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    account = SampleAccount(spark, folder)
    users = account.role_grants().filter("granted_to = 'USER'")
    raw = users.select(F.col("grantee_name").alias("raw_name")).distinct()
    return raw.unionByName(_object_names(account)).select(
        "raw_name",
        identifiers.strip_one_char("raw_name").alias("stripped"),
        identifiers.clean_identifier("raw_name").alias("cleaned"),
        identifiers.clean_asset_name("raw_name").alias("asset_name"),
        identifiers.add_missing_quotes("raw_name").alias("quoted"),
    )


def _future_scope(spark: SparkSession, folder: str) -> DataFrame:
    account = SampleAccount(spark, folder)
    targets = account.future_grants().select(F.col("name").alias("target")).distinct()
    nested = _object_names(account).select(F.concat("raw_name", F.lit(".<TABLE>")).alias("target"))
    return targets.unionByName(nested).select(
        "target", identifiers.future_grant_scope("target").alias("set_on")
    )


def _sensitive(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("name")
    return _table(spark, folder, "columns").select(
        "fqn",
        names.has_sensitive_term(name).alias("sensitive"),
        names.has_safe_term(name).alias("safe"),
        names.is_sensitive(name).alias("flagged"),
    )


def _scoring(spark: SparkSession, folder: str, name: str, function) -> DataFrame:
    """Apply a score function to scores made from order keys."""
    key = F.col("o_orderkey")
    score: Column = (
        F.when(key % 17 == 0, F.lit(None).cast("double"))
        .when(key % 11 == 0, scoring.INFO)
        .when(key % 13 == 0, scoring.INSIGHT)
        .otherwise((key % 1001).cast("double") / 1000)
    )
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(key, score.alias("score"))
    return orders.select(key, function(F.col("score")).alias(name))


# --- operators ----------------------------------------------------------------


def _popularity(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return usage.popularity(_table(spark, folder, table))


def _sliding_usage(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Usage as the second of two audits, a day apart, makes it from kept days."""
    workspace = Workspace(spark)
    log = SampleAccount(spark, folder).raw("access_history")["access_history"]
    as_of = datetime.fromisoformat(ACCESS_AS_OF).replace(tzinfo=UTC)
    path = f"{workspace.path}/daily-usage"
    sliding_usage(log, path, as_of - timedelta(days=1), workspace)
    return sliding_usage(log, path, as_of, workspace)[table]


def _role_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.role_edges(_table(spark, folder, "role_grants"))


def _admin_members(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder, *MEMBERS).role_members(ACCOUNT_ADMIN, SECURITY_ADMIN)


def _user_roles(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder, *MEMBERS).user_roles


def _privileges(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder, "privilege_grants").object_privileges


def _access(spark: SparkSession, folder: str) -> DataFrame:
    audit = _audit(spark, folder, *COUNTS)
    rows = access.user_object_access(audit.workspace, audit.object_privileges, audit.user_roles)
    return rows.select("object", "db", "schema", "grantee", "user", "role")


def _factored(spark: SparkSession, folder: str) -> tuple[FactoredAccess, Audit]:
    audit = _audit(spark, folder, *COUNTS)
    return audit.factored_access, audit


def _object_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _factored(spark, folder)[0].object_sets.df


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return _factored(spark, folder)[0].profiles.df


def _role_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _factored(spark, folder)[0].role_sizes()


def _expanded(spark: SparkSession, folder: str) -> DataFrame:
    factored, audit = _factored(spark, folder)
    return factored.expand(audit.workspace)


def _expanded_for_one(spark: SparkSession, folder: str, side: str) -> DataFrame:
    """Access of the first user, or to the first object, that the factors know."""
    factored, audit = _factored(spark, folder)
    members = getattr(factored, f"{side}s").df
    first = F.col(side) == members.agg(F.min(side)).scalar()
    return factored.expand(audit.workspace, **{f"{side}s": first})


def _user_counts(spark: SparkSession, folder: str, plan: str = "auto") -> DataFrame:
    audit = _audit(spark, folder, *COUNTS)
    snapshot = audit.snapshot
    return access.object_user_counts(
        audit.workspace,
        audit.role_masks,
        snapshot.role_grants,
        snapshot.users,
        audit.role_closure,
        plan,
    )


# --- checks -------------------------------------------------------------------


def _findings(spark: SparkSession, folder: str, check_id: str, name: str = "") -> DataFrame:
    return _audit(spark, folder, *READS[check_id]).plan(CHECKS[check_id]).findings[name]


def _blocked_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """What roles are missing, schema by schema, as the check stores it."""
    plan = _audit(spark, folder, "privilege_grants").plan(CHECKS["c08_inaccessible_objects"])
    return plan.summaries["by_schema"]


def _network_check(spark: SparkSession, folder: str) -> DataFrame:
    row = result_row(_audit(spark, folder, "network_policies"), CHECKS["c04_network_policy"])
    return row.select("check_id", "score", "status", "n_findings")


def _schema_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = _findings(spark, folder, "c12_future_grant_coverage", "schemas")
    return found.withColumn("asset_types", F.array_join("asset_types", ","))


def _example_check(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder, "users").plan(EXAMPLE_CHECK).findings[""]


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return check_results(_full_audit(spark, folder), BUILT_IN)


def _rounded_results(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select(
        "check_id",
        "title",
        F.round("score", 6).alias("score"),
        "status",
        "n_findings",
        F.round("sort_key", 6).alias("sort_key"),
        F.array_join("inputs", ",").alias("inputs"),
    )


def _rounded_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = check_metrics(_results(spark, folder))
    return metrics.withColumn("value", F.round("value", 6))


def _status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return status_counts(_results(spark, folder))


def _scorecard(spark: SparkSession, folder: str) -> DataFrame:
    card = scorecard(_results(spark, folder))
    return card.withColumn("score", F.round("score", 6))


SOURCES: dict[str, Query] = {
    **{
        f"src_{name}": partial(_table, name=table)
        for name, table in {
            "databases": "databases",
            "schemas": "schemas",
            "entities": "entities",
            "columns": "columns",
            "roles": "roles",
            "role_grants": "role_grants",
            "privilege_grants": "privilege_grants",
            "future_grants": "future_grants",
            "masking_policies": "masking_policies",
            "row_access_policies": "row_access_policies",
            "masking_policy_refs": "masking_policy_references",
            "row_access_policy_refs": "row_access_policy_references",
        }.items()
    },
    "src_users": _users,
    "src_login_history": _logins,
    "src_network_policy_flag": _network_flag,
    "snapshot_roundtrip": _roundtrip,
    "snapshot_availability": _availability,
}

FUNCTIONS: dict[str, Query] = {
    "fn_fqn_parts": _fqn_parts,
    "fn_identifier_cleanup": _identifier_cleanup,
    "fn_future_grant_scope": _future_scope,
    "fn_sensitive_name": _sensitive,
    "fn_status": partial(_scoring, name="status", function=scoring.status),
    "fn_grade": partial(_scoring, name="grade", function=scoring.grade),
    "fn_sort_key": partial(_scoring, name="sort_key", function=scoring.sort_key),
}

OPERATORS: dict[str, Query] = {
    "usage_tables": partial(_table, name="usage_tables"),
    "usage_columns": partial(_table, name="usage_columns"),
    "usage_sliding_tables": partial(_sliding_usage, table="usage_tables"),
    "usage_sliding_columns": partial(_sliding_usage, table="usage_columns"),
    "usage_popularity_tables": partial(_popularity, table="usage_tables"),
    "usage_popularity_columns": partial(_popularity, table="usage_columns"),
    "role_edges": _role_edges,
    "role_members_admin": _admin_members,
    "role_closure": _user_roles,
    "object_privileges_by_role": _privileges,
    "user_object_access": _access,
    "access_object_sets": _object_sets,
    "access_profiles": _profiles,
    "access_role_sizes": _role_sizes,
    "access_expanded": _expanded,
    "access_of_one_user": partial(_expanded_for_one, side="user"),
    "access_of_one_object": partial(_expanded_for_one, side="object"),
    "object_user_counts": _user_counts,
    "object_user_counts_bitmaps": partial(_user_counts, plan="bitmaps"),
}

CHECK_QUERIES: dict[str, Query] = {
    **{
        check_id: partial(_findings, check_id=check_id)
        for check_id in CHECKS
        if check_id not in ("c04_network_policy", "c12_future_grant_coverage")
    },
    "c04_network_policy": _network_check,
    "c08_inaccessible_schemas": _blocked_schemas,
    "c12_schema_coverage": _schema_coverage,
    "c12_database_coverage": partial(
        _findings, check_id="c12_future_grant_coverage", name="databases"
    ),
    "check_results": _rounded_results,
    "check_metrics": _rounded_metrics,
    "status_counts": _status_counts,
    "scorecard": _scorecard,
    "sql_check_example": _example_check,
    "gated_results": _gated_results,
    "report_results": _report,
    "report_findings": _report_findings,
}


def entry(spark: SparkSession) -> DataFrame:
    """Most used tables and views of the last 90 days."""
    return _findings(spark, "/root/testdata/sf0.001", "c09_most_used_tables")


def queries() -> dict[str, Query]:
    own = {**SOURCES, **FUNCTIONS, **OPERATORS, **CHECK_QUERIES}
    return {**own, **llm.queries()} if llm else own


def oracle_sql() -> dict[str, str]:
    own = oracle.oracle_sql()
    return {**own, **llm.oracle_sql()} if llm else own
