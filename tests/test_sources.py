import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grantlens import Audit, Snapshot, check_results, load_snapshot, read_raw, read_raw_jdbc, write_report
from grantlens.sources.schemas import OPTIONAL_RAW, RAW, SNAPSHOT
from grantlens.workspace import Workspace
from tests.tables import database, raw, snapshot, table

AS_OF = datetime(2024, 6, 1)


def as_of():
    return F.lit(AS_OF)


def log(user, text, days):
    return {
        "USER_NAME": user,
        "DIRECT_OBJECTS_ACCESSED": text,
        "QUERY_START_TIME": AS_OF - timedelta(days=days),
    }


def objects(*names, domain="Table"):
    entries = ",".join(f'{{"objectDomain":"{domain}","objectName":"{n}"}}' for n in names)
    return f"[{entries}]"


LOG = [
    log("A", objects("DB.S.T", "DB.S.T"), 1),
    log("A", objects("DB.S.T"), 2),
    log('"b c"', objects("DB.S.T", "DB.S.V", domain="View"), 3),
    log("A", objects("DB.S.STAGE", domain="Stage"), 3),
    log("A", objects("DB.S.OLD"), 91),
    log("A", '[{"objectName":"DB.S.NODOMAIN"},{"objectDomain":"Table"}]', 1),
    log("A", "not json", 1),
    log("B", '[{"objectDomain":"Table","objectName":"DB.S.W","columns":'
             '[{"columnName":"C1"},{"columnName":"C1"},{"columnName":"C2"},{}]}]', 1),
    log("B", "[]", 1),
]


@pytest.mark.parametrize("staged", [False, True])
def test_usage_from_json(spark, staged):
    workspace = Workspace(spark) if staged else None
    snap = Snapshot.from_raw(
        {"access_history": raw(spark, "access_history", LOG)},
        access_as_of=as_of(),
        workspace=workspace,
    )
    tables = {(r["user"], r["object"], r["usage_count"]) for r in snap.usage_tables.collect()}
    assert tables == {
        ("A", '"DB"."S"."T"', 2),
        ("b c", '"DB"."S"."T"', 1),
        ("b c", '"DB"."S"."V"', 1),
        ("B", '"DB"."S"."W"', 1),
    }
    columns = {(r["user"], r["object"], r["usage_count"]) for r in snap.usage_columns.collect()}
    assert columns == {("B", '"DB"."S"."W"."C1"', 1), ("B", '"DB"."S"."W"."C2"', 1)}
    unreadable = {tuple(r) for r in snap.unreadable_log_rows.collect()}
    assert unreadable == {("A", 2), ("B", 1)}  # no JSON, or entries without names


@pytest.mark.parametrize("staged", [False, True])
def test_usage_has_one_row_per_quoted_name(spark, staged):
    text = (
        '[{"objectDomain":"Table","objectName":"D.S.T","columns":[{"columnName":"a.b"}]},'
        '{"objectDomain":"Table","objectName":"D.S.T.a","columns":[{"columnName":"b"}]}]'
    )
    snap = Snapshot.from_raw(
        {"access_history": raw(spark, "access_history", [log("A", text, 1)])},
        access_as_of=as_of(),
        workspace=Workspace(spark) if staged else None,
    )
    assert [tuple(r) for r in snap.usage_columns.collect()] == [("A", '"D"."S"."T"."a"."b"', 1)]


def test_windows_end_at_the_given_time(spark):
    times = [AS_OF - timedelta(days=1), AS_OF, AS_OF + timedelta(seconds=1)]
    logins = [{"USER_NAME": f"u{i}", "EVENT_TIMESTAMP": t} for i, t in enumerate(times)]
    queries = [{**log(f"u{i}", objects("DB.S.T"), 0), "QUERY_START_TIME": t} for i, t in enumerate(times)]
    snap = Snapshot.from_raw(
        {
            "login_history": raw(spark, "login_history", logins),
            "access_history": raw(spark, "access_history", queries),
        },
        as_of(),
        as_of(),
    )
    assert {r["user"] for r in snap.login_history.collect()} == {"u0", "u1"}
    assert {r["user"] for r in snap.usage_tables.collect()} == {"u0", "u1"}


def logged_account(spark, folder):
    """Raw tables in files, of which every reader has its own plan."""
    rows = {"access_history": LOG, "users": [], "databases": [{"name": "DB", "owner": "O"}]}
    for name in RAW:
        raw(spark, name, rows.get(name, ())).write.parquet(f"{folder}/{name}")
    return Snapshot.from_raw(read_raw(spark, folder), as_of(), as_of())


def log_scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet \[[^\]]*DIRECT_OBJECTS_ACCESSED", plan)


@pytest.mark.parametrize("path", ["report", "write", "results"])
def test_public_paths_read_the_access_log_once(spark, tmp_path, monkeypatch, path):
    snap = logged_account(spark, f"{tmp_path}/raw")
    scans = []
    stage = Workspace.stage

    def recorded(self, df, name, **options):
        scans.extend(log_scans(df))
        return stage(self, df, name, **options)

    monkeypatch.setattr(Workspace, "stage", recorded)
    if path == "write":
        snap.write(f"{tmp_path}/snap")
        assert Snapshot.read(spark, f"{tmp_path}/snap").usage_tables.count() == 4
    elif path == "report":
        write_report(spark, snap, f"{tmp_path}/report")
        assert spark.read.parquet(f"{tmp_path}/report/check_results").count() == 17
    else:
        plan = check_results(Audit(spark, snap))
        assert not log_scans(plan)
        assert plan.count() == 17
    assert len(scans) == 1


def test_failing_job_is_no_empty_snapshot(spark):
    tables = {name: raw(spark, name) for name in RAW}
    fails = F.raise_error(F.lit("broken file")).cast("string")
    tables["access_history"] = raw(spark, "access_history", LOG).withColumn("DIRECT_OBJECTS_ACCESSED", fails)
    with pytest.raises(Exception, match="broken file"):
        load_snapshot(lambda: tables, as_of(), as_of(), Workspace(spark))


def test_login_window(spark):
    rows = [
        {"USER_NAME": '"x"', "FIRST_AUTHENTICATION_FACTOR": "PASSWORD", "IS_SUCCESS": ok,
         "EVENT_TIMESTAMP": AS_OF - timedelta(days=d)}
        for ok, d in [("YES", 1), ("NO", 6), ("YES", 7), ("YES", 8)]
    ]
    snap = Snapshot.from_raw(
        {"login_history": raw(spark, "login_history", rows)}, login_as_of=as_of()
    )
    found = [(r["user"], r["success"]) for r in snap.login_history.collect()]
    assert sorted(found) == [("x", False), ("x", True)]


def test_privilege_grants_drop_roles_and_other_grantees(spark):
    def row(on, to, name="DB"):
        return {"granted_on": on, "granted_to": to, "name": name, "grantee_name": '"r"',
                "privilege": "USAGE"}

    rows = [row("DATABASE", "ROLE"), row("ROLE", "ROLE"), row("DATABASE", "DATABASE_ROLE"),
            row("TABLE", "ROLE", 'DB."s.x".T')]
    snap = Snapshot.from_raw({"privilege_grants": raw(spark, "privilege_grants", rows)})
    found = {(r["asset"], r["grantee"]) for r in snap.privilege_grants.collect()}
    assert found == {('"DB"', "r"), ('"DB"."s.x"."T"', "r")}


def test_policy_references_split_by_kind(spark):
    def row(kind, column, tag=None):
        return {"POLICY_KIND": kind, "POLICY_NAME": "P", "POLICY_DB": "D", "POLICY_SCHEMA": "S",
                "POLICY_ID": 7, "POLICY_STATUS": "ACTIVE", "REF_DATABASE_NAME": "D",
                "REF_SCHEMA_NAME": "S", "REF_ENTITY_NAME": "T", "REF_COLUMN_NAME": column,
                "TAG_DATABASE": tag, "TAG_SCHEMA": "TS", "TAG_NAME": "TN"}

    rows = [row("MASKING_POLICY", "C"), row("ROW_ACCESS_POLICY", None, "TD"), row("OTHER", None)]
    snap = Snapshot.from_raw({"policy_references": raw(spark, "policy_references", rows)})
    masking = snap.masking_policy_references.collect()
    assert [(r["target_fqn"], r["tag_fqn"], r["policy_id"]) for r in masking] == [
        ('"D"."S"."T"."C"', None, 7)
    ]
    access = snap.row_access_policy_references.collect()
    assert [(r["target_fqn"], r["tag_fqn"], r["fqn"]) for r in access] == [
        ('"D"."S"."T"', '"TD"."TS"."TN"', '"D"."S"."P"')
    ]


@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_read_raw_files(spark, tmp_path, format):
    for name in ("databases", "users"):
        rows = [{"name": "X", "owner": '"o"'}]
        raw(spark, name, rows).write.format(format).save(f"{tmp_path}/{name}")
    tables = read_raw(spark, str(tmp_path), format)
    assert {n for n, df in tables.items() if df is not None} == {"databases", "users"}
    snap = Snapshot.from_raw(tables)
    assert snap.databases.collect()[0]["owner"] == "o"
    assert snap.users.collect()[0]["disabled"] is False
    assert snap.schemas is None


def test_read_raw_csv_keeps_extra_columns_out(spark, tmp_path):
    (tmp_path / "roles").mkdir()
    (tmp_path / "roles" / "part.csv").write_text('name,owner\nR,O\n"""r""",O\n')
    tables = read_raw(spark, str(tmp_path), "csv", {"header": "true", "escape": '"'})
    names = {r["name"] for r in Snapshot.from_raw(tables).roles.collect()}
    assert names == {"R", "r"}


def test_read_raw_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS exported")
    raw(spark, "roles", [{"name": "R"}]).write.mode("overwrite").saveAsTable("exported.roles")
    tables = read_raw(spark, "exported", "table")
    assert tables["roles"].count() == 1
    assert tables["users"] is None
    spark.sql("DROP DATABASE exported CASCADE")


class FakeSpark:
    """Records JDBC reads; no database is opened."""

    def __init__(self, broken=()):
        self.read = self
        self.calls = {}
        self.broken = broken

    def jdbc(self, url, table, properties=None, predicates=None):
        from pyspark.errors import AnalysisException

        if table in self.broken:
            raise AnalysisException("no privilege")
        self.calls[table] = (url, properties, predicates)
        return f"frame of {table}"


def test_read_raw_jdbc_splits_and_tolerates_optional_tables():
    fake = FakeSpark(broken={"LOGS"})
    tables = read_raw_jdbc(
        fake,
        "jdbc:x:y",
        {"schemas": "S", "users": "U", "access_history": "LOGS"},
        {"user": "me"},
        {"schemas": ["db = 'A'", "db = 'B'"]},
    )
    assert fake.calls["S"] == ("jdbc:x:y", {"user": "me"}, ["db = 'A'", "db = 'B'"])
    assert fake.calls["U"] == ("jdbc:x:y", {"user": "me"}, None)
    assert tables["access_history"] is None and tables["roles"] is None
    with pytest.raises(Exception, match="no privilege"):
        read_raw_jdbc(FakeSpark(broken={"U"}), "jdbc:x:y", {"users": "U"})
    with pytest.raises(ValueError, match="unknown raw tables"):
        read_raw_jdbc(fake, "jdbc:x:y", {"nope": "N"})


def test_missing_optional_tables_are_tolerated(spark):
    tables = {name: raw(spark, name) for name in RAW if name not in OPTIONAL_RAW}
    snap = load_snapshot(lambda: tables)
    assert snap.fetch_error is None and snap.has_data
    assert snap.usage_tables is None and not snap.is_enterprise_or_higher


def test_missing_required_table_gives_empty_snapshot(spark):
    tables = {name: raw(spark, name) for name in RAW if name != "users"}
    snap = load_snapshot(lambda: tables)
    assert not snap.has_data and snap.tables() == {}
    assert "users" in snap.fetch_error
    results = check_results(Audit(spark, snap)).collect()
    assert {r["status"] for r in results} == {"UNKNOWN", "INFO"}


def test_snapshot_roundtrip_keeps_missing_and_empty_apart(spark, tmp_path):
    snap = snapshot(spark, databases=[database("A"), database("B")], users=[])
    snap.write(f"{tmp_path}/snap")
    back = Snapshot.read(spark, f"{tmp_path}/snap")
    assert set(back.tables()) == {"databases", "users"}
    assert back.users.count() == 0
    assert back.databases.count() == 2
    assert back.without("users").users is None


def test_workspace_cleans_up_after_itself(spark, tmp_path):
    with Workspace(spark, str(tmp_path)) as workspace:
        stage = workspace.stage(spark.range(7), "seven")
        assert stage.rows == 7 and stage.df.count() == 7
        assert list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())


def test_workspace_uses_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert Workspace(spark).path.startswith(root.rstrip("/") + "/")


def test_schemas_match_normalisers(spark):
    full = {name: raw(spark, name) for name in RAW}
    for name, df in Snapshot.from_raw(full).tables().items():
        expected = table(spark, name).dtypes
        assert df.dtypes == expected, name
    assert set(Snapshot.from_raw(full).tables()) == set(SNAPSHOT)


def test_history_windows_and_columns_reach_the_scan(spark, tmp_path):
    for name in ("access_history", "login_history", "privilege_grants"):
        raw(spark, name).write.parquet(f"{tmp_path}/{name}")
    snap = Snapshot.from_raw(read_raw(spark, str(tmp_path)), as_of(), as_of())

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    usage = plan(snap.usage_tables)
    assert "GreaterThan(QUERY_START_TIME" in usage
    assert usage.count("Exchange hashpartitioning") == 1
    logins = plan(snap.login_history.select("user"))
    assert "GreaterThan(EVENT_TIMESTAMP" in logins
    assert "ReadSchema: struct<USER_NAME:string,EVENT_TIMESTAMP:timestamp>" in logins
    grants = plan(snap.privilege_grants.filter("asset_type = 'SCHEMA'").select("grantee"))
    assert "EqualTo(granted_on,SCHEMA)" in grants
    assert "ReadSchema: struct<granted_on:string,granted_to:string,grantee_name:string>" in grants
