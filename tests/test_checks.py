from dataclasses import replace

import pytest

from grantlens import (
    Audit,
    Check,
    CheckPlan,
    Snapshot,
    check_results,
    register_check,
    registered_checks,
    scorecard,
    sql_check,
    status_counts,
    write_report,
)
from grantlens.plans.check import result_row
from grantlens.plans.registry import BUILT_IN, unregister_check
from pyspark.sql import functions as F
from tests.tables import (
    column,
    database,
    empty_snapshot,
    entity,
    future,
    privilege,
    q,
    schema,
    snapshot,
    table,
    to_role,
    to_user,
    user,
)

CHECKS = {c.id[:3]: c for c in BUILT_IN}


def run(spark, short, snap):
    """(score, status, metrics, findings by name) of one check."""
    audit = Audit(spark, snap)
    check = CHECKS[short]
    row = result_row(audit, check).first()
    findings = {n: df.collect() for n, df in audit.plan(check).findings.items()}
    assert row["n_findings"] == sum(len(rows) for rows in findings.values())
    return row["score"], row["status"], row["metrics"], findings


def found(findings, *names, key=""):
    return sorted(tuple(r[n] for n in names) for r in findings[key])


def test_nothing_collected(spark):
    results = {r["check_id"][:3]: r for r in check_results(Audit(spark, Snapshot())).collect()}
    assert len(results) == 17
    for short, row in results.items():
        informs = short in ("c09", "c10", "c11", "c15", "c16")
        assert row["status"] == ("INFO" if informs else "UNKNOWN"), short
    card = scorecard(check_results(Audit(spark, Snapshot()))).first()
    assert (card["score"], card["grade"], card["n_unknown"]) == (None, "?", 12)


def test_everything_collected_but_empty(spark):
    audit = Audit(spark, empty_snapshot(spark))
    scores = {r["check_id"][:3]: r["score"] for r in check_results(audit).collect()}
    assert scores == {
        "c01": 1.0, "c02": 0.49, "c03": -1.0, "c04": 0.49, "c05": None, "c06": 1.0, "c07": -1.0,
        "c08": 1.0, "c09": -2.0, "c10": -2.0, "c11": -2.0, "c12": -1.0, "c13": -2.0, "c14": -2.0,
        "c15": -1.0, "c16": -1.0, "c17": 1.0,
    }


@pytest.mark.parametrize(
    ("n_active", "n_admins", "score"),
    [(30, 3, 1.0), (30, 4, 0.49), (31, 3, 1.0), (31, 4, 1 - 4 / 31), (40, 4, 0.9), (20, 0, 1.0)],
)
def test_c01_switches_rule_with_account_size(spark, n_active, n_admins, score):
    users = [user(f"u{i}") for i in range(n_active)] + [user("gone", disabled=True)]
    grants = [to_user("ACCOUNTADMIN", f"u{i}") for i in range(n_admins)]
    result = run(spark, "c01", snapshot(spark, users=users, role_grants=grants))
    assert result[0] == pytest.approx(score)


def test_c01_counts_both_roles_and_disabled_admins(spark):
    users = [user("a"), user("b", disabled=True), user("c")]
    grants = [
        to_role("SECURITYADMIN", "ACCOUNTADMIN"), to_user("ACCOUNTADMIN", "a"),
        to_role("ACCOUNTADMIN", "DBA"), to_user("DBA", "b"), to_user("SECURITYADMIN", "c"),
    ]
    snap = snapshot(spark, users=users, role_grants=grants)
    _, _, metrics, findings = run(spark, "c01", snap)
    assert metrics == {"n_admins": 3.0, "n_active": 2.0}
    assert found(findings, "admin_role", "user") == [
        ("ACCOUNTADMIN", "a"), ("ACCOUNTADMIN", "b"),
        ("SECURITYADMIN", "a"), ("SECURITYADMIN", "b"), ("SECURITYADMIN", "c"),
    ]
    score, status, _, findings = run(spark, "c02", snap)
    assert (score, status) == (1.0, "PASS")
    assert found(findings, "user") == [("a",), ("b",)]


def test_c02_needs_a_second_admin(spark):
    snap = snapshot(spark, role_grants=[to_user("ACCOUNTADMIN", "a")])
    assert run(spark, "c02", snap)[:2] == (0.49, "FAIL")


@pytest.mark.parametrize(
    ("grants", "rows", "score"),
    [
        ([future(q("D"), "TABLE", "r1")], [], 1.0),
        ([future(q("D", "S"), "TABLE", "r1")], [], 1.0),
        ([future(q("D"), "TABLE", "r1"), future(q("D"), "TABLE", "r2"),
          future(q("D", "S"), "TABLE", "r1"), future(q("D", "S"), "TABLE", "r9")],
         [(q("D", "S"), "TABLE", "r2")], 0.0),
        ([future(q("D"), "TABLE", "r1"), future(q("D", "S"), "TABLE", "r1")], [], 1.0),
        ([future(q("D"), "TABLE", "r1"), future(q("D", "S"), "VIEW", "r2")], [], 1.0),
        ([future(q("D"), "TABLE", "r1"), future(q("D"), "VIEW", "r1"),
          future(q("D", "S"), "TABLE", "r2"), future(q("D", "S"), "VIEW", "r2")],
         [(q("D", "S"), "TABLE", "r1"), (q("D", "S"), "VIEW", "r1")], 0.5),
    ],
)
def test_c03_shadowed_roles(spark, grants, rows, score):
    result = run(spark, "c03", snapshot(spark, future_grants=grants))
    assert result[0] == pytest.approx(score)
    assert found(result[3], "schema", "asset_type", "role") == rows


@pytest.mark.parametrize(("rows", "score"), [([], 0.49), ([{"name": "p"}], 1.0)])
def test_c04_network_policy(spark, rows, score):
    assert run(spark, "c04", snapshot(spark, network_policies=rows))[0] == score


def login(name, first="PASSWORD", second=None, success=True):
    return {
        "user": name, "first_authentication_factor": first,
        "second_authentication_factor": second, "success": success,
    }


def test_c05_password_only_logins(spark):
    rows = [login("a"), login("a"), login("b", second="DUO"), login("c", first="KEY"),
            login("d", success=False), login("e", first=None)]
    score, status, metrics, findings = run(spark, "c05", snapshot(spark, login_history=rows))
    assert (score, status) == (pytest.approx(0.6), "WARN")
    assert metrics["password_only_percent"] == 40.0
    assert metrics["needs_password_policy"] == 1.0
    assert found(findings, "user") == [("a",)]


def test_c05_without_successful_logins_is_unknown(spark):
    snap = snapshot(spark, login_history=[login("a", success=False)])
    assert run(spark, "c05", snap)[:2] == (None, "UNKNOWN")


def usage(name, obj, n=1):
    return {"user": name, "object": obj, "usage_count": n}


def test_c06_inactive_users(spark):
    users = [user("a"), user("b"), user("off", disabled=True), user("SNOWFLAKE")]
    logins = [login("a"), login("b", success=False)]
    snap = snapshot(spark, users=users, login_history=logins)
    score, _, _, findings = run(spark, "c06", snap)
    assert score == 0.75
    assert found(findings, "user", "reason") == [("b", "no_login_7d")]

    snap = snapshot(spark, users=users, login_history=logins, usage_tables=[usage("b", "t")])
    score, status, _, findings = run(spark, "c06", snap)
    assert (score, status) == (0.25, "FAIL")
    assert found(findings, "user", "reason") == [("a", "no_access_90d"), ("b", "no_login_7d")]

    everyone = [login("a"), login("b")]
    used = [usage("a", "t"), usage("b", "t")]
    snap = snapshot(spark, users=users, login_history=everyone, usage_tables=used)
    assert run(spark, "c06", snap)[0] == 1.0


def test_c07_managed_schemas(spark):
    snap = snapshot(spark, schemas=[schema("D", "A", managed=True), schema("D", "B")])
    score, _, _, findings = run(spark, "c07", snap)
    assert score == 1.0 and found(findings, "schema") == [(q("D", "A"),)]
    assert run(spark, "c07", snapshot(spark, schemas=[schema("D", "B")]))[:2] == (-1.0, "INFO")


def test_c08_counts_schema_only_misses(spark):
    grants = [
        privilege(q("D", "S", "T"), "TABLE", "r", "SELECT"),
        privilege(q("D", "S", "T"), "TABLE", "ACCOUNTADMIN", "SELECT"),
        privilege(q("D"), "DATABASE", "r"),
    ]
    score, _, _, findings = run(spark, "c08", snapshot(spark, privilege_grants=grants))
    assert score == 0.49
    assert found(findings, "grantee", "object", "missing_level") == [
        ("r", q("D", "S", "T"), "schema")
    ]
    grants.append(privilege(q("D", "S"), "SCHEMA", "r"))
    assert run(spark, "c08", snapshot(spark, privilege_grants=grants))[0] == 1.0


def test_c09_c10_rank_and_word_usage(spark):
    rows = [usage("a", "t", 1), usage("a", "s", 1200), usage("b", "t", 1)]
    for short, name in (("c09", "usage_tables"), ("c10", "usage_columns")):
        score, status, _, findings = run(spark, short, snapshot(spark, **{name: rows}))
        assert (score, status) == (-2.0, "INSIGHT")
        assert found(findings, "ranking", "rank", "object", "message") == [
            ("usage", 1, "s", "used 1,200 times by 1 user"),
            ("usage", 2, "t", "used 2 times by 2 users"),
            ("users", 1, "t", "used 2 times by 2 users"),
            ("users", 2, "s", "used 1,200 times by 1 user"),
        ]


def test_c11_unused_first_without_system_objects(spark):
    entities = [
        entity("D", "S", "B"), entity("D", "S", "A", "VIEW"), entity("D", "S", "ST", "STAGE"),
        entity("SNOWFLAKE", "S", "X"), entity("D", "INFORMATION_SCHEMA", "Y"),
        entity("D", "S", "C"),
    ]
    used = [usage("u", q("D", "S", "A"), 4), usage("v", q("D", "S", "A"), 1)]
    _, _, _, findings = run(spark, "c11", snapshot(spark, entities=entities, usage_tables=used))
    assert [tuple(r) for r in findings[""]] == [
        (q("D", "S", "B"), 0), (q("D", "S", "C"), 0), (q("D", "S", "A"), 5),
    ]


def test_c12_coverage(spark):
    snap = snapshot(
        spark,
        databases=[database("D"), database("E"), database("SNOWFLAKE")],
        schemas=[schema("D", "OWN"), schema("D", "NONE"), schema("E", "NONE"),
                 schema("D", "INFORMATION_SCHEMA"), schema("SNOWFLAKE", "S")],
        future_grants=[
            future(q("D", "OWN"), "VIEW", "r"), future(q("D", "OWN"), "TABLE", "r"),
            future(q("D"), "TABLE", "r"), future(q("D"), "STAGE", "r"),
            future(q("E"), "SCHEMA", "r"),
        ],
    )
    score, _, metrics, findings = run(spark, "c12", snap)
    schemas = {r["schema"]: (r["asset_types"], r["covered"]) for r in findings["schemas"]}
    assert schemas == {
        q("D", "OWN"): (["TABLE", "VIEW"], True),
        q("D", "NONE"): (["STAGE", "TABLE"], True),
        q("E", "NONE"): ([], False),
    }
    assert found(findings, "db", "covered", key="databases") == [(q("D"), False), (q("E"), True)]
    assert score == pytest.approx(1 - (1 - 3 / 5) / 2)
    assert metrics["n_future_grants"] == 5.0


def access_account(spark, **more):
    """u1 and u2 reach T1; only u1 reaches T2; nobody reaches T3; u3 is disabled."""
    sch = q("D", "S")
    grants = [
        privilege(q("D"), "DATABASE", "r1"), privilege(sch, "SCHEMA", "r1"),
        privilege(q("D"), "DATABASE", "r2"), privilege(sch, "SCHEMA", "r2"),
        privilege(q("D", "S", "T1"), "TABLE", "r1", "SELECT"),
        privilege(q("D", "S", "T1"), "TABLE", "r2", "SELECT"),
        privilege(q("D", "S", "T2"), "TABLE", "r2", "SELECT"),
        privilege(q("D", "S", "T3"), "TABLE", "locked", "SELECT"),
    ]
    rows = dict(
        users=[user("u1"), user("u2"), user("u3", disabled=True)],
        role_grants=[to_user("r1", "u1"), to_user("r1", "u2"), to_user("r1", "u3"),
                     to_role("r2", "boss"), to_user("boss", "u1"), to_user("locked", "u1")],
        privilege_grants=grants,
        entities=[entity("D", "S", t) for t in ("T1", "T2", "T3")]
        + [entity("SNOWFLAKE", "S", "X"), entity("D", "INFORMATION_SCHEMA", "Y")],
    )
    return snapshot(spark, **(rows | more))


def test_c13_c14_accessibility(spark):
    snap = access_account(spark)
    t1, t2, t3 = (q("D", "S", t) for t in ("T1", "T2", "T3"))
    assert [tuple(r) for r in run(spark, "c13", snap)[3][""]] == [(t1, 2), (t2, 1)]
    assert [tuple(r) for r in run(spark, "c14", snap)[3][""]] == [(t3, 0), (t2, 1), (t1, 2)]


def reference(target, status, policy="P"):
    return {"fqn": q("D", "S", policy), "target_fqn": target, "status": status}


def policy(name):
    return {"name": name, "database": "D", "schema": "S", "fqn": q("D", "S", name)}


@pytest.mark.parametrize(
    ("short", "policies", "references"),
    [("c15", "masking_policies", "masking_policy_references"),
     ("c16", "row_access_policies", "row_access_policy_references")],
)
def test_policy_checks(spark, short, policies, references):
    def score(names, refs):
        rows = {policies: [policy(n) for n in names]}
        if refs is not None:
            rows[references] = refs
        return run(spark, short, snapshot(spark, **rows))

    assert run(spark, short, snapshot(spark))[0] == -1.0
    assert score([], None)[0] == -1.0
    assert score([], [])[0] == -1.0
    listed = score(["P"], None)
    assert listed[0] == -2.0
    assert found(listed[3], "kind", "policy") == [("listed", q("D", "S", "P"))]
    assert score(["P"], [reference("t", "ACTIVE")])[0] == 1.0
    assert score(["P", "Q"], [reference("t", "ACTIVE")])[0] == 0.75
    bad = score(["P", "Q"], [reference("t", "OFF"), reference("s", "ACTIVE")])
    assert bad[:2] == (0.48, "FAIL")
    assert [(r["kind"], r["target"], r["status"]) for r in sorted(bad[3][""])] == [
        ("active", "s", "ACTIVE"), ("misapplied", "t", "OFF"), ("unused", None, None),
    ]


def test_c17_masks_and_threshold(spark):
    users = [user(f"u{i}") for i in range(5)]
    members = [to_user("r1", f"u{i}") for i in range(4)] + [to_user("r2", f"u{i}") for i in range(3)]
    columns = [
        column("D", "S", "T1", "email"), column("D", "S", "T1", "phone"),
        column("D", "S", "T1", "phone_hashed"), column("D", "S", "T2", "email"),
        column("D", "INFO", "T1", "email"), column("SNOWFLAKE", "S", "T1", "email"),
    ]
    privileges = [
        privilege(q("D"), "DATABASE", r) for r in ("r1", "r2")
    ] + [privilege(q("D", "S"), "SCHEMA", r) for r in ("r1", "r2")] + [
        privilege(q("D", "S", "T1"), "TABLE", "r1", "SELECT"),
        privilege(q("D", "S", "T2"), "TABLE", "r2", "SELECT"),
    ]
    base = dict(users=users, role_grants=members, columns=columns, privilege_grants=privileges)
    exposed = [(q("D", "S", "T1", "email"), 4), (q("D", "S", "T1", "phone"), 4)]

    score, status, metrics, findings = run(spark, "c17", snapshot(spark, **base))
    assert (score, status, metrics["threshold"]) == (0.89, "WARN", 3.0)
    assert sorted(tuple(r) for r in findings[""]) == exposed

    target = q("D", "S", "T1", "email")
    for state, left in (("ACTIVE", exposed[1:]), ("INACTIVE", exposed)):
        snap = snapshot(spark, masking_policy_references=[reference(target, state)], **base)
        assert sorted(tuple(r) for r in run(spark, "c17", snap)[3][""]) == left
    assert run(spark, "c17", snapshot(spark, **(base | {"columns": columns[2:]})))[0] == 1.0


def test_c17_lists_all_columns(spark):
    columns = [column("D", "S", "T1", f"email{i:03}") for i in range(60)]
    users = [user(f"u{i}") for i in range(4)]
    snap = snapshot(
        spark, users=users, role_grants=[to_user("r", f"u{i}") for i in range(4)],
        columns=columns,
        privilege_grants=[privilege(q("D"), "DATABASE", "r"),
                          privilege(q("D", "S"), "SCHEMA", "r"),
                          privilege(q("D", "S", "T1"), "TABLE", "r", "SELECT")],
    )
    _, _, metrics, findings = run(spark, "c17", snap)
    assert metrics["n_exposed"] == 60.0
    assert len(findings[""]) == 60


def test_results_are_ordered_worst_first_then_by_title(spark):
    rows = check_results(Audit(spark, access_account(spark))).collect()
    assert [(r["sort_key"], r["title"]) for r in rows] == sorted(
        (r["sort_key"], r["title"]) for r in rows
    )
    counts = status_counts(check_results(Audit(spark, access_account(spark)))).first()
    assert sum(counts) == 17


def test_grade_averages_scored_checks_only(spark):
    results = spark.createDataFrame(
        [(1.0, "PASS"), (0.49, "FAIL"), (-1.0, "INFO"), (-2.0, "INSIGHT"), (None, "UNKNOWN")],
        "score double, status string",
    )
    card = scorecard(results).first()
    assert card["score"] == pytest.approx(0.745)
    assert card["grade"] == "B"
    assert (card["n_pass"], card["n_fail"], card["n_warn"], card["n_unknown"]) == (1, 1, 0, 1)


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_report_tables(spark, tmp_path, format):
    path = f"{tmp_path}/report"
    write_report(spark, access_account(spark), path, format)
    results = spark.read.format(format).load(f"{path}/check_results")
    assert results.count() == 17
    card = spark.read.format(format).load(f"{path}/scorecard").first()
    assert card["grade"] != "?" and card["n_unknown"] > 0
    top = spark.read.format(format).load(f"{path}/findings_c13_most_accessible")
    assert [r["n_users"] for r in top.collect()] == [2, 1]
    assert results.filter("check_id = 'c02_backup_admin'").first()["inputs"] == ["role_grants"]


def test_report_carries_the_fetch_error(spark, tmp_path):
    write_report(spark, Snapshot(fetch_error="no network"), f"{tmp_path}/r")
    card = spark.read.parquet(f"{tmp_path}/r/scorecard").first()
    assert (card["grade"], card["fetch_error"]) == ("?", "no network")


def test_sql_check_and_registration(spark):
    check = sql_check(
        "x90_passwords", "Passwords", ("users",), "SELECT name FROM {users} WHERE has_password"
    )
    register_check(check)
    try:
        assert check in registered_checks()
        with pytest.raises(ValueError, match="exists already"):
            register_check(check)
        snap = snapshot(spark, users=[user("a"), user("b")])
        row = result_row(Audit(spark, snap), check).first()
        assert (row["score"], row["status"], row["n_findings"]) == (0.49, "FAIL", 2)
        assert result_row(Audit(spark, Snapshot()), check).first()["status"] == "UNKNOWN"
    finally:
        unregister_check("x90_passwords")
    assert check not in registered_checks()


def test_python_check(spark):
    def plan(audit):
        names = audit.snapshot.users.select("name")
        return CheckPlan(F.col("share"), {"share": F.lit(0.6)}, {"": names})

    check = Check("x91", "Share", ("users",), plan)
    row = result_row(Audit(spark, snapshot(spark, users=[user("a")])), check).first()
    assert (row["score"], row["status"], row["inputs"]) == (0.6, "WARN", ["users"])


def test_empty_table_helper_is_typed(spark):
    assert table(spark, "users").dtypes[1] == ("disabled", "boolean")


# --- the access log ---------------------------------------------------------------


def lazy_account(spark, monkeypatch):
    """A snapshot that fails when its access log is read, and the list of times its usage was stored."""
    from grantlens.sources import snapshot as module

    log = spark.range(1).select(
        F.lit("u").alias("user"), F.raise_error(F.lit("the log was read")).cast("string").alias("accessed")
    )
    usage = {name: table(spark, name) for name in module.USAGE}
    stored = []

    def staged(given, workspace):
        stored.append(given)
        return usage

    monkeypatch.setattr(module, "staged_usage", staged)
    return replace(empty_snapshot(spark), access_log=log), stored


USES_LOG = {"c06_inactive_users", "c09_most_used_tables", "c10_most_used_columns", "c11_least_used_tables"}


@pytest.mark.parametrize("check", [c for c in BUILT_IN if c.id not in USES_LOG], ids=lambda c: c.id)
def test_checks_without_usage_leave_the_log_alone(spark, monkeypatch, check):
    lazy, stored = lazy_account(spark, monkeypatch)
    assert result_row(Audit(spark, lazy), check).count() == 1
    assert stored == []


def test_checks_of_usage_read_the_log_once(spark, monkeypatch):
    lazy, stored = lazy_account(spark, monkeypatch)
    audit = Audit(spark, lazy)
    rows = check_results(audit, [c for c in BUILT_IN if c.id in USES_LOG]).collect()
    assert len(rows) == 4 and len(stored) == 1
    assert audit.snapshot.has("usage_tables") and not audit.snapshot.without("usage_tables").has("usage_tables")


def test_reports_and_sql_checks_leave_the_log_alone(spark, monkeypatch, tmp_path):
    lazy, stored = lazy_account(spark, monkeypatch)
    own = sql_check("x", "X", ("users",), "SELECT name FROM {users}")
    write_report(spark, lazy, str(tmp_path / "report"), checks=[own, BUILT_IN[0]])
    assert stored == []
    spied = sql_check("y", "Y", ("usage_tables",), "SELECT object FROM {usage_tables}")
    assert result_row(Audit(spark, lazy), spied).count() == 1 and len(stored) == 1


# --- stored in fewer rows ------------------------------------------------------------


def test_blocked_privileges_are_stored_by_schema(spark):
    grants = [privilege(q("D", "S", f"T{i}"), "TABLE", "r", "SELECT") for i in range(50)]
    grants += [privilege(q("D", "S2", "T"), "TABLE", "r", "SELECT"), privilege(q("D"), "DATABASE", "r")]
    grants += [privilege(q("D", "S2"), "SCHEMA", "r"), privilege(q("WH"), "WAREHOUSE", "r2")]
    grants += [privilege(q("D", "S", "T1"), "TABLE", "ACCOUNTADMIN", "SELECT")]
    audit = Audit(spark, snapshot(spark, privilege_grants=grants))
    plan = audit.plan(CHECKS["c08"])
    groups = {tuple(r) for r in plan.summaries["by_schema"].collect()}
    assert groups == {("r", q("D", "S"), "schema", 50), ("r2", None, "both", 1)}
    row = result_row(audit, CHECKS["c08"]).first()
    assert row["n_findings"] == 51 == plan.findings[""].count()
    assert row["metrics"] == {"n_blocked": 51.0, "n_roles": 2.0}


def test_reports_hold_summaries_and_the_stored_order(spark, tmp_path):
    write_report(spark, access_account(spark), str(tmp_path / "r"))
    assert spark.read.parquet(f"{tmp_path}/r/summary_c08_inaccessible_objects_by_schema").columns == [
        "grantee", "schema", "missing_level", "n_objects",
    ]
    results = spark.read.parquet(f"{tmp_path}/r/check_results").collect()
    ranks = sorted((r["section"], r["sort_key"], r["title"], r["place"]) for r in results)
    assert [r[-1] for r in ranks] == list(range(1, 18))
    orders = {r["check_id"]: r["findings_order"] for r in results}
    assert orders["c13_most_accessible"] == ["-n_users", "object"] and orders["c04_network_policy"] == []


def test_patterns_meet_each_column_name_once(spark):
    from grantlens.plans import reach
    from grantlens.workspace import Workspace

    names = ["email", "id", "PHONE", "hashed_email"]
    rows = [column("D", "S", f"T{i}", name) for i in range(30) for name in names]
    workspace = Workspace(spark)
    staged = []
    original = workspace.stage
    workspace.stage = lambda df, name, **kw: staged.append((name, original(df, name, **kw))) or staged[-1][1]
    found = reach.sensitive_names(workspace, table(spark, "columns", rows))
    assert {r["name"] for r in found.df.collect()} == {"email", "PHONE"}
    assert [(name, s.rows) for name, s in staged] == [("column-names", 4), ("sensitive-names", 4)]
    plan = found.df._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan and "Aggregate" not in plan
