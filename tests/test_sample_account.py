"""Raw tables of the sample account over rows of its own."""

from pyspark.sql import functions as F

from grantlens.operators.access import object_privileges_by_role
from grantlens.workspace import Workspace
from sample_account import SampleAccount


def tables(spark, folder):
    """A part, a supplier and a nation's name that come twice, and grants of one part by two nations."""

    def save(name, ddl, *rows):
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")

    save("region", "r_regionkey int, r_name string", (0, "AFRICA"), (1, "FAR EAST"))
    save("nation", "n_nationkey int, n_name string, n_regionkey int", (0, "N0", 0), (1, "N1", 1), (2, "N1", 1))
    save("part", "p_partkey bigint, p_type string", (3, "PROMO"), (3, "PROMO"), (4, "LARGE"), (5, "SMALL"), (7, None))
    save("supplier", "s_suppkey bigint, s_nationkey int", (1, 0), (1, 0), (2, 1), (3, 2), (4, None))
    save("customer", "c_custkey bigint, c_nationkey int", (1, 0), (2, 1), (3, None))
    save("orders", "o_orderkey bigint, o_custkey bigint", (1, 1), (2, 2), (3, 9))
    lines = [(1, 3, 1, "A"), (1, 3, 2, "A"), (1, 3, 3, "A"), (2, 4, 1, "R"), (2, 4, 2, "R"), (2, 5, 2, "R"), (3, 7, 2, None), (3, None, 2, "N"), (3, 7, 4, "N")]
    save("lineitem", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string", *lines)
    return folder


def test_sample_privileges_come_once(spark, tmp_path):
    account = SampleAccount(spark, tables(spark, str(tmp_path)))
    grants = account.privilege_grants().filter(F.col("granted_on").isin("TABLE", "VIEW", "STAGE"))
    assert sorted(tuple(r) for r in grants.select("privilege", "granted_on", "name", "grantee_name").collect()) == sorted([
        ("SELECT", "VIEW", "DB_AFRICA.N0.T_3", "N0"),
        ("SELECT", "VIEW", "DB_AFRICA.N0.T_3", "N1"),
        ("UPDATE", "STAGE", "DB_FAR_EAST.N1.T_4", ""),
        ("UPDATE", "TABLE", "DB_FAR_EAST.N1.T_5", "ACCOUNTADMIN"),
        ("UPDATE", "TABLE", 'DB_FAR_EAST."N1".T_7', "N1"),
    ])


def test_sample_dealings_are_found_once(spark, tmp_path):
    """Future grants go to nations that deal with each other; asking for them again reads no line items."""
    account = SampleAccount(spark, tables(spark, str(tmp_path)))
    pairs = account._dealings.select("buyer", "n", "grantee_name").collect()
    assert sorted(tuple(r) for r in pairs) == [(0, 0, "N0"), (0, 1, "N1"), (0, 2, "N1"), (1, 0, "N0"), (1, 1, "N1")]
    plan = account.future_grants()._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def stored_plans(monkeypatch):
    """Optimized plans of what is stored from here on, by name."""
    plans, store = {}, Workspace.stage

    def recorded(self, df, name, *args, **kwargs):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return store(self, df, name, *args, **kwargs)

    monkeypatch.setattr(Workspace, "stage", recorded)
    return plans


def test_parent_grants_read_no_line_items(spark, tmp_path, monkeypatch):
    """Grants on databases and schemas are looked for only where the sample has some."""
    grants = SampleAccount(spark, tables(spark, str(tmp_path))).snapshot(None, "privilege_grants").privilege_grants
    plans = stored_plans(monkeypatch)
    object_privileges_by_role(Workspace(spark), grants)
    assert "n_nationkey" in plans["parent-grants"] and "l_partkey" not in plans["parent-grants"]


def test_dealings_join_customers_to_orders_first(spark, tmp_path, monkeypatch):
    plans = stored_plans(monkeypatch)
    SampleAccount(spark, tables(spark, str(tmp_path)))._dealings  # noqa: B018
    joins = [line for line in plans["dealings"].splitlines() if "Join" in line]
    # The lines' join with orders is hashed, and customers are joined below it.
    assert "l_orderkey" in joins[1] and "shuffle_hash" in joins[1]
    assert any("c_custkey" in line for line in joins[2:])


def test_parts_are_dealt_out(spark, tmp_path):
    """The few rows of nations are never the side that is run through, in one task, for all parts."""
    account = SampleAccount(spark, tables(spark, str(tmp_path)))
    plan = account.columns()._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan
    assert "rightHint=(strategy=broadcast)" in plan
    assert account.columns().count() > 0


def test_sample_grants_are_distinct_by_number(spark, tmp_path):
    """Names of nations are joined after; a nation may be called like the administrator, or not at all."""
    folder = tables(spark, str(tmp_path))
    names = [(0, "ACCOUNTADMIN", 0), (1, None, 1), (1, "N1", 1), (2, "N1", 1)]
    spark.createDataFrame(names, "n_nationkey int, n_name string, n_regionkey int").write.mode("overwrite").parquet(f"{folder}/nation.parquet")
    lines = [(1, 5, 1, "R"), (1, 5, 2, "R"), (1, 5, 1, "A"), (1, 4, 2, "N"), (1, 4, 3, "N"), (1, 4, 1, "R")]
    lines = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string")
    lines.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    grants = SampleAccount(spark, folder)._object_grants()
    plan = grants._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [p_partkey" in plan and ", privilege#" not in plan.split("Aggregate [p_partkey")[1].split("]")[0]
    pairs = grants.select("privilege", "grantee_name", F.substring_index("asset", ".", -1).alias("name")).distinct()
    found = [(r["privilege"], r["grantee_name"]) for r in pairs.filter("name = 'T_5'").collect()]
    assert sorted(found) == [("SELECT", "ACCOUNTADMIN"), ("UPDATE", "ACCOUNTADMIN")]
    found = [(r["privilege"], r["grantee_name"]) for r in pairs.filter("name = 'T_4'").collect()]
    assert sorted(found, key=str) == [("INSERT", "N1"), ("INSERT", None), ("UPDATE", "")]
