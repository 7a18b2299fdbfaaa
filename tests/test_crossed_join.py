"""Joins whose rows are the result: the keys that make most of them are products."""

import pytest
from pyspark.sql import functions as F

from grantlens.operators import access, skew
from grantlens.workspace import Stage, Workspace
from tests.test_factored import audit_of, tuples
from tests.test_fan_out import rows_by_task


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sides(spark, workspace):
    """A key of 40,000 rows, one of 900, twenty of one row each, keys of one side, and rows without a key."""
    names = [("A", 200)] + [("B", 30)] + [(f"C{i}", 1) for i in range(20)]

    def side(column, own):
        rows = [(key, f"{column}{key}{i % 90}") for key, n in [*names, (own, 300), (None, 400)] for i in range(n)]
        return workspace.stage(spark.createDataFrame(rows, f"role string, {column} string"), column)

    return side("object", "left only"), side("user", "right only")


@pytest.mark.parametrize("most", [1, 64])
def test_large_keys_are_products_and_others_are_joined(spark, workspace, monkeypatch, most):
    """Rows come as often as in a plain join, also where whole rows repeat."""
    left, right = sides(spark, workspace)
    expected = left.df.join(right.df, "role")
    monkeypatch.setattr(skew, "TASK_PAIRS", 2000)
    monkeypatch.setattr(skew, "CELL_ROWS", 50)
    monkeypatch.setattr(skew, "CROSSED_PAIRS", 500)
    monkeypatch.setattr(skew, "CROSSED_KEYS", most)
    joined = skew.crossed_join(workspace, left, right, ["role"], "object", "user")
    assert joined.columns == expected.columns == ["role", "object", "user"]
    assert joined.count() == 40_000 + 900 + 20
    assert joined.exceptAll(expected).isEmpty() and expected.exceptAll(joined).isEmpty()
    assert plan(joined).count("CartesianProduct") == min(most, 2)
    tasks = rows_by_task(joined)
    assert len(tasks) >= 20 and max(tasks) < 4000


def test_few_rows_are_joined(spark, workspace):
    left, right = sides(spark, workspace)
    joined = skew.crossed_join(workspace, left, right, ["role"], "object", "user")
    assert "CartesianProduct" not in plan(joined) and joined.count() == 40_920


def test_a_side_may_be_empty(spark, workspace, monkeypatch):
    """Stages may know no more than a bound of their rows."""
    monkeypatch.setattr(skew, "CROSSED_PAIRS", 100)
    left, right = sides(spark, workspace)
    none = Stage(right.df.filter("user = 'nobody'"), 1000)
    assert skew.crossed_join(workspace, left, none, ["role"], "object", "user").isEmpty()


def of_products(df):
    """Whether rows come from products as they are, with no field written again."""
    parts = plan(df).split("CartesianProduct")
    return len(parts) > 3 and "Project" not in parts[0]


def test_expanded_rows_are_products(spark, monkeypatch):
    audit = audit_of(spark, 1)
    expected = tuples(audit.factored_access.expand(audit.workspace))
    monkeypatch.setattr(skew, "CROSSED_PAIRS", 60)
    expanded = audit.factored_access.expand(audit.workspace)
    assert tuples(expanded) == expected and len(expected) > 500
    assert of_products(expanded)
    some = audit.factored_access.expand(audit.workspace, users=F.col("user") == "U4")
    assert tuples(some) == [r for r in expected if r[4] == "U4"]


def test_rows_of_access_are_products(spark, monkeypatch):
    audit = audit_of(spark, 1)

    def rows(**chosen):
        found = access.user_object_access(audit.workspace, audit.object_privileges, audit.user_roles, **chosen)
        return found.select("object", "db", "schema", "grantee", "user", "role")

    expected = tuples(rows())
    monkeypatch.setattr(skew, "CROSSED_PAIRS", 60)
    assert tuples(rows()) == expected and len(expected) > 500
    assert of_products(rows())
    assert tuples(rows(users=F.col("user") == "U4")) == [r for r in expected if r[4] == "U4"]
