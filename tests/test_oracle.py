"""Every registered query against its SQL, whole results."""

import pytest

import __spark_entry__ as entry
from grantlens.workspace import Workspace
from tests.compare import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


# Plan nodes that have no place on the data path.
UNWANTED = [
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
    "MapInPandas", "FlatMapGroupsInPandas",
]


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of all tables staged during a test."""
    seen = []
    stage = Workspace.stage

    def recorded(self, df, name, **options):
        seen.append(plan_of(df))
        return stage(self, df, name, **options)

    monkeypatch.setattr(Workspace, "stage", recorded)
    return seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


OWN = set(QUERIES) - set(entry.llm.queries() if entry.llm else ())


def test_every_query_has_sql():
    assert OWN <= set(SQL)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_sql(spark, con, plans, name):
    df = QUERIES[name](spark, FOLDER)
    names, rows = spark_rows(df)
    expected_names, expected = duck_rows(con, SQL[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows
    for plan in [*plans, plan_of(df)]:
        assert not [node for node in UNWANTED if node in plan]


def test_entry(spark):
    assert entry.entry(spark).count() == 20
