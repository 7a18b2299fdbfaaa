"""Merging owners by their roles."""

import pytest

from grantlens.operators import access
from grantlens.workspace import Stage, Workspace


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


@pytest.mark.parametrize("listed", [0, 2, 1000])
def test_merged_sets_equal_sets_by_name(spark, workspace, monkeypatch, listed):
    """Whichever owners are compared by lists; one has a role without a name."""
    monkeypatch.setattr(access, "LISTED_ROLES", listed or 1)
    monkeypatch.setattr("grantlens.workspace.SMALL_ROWS", -1)
    held = {"a": "xy", "b": "yx", "c": "xyz", "d": "xyz", "e": "x", "f": "z", "g": "x", "h": "wxyz"}
    pairs = [(owner, role) for owner, roles in held.items() for role in roles]
    rows = spark.createDataFrame(pairs, "object string, role string")
    members, asking = access.merged_sets(workspace, Stage(rows, len(pairs)), "object")
    expected = access.set_ids(workspace, rows, "object").df
    assert sorted(members.df.collect()) == sorted(expected.collect())
    assert dict(members.df.collect())["b"] == "a" and members.rows == 8
    weighed = access.set_roles(rows, expected, "object").select("set_id", "weight", "role")
    assert sorted(asking.df.select("set_id", "weight", "role").collect()) == sorted(weighed.collect())


def test_few_roles_are_not_counted_by_owner(spark, workspace, monkeypatch):
    """No owner can have more roles than there are, so none is looked for among owners."""
    monkeypatch.setattr("grantlens.workspace.SMALL_ROWS", -1)
    names = []
    stage = Workspace.stage
    monkeypatch.setattr(Workspace, "stage", lambda self, df, name, *a, **k: names.append(name) or stage(self, df, name, *a, **k))
    rows = Stage(spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "object string, role string"), 3)
    members, _ = access.merged_sets(workspace, rows, "object")
    assert sorted(members.df.collect()) == [("a", "a"), ("b", "b")] and "object-crowded" not in names
    monkeypatch.setattr(access, "LISTED_ROLES", 1)
    members, _ = access.merged_sets(workspace, rows, "object")
    assert sorted(members.df.collect()) == [("a", "a"), ("b", "b")] and "object-crowded" in names
