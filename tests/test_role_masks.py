"""Privileges on objects as masks of role numbers."""

import pytest

from grantlens.operators import access
from grantlens.workspace import Workspace
from tests.tables import privilege, q, table


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


def account(spark, n_roles, n_objects):
    """Object i goes to every (i % 7 + 1)th role, twice; some roles lack the database, some the schema."""
    roles = [f"R{i}" for i in range(n_roles)]
    grants = [privilege(q("D"), "DATABASE", r) for i, r in enumerate(roles) if i % 5]
    grants += [privilege(q("D", "S"), "SCHEMA", r) for i, r in enumerate(roles) if i % 3]
    grants += [privilege(q("D", "S"), "SCHEMA", "OTHER"), privilege(q("D"), "DATABASE", "OTHER")]
    for i in range(n_objects):
        for role in roles[:: i % 7 + 1]:
            grants += [privilege(q("D", "S", f"T{i}"), "TABLE", role, name) for name in ("SELECT", "INSERT")]
    grants += [privilege(q("D", "S", "T0"), "TABLE", None), privilege(q("D", "S", "T0"), "TABLE", "")]
    grants += [privilege(None, "TABLE", "R1"), privilege(q("D", "S", "T99"), "TABLE", "R0")]
    return table(spark, "privilege_grants", grants), roles


def test_masks_hold_every_privilege_once(spark, workspace):
    """More roles than a mask has bits, also its last, which is the sign of the number."""
    grants, roles = account(spark, 150, 9)
    masks = access.role_masks(workspace, grants)
    assert masks.names.rows == 150
    # An object is a row per 64 role numbers, not one per role.
    assert masks.masks.df.groupBy("object").count().agg({"count": "max"}).first()[0] <= 150 // 64 + 1 + masks.names.df.rdd.getNumPartitions()
    expected = {
        (q("D", "S", f"T{i}"), q("D"), q("D", "S"), r, int(r[1:]) % 5 > 0, int(r[1:]) % 3 > 0)
        for i in range(9)
        for r in roles[:: i % 7 + 1]
    }
    expected |= {(q("D", "S", "T99"), q("D"), q("D", "S"), "R0", False, False), (None, None, None, "R1", False, False)}
    found = [tuple(r) for r in masks.privileges(workspace).collect()]
    assert len(found) == len(expected) and set(found) == expected


@pytest.mark.parametrize("listed", [1, 1000])
def test_objects_merge_by_masks_as_by_roles(spark, workspace, monkeypatch, listed):
    monkeypatch.setattr(access, "LISTED_ROLES", listed)
    monkeypatch.setattr("grantlens.workspace.SMALL_ROWS", -1)
    masks = access.role_masks(workspace, account(spark, 150, 20)[0])
    members, asking = masks.merged(workspace)
    reached = access.reachable_grants(workspace, masks.privileges(workspace))
    others, roles = access.merged_sets(workspace, reached, "object")
    assert sorted(members.df.collect()) == sorted(others.df.collect()) and members.rows == 11
    columns = ("set_id", "weight", "role")
    assert sorted(asking.df.select(*columns).collect()) == sorted(roles.df.select(*columns).collect())
    # Objects whose roles all lack a parent are in no set.
    assert q("D", "S", "T99") not in {r["object"] for r in members.df.collect()}
