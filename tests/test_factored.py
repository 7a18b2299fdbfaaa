import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from grantlens import Audit
from grantlens.operators import access, ranking, skew
from grantlens.operators.factored import FactoredAccess
from grantlens.plans.registry import BUILT_IN
from grantlens.workspace import Stage, Workspace
from tests.tables import column, database, entity, privilege, q, schema, snapshot, to_role, to_user, user

CHECKS = {c.id[:3]: c for c in BUILT_IN}


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


def account(seed, n_roles=14, n_users=60, n_objects=80):
    """Grants of random roles on objects, to users with random roles, some of them through other roles."""
    draw = random.Random(seed)
    roles = [f"R{i}" for i in range(n_roles)]
    edges = [to_role(draw.choice(roles), draw.choice(roles)) for _ in range(5)]
    held = [to_user(draw.choice(roles), f"U{i}") for i in range(n_users) for _ in range(draw.randint(0, 2))]
    privileges = [privilege(q("D"), "DATABASE", r) for r in roles] + [privilege(q("D", "S"), "SCHEMA", r) for r in roles]
    for i in range(n_objects):
        for role in draw.sample(roles, draw.randint(0, min(5, n_roles))):
            privileges.append(privilege(q("D", "S", f"T{i:03}"), "TABLE", role, "SELECT"))
    return edges + held, [user(f"U{i}", disabled=i % 9 == 0) for i in range(n_users)], privileges


def audit_of(spark, seed, **sizes):
    grants, users, privileges = account(seed, **sizes)
    n = sizes.get("n_objects", 80)
    return Audit(
        spark,
        snapshot(
            spark,
            role_grants=grants,
            users=users,
            privilege_grants=privileges,
            databases=[database("D")],
            schemas=[schema("D", "S")],
            entities=[entity("D", "S", f"T{i:03}") for i in range(n + 5)],
            columns=[column("D", "S", f"T{i:03}", "email") for i in range(n)],
        ),
    )


def plain(audit):
    """Object -> users by joining the rows."""
    rows = access.user_object_access(audit.workspace, audit.object_privileges, audit.user_roles)
    found = defaultdict(set)
    for r in rows.collect():
        found[r.object].add(r.user)
    return found


def tuples(df):
    return sorted(tuple(r) for r in df.select("object", "db", "schema", "grantee", "user", "role").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_expansion_equals_the_joined_rows(spark, seed):
    audit = audit_of(spark, seed)
    rows = tuples(access.user_object_access(audit.workspace, audit.object_privileges, audit.user_roles))
    factored = audit.factored_access
    assert tuples(factored.expand(audit.workspace)) == rows and len(rows) > 500
    one = factored.expand(audit.workspace, users=F.col("user") == "U4")
    assert tuples(one) == [r for r in rows if r[4] == "U4"]
    some = factored.expand(audit.workspace, F.col("object") < q("D", "S", "T009"), F.col("user").endswith("1"))
    assert tuples(some) == [r for r in rows if r[0] < q("D", "S", "T009") and r[4].endswith("1")]
    none = factored.expand(audit.workspace, users=F.col("user") == "nobody")
    assert none.count() == 0
    sizes = {r.role: (r.n_objects, r.n_users, r.n_rows) for r in factored.role_sizes().collect()}
    by_role = defaultdict(lambda: (set(), set()))
    for o, _, _, _, u, role in rows:
        by_role[role][0].add(o)
        by_role[role][1].add(u)
    assert sizes == {role: (len(o), len(u), len(o) * len(u)) for role, (o, u) in by_role.items()}


def test_factors_do_not_grow_with_users_times_objects(spark):
    """Everybody with one role that works on everything: one set, one profile."""
    n = 300
    grants = [to_user("R", f"U{i}") for i in range(n)]
    privileges = [privilege(q("D"), "DATABASE", "R"), privilege(q("D", "S"), "SCHEMA", "R")]
    privileges += [privilege(q("D", "S", f"T{i}"), "TABLE", "R", "SELECT") for i in range(n)]
    audit = Audit(spark, snapshot(spark, role_grants=grants, users=[user(f"U{i}") for i in range(n)], privilege_grants=privileges))
    staged = []
    original = audit.workspace.stage
    audit.workspace.stage = lambda *a, **kw: staged.append(original(*a, **kw)) or staged[-1]
    factored = audit.factored_access
    assert factored.object_sets.df.collect() == [(q("D", "S", "T0"), "R", n)]
    assert factored.profiles.df.collect() == [("U0", "R", n)]
    assert factored.role_sizes().collect() == [("R", n, n, n * n)]
    assert factored.expand(audit.workspace, users=F.col("user") == "U7").count() == n
    assert max(s.rows for s in staged) <= 3 * n


def test_expansion_splits_hot_roles_and_sets(spark, workspace, monkeypatch):
    monkeypatch.setattr(skew, "HOT_PAIRS", 50)
    monkeypatch.setattr(skew.balanced_join, "__defaults__", (None, 50, 4))
    audit = audit_of(spark, 3, n_roles=4, n_users=40, n_objects=30)
    rows = tuples(access.user_object_access(audit.workspace, audit.object_privileges, audit.user_roles))
    expanded = audit.factored_access.expand(audit.workspace)
    assert "_left_slice" in expanded._jdf.queryExecution().analyzed().toString()
    assert tuples(expanded) == rows


def test_factors_survive_a_round_trip(spark, tmp_path):
    audit = audit_of(spark, 4)
    factored = audit.factored_access
    factored.write(str(tmp_path / "access"))
    again = FactoredAccess.read(spark, str(tmp_path / "access"))
    chosen = F.col("object") == q("D", "S", "T003")
    assert tuples(again.expand(audit.workspace, chosen)) == tuples(factored.expand(audit.workspace, chosen))
    assert again.users.rows == factored.users.df.count()


def test_nobody_and_nothing(spark):
    audit = Audit(spark, snapshot(spark, role_grants=[], users=[], privilege_grants=[], entities=[entity("D", "S", "T")]))
    assert audit.factored_access.expand(audit.workspace).count() == 0
    assert audit.plan(CHECKS["c13"]).findings[""].count() == 0
    assert [tuple(r) for r in audit.plan(CHECKS["c14"]).findings[""].collect()] == [(q("D", "S", "T"), 0)]


# --- ranking --------------------------------------------------------------------


@pytest.mark.parametrize("seed", [5, 6])
def test_ranking_equals_counting_everything(spark, seed):
    audit = audit_of(spark, seed)
    users = plain(audit)
    every = {o: len(u) for o, u in users.items()}
    bounds = {r.set_id: (r.lower, r.upper) for r in audit.set_bounds.df.collect()}
    for r in audit.role_sets.objects.df.collect():
        lower, upper = bounds[r.set_id]
        assert lower <= every.get(r.object, 0) <= upper
    known = audit.role_sets.objects.df.select("object")
    entities = audit.snapshot.entities.select(F.col("fqn").alias("object"))
    for objects in (known, entities):
        counts = {r.object: every.get(r.object, 0) for r in objects.collect()}
        for most in (True, False):
            for n in (1, 10):
                found = ranking.ranked_objects(audit.workspace, audit.role_sets, audit.set_bounds, objects, n, most, first_sets=2)
                ordered = sorted(counts.items(), key=lambda x: (-x[1] if most else x[1], x[0]))[:n]
                assert [tuple(r) for r in found.rows.collect()] == ordered


def test_checks_of_access_equal_counting_everything(spark):
    audit = audit_of(spark, 8)
    every = {o: len(u) for o, u in plain(audit).items()}
    top = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [tuple(r) for r in audit.plan(CHECKS["c13"]).findings[""].orderBy(F.desc("n_users"), "object").collect()] == top
    all_objects = {q("D", "S", f"T{i:03}"): 0 for i in range(85)} | every
    bottom = sorted(all_objects.items(), key=lambda x: (x[1], x[0]))[:10]
    assert [tuple(r) for r in audit.plan(CHECKS["c14"]).findings[""].orderBy("n_users", "object").collect()] == bottom
    active = sum(i % 9 != 0 for i in range(60))
    wide = {(o[:-1] + '"."email"', n) for o, n in every.items() if n > max(3, active // 10)}
    assert {tuple(r) for r in audit.plan(CHECKS["c17"]).findings[""].collect()} == wide
    assert 0 < len(wide) < 80


def test_few_sets_are_counted(spark):
    """Objects far from either end are never counted."""
    grants = [to_user(f"R{i}", f"U{i}_{k}") for i in range(40) for k in range(i + 1)]
    users = [user(g["grantee"]) for g in grants]
    privileges = [privilege(q("D"), "DATABASE", f"R{i}") for i in range(40)]
    privileges += [privilege(q("D", "S"), "SCHEMA", f"R{i}") for i in range(40)]
    for i in range(3, 40):
        for role in (i, i - 1, i - 3):
            privileges.append(privilege(q("D", "S", f"T{i:03}"), "TABLE", f"R{role}", "SELECT"))
    audit = Audit(spark, snapshot(spark, role_grants=grants, users=users, privilege_grants=privileges))
    objects = audit.role_sets.objects.df.select("object")
    found = ranking.ranked_objects(audit.workspace, audit.role_sets, audit.set_bounds, objects, 3, True, first_sets=1)
    assert [r.n_users for r in found.rows.collect()] == [40 + 39 + 37, 39 + 38 + 36, 38 + 37 + 35]
    assert found.n_sets_counted <= 21


def test_a_set_is_named_by_its_first_owner(spark, workspace):
    pairs = [("b", "x"), ("a", "x"), ("c", "y"), ("d", "y"), ("d", "x")]
    members = access.set_ids(workspace, spark.createDataFrame(pairs, "owner string, role string"), "owner")
    assert {tuple(r) for r in members.df.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    assert isinstance(members, Stage)
