import random
import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grantlens.operators import access, graph, skew, usage
from grantlens.workspace import Stage, Workspace
from tests.tables import privilege, q, table, to_role, to_user, user


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


# --- graph --------------------------------------------------------------------


def held_roles(grants):
    """Plain traversal per user: the answer to match."""
    up = defaultdict(set)
    for g in grants:
        kind = "USER" if g["grantee_type"] == "USER" else "ROLE"
        up[(g["grantee"], kind)].add(g["role"])
    out = set()
    for name, kind in list(up):
        if kind != "USER":
            continue
        todo, seen = list(up[(name, "USER")]), set()
        while todo:
            role = todo.pop()
            if role not in seen:
                seen.add(role)
                todo += up.get((role, "ROLE"), ())
        out |= {(name, role) for role in seen}
    return out


def random_grants(seed, n_roles, n_users, n_edges):
    rng = random.Random(seed)
    role = lambda: f"R{rng.randrange(n_roles)}"
    grants = [to_role(role(), role()) for _ in range(n_edges)]
    return grants + [to_user(role(), f"U{rng.randrange(n_users)}") for _ in range(n_users)]


@pytest.mark.parametrize("seed", [1, 2])
def test_user_roles_match_traversal(spark, workspace, seed):
    grants = random_grants(seed, 12, 15, 18)
    df = table(spark, "role_grants", grants)
    users = table(spark, "users", [user(f"U{i}", disabled=i % 4 == 0) for i in range(15)])
    closure = graph.role_closure(workspace, df)
    found = graph.user_roles(workspace, df, users, closure)
    active = {f"U{i}" for i in range(15) if i % 4}
    assert rows(found, "user", "role") == {p for p in held_roles(grants) if p[0] in active}
    assert found.count() == found.distinct().count()

    members = graph.role_members(workspace, df, ["R1", "R2", "ABSENT"])
    expected = {(r, u) for u, r in held_roles(grants) if r in ("R1", "R2")}
    assert rows(members, "root", "user") == expected


def test_long_chain_needs_few_rounds(spark, workspace):
    chain = [to_role(f"R{i + 1}", f"R{i}") for i in range(20)]
    df = table(spark, "role_grants", chain)
    staged = []
    original = workspace.stage
    workspace.stage = lambda df, name, **kw: staged.append(name) or original(df, name, **kw)
    closure = graph.role_closure(workspace, df)
    assert closure.df.count() == closure.rows == 20 * 21 // 2
    assert staged.count("role-closure") <= 6


def test_cycle_ends_and_lists_each_role_once(spark, workspace):
    grants = [to_role("A", "B"), to_role("B", "A"), to_user("A", "u"), to_user("A", "u")]
    df = table(spark, "role_grants", grants)
    users = table(spark, "users", [user("u")])
    found = graph.user_roles(workspace, df, users, graph.role_closure(workspace, df))
    assert sorted(r["role"] for r in found.collect()) == ["A", "B"]


def test_user_and_role_of_one_name_stay_apart(spark, workspace):
    grants = [to_user("ADMIN", "x"), to_role("SECRET", "x"), to_user("x", "y")]
    df = table(spark, "role_grants", grants)
    users = table(spark, "users", [user("x"), user("y")])
    found = graph.user_roles(workspace, df, users, graph.role_closure(workspace, df))
    assert rows(found, "user", "role") == {("x", "ADMIN"), ("y", "x"), ("y", "SECRET")}
    edges = rows(graph.role_edges(df), "src", "dst", "dst_type")
    assert ("ADMIN", "x", "USER") in edges and ("SECRET", "x", "ROLE") in edges


def test_closure_is_idempotent(spark, workspace):
    df = table(spark, "role_grants", random_grants(3, 8, 1, 12))
    closure = graph.role_closure(workspace, df).df
    again = closure.select(
        F.col("role"), F.col("held_by").alias("grantee"), F.lit("ROLE").alias("grantee_type")
    )
    twice = graph.role_closure(workspace, again).df
    assert rows(twice, "held_by", "role") == rows(closure, "held_by", "role")


# --- privileges ---------------------------------------------------------------


def test_parent_permission_flags(spark, workspace):
    obj = q("D", "S", "T")
    grants = [
        privilege(obj, "TABLE", role, "SELECT")
        for role in ("own", "use", "monitor", "nodb", "none", "")
    ]
    grants += [privilege(obj, "TABLE", "use", "INSERT")]
    grants += [privilege(q("D", "S"), "SCHEMA", "own", "OWNERSHIP")]
    grants += [privilege(q("D", "S"), "SCHEMA", r) for r in ("use", "nodb")]
    grants += [privilege(q("D", "S"), "SCHEMA", "monitor", "MONITOR")]
    grants += [privilege(q("D"), "DATABASE", r, "MONITOR") for r in ("own", "use", "monitor")]
    found = access.object_privileges_by_role(workspace, table(spark, "privilege_grants", grants))
    assert found.count() == 5
    assert rows(found, "grantee", "has_db_permission", "has_schema_permission") == {
        ("own", True, True),
        ("use", True, True),
        ("monitor", True, False),
        ("nodb", False, True),
        ("none", False, False),
    }
    assert rows(found, "object", "db", "schema") == {(obj, q("D"), q("D", "S"))}


def test_access_of_some_objects_and_users(spark, workspace):
    grants = [privilege(q("D"), "DATABASE", "r"), privilege(q("D", "S"), "SCHEMA", "r")]
    grants += [privilege(q("D", "S", f"T{i}"), "TABLE", "r", "SELECT") for i in range(4)]
    privileges = access.object_privileges_by_role(workspace, table(spark, "privilege_grants", grants))
    held = spark.createDataFrame([(f"u{i}", "r") for i in range(5)], "user string, role string")
    every = access.user_object_access(workspace, privileges, held)
    assert every.count() == 20
    some = access.user_object_access(
        workspace, privileges, held, F.col("object").endswith('T1"'), F.col("user") != "u0"
    )
    assert rows(some, "object", "user") == {(q("D", "S", "T1"), f"u{i}") for i in range(1, 5)}


def test_account_level_grants_have_no_schema(spark, workspace):
    grants = [privilege(q("WH"), "WAREHOUSE", "r")]
    found = access.object_privileges_by_role(workspace, table(spark, "privilege_grants", grants))
    assert [tuple(r)[1:] for r in found.collect()] == [(q("WH"), None, "r", False, False)]


# --- counts -------------------------------------------------------------------


def account(spark, seed, n_roles=9, n_users=40, n_objects=30):
    rng = random.Random(seed)
    grants = random_grants(seed, n_roles, n_users, 8)
    grants += [to_user("R0", f"U{i}") for i in range(n_users) if i % 3]
    users = [user(f"U{i}", disabled=i % 7 == 0) for i in range(n_users)]
    privileges = [privilege(q("D"), "DATABASE", f"R{i}") for i in range(n_roles) if i != 4]
    privileges += [privilege(q("D", "S"), "SCHEMA", f"R{i}") for i in range(n_roles) if i != 5]
    for i in range(n_objects):
        for role in rng.sample(range(n_roles), rng.randrange(1, 4)):
            privileges.append(privilege(q("D", "S", f"T{i % 20}"), "TABLE", f"R{role}", "SELECT"))
    return (
        table(spark, "role_grants", grants),
        table(spark, "users", users),
        table(spark, "privilege_grants", privileges),
    )


@pytest.mark.parametrize("plan", ["profiles", "bitmaps", "auto"])
@pytest.mark.parametrize("seed", [5, 6])
def test_counts_equal_counting_the_rows(spark, workspace, plan, seed):
    grants, users, privileges = account(spark, seed)
    closure = graph.role_closure(workspace, grants)
    v01 = access.object_privileges_by_role(workspace, privileges)
    v02 = access.user_object_access(
        workspace, v01, graph.user_roles(workspace, grants, users, closure)
    )
    expected = rows(
        v02.groupBy("object").agg(F.count_distinct("user").alias("n")), "object", "n"
    )
    reached = access.reachable_grants(workspace, v01)
    counts = access.object_user_counts(workspace, reached, grants, users, closure, plan)
    assert rows(counts, "object", "n_users") == expected
    assert counts.count() == len(expected) > 5


@pytest.mark.parametrize("most_pieces", [0, 1, 2, 1000])
def test_pieces_and_bitmaps_count_alike(spark, workspace, monkeypatch, most_pieces):
    """Roles of few and of many profiles, in lists of pieces, in bitmaps, and in sets that have both."""
    monkeypatch.setattr(access, "MOST_PIECES", most_pieces)
    grants, users, privileges = account(spark, 7)
    closure = graph.role_closure(workspace, grants)
    reached = access.reachable_grants(workspace, access.object_privileges_by_role(workspace, privileges))
    staged = {}
    original = workspace.stage
    workspace.stage = lambda df, name, **kw: staged.setdefault(name, original(df, name, **kw))
    sets = access.role_sets(workspace, reached, grants, users, closure)
    expected = rows(access.set_counts(workspace, sets.asking, sets, "profiles"), "set_id", "n_users")
    assert rows(access.set_counts(workspace, sets.asking, sets, "bitmaps"), "set_id", "n_users") == expected
    n_bitmaps = staged["role-bitmaps"].rows
    assert n_bitmaps == 0 if most_pieces == 1000 else n_bitmaps > 0
    assert most_pieces == 0 or n_bitmaps < staged["role-blocks"].rows


def test_one_more_grant_never_lowers_a_count(spark, workspace):
    grants, users, privileges = account(spark, 9)
    more = grants.unionByName(table(spark, "role_grants", [to_user("R1", "U1")]))

    def counts(g):
        v01 = access.object_privileges_by_role(workspace, privileges)
        closure = graph.role_closure(workspace, g)
        reached = access.reachable_grants(workspace, v01, stored_rows=1000)
        found = access.object_user_counts(workspace, reached, g, users, closure)
        return {r["object"]: r["n_users"] for r in found.collect()}

    before, after = counts(grants), counts(more)
    assert all(after[o] >= n for o, n in before.items())


def test_plan_choice_compares_shuffled_bytes(spark):
    def stage(n_rows, n_roles, other):
        df = spark.range(n_rows).select(
            (F.col("id") % n_roles).cast("string").alias("role"),
            F.col("id").cast("string").alias(other),
        )
        return Stage(df, n_rows)

    members = Stage(spark.range(1), 1000)
    sets = stage(100_000, 2, "set_id")
    assert access.cheaper_plan(stage(50, 2, "profile"), sets, members) == "profiles"
    assert access.cheaper_plan(stage(20_000, 2, "profile"), sets, members) == "bitmaps"


def test_sets_are_named_without_regard_to_order(spark, workspace):
    pairs = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "z")]
    df = spark.createDataFrame(pairs, "owner string, role string")
    members = access.set_ids(workspace, df, "owner").df
    ids = {r["owner"]: r["set_id"] for r in members.collect()}
    assert ids["a"] == ids["b"]
    assert len(set(ids.values())) == 4
    sets = access.set_roles(df, members, "owner").collect()
    assert Counter((r["weight"], r["role"]) for r in sets) == {
        (2, "x"): 1, (2, "y"): 1, (1, "x"): 1, (1, "y"): 1, (1, "z"): 1,
    }


def colliding_sets():
    """Two disjoint sets of roles, equally large, whose folded hashes are the same."""
    basis = {}
    for i in range(400):
        digest = int(hashlib.sha256(f"ROLE_{i}".encode()).hexdigest()[:45], 16)
        members = {i}
        while digest and digest.bit_length() in basis:
            other, their = basis[digest.bit_length()]
            digest ^= other
            members ^= their
        if digest:
            basis[digest.bit_length()] = digest, members
        elif len(members) % 2 == 0:
            half = len(members) // 2
            return sorted(members)[:half], sorted(members)[half:]


@pytest.mark.parametrize("plan", ["profiles", "bitmaps"])
def test_sets_with_one_name_are_told_apart(spark, workspace, plan):
    left, right = colliding_sets()
    grants = [(f"o{i}", f"ROLE_{i}") for i in [*left, *right]]
    held = [("x", f"ROLE_{i}") for i in left] + [("y", f"ROLE_{i}") for i in right]
    rows = spark.createDataFrame(held, "user string, role string")
    names = access.set_names(rows, "user").collect()
    assert len({r["set_id"] for r in names}) == 1  # the candidate names do collide
    role_grants = rows.select("role", F.col("user").alias("grantee"), F.lit("USER").alias("grantee_type"))
    users = spark.createDataFrame([("x", False), ("y", False)], "name string, disabled boolean")
    given = workspace.stage(spark.createDataFrame(grants, "object string, role string"), "grants")
    closure = graph.role_closure(workspace, role_grants)
    found = access.object_user_counts(workspace, given, role_grants, users, closure, plan)
    assert {r["object"]: r["n_users"] for r in found.collect()} == {o: 1 for o, _ in grants}


# --- skew ---------------------------------------------------------------------


def skewed(spark, n):
    """Half of the rows on one key, some keys without a partner, some null keys."""
    key = (
        F.when(F.col("id") % 2 == 0, "hot")
        .when(F.col("id") % 11 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string")))
    )
    return spark.range(n).select(key.alias("key"), F.col("id").cast("string").alias("a"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_by_slices_equals_plain_join(spark, workspace, how):
    left = skewed(spark, 2000)
    keys = [("hot", 1), ("k1", 2), ("k2", 3), ("alone", 4)]
    right = spark.createDataFrame(keys, "key string, v int")
    found = skew.lookup_join(
        workspace, left, Stage(right, 4), ["key"], how, "a",
        broadcast_rows=0, hot_pairs=100, slice_rows=50,
    )
    assert "_left_slice" in found._jdf.queryExecution().analyzed().toString()
    expected = left.join(right, "key", how)
    assert Counter(map(tuple, found.select(expected.columns).collect())) == Counter(
        map(tuple, expected.collect())
    )


def test_fan_out_join_by_slices_equals_plain_join(spark, workspace):
    left = skewed(spark, 600)
    right = skewed(spark, 300).withColumnRenamed("a", "b")
    found = skew.balanced_join(
        workspace, Stage(left, 600), Stage(right, 300), ["key"], "inner", "a", "b",
        hot_pairs=1000, slice_rows=40,
    )
    expected = left.join(right, "key")
    assert Counter(map(tuple, found.select("key", "a", "b").collect())) == Counter(
        map(tuple, expected.select("key", "a", "b").collect())
    )


def test_slices_spread_a_hot_key(spark, workspace):
    left, right = skewed(spark, 4000), spark.createDataFrame([("hot", 1)], "key string, v int")
    hot = skew._hot_keys(workspace, Stage(left, 4000), Stage(right, 1), ["key"], 500, 100)
    assert [tuple(r) for r in hot.df.collect()] == [("hot", 20, 1)]


def test_rows_without_a_key_are_spread_and_kept(spark, workspace):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("key"),
        F.col("id").cast("string").alias("a"),
    )
    right = spark.createDataFrame([("3", 1)], "key string, v int")
    found = skew.lookup_join(
        workspace, left, Stage(right, 1), ["key"], "left", "a",
        broadcast_rows=0, hot_pairs=100, slice_rows=50,
    )
    assert found.count() == 3000
    assert [r["a"] for r in found.filter("v = 1").collect()] == ["3"]
    assert found.filter("key IS NULL").select("a").distinct().count() == 2000


def test_every_hot_key_is_split(spark, workspace, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1000)
    rows = spark.range(12_000).select(
        (F.col("id") % 3000).cast("string").alias("key"), F.col("id").cast("string").alias("a")
    )
    stage = Stage(rows, 12_000)
    hot = skew._hot_keys(workspace, stage, stage, ["key"], 16, 2)
    assert hot.rows == 3000
    assert hot.df.select("left_slices", "right_slices").distinct().collect() == [(2, 2)]
    right = Stage(rows.withColumnRenamed("a", "b"), 12_000)
    found = skew.balanced_join(
        workspace, stage, right, ["key"], "inner", "a", "b", hot_pairs=16, slice_rows=2
    )
    assert "_left_slice" in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 3000 * 16 == found.distinct().count()


def test_balanced_join_is_plain_without_hot_keys(spark, workspace):
    left, right = skewed(spark, 50), spark.createDataFrame([("hot", 1)], "key string, v int")
    found = skew.balanced_join(
        workspace, Stage(left, 10**10), Stage(right, 1), ["key"], "left", "a", hot_pairs=10**9
    )
    assert "_left_slice" not in found._jdf.queryExecution().analyzed().toString()
    assert found.count() == 50


# --- usage --------------------------------------------------------------------


def test_rankings_break_ties_by_other_count_then_name(spark):
    use = [("u1", "b", 5), ("u1", "a", 5), ("u1", "c", 2), ("u2", "c", 3), ("u3", "d", 1)]
    df = spark.createDataFrame(use, "user string, object string, usage_count bigint")
    found = {(r["ranking"], r["rank"]): r["object"] for r in usage.most_used(df).collect()}
    assert [found["usage", i] for i in (1, 2, 3, 4)] == ["c", "a", "b", "d"]
    assert [found["users", i] for i in (1, 2, 3, 4)] == ["c", "a", "b", "d"]


def test_rankings_stop_at_ten(spark):
    use = [(f"u{i}", f"o{i:02}", i) for i in range(25)]
    df = spark.createDataFrame(use, "user string, object string, usage_count bigint")
    found = usage.most_used(df)
    assert found.count() == 20
    assert rows(found.filter("rank = 1"), "ranking", "object") == {
        ("usage", "o24"), ("users", "o24"),
    }
