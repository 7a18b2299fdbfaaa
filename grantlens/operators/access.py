"""Which roles and users reach which objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.identifiers import truncated_database, truncated_schema
from grantlens.operators.graph import CondensedClosure, active_names, condensed, direct_roles
from grantlens.operators.skew import balanced_join, crossed_join, lookup_join
from grantlens.workspace import Stage, Workspace

# Privileges on a schema that open it.
SCHEMA_PRIVILEGES = ["OWNERSHIP", "USAGE"]

BITMAP_BYTES = 4096
BLOCK_USERS = BITMAP_BYTES * 8

# Users of a role in a block are listed in up to so many pieces; a bitmap is smaller beyond that.
MOST_PIECES = BITMAP_BYTES // 4
PAIR_BYTES = 32
PAIRS_WITHOUT_COUNTING = 10_000_000

# Sets of no more roles than this are compared as lists.
LISTED_ROLES = 1000

# Roles of a mask: the bits of a long.
MASK_ROLES = 64


@dataclass(frozen=True)
class RoleMasks:
    """Which roles have privileges on which objects: a row per object and block of 64 role numbers, a bit per role.

    So an object with few roles is a row or two, however many grants it has, and its name is cut and looked up once.
    """

    # object, db, schema, block, held, in_db, in_schema: roles with a privilege, and those that the parents are open to
    masks: Stage
    names: Stage  # grantee, number

    def privileges(self, workspace: Workspace) -> DataFrame:
        """The rows of ``object_privileges_by_role``."""
        bit = F.col("bit")
        single = self.masks.df.select("*", F.explode(F.sequence(F.lit(0), F.lit(MASK_ROLES - 1))).alias("bit"))
        numbered = single.filter(F.getbit("held", bit) == 1).select(
            "object",
            "db",
            "schema",
            (F.col("block") * MASK_ROLES + bit).alias("number"),
            (F.getbit("in_db", bit) == 1).alias("has_db_permission"),
            (F.getbit("in_schema", bit) == 1).alias("has_schema_permission"),
        )
        named = lookup_join(workspace, numbered, self.names, ["number"], "inner", spread="object")
        return named.select("object", "db", "schema", "grantee", "has_db_permission", "has_schema_permission")

    def merged(self, workspace: Workspace) -> tuple[Stage, Stage]:
        """The objects of working privileges as ``merged_sets`` merges them, comparing masks instead of roles."""
        bits = F.col("held").bitwiseAND(F.col("in_db")).bitwiseAND(F.col("in_schema"))
        working = self.masks.df.select("object", "block", bits.alias("bits")).filter("bits <> 0")
        cells = working.select("object", F.concat_ws(":", "block", "bits").alias("role"))
        members, asking = merged_sets(workspace, Stage(cells, self.masks.rows), "object", most=self.names.rows)
        block, bits = (F.split_part("role", F.lit(":"), F.lit(i)).cast("bigint") for i in (1, 2))
        masks = asking.df.select("set_id", "weight", block.alias("block"), bits.alias("bits"))
        single = masks.select("*", F.explode(F.sequence(F.lit(0), F.lit(MASK_ROLES - 1))).alias("bit"))
        numbered = single.filter(F.getbit("bits", F.col("bit")) == 1).select(
            "set_id", "weight", (F.col("block") * MASK_ROLES + F.col("bit")).alias("number")
        )
        named = lookup_join(workspace, numbered, self.names, ["number"], "inner", spread="set_id")
        return members, workspace.stage(named.select("set_id", "weight", F.col("grantee").alias("role")), "object-roles")


def _masked(numbered: DataFrame, name: str, *by: str) -> DataFrame:
    """(by, block, name): a bit for each number."""
    bit = F.expr(f"shiftleft(1L, cast(number % {MASK_ROLES} AS int))")
    block = F.floor(F.col("number") / MASK_ROLES).alias("block")
    return numbered.groupBy(*by, block).agg(F.bit_or(bit).alias(name))


def role_masks(workspace: Workspace, privilege_grants: DataFrame) -> RoleMasks:
    """The privileges on objects, and whether their parents are open to the same role.

    Any privilege on the database opens it; on the schema only usage or ownership.
    """
    kind = F.col("asset_type")
    # Each kind by itself: a plan takes a plain comparison down to where kinds are known, and reads no others there.
    # One condition on both kinds would stay above, since it is simplified to one with the privilege in it.
    databases = privilege_grants.filter(kind == "DATABASE")
    schemas = privilege_grants.filter(kind == "SCHEMA").filter(F.col("privilege").isin(*SCHEMA_PRIVILEGES))
    opening = databases.unionByName(schemas).select("asset_type", "asset", "grantee").distinct()
    parents = workspace.stage(opening, "parent-grants")

    grants = privilege_grants.filter(~kind.isin("SCHEMA", "DATABASE") & (F.col("grantee") != ""))
    # Stored as they come, since roles have to be numbered first: bits can be gathered before rows are dealt by object.
    grants = workspace.stage(grants.select(F.col("asset").alias("object"), "grantee"), "object-grants")
    names = workspace.stage(
        grants.df.select("grantee").distinct().select("grantee", F.monotonically_increasing_id().alias("number")),
        "grantee-numbers",
    )
    numbered = lookup_join(workspace, grants.df, names, ["grantee"], "inner", spread="object")
    objects = _masked(numbered, "held", "object").withColumns(
        {"db": truncated_database("object"), "schema": truncated_schema("object")}
    )
    opened = lookup_join(workspace, parents.df, names, ["grantee"], "inner", spread="asset")
    opened = workspace.stage(_masked(opened, "open", "asset_type", "asset"), "parent-masks", at_most=parents.rows)

    def parent(level: str, name: str, flag: str) -> Stage:
        rows = opened.df.filter(kind == level).select(F.col("asset").alias(name), "block", F.col("open").alias(flag))
        return Stage(rows, opened.rows)

    flagged = lookup_join(workspace, objects, parent("DATABASE", "db", "in_db"), ["db", "block"], "left", "object")
    flagged = lookup_join(
        workspace, flagged, parent("SCHEMA", "schema", "in_schema"), ["schema", "block"], "left", "object"
    )
    none = F.lit(0).cast("bigint")
    masks = flagged.select(
        "object",
        "db",
        "schema",
        "block",
        "held",
        F.coalesce("in_db", none).alias("in_db"),
        F.coalesce("in_schema", none).alias("in_schema"),
    )
    return RoleMasks(workspace.stage(masks, "object-masks"), names)


def object_privileges_by_role(workspace: Workspace, privilege_grants: DataFrame) -> DataFrame:
    """(object, db, schema, grantee, has_db_permission, has_schema_permission) of ``role_masks``."""
    return role_masks(workspace, privilege_grants).privileges(workspace)


def reachable(privileges: DataFrame) -> DataFrame:
    """Privileges that work, because the database and the schema are open too."""
    return privileges.filter(F.col("has_db_permission") & F.col("has_schema_permission"))


def reachable_grants(
    workspace: Workspace, privileges: DataFrame, stored_rows: int | None = None
) -> Stage:
    """(object, role) of working privileges.

    ``stored_rows`` is the size of ``privileges`` if that is a stored table, which is
    then filtered in place instead of being written once more.
    """
    grants = reachable(privileges).select("object", F.col("grantee").alias("role"))
    if stored_rows is not None:
        return Stage(grants, stored_rows)
    return workspace.stage(grants, "reachable")


def user_object_access(
    workspace: Workspace,
    privileges: DataFrame,
    user_roles: DataFrame,
    objects: Column | None = None,
    users: Column | None = None,
) -> DataFrame:
    """One row per working privilege and user that holds its role.

    The rows repeat every user of a role for every object of the role. Ask for some with
    ``objects`` and ``users``, conditions on the columns of either side, which are applied
    before anything is repeated; use ``object_user_counts`` to count.
    """
    working, held = reachable(privileges), user_roles
    if objects is not None:
        working = working.filter(objects)
    if users is not None:
        held = held.filter(users)
    grants = workspace.stage(working, "reachable")
    holders = workspace.stage(held.withColumn("grantee", F.col("role")), "holders")
    return crossed_join(workspace, grants, holders, ["grantee"], "object", "user")


# --- distinct users per object ------------------------------------------------


def _hash_part(member: Column, start: int) -> Column:
    digits = F.substring(F.sha2(member, 256), start, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def set_names(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, n_roles, set_id): a candidate name for the set of roles of each owner.

    ``rows`` is distinct (owner, role). A set is named by its size and 180 bits of an
    order-free SHA-256 fold, which is a plain aggregate combined on the map side: no
    role list is ever gathered, however many roles one owner has. Different sets may
    share a name, by intent even, so names are only candidates.
    """
    parts = [F.hex(F.bit_xor(_hash_part(F.col("role"), start))) for start in (1, 16, 31)]
    return rows.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_roles"),
        F.concat_ws("-", F.count(F.lit(1)), *parts).alias("set_id"),
    )


def set_ids(workspace: Workspace, rows: DataFrame, owner: str) -> Stage:
    """(owner, set_id): equal exactly for owners with equal sets of roles; a set is named by its first owner.

    The roles of every owner are looked up among those of the first owner with the same candidate name.
    Sets of one size that share all roles are equal; an owner whose set differs is a set of its own.
    """
    named = workspace.stage(set_names(rows, owner), f"{owner}-set-names")
    samples = named.df.groupBy("set_id").agg(F.min(owner).alias(owner))
    claimed = rows.join(named.df.select(owner, "set_id"), owner)
    expected = workspace.stage(
        rows.join(samples, owner).select("set_id", "role"), f"{owner}-sample-roles"
    )
    shared = lookup_join(
        workspace, claimed, expected, ["set_id", "role"], "left_semi", spread=owner
    )
    counts = shared.groupBy(owner).agg(F.count(F.lit(1)).alias("n_shared"))
    firsts = Stage(samples.withColumnRenamed(owner, "first"), named.rows)
    checked = named.df.join(counts, owner, "left")
    checked = lookup_join(workspace, checked, firsts, ["set_id"], "left", spread=owner)
    same = F.col("n_shared").eqNullSafe(F.col("n_roles"))
    exact = checked.select(owner, F.when(same, F.col("first")).otherwise(F.col(owner)).alias("set_id"))
    return workspace.stage(exact, f"{owner}-sets", at_most=named.rows)


def set_roles(rows: DataFrame, members: DataFrame, owner: str) -> DataFrame:
    """(set_id, weight, role): the roles of each set, read back from its first owner.

    ``weight`` is the number of owners with that set. The join is on the owner, who has
    each role once, so no key has more rows than there are roles.
    """
    sets = members.groupBy(F.col("set_id").alias(owner)).agg(F.count(F.lit(1)).alias("weight"))
    return rows.join(sets, owner).select(F.col(owner).alias("set_id"), "weight", "role")


def merged_sets(
    workspace: Workspace, rows: Stage, owner: str, most: int | None = None
) -> tuple[Stage, Stage]:
    """(owner, set_id) as ``set_ids`` gives it, and (set_id, weight, role) as ``set_roles`` does.

    An owner with few roles is compared by their sorted list, which takes one aggregate over ``rows``. Owners
    with more are counted first and go through ``set_ids``, which gathers no list. ``most``: how many roles
    an owner can have, if that is known.
    """
    crowded = _crowded(workspace, rows, owner, most)
    listed = rows.df
    if crowded.rows > 0:
        listed = lookup_join(workspace, listed, crowded, [owner], "left_anti", spread="role")
    roles = F.sort_array(F.collect_list("role")).alias("roles")
    lists = workspace.stage(listed.groupBy(owner).agg(roles), f"{owner}-role-lists")
    sets = workspace.stage(
        lists.df.groupBy("roles").agg(F.min(owner).alias("set_id"), F.count(F.lit(1)).alias("weight")), f"{owner}-sets"
    )
    members = lookup_join(workspace, lists.df, Stage(sets.df.select("roles", "set_id"), sets.rows), ["roles"], "inner", spread=owner)
    members = members.select(owner, "set_id")
    asking = sets.df.select("set_id", "weight", F.explode("roles").alias("role"))
    if crowded.rows > 0:
        many = workspace.stage(
            lookup_join(workspace, rows.df, crowded, [owner], "left_semi", spread="role"), f"{owner}-crowded-roles"
        ).df
        others = set_ids(workspace, many, owner).df
        members = members.unionByName(others)
        asking = asking.unionByName(set_roles(many, others, owner))
    return workspace.stage(members, f"{owner}-members"), workspace.stage(asking, f"{owner}-set-roles")


def _crowded(workspace: Workspace, rows: Stage, owner: str, most: int | None = None) -> Stage:
    """(owner): those with more than LISTED_ROLES roles. None has more than there are, so few roles need no count by owner."""
    owners = rows.df.groupBy(owner).agg(F.count(F.lit(1)).alias("n_roles")).filter(F.col("n_roles") > LISTED_ROLES)
    if most is None:
        most = rows.df.select("role").distinct().limit(LISTED_ROLES + 1).count()
    if most <= LISTED_ROLES:
        return Stage(owners.select(owner), 0)
    return workspace.stage(owners.select(owner), f"{owner}-crowded", at_most=rows.rows // LISTED_ROLES)


@dataclass(frozen=True)
class RoleSets:
    """Objects and enabled users, merged by equal sets of roles, without a row per object and user."""

    objects: Stage  # object, set_id
    asking: Stage  # set_id, weight, role: roles that work on the objects of a set
    people: Stage  # user, set_id
    reach: Stage  # profile, weight, role: roles that the users of a set act with, if some object asks for them


def role_sets(
    workspace: Workspace, grants: Stage | RoleMasks, role_grants: DataFrame, users: DataFrame, closure: Stage
) -> RoleSets:
    """Merge the objects of ``reachable_grants`` or ``role_masks``, and the users with such roles, by their roles."""
    if isinstance(grants, RoleMasks):
        objects, asking = grants.merged(workspace)
    else:
        objects, asking = merged_sets(workspace, grants, "object")

    # (held_by, role): holding the first gives the second, which some object asks for. The roles of a cycle are
    # held as one, and so are named by their component.
    cycles = closure.cycles if isinstance(closure, CondensedClosure) else None
    asked = asking.df.select("role").distinct().withColumn("held_by", F.col("role"))
    granted = direct_roles(role_grants)
    if cycles is not None and cycles.rows > 0:
        asked = condensed(workspace, asked, cycles, "held_by", spread="role")
        granted = condensed(workspace, granted, cycles, "role", spread="user").distinct()
    asked = workspace.stage(asked, "asked-roles", at_most=asking.rows)
    # A component may stand for many roles, and many roles may reach it.
    reaching = Stage(closure.df.select("held_by", F.col("role").alias("via")), closure.rows)
    inner = Stage(asked.df.select("role", F.col("held_by").alias("via")), asked.rows)
    inherited = balanced_join(workspace, reaching, inner, ["via"], "inner", "held_by", "role")
    given = workspace.stage(
        asked.df.select("held_by", "role").unionByName(inherited.select("held_by", "role")).distinct(),
        "given-roles",
    )
    useful = Stage(given.df.select(F.col("held_by").alias("role")).distinct(), given.rows)
    direct = lookup_join(workspace, granted, useful, ["role"], "left_semi", spread="user")
    held = workspace.stage(direct.join(active_names(users), "user", "left_semi"), "held-roles")
    people, profiles = merged_sets(workspace, held, "user")
    profiles = Stage(profiles.df.withColumnRenamed("role", "held_by"), profiles.rows)
    wide = balanced_join(workspace, profiles, given, ["held_by"], "inner", "set_id", "role")
    reach = workspace.stage(
        wide.select(F.col("set_id").alias("profile"), "weight", "role").distinct(),
        "profile-roles",
        at_most=profiles.rows * given.rows,
    )
    return RoleSets(objects, asking, people, reach)


def object_user_counts(
    workspace: Workspace,
    grants: Stage | RoleMasks,
    role_grants: DataFrame,
    users: DataFrame,
    closure: Stage,
    plan: str = "auto",
) -> DataFrame:
    """(object, n_users): enabled users that reach each object, exactly.

    Joining grants to users through roles repeats every user for every object. Both
    sides repeat few role sets, so equal sets are merged first, the sets are matched,
    and counts are weighted by set size. ``grants`` are ``reachable_grants`` or ``role_masks``; ``plan``
    forces ``profiles`` or ``bitmaps``.
    """
    return counts_of_sets(workspace, role_sets(workspace, grants, role_grants, users, closure), plan)


def counts_of_sets(workspace: Workspace, sets: RoleSets, plan: str = "auto") -> DataFrame:
    """``object_user_counts`` of sets that are known."""
    counted = set_counts(workspace, sets.asking, sets, plan)
    counts = workspace.stage(counted, "set-counts", at_most=sets.asking.rows)
    return lookup_join(
        workspace, sets.objects.df, counts, ["set_id"], "inner", spread="object"
    ).select("object", "n_users")


def set_counts(workspace: Workspace, asking: Stage, sets: RoleSets, plan: str = "auto") -> DataFrame:
    """(set_id, n_users) of the object sets in ``asking`` that some user reaches."""
    if plan == "auto":
        plan = cheaper_plan(sets.reach, asking, sets.people)
    if plan == "profiles":
        return _count_by_profiles(workspace, asking, sets.reach)
    return _count_by_bitmaps(workspace, asking, sets.reach, sets.people)


def cheaper_plan(reach: Stage, asking: Stage, people: Stage) -> str:
    """Compare, in bytes to shuffle, what the two exact plans would emit.

    Matching profiles emits one small row per role, object set and profile. The other plan emits, per role,
    object set and block of users, at most a bitmap, and less where a role has few profiles.
    """
    if reach.rows * asking.rows <= PAIRS_WITHOUT_COUNTING:
        return "profiles"
    holders = reach.df.groupBy("role").agg(F.count(F.lit(1)).alias("profiles"))
    askers = asking.df.groupBy("role").agg(F.count(F.lit(1)).alias("sets"))
    blocks = F.least(F.col("profiles"), F.lit(people.rows // (BITMAP_BYTES * 8) + 1))
    sets = F.col("sets").cast("double")
    sums = (
        holders.join(askers, "role")
        .agg(
            F.sum(sets * F.col("profiles")).alias("pairs"),
            F.sum(sets * blocks).alias("blocks"),
        )
        .first()
    )
    pairs, filled = sums["pairs"] or 0.0, sums["blocks"] or 0.0
    return "profiles" if pairs * PAIR_BYTES <= filled * BITMAP_BYTES else "bitmaps"


def _count_by_profiles(workspace: Workspace, asking: Stage, reach: Stage) -> DataFrame:
    """Match object sets to profiles through roles and add up the profile weights."""
    sets = Stage(asking.df.select("set_id", "role"), asking.rows)
    matched = balanced_join(workspace, sets, reach, ["role"], "inner", "set_id", "profile")
    pairs = matched.select("set_id", "profile", "weight").distinct()
    return pairs.groupBy("set_id").agg(F.sum("weight").alias("n_users"))


def _count_by_bitmaps(
    workspace: Workspace, asking: Stage, reach: Stage, people: Stage
) -> DataFrame:
    """Union the users of each object set's roles, block by block of user numbers.

    Users are numbered in profile order, so a profile fills one piece of a block: a run, or a single number
    where profiles are small. The users of a role in a block are a sorted list of pieces as long as there
    are few, and else a bitmap. Pieces of different profiles do not overlap, so equal pieces are merged and
    their lengths added; only where a set has a bitmap too are they written into one. The numbering is
    written before use because it must not change between readers.
    """
    numbered = workspace.stage(
        people.df.repartitionByRange("set_id", "user")
        .sortWithinPartitions("set_id", "user")
        .select(F.col("set_id").alias("profile"), F.monotonically_increasing_id().alias("uid")),
        "numbered-users",
    )
    start = F.min(F.bitmap_bit_position("uid"))
    # One number holds a piece: its start, and its length less one.
    piece = (start * BLOCK_USERS + F.count(F.lit(1)) - 1).cast("int")
    pieces = workspace.stage(
        numbered.df.groupBy("profile", F.bitmap_bucket_number("uid").alias("block")).agg(piece.alias("piece")),
        "profile-pieces",
    )
    holders = Stage(reach.df.select("profile", "role"), reach.rows)
    by_role = balanced_join(workspace, holders, pieces, ["profile"], "inner", "role", "block")
    # No more pieces than a block has users.
    listed = workspace.stage(
        by_role.groupBy("role", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces")), "role-blocks"
    )
    few = F.size("pieces") <= MOST_PIECES
    bitmaps = workspace.stage(_bitmaps(listed.df.filter(~few), "role", F.explode("pieces")), "role-bitmaps")

    sets = Stage(asking.df.select("set_id", "role"), asking.rows)
    sparse = Stage(listed.df.filter(few), listed.rows)
    met = balanced_join(workspace, sets, sparse, ["role"], "inner", "set_id", "block")
    merged = met.select("set_id", "block", F.explode("pieces").alias("piece")).distinct()
    length = F.pmod("piece", F.lit(BLOCK_USERS)) + 1
    if bitmaps.rows == 0:
        return merged.groupBy("set_id").agg(F.sum(length).alias("n_users"))
    merged = workspace.stage(merged, "set-pieces").df
    filled = balanced_join(workspace, sets, bitmaps, ["role"], "inner", "set_id", "block")
    filled = workspace.stage(
        filled.groupBy("set_id", "block").agg(F.bitmap_or_agg("bits").alias("bits")), "set-bitmaps"
    ).df
    key = ["set_id", "block"]
    apart = merged.join(filled.select(key), key, "left_anti").select("set_id", length.cast("bigint").alias("n"))
    inside = _bitmaps(merged.join(filled.select(key), key, "left_semi"), "set_id", F.col("piece"))
    whole = filled.unionByName(inside).groupBy(key).agg(F.bitmap_or_agg("bits").alias("bits"))
    both = apart.unionByName(whole.select("set_id", F.bitmap_count("bits").alias("n")))
    return both.groupBy("set_id").agg(F.sum("n").alias("n_users"))


def _bitmaps(rows: DataFrame, owner: str, piece: Column) -> DataFrame:
    """(owner, block, bits): pieces written into a bitmap per block."""
    single = rows.select(owner, "block", piece.alias("piece"))
    start = F.floor(F.col("piece") / BLOCK_USERS)
    users = F.explode(F.sequence(start, start + F.pmod("piece", F.lit(BLOCK_USERS))))
    positions = single.select(owner, "block", users.alias("position"))
    return positions.groupBy(owner, "block").agg(F.bitmap_construct_agg("position").alias("bits"))
