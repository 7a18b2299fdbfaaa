"""The objects that the most or the fewest users reach, counting users only where bounds leave it open.

The users of an object are the union of those of its roles. The two largest roles give a lower bound, and
with the sizes of the others an upper one; so most objects are ruled out, or known exactly, before the
union of all their roles is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.operators.access import RoleSets, set_counts
from grantlens.operators.skew import BROADCAST_ROWS, lookup_join
from grantlens.workspace import Stage, Workspace

# Sets counted in the first round; each round counts four times as many, as long as some are open.
FIRST_SETS = 32


@dataclass(frozen=True)
class Ranking:
    """``rows``: (object, n_users), first to last. ``n_sets_counted``: role sets whose users were counted."""

    rows: DataFrame
    n_sets_counted: int


def set_bounds(workspace: Workspace, sets: RoleSets) -> Stage:
    """(set_id, lower, upper): bounds on the users of each object set.

    At least the users of its two largest roles, at most those and all that its other roles have. Many sets
    share their two largest roles, so there are few such unions to count.
    """
    sizes = sets.reach.df.groupBy("role").agg(F.sum("weight").alias("n"))
    sized = lookup_join(
        workspace, sets.asking.df, Stage(sizes, sets.reach.rows), ["role"], "left", spread="set_id"
    ).select("set_id", "role", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    by_size = Window.partitionBy("set_id").orderBy(F.desc("n"), "role")
    ranked = sized.withColumn("place", F.row_number().over(by_size))
    large = F.col("place") <= 2
    largest = workspace.stage(
        ranked.groupBy("set_id").agg(
            F.min(F.when(large, F.col("role"))).alias("a"),
            F.max(F.when(large, F.col("role"))).alias("b"),
            F.max("n").alias("n_largest"),
            F.sum(F.when(~large, F.col("n")).otherwise(0)).alias("n_others"),
        ),
        "largest-roles",
    )
    pair = F.to_json(F.array("a", "b"))
    pairs = largest.df.filter("a <> b").select(pair.alias("set_id"), "a", "b").distinct()
    asking = workspace.stage(
        pairs.select("set_id", F.explode(F.array("a", "b")).alias("role")), "role-pairs", at_most=2 * largest.rows
    )
    unions = workspace.stage(
        set_counts(workspace, asking, sets).select(F.col("set_id").alias("pair"), F.col("n_users").alias("n_pair")),
        "pair-counts",
        at_most=asking.rows,
    )
    paired = lookup_join(
        workspace, largest.df.withColumn("pair", pair), unions, ["pair"], "left", spread="set_id"
    )
    lower = F.coalesce("n_pair", "n_largest")
    most = F.lit(sets.people.rows).cast("bigint")
    upper = F.least(lower + F.col("n_others"), most)
    return workspace.stage(paired.select("set_id", lower.alias("lower"), upper.alias("upper")), "set-bounds")


def counted(workspace: Workspace, sets: RoleSets, chosen: DataFrame, n_chosen: int) -> DataFrame:
    """(set_id, n_users): exact counts of the chosen sets (set_id); none reached by nobody is left out."""
    asking = workspace.stage(
        lookup_join(workspace, sets.asking.df, Stage(chosen, n_chosen), ["set_id"], "left_semi", spread="role"),
        "chosen-sets",
    )
    found = set_counts(workspace, asking, sets)
    return chosen.join(found, "set_id", "left").select(
        "set_id", F.coalesce("n_users", F.lit(0).cast("bigint")).alias("n_users")
    )


def ranked_objects(
    workspace: Workspace,
    sets: RoleSets,
    bounds: Stage,
    objects: DataFrame,
    n: int,
    most: bool,
    first_sets: int = FIRST_SETS,
) -> Ranking:
    """The first ``n`` of ``objects`` (object, distinct) by number of users, ties by name.

    ``bounds`` are ``set_bounds``.     Objects of one set have the same users, so only the first ``n`` names of each set take part. A round
    takes the ``n`` objects that are best even if their bounds turn out worst; sets that could still come
    before the last of them are counted, the most promising first, until none is left.
    """
    members = sets.objects.df.withColumnRenamed("set_id", "_set")
    placed = objects.join(members, "object", "left").select("object", F.col("_set").alias("set_id"))
    by_name = Window.partitionBy("set_id").orderBy("object")
    named = placed.withColumn("place", F.row_number().over(by_name)).filter(F.col("place") <= n).drop("place")
    zero = F.lit(0).cast("bigint")
    # Objects that nobody was granted are in no set, and have no users for certain.
    bounded = lookup_join(workspace, named, bounds, ["set_id"], "left", spread="object")
    heads = workspace.stage(
        bounded.select(
            "object", "set_id", F.coalesce("lower", zero).alias("lower"), F.coalesce("upper", zero).alias("upper")
        ),
        "ranked-heads",
    )
    sure, hoped = ("lower", "upper") if most else ("upper", "lower")

    def order(name: str) -> list[Column]:
        return [F.desc(name) if most else F.asc(name), F.asc("object")]

    n_counted, batch = 0, first_sets
    while True:
        safe = heads.df.orderBy(*order(sure)).limit(n).select("object", sure).collect()
        is_open = F.col("lower") < F.col("upper")
        if len(safe) == n:
            last = safe[-1]
            better = F.col(hoped) > last[1] if most else F.col(hoped) < last[1]
            is_open &= better | ((F.col(hoped) == last[1]) & (F.col("object") <= last[0]))
        best = F.max(hoped) if most else F.min(hoped)
        open_sets = heads.df.filter(is_open).groupBy("set_id").agg(best.alias(hoped), F.min("object").alias("object"))
        chosen = workspace.stage(open_sets.orderBy(*order(hoped)).limit(batch).select("set_id"), "counted-sets")
        if chosen.rows == 0:
            break
        exact = counted(workspace, sets, chosen.df, chosen.rows)
        # No more rows than were chosen, and those are few unless many rounds leave many sets open.
        exact = F.broadcast(exact) if chosen.rows <= BROADCAST_ROWS else exact
        known = heads.df.join(exact, "set_id", "left")
        heads = workspace.stage(
            known.select("object", "set_id", *[F.coalesce("n_users", b).alias(b) for b in ("lower", "upper")]),
            "ranked-heads",
        )
        n_counted += chosen.rows
        batch *= 4
    ranked = heads.df.orderBy(*order("lower")).limit(n)
    return Ranking(ranked.select("object", F.col("lower").alias("n_users")), n_counted)
