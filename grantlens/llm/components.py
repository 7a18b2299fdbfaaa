"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.workspace import Workspace

# Each round at least halves the links that are no stars yet, so this many reach any size.
MOST_ROUNDS = 60


def components(workspace: Workspace, links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links (a, b).

    Large-star and small-star rounds: a node points its higher neighbours, then its lower ones, to the
    lowest of them. The number of links never grows, and the loop ends when only stars are left.
    """
    stars = links.filter("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("low")).distinct()
    stars = workspace.stage(stars, "component_links")
    for _ in range(MOST_ROUNDS):
        if _all_stars(stars.df):
            break
        both = stars.df.unionByName(stars.df.select(F.col("low").alias("id"), F.col("id").alias("low")))
        lowest = both.groupBy("id").agg(F.min("low").alias("least"))
        lowest = lowest.select("id", F.least("id", "least").alias("least"))
        higher = both.filter("low > id").join(lowest, "id").select(F.col("low").alias("id"), F.col("least").alias("low"))
        large = higher.filter("id <> low").distinct()
        smallest = large.groupBy("id").agg(F.min("low").alias("least"))
        joined = large.join(smallest, "id")
        chained = joined.filter("low <> least").select(F.col("low").alias("id"), F.col("least").alias("low"))
        kept = smallest.select("id", F.col("least").alias("low"))
        stars = workspace.stage(kept.unionByName(chained).distinct(), "component_links")
    else:
        raise RuntimeError("components did not settle")
    roots = stars.df.select(F.col("low").alias("id")).distinct()
    members = stars.df.select("id", F.col("low").alias("component"))
    return members.unionByName(roots.select("id", F.col("id").alias("component")))


def _all_stars(stars: DataFrame) -> bool:
    """Whether every node has one lower neighbour, which itself has none."""
    several = stars.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chained = stars.join(stars.select(F.col("id").alias("low")), "low", "left_semi")
    return several.isEmpty() and chained.isEmpty()
