"""Sums over all subtrees of a forest, by parallel tree contraction.

A round rakes the leaves, adding them to their parents, and then compresses chains of nodes with one child
onto the node below them. What stays inside the tree then branches, so that each round more than halves it
however deep or wide it is. Afterwards the chains are expanded again, the last round first: a node of a chain
has its part of the chain and all of the subtree at its end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.operators.skew import lookup_join
from grantlens.workspace import Stage, Workspace


def subtree_sums(workspace: Workspace, nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): each value summed over a node and all below it.

    ``nodes`` is (id, parent, *values) with each id once; roots have no parent. Any type that can be
    compared serves as id. Values are whole numbers, not null. Without nodes there are no rows.
    """
    edges = [_nothing().alias(_edge(v)) for v in values]
    live = workspace.stage(nodes.select("id", "parent", *values, *edges), "tree")
    known = [live.df.select("id", *values).limit(0)]
    n_known, chains = 0, []
    while live.rows > 0:
        before = live.rows
        live, leaves = _rake(workspace, live, values)
        known.append(leaves)
        n_known += before - live.rows
        before = live.rows
        live, ways = _compress(workspace, live, values)
        if ways is not None:
            chains.append(Stage(ways, before - live.rows))
    for chain in reversed(chains):
        ends = _union(known).select(F.col("id").alias("onto"), *[F.col(v).alias(_end(v)) for v in values])
        # All nodes of a chain, which may be a long one, look up the same end.
        met = lookup_join(workspace, chain.df, Stage(ends, n_known), ["onto"], "inner", spread="id")
        grown = workspace.stage(
            met.select("id", *[(F.col(v) + F.col(_end(v))).alias(v) for v in values]), "subtrees"
        )
        known.append(grown.df)
        n_known += grown.rows
    return _union(known)


def _edge(value: str) -> str:
    """What was spliced out between a node and its parent."""
    return f"edge_{value}"


def _end(value: str) -> str:
    return f"end_{value}"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _nothing() -> Column:
    return F.lit(0).cast("bigint")


def _or_nothing(name: str) -> Column:
    return F.coalesce(name, _nothing())


def _with_children(workspace: Workspace, live: Stage, values: list[str]) -> DataFrame:
    """The live nodes with the number of their children and, for those with one, that child."""
    child = F.min(F.struct("id", *map(_edge, values))).alias("child")
    kids = live.df.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id"))
    marked = live.df.join(kids.agg(F.count(F.lit(1)).alias("n_kids"), child), "id", "left")
    return workspace.stage(marked.withColumn("n_kids", _or_nothing("n_kids")), "tree-children").df


def _rake(workspace: Workspace, live: Stage, values: list[str]) -> tuple[Stage, DataFrame]:
    """Take the leaves off: their sums are final, and go to their parents with what their edges carry."""
    marked = _with_children(workspace, live, values)
    leaves = marked.filter("n_kids = 0")
    given = (
        leaves.filter("parent IS NOT NULL")
        .groupBy(F.col("parent").alias("id"))
        .agg(*[F.sum(F.col(v) + F.col(_edge(v))).alias(_end(v)) for v in values])
    )
    rest = marked.filter("n_kids > 0").join(given, "id", "left")
    sums = [(F.col(v) + _or_nothing(_end(v))).alias(v) for v in values]
    kept = workspace.stage(rest.select("id", "parent", *sums, *map(_edge, values)), "tree")
    return kept, leaves.select("id", *values)


def _compress(
    workspace: Workspace, live: Stage, values: list[str]
) -> tuple[Stage, DataFrame | None]:
    """Splice chains of nodes with one child out of the tree.

    Also returns, for each of their nodes, (id, onto, *values): the node below the chain, and the values from
    the node down to it. Roots stay, as they have no edge to carry a chain's values.
    """
    if live.rows <= 1:
        return live, None
    marked = _with_children(workspace, live, values)
    single = (F.col("n_kids") == 1) & F.col("parent").isNotNull()
    chain = marked.filter(single).select(
        "id",
        "parent",
        F.col("child.id").alias("onto"),
        *[(F.col(v) + F.col(f"child.{_edge(v)}")).alias(v) for v in values],
        *map(_edge, values),
    )
    # The child of a chain node that is a chain node too is not the top of its chain.
    inner = chain.select(F.col("onto").alias("id"), F.lit(True).alias("inner"))
    ways = workspace.stage(chain.join(inner, "id", "left"), "chains")
    if ways.rows == 0:
        return live, None
    ended = _to_the_end(workspace, ways.df, values)
    tops = ended.filter("inner IS NULL").select(
        F.col("onto").alias("id"),
        F.col("parent").alias("above"),
        *[(F.col(v) + F.col(_edge(v))).alias(_end(v)) for v in values],
    )
    spliced = marked.filter(~single).join(tops, "id", "left")
    edges = [F.coalesce(_end(v), _edge(v)).alias(_edge(v)) for v in values]
    parent = F.coalesce("above", "parent").alias("parent")
    kept = workspace.stage(spliced.select("id", parent, *values, *edges), "tree")
    return kept, ended.select("id", "onto", *values)


def _to_the_end(workspace: Workspace, ways: DataFrame, values: list[str]) -> DataFrame:
    """Follow ``onto`` until it leaves the chain, adding up values; each round doubles every way."""
    ended: list[DataFrame] = []
    going = ways
    while not going.isEmpty():
        onward = _union([*ended, going]).select(
            F.col("id").alias("onto"),
            F.col("onto").alias("next"),
            *[F.col(v).alias(_end(v)) for v in values],
        )
        stepped = workspace.stage(
            going.join(onward, "onto", "left").select(
                "id",
                "parent",
                "inner",
                F.coalesce("next", "onto").alias("onto"),
                *[(F.col(v) + _or_nothing(_end(v))).alias(v) for v in values],
                *map(_edge, values),
                F.col("next").isNotNull().alias("moved"),
            ),
            "chains",
        ).df
        ended.append(stepped.filter("NOT moved").drop("moved"))
        going = stepped.filter("moved").drop("moved")
    return _union(ended)
