"""Strongly connected components of a directed graph, by joins.

Nodes that nothing leads to, or that lead nowhere, are on no cycle and go first. Chains of nodes with one
edge in and one out are cut short to an edge, in rounds that double; one that closes on itself is a component.
What is left branches everywhere: there the smallest name that reaches a node is its label, and the nodes of a
label from which that name can be reached again are a component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlens.operators.skew import lookup_join
from grantlens.workspace import Stage, Workspace


def strong_components(workspace: Workspace, edges: DataFrame) -> Stage:
    """(node, component) of the nodes on cycles of two nodes or more; a component is named by its smallest node.

    ``edges`` is (src, dst). All tables on the way are no larger than the edges.
    """
    live = workspace.stage(edges.filter("src <> dst").select("src", "dst").distinct(), "component-edges")
    nothing = live.df.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found, chains = [nothing], []
    while live.rows > 0:
        before = live.rows
        live = _trim(workspace, live)
        live, rings, ways = _shorten(workspace, live)
        found += rings
        chains += ways
        if live.rows == before:
            live, members = _colour(workspace, live)
            found.append(members)
    known = workspace.stage(_union(found), "component-members")
    for chain in reversed(chains):
        known = _put_back(workspace, known, chain)
    # The ends of a chain that closed on one node are named only by its other nodes.
    named = known.df.unionByName(known.df.select(F.col("component").alias("node"), "component")).distinct()
    smallest = known.df.groupBy("component").agg(F.least(F.min("node"), F.min("component")).alias("smallest"))
    renamed = lookup_join(workspace, named, Stage(smallest, known.rows), ["component"], "inner", spread="node")
    return workspace.stage(renamed.select("node", F.col("smallest").alias("component")), "components")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _trim(workspace: Workspace, live: Stage) -> Stage:
    """Edges that something leads to and that lead on."""
    sources = Stage(live.df.select(F.col("src").alias("dst")).distinct(), live.rows)
    targets = Stage(live.df.select(F.col("dst").alias("src")).distinct(), live.rows)
    going_on = lookup_join(workspace, live.df, sources, ["dst"], "left_semi", spread="src")
    kept = lookup_join(workspace, going_on, targets, ["src"], "left_semi", spread="dst")
    return workspace.stage(kept.select("src", "dst"), "component-edges")


def _shorten(workspace: Workspace, live: Stage) -> tuple[Stage, list[DataFrame], list[DataFrame]]:
    """Edges in place of chains, the components of chains without ends, and (node, above, below) of the others."""
    outs = live.df.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("onto"))
    ins = live.df.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("above"))
    unary = outs.filter("n_out = 1").join(ins.filter("n_in = 1"), "node").select("node", "above", "onto")
    inner = unary.select(F.col("onto").alias("node"), F.lit(True).alias("inner"))
    start = workspace.stage(
        unary.join(inner, "node", "left").withColumns({"last": F.col("node"), "least": F.col("node")}), "chains"
    )
    if start.rows == 0:
        return live, [], []
    ended, endless = _follow(workspace, start)
    rings = endless.select("node", F.col("least").alias("component"))
    tops = ended.filter("inner IS NULL").select("last", F.col("above").alias("top"), "onto")
    firsts = Stage(tops.select("last", F.col("top").alias("above")), start.rows)
    ways = lookup_join(
        workspace, ended.select("node", "last", F.col("onto").alias("below")), firsts, ["last"], "inner", spread="node"
    )
    ways = workspace.stage(ways.select("node", "above", "below"), "chains").df
    gone = Stage(start.df.select(F.col("node").alias("src")), start.rows)
    rest = lookup_join(workspace, live.df, gone, ["src"], "left_anti", spread="dst")
    gone = Stage(start.df.select(F.col("node").alias("dst")), start.rows)
    rest = lookup_join(workspace, rest, gone, ["dst"], "left_anti", spread="src")
    short = tops.filter("top <> onto").select(F.col("top").alias("src"), F.col("onto").alias("dst"))
    kept = rest.select("src", "dst").unionByName(short).distinct()
    return workspace.stage(kept, "component-edges"), [rings], [ways]


def _follow(workspace: Workspace, start: Stage) -> tuple[DataFrame, DataFrame]:
    """Chain nodes with ``onto`` past the chain's end and ``last`` its last node; and the nodes of endless chains.

    Each round doubles the way, so what has not ended after as many rounds as the number of nodes has bits runs in
    a ring, whose smallest node it has then seen.
    """
    names = ["node", "above", "inner", "onto", "last", "least"]
    ended: list[DataFrame] = []
    going = start.df.select(names)
    for _ in range(start.rows.bit_length() + 1):
        if going.isEmpty():
            break
        onward = _union([*ended, going]).select(
            F.col("node").alias("onto"), F.col("onto").alias("next"), F.col("last").alias("next_last"), F.col("least").alias("next_least")
        )
        stepped = workspace.stage(
            going.join(onward, "onto", "left").select(
                "node",
                "above",
                "inner",
                F.coalesce("next", "onto").alias("onto"),
                F.coalesce("next_last", "last").alias("last"),
                F.least("least", "next_least").alias("least"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "chains",
        ).df
        ended.append(stepped.filter("NOT moved").drop("moved"))
        going = stepped.filter("moved").drop("moved")
    return _union([*ended, going.limit(0)]), going


def _put_back(workspace: Workspace, known: Stage, chain: DataFrame) -> Stage:
    """A chain's nodes are on a cycle if its two ends are in one component."""

    def looked_up(rows: DataFrame, end: str) -> DataFrame:
        names = Stage(known.df.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), known.rows)
        found = lookup_join(workspace, rows, names, [end], "left", spread="node")
        return found.withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))

    placed = looked_up(looked_up(chain, "above"), "below").filter("above_in = below_in")
    members = placed.select("node", F.col("above_in").alias("component"))
    return workspace.stage(known.df.unionByName(members), "component-members")


def _colour(workspace: Workspace, live: Stage) -> tuple[Stage, DataFrame]:
    """Take the components out that hold the smallest name that reaches them; also return their members.

    Rounds grow with the longest of the shortest ways between nodes, which is little where no chains are left.
    """
    nodes = live.df.select(F.col("src").alias("node")).unionByName(live.df.select(F.col("dst").alias("node"))).distinct()
    labels = workspace.stage(nodes.withColumn("label", F.col("node")), "labels")
    fresh = labels
    while fresh.rows > 0:
        told = lookup_join(
            workspace,
            live.df,
            Stage(fresh.df.select(F.col("node").alias("src"), "label"), fresh.rows),
            ["src"],
            "inner",
            spread="dst",
        )
        least = told.groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("told"))
        lower = labels.df.join(least, "node", "left")
        labels = workspace.stage(
            lower.select(
                "node", F.least("label", "told").alias("label"), F.coalesce(F.col("told") < F.col("label"), F.lit(False)).alias("changed")
            ),
            "labels",
        )
        changed = labels.df.filter("changed")
        fresh = Stage(changed, changed.count())
        labels = Stage(labels.df.drop("changed"), labels.rows)
    within = live.df
    for end in ("src", "dst"):
        named = Stage(labels.df.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), labels.rows)
        within = lookup_join(workspace, within, named, [end], "inner", spread="dst" if end == "src" else "src")
    within = workspace.stage(within.filter("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")), "coloured-edges")
    members = workspace.stage(labels.df.filter("node = label"), "coloured-members")
    fresh = members
    while fresh.rows > 0:
        back = lookup_join(
            workspace, within.df, Stage(fresh.df.select(F.col("node").alias("dst")), fresh.rows), ["dst"], "left_semi", spread="src"
        )
        found = back.select(F.col("src").alias("node"), "label").distinct()
        fresh = workspace.stage(found.join(members.df, ["node", "label"], "left_anti"), "coloured-members")
        members = Stage(members.df.unionByName(fresh.df), members.rows + fresh.rows)
    rest = live.df
    for end in ("src", "dst"):
        gone = Stage(members.df.select(F.col("node").alias(end)), members.rows)
        rest = lookup_join(workspace, rest, gone, [end], "left_anti", spread="dst" if end == "src" else "src")
    several = members.df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label")
    cyclic = members.df.join(several, "label", "left_semi").select("node", F.col("label").alias("component"))
    return workspace.stage(rest.select("src", "dst"), "component-edges"), cyclic
