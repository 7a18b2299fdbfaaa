"""Sharding: balanced label propagation over linked documents.

Documents begin in a shard of their own id. In each round, joins count the neighbours' shards of every
document, and those who have most of their neighbours elsewhere move there as far as the shard's quota
goes: leaves in one half of a round, the others in the other half, so that neighbours don't swap. A group
that finds no room is sent to a shard that has some, with all its documents. Then shards above the mean give
up what is too much, and it fills the other shards together with the documents without links, large ones
first, so that sizes end up even.

Law ``bytes``: the shards' sums of sizes are near equal - they differ by about one of the smallest
documents, or by the largest where there are few others. A group of links larger than a part of a shard
is cut into chunks beforehand, so that a group may be larger than a shard.

Rows: every input row gets one place. Repeated rows are rows of their own, and equal texts are linked;
null text counts as empty. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.operators.skew import lookup_join
from grantlens.workspace import Stage, Workspace

# Bytes that a document takes besides its text.
OVERHEAD = 16

# A group's chunks are this part of a shard at most, by expectation.
CHUNK_PART = 0.9

# Rounds of propagation at most; it ends as soon as nothing moves.
ROUNDS = 6

# Room that linked documents may take above a shard's mean while they move, and the part of those who want
# to leave a shard that counts as room for others.
SLACK = 0.05
LEAVING = 0.5

# Groups of more than this part of a shard choose among the emptiest shards; fewer than shards / BIG_PART exist.
BIG_PART = 0.25

# Size classes, from the largest documents to the smallest; each evens out what the one before left.
CLASS_BOUNDS = (65_536, 16_384, 4_096, 1_024)

# Rows that one running sum goes over, about, and the most running sums per class or shard.
RUN_ROWS = 10_000
MOST_RUNS = 16_384

# Rows of one label that one running sum goes over, unless that makes more than MOST_RUNS pieces.
PIECE_ROWS = 250
PIECES_END = 2**20


def _runs(rows: int, parts: int) -> int:
    return int(min(MOST_RUNS, max(8, rows // (RUN_ROWS * max(1, parts)) + 1)))


def _run_of(column: str, runs: int, name: str = "run") -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(name)), F.lit(runs)).cast("int")


def _positions(df: DataFrame, part: str, order: list[str], value: Column) -> DataFrame:
    """Add ``position``: the sum of ``value`` over the rows of the same part that come before.

    The rows of a part are dealt to runs; a table of parts x runs holds what comes before each run.
    """
    sums = df.groupBy(part, "run").agg(F.sum(value).alias("run_sum"))
    before = Window.partitionBy(part).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, "run", F.coalesce(F.sum("run_sum").over(before), F.lit(0)).alias("run_start"))
    inside = Window.partitionBy(part, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # parts x runs rows, and one per piece of a large label: bounded by the constants above.
    joined = placed.join(F.broadcast(starts), [part, "run"])
    return joined.withColumn("position", F.col("run_start") + F.col("within")).drop("run_start", "within")


def _loads(nodes: DataFrame, shards: int) -> np.ndarray:
    """Bytes in each shard; one row per shard comes to the driver."""
    loads = np.zeros(shards)
    for row in nodes.groupBy("shard").agg(F.sum("size").alias("load")).collect():
        loads[row["shard"]] = float(row["load"])
    return loads


def _lookup(values: list[float], index: Column) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])[index]


def _in_pieces(workspace: Workspace, linked: DataFrame, rows: int) -> DataFrame:
    """Add ``piece`` to nodes (id, label): 0, or from 1 on for the parts of a label with many rows."""
    most = max(PIECE_ROWS, rows // MOST_RUNS)
    sizes = linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    large = workspace.stage(sizes.select("label", F.ceil(F.col("n") / most).alias("pieces")), "shard_large")
    own = F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces")) + 1
    split = lookup_join(workspace, linked, large, ["label"], "left", spread="id")
    return split.withColumn("piece", F.coalesce(own, F.lit(0))).drop("pieces")


def _label_run(runs: int) -> Column:
    """The run of a label; each piece of a large one is a run of its own that follows."""
    return _run_of("label", runs).cast("long") * PIECES_END + F.col("piece")


def _votes(linked: DataFrame, edges: DataFrame, leaves: bool, number: int) -> DataFrame:
    """id and wish of the nodes that have more neighbours in another shard than in their own."""
    seen = edges.join(linked.select(F.col("id").alias("b"), "shard"), "b")
    counts = seen.groupBy("a", "shard").agg(F.count(F.lit(1)).alias("n"))
    movers = linked.filter(F.col("aim").isNull() & (F.col("leaf") == leaves))
    if not leaves:
        # A coin lets only one of two neighbours move, so that they don't swap.
        movers = movers.filter(F.pmod(F.xxhash64("id", F.lit(number)), F.lit(2)) == 0)
    votes = counts.join(movers.select(F.col("id").alias("a"), F.col("shard").alias("now")), "a").groupBy("a").agg(
        F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("most"),
        F.sum(F.when(F.col("shard") == F.col("now"), F.col("n")).otherwise(0)).alias("stay"),
    )
    return votes.filter(F.col("most.n") > F.col("stay")).select(
        F.col("a").alias("id"), (-F.col("most.minus")).alias("wish")
    )


def _aims(workspace: Workspace, moved: DataFrame, room: np.ndarray, mean: float) -> Stage:
    """label and aim, a shard with room, of the labels some of whose nodes were denied their wish."""
    groups = moved.groupBy("label").agg(F.sum("size").alias("bytes"), F.max("denied").alias("denied"))
    groups = workspace.stage(groups.filter("denied").select("label", "bytes"), "shard_denied").df
    big = F.col("bytes") > mean * BIG_PART
    left, chosen = np.maximum(0.0, room), []
    # Their bytes add up to the nodes' at most, so there are fewer than shards / BIG_PART.
    for row in groups.filter(big).orderBy(F.desc("bytes"), "label").collect():
        best = int(np.argmax(left))
        left[best] -= float(row["bytes"])
        chosen.append((row["label"], best))
    left = np.maximum(1.0, left)
    ends = list(accumulate(left / left.sum()))
    place = F.pmod(F.xxhash64("label", F.lit("aim")), F.lit(1 << 30)) / float(1 << 30)
    passed = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends[:-1]]), lambda end: end <= place))
    small = groups.filter(~big).select("label", passed.cast("int").alias("aim"))
    own = workspace.spark.createDataFrame(chosen, "label long, aim int")
    return workspace.stage(small.unionByName(own), "shard_aims")


def _propagate(
    workspace: Workspace, linked: DataFrame, edges: DataFrame, shards: int, mean: float, rounds: int
) -> DataFrame:
    """Move linked nodes (id, size, label, piece, run, leaf, shard) to their neighbours' shards under the quota."""
    linked, idle = linked.withColumn("aim", F.lit(None).cast("int")), 0
    for number in range(2 * rounds):
        aimed = linked.filter("aim <> shard").select("id", F.col("aim").alias("wish"))
        wished = _votes(linked, edges, number % 2 == 0, number).unionByName(aimed)
        wishes = linked.drop("aim").withColumnRenamed("shard", "now").join(wished, "id")
        wishes = workspace.stage(
            wishes.select("id", "size", "label", "run", "now", F.col("wish").alias("shard")), "shard_wishes"
        )
        idle = 0 if wishes.rows else idle + 1
        if idle == 2:
            break
        if idle:
            continue
        leaving = _loads(wishes.df.select(F.col("now").alias("shard"), "size"), shards)
        quota = mean * (1 + SLACK)
        room = np.maximum(0, quota - _loads(linked, shards) + LEAVING * leaving)
        fits = F.col("position") + F.col("size") <= _lookup(list(room), F.col("shard"))
        outcome = _positions(wishes.df, "shard", ["label", "id"], F.col("size")).select(
            "id", F.col("shard").alias("to"), fits.alias("fits")
        )
        moved = linked.drop("aim").join(outcome, "id", "left").select(
            *[c for c in linked.columns if c not in ("aim", "shard")],
            F.when(F.col("fits"), F.col("to")).otherwise(F.col("shard")).alias("shard"),
            F.coalesce(~F.col("fits"), F.lit(False)).alias("denied"),
        )
        moved = workspace.stage(moved, "shard_moved").df
        aims = _aims(workspace, moved, quota - _loads(moved, shards), mean)
        # Large labels are aims of many rows; few aims are broadcast, of many the large ones are split.
        linked = lookup_join(workspace, moved.drop("denied"), aims, ["label"], "left", spread="id")
        linked = workspace.stage(linked, "shard_linked").df
    return linked.drop("aim")


def _fill(loads: np.ndarray, amount: float) -> list[float]:
    """Ends of the shards' intervals when ``amount`` raises the lowest loads to one level."""
    order = np.sort(loads)
    level = order[0]
    for n in range(1, len(order) + 1):
        level = (order[:n].sum() + amount) / n
        if n == len(order) or level <= order[n]:
            break
    return list(accumulate(np.maximum(0.0, level - loads)))


def place(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """A shard for every node (id, size); links (a, b) are ids of nodes that belong together.

    Nodes may have a column ``start``: the shard they begin in, or null. Returns id, size and shard.
    """
    workspace = Workspace(nodes.sparkSession)
    both = links.filter("a <> b").select("a", "b")
    edges = workspace.stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shard_edges").df
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    mean = total["size"] / shards
    runs = _runs(total["n"], shards)
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    wish = F.col("start") if "start" in nodes.columns else F.lit(None)
    labelled = nodes.join(lowest, nodes["id"] == lowest["a"], "left").select(
        "id",
        "size",
        wish.cast("int").alias("start"),
        F.col("low").isNotNull().alias("linked"),
        F.least("id", F.coalesce("low", "id")).alias("label"),
        F.coalesce((F.col("low") == F.col("high")) & (F.col("low") < F.col("id")), F.lit(False)).alias("leaf"),
    )
    by_label = F.pmod(F.xxhash64("label", F.lit("shard")), F.lit(shards)).cast("int")
    labelled = labelled.withColumn("shard", F.coalesce("start", by_label))
    labelled = workspace.stage(labelled, "shard_start").df
    linked = _in_pieces(workspace, labelled.filter("linked").select("id", "size", "label", "leaf", "shard"), total["n"])
    linked = workspace.stage(linked.withColumn("run", _label_run(runs)), "shard_linked").df
    linked = _propagate(workspace, linked, edges, shards, mean, rounds)

    # What linked nodes take above the mean is given up, whole labels as far as possible.
    ordered = _positions(linked, "shard", ["label", "id"], F.col("size"))
    kept = workspace.stage(
        ordered.select("id", "size", "label", "piece", "shard", (F.col("position") + F.col("size") <= mean).alias("stays")),
        "shard_kept",
    ).df
    free = kept.filter("NOT stays").select("id", "size", "label", "piece")
    single = labelled.filter("NOT linked").select("id", "size", "label", F.lit(0).cast("long").alias("piece"))
    free = free.unionByName(single)
    kind = F.lit(len(CLASS_BOUNDS))
    for k in reversed(range(len(CLASS_BOUNDS))):
        kind = F.when(F.col("size") >= CLASS_BOUNDS[k], k).otherwise(kind)
    free = free.withColumn("kind", kind).withColumn("run", _label_run(_runs(total["n"], 1)))
    free = workspace.stage(
        _positions(free, "kind", ["label", "id"], F.col("size")).select(
            "id", "size", "kind", "position"
        ),
        "shard_free",
        partition_by="kind",
    ).df
    amounts = {r["kind"]: r["size"] for r in free.groupBy("kind").agg(F.sum("size").alias("size")).collect()}

    settled = kept.filter("stays").select("id", "size", "shard")
    loads = _loads(settled, shards)
    placed = [settled]
    for k in range(len(CLASS_BOUNDS) + 1):
        if not amounts.get(k):
            continue
        ends = _fill(loads, float(amounts[k]))
        # The shard whose interval holds the middle of the document.
        middle = F.col("position") + F.col("size") / 2
        passed = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]), lambda end: end <= middle))
        own = free.filter(F.col("kind") == k).select("id", "size", passed.cast("int").alias("shard"))
        loads = loads + _loads(own, shards)
        placed.append(own)
    result = placed[0]
    for own in placed[1:]:
        result = result.unionByName(own)
    return workspace.stage(result, "shard_placed").df


def shard_documents(docs: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Place every document; equal texts are linked, and every document begins in a shard of its own id.

    Returns doc_id, size, text_crc32, law, shard, slot (from 0 without gaps in each shard) and
    grown_shard, which this law does not have.
    """
    workspace = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Written before use: the row number must not change if a task runs again.
    rows = workspace.stage(
        docs.select(
            F.monotonically_increasing_id().alias("id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("key"),
        ),
        "shard_rows",
    )
    total = rows.df.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    part = max(1.0, total / shards * CHUNK_PART)
    groups = rows.df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    groups = workspace.stage(groups.select("key", F.ceil(F.col("bytes") / part).alias("chunks")), "shard_groups")
    # Few groups are broadcast; of many, those that hold a large part of the rows are split.
    members = lookup_join(workspace, rows.df.select("id", "key"), groups, ["key"], "inner", spread="id")
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks"))
    members = workspace.stage(members.select("id", "key", chunk.alias("chunk")), "shard_members").df
    hubs = members.groupBy("key", "chunk").agg(F.min("id").alias("hub"))
    hubs = workspace.stage(hubs, "shard_hubs")
    links = lookup_join(workspace, members, hubs, ["key", "chunk"], "inner", spread="id")
    links = links.select(F.col("id").alias("a"), F.col("hub").alias("b"))
    start = F.pmod(F.xxhash64("id", F.lit("start")), F.lit(shards)).alias("start")
    placed = place(rows.df.select("id", "size", start), links, shards, rounds).select("id", "shard")

    runs = _runs(rows.rows, shards)
    # Documents fill shards in the order of their runs, so slots are counted in runs of another hash.
    whole = rows.df.drop("key").join(placed, "id").withColumn("run", _run_of("id", runs, "slot"))
    slots = _positions(whole, "shard", ["id"], F.lit(1))
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
