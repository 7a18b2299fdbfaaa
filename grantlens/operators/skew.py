"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from grantlens.workspace import Stage, Workspace

# A side is broadcast only when it was counted at no more rows than this.
BROADCAST_ROWS = 100_000

# Work (left rows times right rows) of one key that a single task may take on.
HOT_PAIRS = 100_000_000

# Rows of a hot key, per side, that go to one task.
SLICE_ROWS = 20_000

# Where both sides repeat keys, the rows of a hot key and side that go to one cell, and the pairs of a task. The
# inputs of such a join are small beside what it makes, so its tasks are counted by pairs, not by bytes.
CELL_ROWS = 2_000
TASK_PAIRS = CELL_ROWS * CELL_ROWS
MOST_TASKS = 20_000

# A key that makes so many rows is a product of its own, and so many keys at most are.
CROSSED_PAIRS = 5 * TASK_PAIRS
CROSSED_KEYS = 64

# Slices of the left rows without a key, which match nothing but may have to be kept.
NULL_SLICES = 4096


def lookup_join(
    workspace: Workspace,
    left: DataFrame,
    right: Stage,
    on: list[str],
    how: str,
    spread: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_pairs: int = HOT_PAIRS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Join against a table that has each key once (inner, left, left_semi, left_anti).

    A small table is broadcast, so the large side does not move at all. Otherwise
    keys that fill a task on their own are split by ``spread``.
    """
    if right.rows <= broadcast_rows:
        return left.join(F.broadcast(right.df), on, how)
    stored = workspace.stage(left, "lookup-left")
    return balanced_join(
        workspace, stored, right, on, how, spread, hot_pairs=hot_pairs, slice_rows=slice_rows
    )


def balanced_join(
    workspace: Workspace,
    left: Stage,
    right: Stage,
    on: list[str],
    how: str,
    spread_left: str,
    spread_right: str | None = None,
    hot_pairs: int = HOT_PAIRS,
    slice_rows: int = SLICE_ROWS,
    *,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi-join with the hot keys, and only those, cut into a grid of slices.

    A row of a hot key takes one slice of its own side and is repeated for the
    slices of the other. ``spread_left`` and ``spread_right`` name the columns that
    place rows; without ``spread_right`` the right side must have unique keys, and
    any join type that keeps left rows is allowed. ``sizes`` are ``_key_sizes``, if they are known.
    """
    if spread_right:
        hot_pairs, slice_rows = min(hot_pairs, TASK_PAIRS), min(slice_rows, CELL_ROWS)
    if left.rows * max(right.rows if spread_right else 1, 1) < hot_pairs:
        return left.df.join(right.df, on, how)
    if sizes is None:
        sizes = _key_sizes(workspace, left, right, on)
    hot = _hot_keys(workspace, left, right, on, hot_pairs, slice_rows, sizes)
    tasks = 0
    if spread_right:
        pairs = sizes.agg(F.sum("pairs")).first()[0] or 0
        tasks = min(int(pairs // TASK_PAIRS) + 1, MOST_TASKS)
    if hot.rows == 0:
        return _in_tasks(left.df, right.df, on, how, tasks)

    # Many hot keys are joined by a shuffle; each key has one mark, so nothing is repeated.
    marks = F.broadcast(hot.df) if hot.rows <= BROADCAST_ROWS else hot.df
    n_left = F.coalesce("left_slices", F.lit(1))
    n_right = F.coalesce("right_slices", F.lit(1)) if spread_right else F.lit(1)
    keyless = reduce(or_, [F.col(name).isNull() for name in on])
    lefts = left.df.join(marks, on, "left").select(
        *left.df.columns,
        _own_slice(spread_left, F.when(keyless, NULL_SLICES).otherwise(n_left)).alias(
            "_left_slice"
        ),
        _every_slice(n_right).alias("_right_slice"),
    )
    rights = right.df.join(marks, on, "left").withColumn(
        "_right_slice", _own_slice(spread_right, n_right) if spread_right else F.lit(0)
    )
    rights = rights.select(
        *right.df.columns, "_right_slice", _every_slice(n_left).alias("_left_slice")
    )
    joined = _in_tasks(lefts, rights, [*on, "_left_slice", "_right_slice"], how, tasks)
    return joined.drop("_left_slice", "_right_slice")


def crossed_join(
    workspace: Workspace, left: Stage, right: Stage, on: list[str], spread_left: str, spread_right: str
) -> DataFrame:
    """The inner ``balanced_join`` of sides that both repeat keys, for rows that are read as they come.

    A join writes each row field by field and copies it. A product puts the bytes of two rows one behind the
    other, so the keys that make most rows are products, each of a partition of its own side with all of the
    other's, and evenly cut. The rest is joined. Where rows are only counted or aggregated, a join is cheaper.
    """
    if left.rows * right.rows < CROSSED_PAIRS:
        return balanced_join(workspace, left, right, on, "inner", spread_left, spread_right)
    sizes = _key_sizes(workspace, left, right, on).filter(reduce(and_, [F.col(name).isNotNull() for name in on]))
    most = sizes.filter(F.col("pairs") >= CROSSED_PAIRS).orderBy(F.desc("pairs")).limit(CROSSED_KEYS)
    crossed = workspace.stage(most.withColumn("_key", F.monotonically_increasing_id()), "crossed-keys")
    if crossed.rows == 0:
        return balanced_join(workspace, left, right, on, "inner", spread_left, spread_right, sizes=sizes)

    marks = F.broadcast(crossed.df.select(*on, "_key"))

    def dealt(side: Stage, name: str) -> DataFrame:
        marked = side.df.join(marks, on, "left").select(*side.df.columns, F.coalesce("_key", F.lit(-1)).alias("_key"))
        return workspace.stage(marked, name, partition_by="_key").df

    lefts, rights = dealt(left, "crossed-left"), dealt(right, "crossed-right")
    columns = [*on, *[c for df in (left.df, right.df) for c in df.columns if c not in on]]
    keys = crossed.df.drop(*on).collect()
    task_pairs = max(TASK_PAIRS, sum(key["pairs"] for key in keys) / MOST_TASKS)

    def product(key: Row) -> DataFrame:
        of_key = F.col("_key") == key["_key"]
        n_right = ceil(key["right_rows"] / CELL_ROWS)
        n_left = min(ceil(key["pairs"] / n_right / task_pairs), key["left_rows"])
        lasting = lefts.filter(of_key).drop("_key").repartition(n_left)
        repeated = rights.filter(of_key).drop("_key", *on).repartition(n_right)
        return lasting.crossJoin(repeated.hint("shuffle_replicate_nl")).select(columns)

    parts = [product(key) for key in keys]
    others = sizes.join(marks, on, "left_anti")
    if not others.isEmpty():
        rest = [Stage(df.filter("_key = -1").drop("_key"), side.rows) for df, side in ((lefts, left), (rights, right))]
        joined = balanced_join(workspace, *rest, on, "inner", spread_left, spread_right, sizes=others)
        parts.append(joined.select(columns))
    return reduce(DataFrame.unionByName, parts)


def _in_tasks(left: DataFrame, right: DataFrame, on: list[str], how: str, tasks: int) -> DataFrame:
    """The join in so many tasks, if that is more than one; they are not merged for being small."""
    if tasks <= 1:
        return left.join(right, on, how)
    # Sorted, the few rows of a cell are run through in memory order for each row of the other side.
    return left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on, how)


def _own_slice(spread: str, slices: Column) -> Column:
    return F.pmod(F.xxhash64(spread), slices).cast("int")


def _every_slice(slices: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (slices - 1).cast("int")))


def _key_sizes(workspace: Workspace, left: Stage, right: Stage, on: list[str]) -> DataFrame:
    """The rows of each key on either side, one at least, and the pairs they make."""
    lefts = left.df.groupBy(on).agg(F.count(F.lit(1)).alias("left_rows"))
    rights = right.df.groupBy(on).agg(F.count(F.lit(1)).alias("right_rows"))
    sized = lefts.join(rights, on, "full").select(
        *on,
        F.coalesce("left_rows", F.lit(1)).alias("left_rows"),
        F.coalesce("right_rows", F.lit(1)).alias("right_rows"),
    )
    return workspace.stage(
        sized.withColumn("pairs", F.col("left_rows").cast("double") * F.col("right_rows")),
        "key-sizes",
    ).df


def _hot_keys(
    workspace: Workspace,
    left: Stage,
    right: Stage,
    on: list[str],
    hot_pairs: int,
    slice_rows: int,
    sizes: DataFrame | None = None,
) -> Stage:
    """Keys too large for one task, with their slice counts. ``sizes`` are ``_key_sizes``, if they are known."""
    if sizes is None:
        sizes = _key_sizes(workspace, left, right, on)
    hot = sizes.filter(F.col("pairs") >= hot_pairs)
    return workspace.stage(
        hot.select(
            *on,
            F.ceil(F.col("left_rows") / slice_rows).alias("left_slices"),
            F.ceil(F.col("right_rows") / slice_rows).alias("right_slices"),
        ),
        "hot-keys",
    )
