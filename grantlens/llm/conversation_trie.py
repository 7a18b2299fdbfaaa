"""The trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

Conversations that begin with the same turns share nodes. A turn travels as a digest; a prefix is named by
the XOR of its turns' digests, each hashed with its place, which adds up along a conversation in pieces. So
a conversation of any length is cut into runs that different tasks work on, and no conversation and no
group of equal ones is ever gathered.

Defined results: rows without conv_id belong to no conversation and make no node; a null role or text is
empty; a null turn comes first, and rows of one turn go by role and then by digest, each as often as it
occurs. Without conversations there are no rows. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.tree_contraction import subtree_sums
from grantlens.operators.skew import lookup_join
from grantlens.workspace import Stage, Workspace

WORD = r"[^\x20\x09-\x0D]+"

# Hash parts of a prefix, 60 bits each.
PARTS = 2

_KEY = ["depth", *[f"p{i}" for i in range(PARTS)]]
_ABOVE = [f"a{i}" for i in range(PARTS)]
_MARK = [f"t{i}" for i in range(PARTS)]


def _turns(workspace: Workspace, conversations: DataFrame) -> DataFrame:
    """(conv_id, run, row, digest, words): turns in order; a run is a stretch of rows that one task has sorted."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length in front tells where the role ends.
    content = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.sha2(content, 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("source"),
    )
    order = ["conv_id", "turn", "role", "digest", "source"]
    sorted_turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return workspace.stage(
        sorted_turns.select(
            "conv_id",
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
            "digest",
            "words",
        ),
        "turns",
    ).df


def _pieces(workspace: Workspace, turns: DataFrame, block: int, shared: int) -> DataFrame:
    """(conv_id, run, first_row, n_before, n_turns, base, n_cut, n_kept): what each run needs to place its turns.

    ``n_cut`` own turns in front make way for the ``n_kept`` first ones of ``base``.
    """
    pieces = workspace.stage(
        turns.groupBy("conv_id", "run").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")), "pieces"
    ).df
    by_run = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("n_before", F.coalesce(F.sum("n").over(by_run), F.lit(0).cast("long")))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    cut = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared if shared else F.lit(0).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % block if shared else F.col("conv_id")
    convs = sizes.select("conv_id", "n_turns", base.alias("base"), cut.alias("n_cut"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    kept = F.least("n_cut", F.coalesce("n_base", F.lit(0).cast("long"))).alias("n_kept")
    known = convs.join(bases, "base", "left").select("conv_id", "n_turns", "base", "n_cut", kept)
    return workspace.stage(placed.drop("n").join(known, "conv_id"), "placed-pieces").df


def _mark(depth: Column, digest: Column) -> list[Column]:
    """Hashes of a turn at its place, to be combined by XOR."""
    whole = F.sha2(F.concat(depth.cast("string"), F.lit(":"), digest), 256)
    return [
        F.conv(F.substring(whole, 1 + 15 * i, 15), 16, 10).cast("long").alias(_MARK[i]) for i in range(PARTS)
    ]


def _steps(workspace: Workspace, conversations: DataFrame, block: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """Every turn of every rebuilt conversation with the keys of its prefix and the one above, and the conversations.

    Steps: (conv_id, depth, p0.., a0.., words, last). Conversations: (conv_id, length).
    """
    turns = _turns(workspace, conversations)
    pieces = _pieces(workspace, turns, block, shared)
    convs = pieces.filter("n_before = 0").select(
        "conv_id",
        "base",
        "n_cut",
        (F.col("n_kept") + F.greatest(F.col("n_turns") - F.col("n_cut"), F.lit(0))).alias("length"),
    )
    place = F.col("row") - F.col("first_row") + F.col("n_before") + 1

    # The first turns of a base go to all conversations of its block, a bounded number each.
    heads = turns.filter(F.col("conv_id") % block == 0).join(
        pieces.select("conv_id", "run", "first_row", "n_before"), ["conv_id", "run"]
    )
    heads = heads.withColumn("depth", place).filter(F.col("depth") < max(shared, 1))
    borrowed = (
        heads.select(F.col("conv_id").alias("base"), "depth", "digest", "words")
        .join(convs, "base")
        .filter(F.col("depth") <= F.col("n_cut"))
        .select("conv_id", F.lit(-1).alias("run"), "depth", "digest", "words", "length")
    )
    own = (
        turns.join(pieces, ["conv_id", "run"])
        .withColumn("depth", place - F.col("n_cut") + F.col("n_kept"))
        .filter(place > F.col("n_cut"))
        .select(
            "conv_id",
            "run",
            "depth",
            "digest",
            "words",
            (F.col("n_kept") + F.col("n_turns") - F.col("n_cut")).alias("length"),
        )
    )
    marked = workspace.stage(
        borrowed.unionByName(own).select(
            "conv_id",
            "run",
            "depth",
            "words",
            (F.col("depth") == F.col("length")).alias("last"),
            *_mark(F.col("depth"), F.col("digest")),
        ),
        "marked-turns",
    ).df

    # XOR along a conversation: within a run by a window, and over its earlier runs by their totals.
    runs = marked.groupBy("conv_id", "run").agg(*[F.bit_xor(m).alias(f"run_{m}") for m in _MARK])
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(
        "conv_id", "run", *[F.coalesce(F.bit_xor(f"run_{m}").over(earlier), F.lit(0)).alias(f"run_{m}") for m in _MARK]
    )
    along = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.select("*", *[F.bit_xor(m).over(along).alias(f"sum_{m}") for m in _MARK])
    keyed = within.join(before, ["conv_id", "run"])
    prefix = [F.col(f"sum_{m}").bitwiseXOR(F.col(f"run_{m}")) for m in _MARK]
    steps = keyed.select(
        "conv_id",
        "depth",
        "words",
        "last",
        *[p.alias(name) for p, name in zip(prefix, _KEY[1:], strict=True)],
        *[p.bitwiseXOR(F.col(m)).alias(name) for p, m, name in zip(prefix, _MARK, _ABOVE, strict=True)],
    )
    return workspace.stage(steps, "prefixes").df, convs.select("conv_id", "length")


def _linked(workspace: Workspace, nodes: Stage) -> DataFrame:
    """Nodes with ``parent_conv_id``, found by the key of the prefix above."""
    names = nodes.df.select(
        (F.col("depth") + 1).alias("depth"),
        *[F.col(p).alias(a) for p, a in zip(_KEY[1:], _ABOVE, strict=True)],
        F.col("conv_id").alias("parent_conv_id"),
    )
    # A node may have any number of children.
    return lookup_join(
        workspace, nodes.df, Stage(names, nodes.rows), ["depth", *_ABOVE], "left", spread="conv_id"
    )


def _ends(workspace: Workspace, ended: DataFrame) -> DataFrame:
    """(*key, ends_sha256): SHA-256 of the comma-joined ids of the conversations that end at a node.

    Ids are sorted in ranges and joined to text within each; a node whose ids fill several ranges has several
    texts, which pass through the hash one after the other.
    """
    order = [*_KEY, "conv_id"]
    ranged = ended.repartitionByRange(*order).select(*order, F.spark_partition_id().alias("run"))
    stored = workspace.stage(ranged, "ends").df
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    texts = stored.groupBy(*_KEY, "run").agg(F.array_join(ids, ",").alias("ids"))
    lines = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").select(*_KEY, "ids")
    schema = ", ".join([*[f"{name} bigint" for name in _KEY], "ends_sha256 string"])
    return lines.mapInArrow(_hashed, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key from sorted rows (key, ids); nothing but the hash of the current key is held."""
    current, digest = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key, _ in done], pa.int64()) for i in range(len(_KEY))]
        return pa.record_batch([*columns, pa.array([h for _, h in done], pa.string())], [*_KEY, "ends_sha256"])

    for batch in batches:
        done = []
        keys = zip(*[batch.column(i).to_pylist() for i in range(len(_KEY))], strict=True)
        for key, ids in zip(keys, batch.column(len(_KEY)), strict=True):
            if key == current:
                digest.update(b",")
            else:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = key, hashlib.sha256()
            digest.update(ids.as_buffer())
        yield rows(done)
    if digest is not None:
        yield rows([(current, digest.hexdigest())])


def prefix_trie(conversations: DataFrame, block: int = 1, shared: int = 0) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    With ``shared``, conversations are rebuilt first: c takes the first h turns of the one at the start of its
    block of ids, c - c % ``block``, in place of its own first h, where h is the CRC-32 of the decimal c modulo
    ``shared``. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that members share instead of repeating, in the subtree), ends_sha256.
    """
    workspace = Workspace(conversations.sparkSession)
    steps, convs = _steps(workspace, conversations, block, shared)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    none = [F.lit(0).cast("long").alias(name) for name in ("depth", *_KEY[1:])]
    unused = [F.lit(None).cast("long").alias(name) for name in _ABOVE]
    found = steps.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        *[F.min(a).alias(a) for a in _ABOVE],
    )
    root = top.select(*none, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *unused)
    nodes = workspace.stage(root.unionByName(found), "nodes")
    linked = workspace.stage(_linked(workspace, nodes), "linked-nodes")

    tree = linked.df.withColumns(
        {
            "id": F.struct("depth", "conv_id"),
            "parent": F.when(
                F.col("parent_conv_id").isNotNull(),
                F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")),
            ),
        }
    )
    children = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id"))
    grown = workspace.stage(
        tree.join(children.agg(F.count(F.lit(1)).alias("n_children")), "id", "left").withColumn(
            "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
        ),
        "grown-nodes",
    ).df
    sums = subtree_sums(
        workspace,
        grown.select(
            "id",
            "parent",
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        ["n_leaves", "saved_tokens"],
    )
    ended = steps.filter("last").select(*_KEY, "conv_id").unionByName(
        convs.filter("length = 0").select(*none, "conv_id")
    )
    nothing = F.lit(hashlib.sha256().hexdigest())
    return (
        grown.join(sums, "id")
        .join(_ends(workspace, ended), _KEY, "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
