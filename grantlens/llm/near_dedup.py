"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct five-word shingles. Equal sets are merged first. Each set gets
``SYMBOLS`` MinHash values cut to 16 bits. For sets with the similarity looked for, more than
``distance`` of them differ in one of ten million pairs or less; every pair within that distance is found:
the signature is cut into more than ``distance / 2`` chunks, by pigeonhole one of them has at most
one differing value, and each chunk is indexed once per value that may differ,
under its other values. Pairs are confirmed on the full sets.

A bucket's members are first compared with the lowest one only. Then connected components are taken,
and only buckets that still hold several components give pairs, only across components, each pair in
one bucket, and only if enough shingles of both occur in other documents too. So a group of copies costs
one comparison a member, and no link between components is lost.

Rows: one per doc_id. A text without words, or null, has an empty set and is linked with nothing. Fewer
words than five are one shingle. Rows without doc_id get no row, as a component is named by an id, and
are kept by ``deduplicate``. Where rows share a doc_id, equal rows count once and each different text is
compared on its own: ``deduplicate`` drops those texts that are near copies and keeps their namesakes. Such
a document's row adds up its texts' shingles; it is kept if one of its texts is, and else its component is
the smallest one of its texts'. The smallest id names a component, and of its texts the one with the
lowest MD5, so there are no ties. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.llm.batches import id_and_text, map_slices, mix, shingle_sets
from grantlens.llm.components import components
from grantlens.operators.skew import lookup_join
from grantlens.workspace import Stage, Workspace

SHINGLE_WORDS = 5

# Links: 100 * intersection >= percent * union; this one unless the caller names another.
PERCENT = 85

# Signature: 64 values of 16 bits, stored as 16 longs, of which each has one bit of every value.
SYMBOLS = 64
PLANES = 16

# The part of pairs at the similarity looked for that may lie beyond the signature distance, at most.
MISSED = 1e-7

# The column that tells apart the texts of one doc_id.
TEXT_KEY = "near_text_md5"

# Ids that are broadcast to pick documents, at most; beyond that they are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = ((_SEEDS >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
_TOGGLE = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32)

SIGNATURE = [f"s{k}" for k in range(PLANES)]


@dataclass(frozen=True)
class Index:
    """The chunks of signatures for one similarity; pairs that differ in ``distance`` values or fewer meet."""

    percent: int
    chunks: int

    @property
    def distance(self) -> int:
        return min(2 * self.chunks - 1, SYMBOLS)

    @property
    def edges(self) -> list[tuple[int, int]]:
        """First and last-plus-one value of each chunk."""
        cuts = np.linspace(0, SYMBOLS, self.chunks + 1).round().astype(int).tolist()
        return list(zip(cuts[:-1], cuts[1:], strict=True))


def missed(percent: int, distance: int) -> float:
    """The part of pairs with this similarity that differ in more values."""
    one = 1 - percent / 100
    return sum(comb(SYMBOLS, n) * one**n * (1 - one) ** (SYMBOLS - n) for n in range(distance + 1, SYMBOLS + 1))


def index_for(percent: int) -> Index:
    """The index with the fewest chunks that misses few enough pairs: 14 chunks at 85, 16 at 80."""
    for chunks in range(1, SYMBOLS // 2 + 1):
        index = Index(percent, chunks)
        if missed(percent, index.distance) <= MISSED:
            return index
    raise ValueError(f"signatures are too short for a similarity of {percent} percent")


DEFAULT = index_for(PERCENT)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16-bit MinHash values (rows x SYMBOLS) of sets of 64-bit hashes; zeros for empty sets."""
    n_rows = len(bounds) - 1
    result = np.zeros((n_rows, SYMBOLS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return result
    short = (values >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1][full]
    for k in range(SYMBOLS):
        hashed = (short ^ _TOGGLE[k]) * _FACTOR[k]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        low = np.minimum.reduceat(hashed, starts)
        # The value itself says which shingle is lowest; mixed again, its low bits are even.
        result[full, k] = (mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return result


def to_planes(symbols: np.ndarray) -> np.ndarray:
    """Values (rows x SYMBOLS) as longs (rows x PLANES): bit i of long p is bit p of value i."""
    bits = (symbols[:, None, :] >> np.arange(PLANES, dtype=np.uint16)[None, :, None]) & np.uint16(1)
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.int64).reshape(-1, PLANES)


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The inverse of ``to_planes``."""
    shaped = np.ascontiguousarray(planes).view(np.uint8).reshape(-1, PLANES, SYMBOLS // 8)
    bits = np.unpackbits(shaped, axis=2, bitorder="little").astype(np.uint16)
    return (bits << np.arange(PLANES, dtype=np.uint16)[None, :, None]).sum(axis=1, dtype=np.uint16)


def chunk_keys(symbols: np.ndarray, index: Index = DEFAULT) -> np.ndarray:
    """Keys (rows x SYMBOLS) of the index: for each value, its chunk's other values, hashed."""
    keys = np.empty((len(symbols), SYMBOLS), dtype=np.uint64)
    wide = symbols.astype(np.uint64)
    for start, stop in index.edges:
        for left_out in range(start, stop):
            key = np.full(len(symbols), left_out + 1, dtype=np.uint64)
            for k in range(start, stop):
                if k != left_out:
                    key = mix(key * np.uint64(0x100000001B3) + wide[:, k])
            # The low bits say which value is left out.
            keys[:, left_out] = (key & ~np.uint64(SYMBOLS - 1)) | np.uint64(left_out)
    return keys


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, set size, two hashes that name the set, and the signature as longs, for each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(batch.column("text"), SHINGLE_WORDS)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(seed)))]) for seed in (1, 2)]
        names = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
        planes = to_planes(signatures(values, bounds))
        columns = [pa.array(np.diff(bounds)), *map(pa.array, names), *(pa.array(p.copy()) for p in planes.T)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "name1", "name2", *SIGNATURE]
        )

    planes = ", ".join(f"{name} long" for name in SIGNATURE)
    return map_slices(docs, run, f"doc_id long, n_shingles long, name1 long, name2 long, {planes}")


def difference(left: str, right: str) -> Column:
    """A bit for each value in which the signatures of two aliased tables differ."""
    planes = [F.col(f"{left}.{name}").bitwiseXOR(F.col(f"{right}.{name}")) for name in SIGNATURE]
    return reduce(Column.bitwiseOR, planes)


def differing(left: str, right: str) -> Column:
    """How many of the signatures' values differ, in the columns of two aliased tables."""
    return F.bit_count(difference(left, right))


def _signed(bits: int) -> Column:
    return F.lit(bits - 2**64 if bits >= 2**63 else bits).cast("long")


def first_shared(mask: Column, index: Index = DEFAULT) -> Column:
    """The value left out, as a bit, in the first key that a pair with this difference has in common."""

    def bit(known: Column) -> Column:
        first = F.lit(None).cast("long")
        for start, stop in reversed(index.edges):
            inside = known.bitwiseAND(_signed((1 << stop) - (1 << start)))
            left_out = F.when(inside == 0, _signed(1 << start)).otherwise(inside)
            first = F.when(F.bit_count(inside) <= 1, left_out).otherwise(first)
        return first

    return F.transform(F.array(mask), bit)[0]


def _keys(signed: DataFrame, index: Index) -> DataFrame:
    """id and the keys under which it is indexed."""

    def run(batches):
        for batch in batches:
            planes = np.stack([np.asarray(batch.column(name)) for name in SIGNATURE], axis=1)
            keys = chunk_keys(from_planes(planes), index)
            ids = np.repeat(np.asarray(batch.column("id")), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return signed.select("id", *SIGNATURE).mapInArrow(run, "key long, id long")


def _confirm(workspace: Workspace, pairs: Stage, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity; ``sets`` has id, n_shingles and the shingles."""

    def run(batches):
        for batch in batches:
            lists = [batch.column(name).to_pylist() for name in ("left", "right")]
            keep = []
            for left, right in zip(*lists, strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.df.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long")


def _picked(docs: DataFrame, ids: Stage) -> DataFrame:
    """The documents with the given ids; the ids are broadcast if they are few."""
    return docs.join(_hinted(ids), "doc_id", "left_semi")


def _shingles(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(batch.column("text"), SHINGLE_WORDS)
        packed = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["id", "shingles"])

    return map_slices(docs, run, "id long, shingles binary")


@dataclass(frozen=True)
class NearDuplicates:
    """What was found.

    members: doc_id, n_shingles, component_id and kept; links: confirmed pairs (a, b) of documents that
    stand for their equal sets; repeated: the ids of several rows; gone: the doc_id of what is not kept,
    and if ids are repeated also the ``TEXT_KEY`` of its text.
    """

    members: DataFrame
    links: DataFrame
    repeated: Stage
    gone: DataFrame


def _hinted(ids: Stage) -> DataFrame:
    """Ids to join with: broadcast if they are few."""
    return F.broadcast(ids.df) if ids.rows <= BROADCAST_IDS else ids.df


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias(TEXT_KEY)


def _numbered(workspace: Workspace, docs: DataFrame, repeated: Stage) -> DataFrame:
    """id, doc_id, key and text of every different row, where ids are repeated."""
    rows = id_and_text(docs).filter("doc_id IS NOT NULL").select("doc_id", "text", _text_key("text"))
    single = rows.join(_hinted(repeated), "doc_id", "left_anti")
    several = rows.join(_hinted(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", TEXT_KEY])
    both = single.unionByName(several.select(*single.columns))
    # Written before use: the row number must not change if a task runs again.
    return workspace.stage(both.withColumn("id", F.monotonically_increasing_id()), "near_rows").df


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> NearDuplicates:
    """Link documents whose similarity is ``percent`` or more and name their components."""
    near = index_for(percent)
    workspace = Workspace(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = workspace.stage(counted.filter("n > 1").select("doc_id"), "near_repeated")
    if not repeated.rows:
        found, links = _linked(workspace, id_and_text(docs).filter("doc_id IS NOT NULL"), near)
        members = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
        return NearDuplicates(members, links, repeated, members.filter("NOT kept").select("doc_id"))

    numbered = _numbered(workspace, docs, repeated)
    found, links = _linked(workspace, numbered.select(F.col("id").alias("doc_id"), "text"), near)
    owners = numbered.select("id", "doc_id", TEXT_KEY)
    found = found.select(F.col("doc_id").alias("id"), "n_shingles", "component_id")
    owned = workspace.stage(found.join(owners, "id"), "near_owned").df
    lowest = owned.groupBy("component_id").agg(F.min(F.struct("doc_id", TEXT_KEY)).alias("lowest"))
    lowest = workspace.stage(lowest, "near_lowest")
    rows = lookup_join(workspace, owned, lowest, ["component_id"], "inner", spread="id")
    rows = rows.withColumn("kept", F.struct("doc_id", TEXT_KEY) == F.col("lowest"))
    rows = workspace.stage(rows.withColumn("low", F.col("lowest.doc_id")).drop("lowest"), "near_kept").df
    members = rows.groupBy("doc_id").agg(
        F.sum("n_shingles").alias("n_shingles"), F.min("low").alias("low"), F.max("kept").alias("kept")
    )
    named = F.when(F.col("kept"), F.col("doc_id")).otherwise(F.col("low")).alias("component_id")
    members = members.select("doc_id", "n_shingles", named, "kept")
    ends = [owners.select(F.col("id").alias(end), F.col("doc_id").alias(f"{end}_doc")) for end in ("a", "b")]
    links = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    return NearDuplicates(members, links, repeated, rows.filter("NOT kept").select("doc_id", TEXT_KEY))


def _linked(workspace: Workspace, texts: DataFrame, near: Index) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and component_id of texts with unique ids, and the links between them."""
    signed = workspace.stage(sign(texts), "near_signed").df
    named = ["name1", "name2", "n_shingles"]
    full = signed.filter("n_shingles > 0")
    copied = full.groupBy(*named).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # Written first, so that the join below is one that Spark can split by a hot set.
    copied = workspace.stage(copied.filter("n > 1").drop("n"), "near_copied").df
    rep = full.select("doc_id", *named).join(copied, named, "left")
    rep = rep.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    rep = workspace.stage(rep, "near_rep").df
    sets = rep.filter("doc_id = rep").select(F.col("doc_id").alias("id"))
    unique = workspace.stage(
        full.join(sets, full["doc_id"] == sets["id"]).select("id", "n_shingles", *SIGNATURE), "near_unique"
    ).df

    # The index: keys that several sets have, with the lowest of them.
    keys = _keys(unique, near)
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last")
    index = workspace.stage(keys.join(shared.select("key", "hub"), "key"), "near_index").df
    hubs = index.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    first = _within(workspace, unique, hubs, near)
    links = workspace.stage(_confirmed(workspace, texts, first, near.percent), "near_links").df
    found = components(workspace, links)

    # What is left: buckets that hold several components.
    label = F.coalesce("component", "id").alias("component")
    labelled = index.select("key", "id").join(found, "id", "left").select("key", "id", label)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = workspace.stage(
        labelled.join(mixed.filter("low < high").select("key"), "key"), "near_rest"
    ).df
    alone = _alone(workspace, texts, rest.select(F.col("id").alias("doc_id")).distinct())
    shared_part = (F.col("n_shingles") - F.col("alone")).alias("common")
    bucketed = rest.join(alone, "id").join(unique, "id")
    bucketed = bucketed.select("key", "id", "component", "n_shingles", shared_part, *SIGNATURE)
    bucketed = workspace.stage(bucketed, "near_buckets").df
    own_key = F.expr("shiftleft(1L, CAST(x.key & 63 AS INT))")
    pairs = bucketed.alias("x").join(
        bucketed.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") < F.col("y.component"))
        & _overlap_allows("x", "y", near.percent)
        & (differing("x", "y") <= near.distance)
        & (first_shared(difference("x", "y"), near) == own_key),
    )
    low, high = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    second = workspace.stage(
        pairs.select(low, high).distinct().join(first.df, ["a", "b"], "left_anti"), "near_second"
    )
    if second.rows:
        more = _confirmed(workspace, texts, second, near.percent)
        links = workspace.stage(links.unionByName(more), "near_all_links").df
        found = components(workspace, links)

    grouped = rep.join(found, rep["rep"] == found["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(empty), links


def _sizes_allow(left: str, right: str, percent: int) -> Column:
    """Sets too different in size cannot have the similarity."""
    x, y = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _overlap_allows(left: str, right: str, percent: int) -> Column:
    """Two sets have at most those shingles in common that each shares with some other document."""
    most = F.least(f"{left}.common", f"{right}.common")
    return most * (100 + percent) >= (F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles")) * percent


def _alone(workspace: Workspace, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id and ``alone``: how many shingles of each of these documents none of the others has."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(batch.column("text"), SHINGLE_WORDS)
        owner = np.repeat(np.asarray(batch.column("doc_id")), np.diff(bounds))
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(values.view(np.int64))], ["id", "shingle"])

    chosen = workspace.stage(ids, "near_rest_ids")
    sets = map_slices(_picked(texts, chosen), run, "id long, shingle long")
    # One row per shingle: whether one document has it, and which.
    owners = sets.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    alone = owners.filter("id = last").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    sizes = chosen.df.select(F.col("doc_id").alias("id"))
    sizes = sizes.join(alone, "id", "left").select("id", F.coalesce("alone", F.lit(0)).alias("alone"))
    return workspace.stage(sizes, "near_alone").df


def _within(workspace: Workspace, unique: DataFrame, pairs: DataFrame, near: Index) -> Stage:
    """Those pairs (a, b) whose signatures are within the distance."""
    left = pairs.distinct().join(unique.alias("x"), F.col("a") == F.col("x.id"))
    both = left.join(unique.alias("y"), F.col("b") == F.col("y.id"))
    close = both.filter((differing("x", "y") <= near.distance) & _sizes_allow("x", "y", near.percent))
    return workspace.stage(close.select("a", "b"), "near_pairs")


def _confirmed(workspace: Workspace, texts: DataFrame, pairs: Stage, percent: int) -> DataFrame:
    ends = pairs.df.select(F.col("a").alias("doc_id")).union(pairs.df.select("b")).distinct()
    ids = workspace.stage(ends, "near_ends")
    sets = workspace.stage(_shingles(_picked(texts, ids)), "near_sets").df
    return _confirm(workspace, pairs, sets, percent)


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept: of each component the one with the smallest id, and of equal rows one."""
    found = near_duplicates(docs, percent)
    workspace = Workspace(docs.sparkSession)
    gone = workspace.stage(found.gone, "near_gone")
    if not found.repeated.rows:
        return docs.join(_hinted(gone), "doc_id", "left_anti")
    keyed = docs.select("*", _text_key("text")).join(_hinted(gone), ["doc_id", TEXT_KEY], "left_anti")
    rest = keyed.join(_hinted(found.repeated), "doc_id", "left_anti").select(*docs.columns)
    again = keyed.join(_hinted(found.repeated), "doc_id", "left_semi")
    # Rows that differ in other columns only: the one that comes first by the whole row's hash.
    row = F.struct(*docs.columns)
    again = again.groupBy("doc_id", TEXT_KEY).agg(F.min_by(row, F.md5(F.to_json(row).cast("binary"))).alias("row"))
    return rest.unionByName(again.select("row.*"))
