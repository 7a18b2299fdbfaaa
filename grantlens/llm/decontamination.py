"""Benchmark decontamination: greedy string tiling of documents with benchmark items.

Documents and items that share a five-token seed are tiled: the longest matches of tokens that no tile
covers yet are marked, again and again, down to five tokens; matches of a length are found with running
Karp-Rabin hashes. Tiles may lie in any order, so reordered passages count. A document leaks an item
when tiles cover at least ``COVERAGE`` of the item's tokens.

Seeds are joined: those of the items with those of the documents. One scan of the documents keeps the texts
that hold a seed, by a filter of at most ``FILTER_BITS`` bits, whatever the size of the benchmark. Tiles of five
tokens or more that reach the coverage hold a known number of an item's seeds, so all but that number, the
rarest ones, are enough to meet every such document; the seeds that most documents share need no join.
Equal texts are tiled once.

Tokens are runs of letters and digits within words, lower-cased; words without any are skipped.

Rows: one per document row and item row with a leak, so that repeated rows repeat. Null and empty texts
leak nothing, and items of fewer than five tokens cannot be leaked. Ties between matches of a length go to
the one that comes first in the item, then in the document. Other columns are ignored, and kept by
``decontaminate``.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm import text_stats
from grantlens.llm.batches import _BASE, _INVERSE, _power_table, map_slices, mix
from grantlens.llm.text_stats import Texts, lowered
from grantlens.operators.skew import balanced_join, lookup_join
from grantlens.workspace import Stage, Workspace

SEED_TOKENS = 5

COVERAGE = 0.8

# Bits of the filter that documents' seeds have to pass before they are joined: per seed of the items, and at
# most (16 MiB to every worker). A full filter lets more seeds through to the join, and loses none.
BITS_PER_SEED = 256
FILTER_BITS = 2**27
FILTER_HASHES = 4

# Length of the first search; it doubles when matches are longer and halves when they are used up.
FIRST_LENGTH = 20

def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, and the row of each."""
    texts = Texts(column)
    plain = lowered(texts.data)
    kept = text_stats._LETTER | text_stats._DIGIT
    some = texts.words_with(kept) > 0
    return texts.hashes(plain, kept[plain])[some], texts.row[some]


def windows(values: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up = _power_table(_BASE, "up", len(values))[: len(values)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
    # Every window is brought back to the first place.
    return mix((total[length:] - total[:-length]) * _power_table(_INVERSE, "down", n)[:n])


def _free_runs(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` that hold no marked token."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[length:] == total[:-length]) if len(marked) >= length else np.empty(0, np.int64)


def _matches(item: np.ndarray, text: np.ndarray, done_item: np.ndarray, done_text: np.ndarray, length: int):
    """Maximal matches of ``length`` or more unmarked tokens as (size, item place, text place)."""
    free_item, free_text = _free_runs(done_item, length), _free_runs(done_text, length)
    if not len(free_item) or not len(free_text):
        return []
    places = defaultdict(list)
    hashes = windows(item, length)
    for p in free_item.tolist():
        places[int(hashes[p])].append(p)
    hashes = windows(text, length)[free_text]
    known = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
    found = []
    for t, h in zip(free_text[known].tolist(), hashes[known].tolist(), strict=True):
        for p in places[h]:
            inside = p > 0 and t > 0 and not done_item[p - 1] and not done_text[t - 1] and item[p - 1] == text[t - 1]
            if inside:
                continue  # part of a longer match that begins before
            size = 0
            while (
                p + size < len(item)
                and t + size < len(text)
                and not done_item[p + size]
                and not done_text[t + size]
                and item[p + size] == text[t + size]
            ):
                size += 1
            if size >= length:
                found.append((size, p, t))
    return found


def tile(item: np.ndarray, text: np.ndarray, shortest: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Greedy tiles (size, item place, text place), longest first, of ``shortest`` tokens or more."""
    done_item, done_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles = []
    length = max(shortest, FIRST_LENGTH)
    while True:
        found = _matches(item, text, done_item, done_text, length)
        longest = max((size for size, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        # Longest first; what earlier tiles cover is cut off, and the rest waits its turn.
        waiting = defaultdict(list)
        for size, p, t in found:
            waiting[size].append((p, t))
        size = longest
        while size >= length:
            for p, t in sorted(waiting.pop(size, ())):
                blocked = np.flatnonzero(done_item[p : p + size] | done_text[t : t + size])
                if not len(blocked):
                    tiles.append((size, p, t))
                    done_item[p : p + size] = True
                    done_text[t : t + size] = True
                    continue
                edges = np.concatenate([[-1], blocked, [size]])
                for a, b in zip(edges[:-1] + 1, edges[1:], strict=True):
                    if b - a >= length:
                        waiting[int(b - a)].append((p + int(a), t + int(a)))
            if not waiting.get(size):
                size -= 1
        if length == shortest:
            return tiles
        length = max(shortest, length // 2)


def _lists(values: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """One list of 64-bit values per row; ``row`` is ascending."""
    ends = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _seeds(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds of each text, and the row of each."""
    hashes = windows(values, SEED_TOKENS)
    whole = row[: len(hashes)] == row[SEED_TOKENS - 1 :]
    return hashes[whole], row[: len(hashes)][whole]


def _around(values: np.ndarray, places: np.ndarray, reach: int, start: int, stop: int) -> np.ndarray:
    """The parts of a document that a tile can lie in: every tile holds a seed and is no longer than the item."""
    near = np.zeros(stop - start + 1, dtype=np.int64)
    np.add.at(near, np.maximum(places - start - reach, 0), 1)
    np.add.at(near, np.minimum(places - start + reach + SEED_TOKENS, stop - start), -1)
    inside = np.cumsum(near[:-1]) > 0
    gap = ~inside & np.concatenate([[False], inside[:-1]])  # one token that matches nothing between parts
    part = values[start:stop].copy()
    part[gap] = np.arange(1, gap.sum() + 1, dtype=np.uint64)
    return part[inside | gap]


def least_seeds(n_tokens: int) -> int:
    """Places of an item's seeds that every document with a leak holds: a tile of n tokens holds n - 4 of them."""
    return ceil(ceil(COVERAGE * n_tokens - 1e-9) / SEED_TOKENS)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (the key of its text), tokens, seeds by place, and how many of the seeds every leak holds."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _key(F.col("text")).alias("item"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, row = tokens(batch.column("text"))
        n = batch.num_rows
        least = [least_seeds(k) for k in np.bincount(row, minlength=n).tolist()]
        lists = [_lists(values, row, n), _lists(*_seeds(values, row), n)]
        columns = [batch.column("item_id"), batch.column("item"), *lists, pa.array(least, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["item_id", "item", "tokens", "seeds", "least"])

    schema = "item_id long, item binary, tokens array<long>, seeds array<long>, least int"
    return map_slices(rows.filter("text IS NOT NULL"), run, schema).filter(F.size("seeds") > 0)


def _bit_places(seeds: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bits of each seed, one row per hash; ``bits`` is a power of two."""
    salts = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E6C63D0876A9A47)
    return mix(seeds.view(np.uint64)[None, :] ^ salts) & np.uint64(bits - 1)


def _filter(seeds: DataFrame, n_seeds: int) -> np.ndarray:
    """The filter as 64-bit words. Tasks set bits, and a word comes to the driver once: ``FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, 1 << max(16, (BITS_PER_SEED * n_seeds).bit_length()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places = np.unique(_bit_places(batch.column("seed").to_numpy(), bits))
        word = (places >> np.uint64(6)).astype(np.int64)
        bit = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])

    marked = seeds.mapInArrow(lambda batches: map(run, batches), "word long, bit long")
    words = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def _texts_with_seeds(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, text, its key and the distinct seeds that pass the filter, of the documents with any."""
    words = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, row = _seeds(*tokens(batch.column("text")))
        passed = np.ones(len(values), dtype=bool)
        for places in _bit_places(values, 64 * len(words.value)):
            passed &= (words.value[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) > 0
        values, row = values[passed], row[passed]
        order = np.lexsort((values, row))
        values, row = values[order], row[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[new], row[new]
        own = np.unique(row)
        kept = batch.take(pa.array(own))
        lists = _lists(values, np.searchsorted(own, row), len(own))
        return pa.RecordBatch.from_arrays([*kept.columns, lists], ["doc_id", "key", "text", "seeds"])

    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"), text)
    return map_slices(rows, run, "doc_id long, key binary, text string, seeds array<long>")


def _index(workspace: Workspace, items: DataFrame, shared: DataFrame) -> Stage:
    """seed and item: of each item the rarest seeds, as many as meet every document with a leak."""
    frequency = shared.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    places = items.select("item", "least", F.posexplode("seeds").alias("place", "seed"))
    ranked = places.join(frequency, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_frequency = Window.partitionBy("item").orderBy(F.desc("n"), "place")
    ranked = ranked.withColumn("rank", F.row_number().over(by_frequency))
    # Seeds that no document holds count as places, but meet nothing.
    return workspace.stage(ranked.filter("rank >= least AND n > 0").select("seed", "item").distinct(), "dc_index")


def _tiled(pairs: DataFrame) -> DataFrame:
    """key, item and tiles of the pairs (key, text, item, tokens) that reach the coverage."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, row = tokens(batch.column("text"))
        starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        found = []
        for r, own in enumerate(batch.column("tokens")):
            item = own.values.to_numpy().view(np.uint64)
            whole = values[starts[r] : starts[r + 1]]
            places = np.flatnonzero(np.isin(windows(whole, SEED_TOKENS), windows(item, SEED_TOKENS)))
            tiles = tile(item, _around(whole, places, len(item), 0, len(whole)))
            coverage = sum(size for size, _, _ in tiles) / len(item)
            if coverage >= COVERAGE:
                found.append((r, coverage, len(tiles), max(size for size, _, _ in tiles)))
        rows = batch.take(pa.array([r for r, *_ in found], pa.int64()))
        columns = [
            rows.column("key"),
            rows.column("item"),
            pa.array([c for _, c, _, _ in found], pa.float64()),
            pa.array([n for _, _, n, _ in found], pa.int32()),
            pa.array([size for *_, size in found], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "item", "coverage", "n_tiles", "longest_tile"])

    return map_slices(pairs, run, "key binary, item binary, coverage double, n_tiles int, longest_tile int")


def _matched(workspace: Workspace, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, Stage]:
    """Items by row, documents with seeds by row, and the tiles of each pair of their texts with a leak."""
    items = workspace.stage(_items(benchmark), "dc_items").df
    seeds = workspace.stage(items.select(F.explode("seeds").alias("seed")).distinct(), "dc_seeds")
    found = workspace.stage(_texts_with_seeds(docs, _filter(seeds.df, seeds.rows)), "dc_found").df
    shared = found.select("key", F.explode("seeds").alias("seed")).distinct()
    shared = workspace.stage(shared.join(seeds.df, "seed", "left_semi"), "dc_shared")
    single = items.dropDuplicates(["item"]).drop("item_id")
    index = _index(workspace, single, shared.df)
    # A seed that many texts, or many items, share is cut into slices.
    met = balanced_join(workspace, shared, index, ["seed"], "inner", spread_left="key", spread_right="item")
    pairs = workspace.stage(met.select("key", "item").distinct(), "dc_pairs")
    by_item = workspace.stage(single.select("item", "tokens"), "dc_tokens")
    pairs = balanced_join(workspace, pairs, by_item, ["item"], "inner", spread_left="key")
    texts = found.select("key", "text").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    return items, found, workspace.stage(_tiled(pairs.join(texts, "key")), "dc_tiled")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and longest_tile of every leak."""
    workspace = Workspace(docs.sparkSession)
    items, found, tiled = _matched(workspace, docs, benchmark)
    rows = workspace.stage(found.select("doc_id", "key"), "dc_rows")
    by_row = balanced_join(workspace, rows, tiled, ["key"], "inner", spread_left="doc_id", spread_right="item")
    return by_row.join(items.select("item_id", "item"), "item").select(
        "doc_id", "item_id", "coverage", "n_tiles", "longest_tile"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak nothing, with all their columns."""
    workspace = Workspace(docs.sparkSession)
    _, _, tiled = _matched(workspace, docs, benchmark)
    leaked = workspace.stage(tiled.df.select(F.col("key").alias("_leaked_key")).distinct(), "dc_leaked")
    keyed = docs.withColumn("_leaked_key", _key(F.col("text")))
    kept = lookup_join(workspace, keyed, leaked, ["_leaked_key"], "left_anti", spread="_leaked_key")
    return kept.select(*[F.col(f"`{name}`") for name in docs.columns])
