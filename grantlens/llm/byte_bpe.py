"""Byte-level BPE: segment trees over byte positions choose each merge.

Each leaf of a tree is a byte position and holds the rank of the pair that begins there, or no
rank. An inner node holds the smaller of its children, the left one on ties, so the root is the
leftmost pair of the lowest rank. A merge changes the pairs at the merged position and at its live
left neighbour, which are two point updates of log n steps. Pretokens of like length go through
their trees side by side in numpy; what a worker has encoded it remembers, within a bound.

Rows: every document once per input row. A null text is empty: no ids, and the digest of nothing.
Repeated rows stay. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grantlens.llm.batches import id_and_text, map_slices

# Pretokens remembered per worker, and the longest that is.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 64

# Bytes of the pretokens whose trees are built side by side.
WAVE_BYTES = 1 << 18

_NONE = np.int32(2**31 - 1)


class ByteBpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        pairs = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.shift = int(max(ranks.values())).bit_length()
        keys = (table[:, 0] << self.shift) | table[:, 1]
        # Open addressing with linear probes: one gather finds nearly every pair.
        self.bits = max(8, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, dtype=np.int64)
        self.slot_rank = np.full(size, _NONE, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[left[free]]  # the last writer of a slot has it
            won = self.slot_key[at] == keys[left]
            self.slot_rank[at[won]] = table[left[won], 2]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or the highest int where the pair is no token."""
        keys = (left << self.shift) | right
        at = self._slot(keys)
        ranks = np.where(self.slot_key[at] == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((ranks == _NONE) & (self.slot_key[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slot_key) - 1)
            found = self.slot_key[at[open_]] == keys[open_]
            ranks[open_[found]] = self.slot_rank[at[open_[found]]]
            open_ = open_[~found & (self.slot_key[at[open_]] >= 0)]
        return ranks

    # --- merging ---------------------------------------------------------------------

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word. Words of like length share a wave of trees."""
        result: list[tuple[int, ...]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            width = _tree_width(len(words[order[start]]))
            stop = start
            while (
                stop < len(order)
                and _tree_width(len(words[order[stop]])) == width
                and (stop == start or (stop - start + 1) * width <= WAVE_BYTES)
            ):
                stop += 1
            group = order[start:stop]
            for i, ids in zip(group, self._wave([words[i] for i in group], width), strict=True):
                result[i] = ids
            start = stop
        return result

    def _wave(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # Column -1 and `width` stand for "no neighbour"; ids of dead positions are not read.
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[row, column] = self.byte_id[text]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NONE, dtype=np.int32)  # leaves at width + position
        has = np.flatnonzero((ids[:, :-1].ravel() >= 0) & (ids[:, 1:].ravel() >= 0))
        r, c = has // width, has % width
        tree[r, width + c] = self.pair_rank(ids[r, c], ids[r, c + 1])
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            rank = tree[live, 1]
            node = np.ones(len(live), dtype=np.int64)
            while node[0] < width:  # all trees of a wave have the same depth
                node = 2 * node
                node += tree[live, node] != rank  # the left child unless only the right has it
            at = node - width
            gone = after[live, at]
            following = after[live, gone]
            previous = before[live, at]
            ids[live, at] = rank
            ids[live, gone] = -1
            after[live, at] = following
            inner = following < width
            before[live[inner], following[inner]] = at[inner]
            self._update(tree, width, live, gone, np.full(len(live), _NONE, np.int32))
            right = np.where(inner, ids[live, np.minimum(following, width)], -1)
            ranks = np.where(right >= 0, self.pair_rank(rank.astype(np.int64), np.maximum(right, 0)), _NONE)
            self._update(tree, width, live, at, ranks.astype(np.int32))
            has_left = np.flatnonzero(previous >= 0)
            if len(has_left):
                r, p = live[has_left], previous[has_left]
                ranks = self.pair_rank(ids[r, p], rank[has_left].astype(np.int64))
                self._update(tree, width, r, p, ranks)
            live = live[tree[live, 1] != _NONE]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].tolist()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _update(tree: np.ndarray, width: int, row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """Set one leaf per row and mend the nodes above it."""
        node = width + at
        tree[row, node] = rank
        while node[0] > 1:
            node = node // 2
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    # --- texts -----------------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text: its pretokens' ids one after the other."""
        found = [self.find(text) for text in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known = self.known
        fresh = list({piece for pieces in found for piece in pieces if piece not in known})
        merged = dict(zip(fresh, self.merge([piece.encode() for piece in fresh]), strict=True))
        known.update(merged)
        encoded = []
        for pieces in found:
            ids: list[int] = []
            for piece_ids in map(known.__getitem__, pieces):
                ids += piece_ids
            encoded.append(ids)
        for piece in fresh:
            if len(piece) > CACHE_CHARS:
                del known[piece]
        return encoded

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _tree_width(length: int) -> int:
    return max(2, 1 << (max(1, length) - 1).bit_length())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def byte_bpe(rank_file: str, pattern: str) -> ByteBpe:
    """The encoder of a worker, built once from the installed vocabulary."""
    return ByteBpe(read_ranks(rank_file), pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = byte_bpe(rank_file, pattern).encode_batch(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
        )

    return map_slices(id_and_text(docs), run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode and decode every document: counts and digests of the ids and of the decoded bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = byte_bpe(rank_file, pattern)
        encoded = coder.encode_batch(batch.column("text").to_pylist())
        counts, ids_digest, text_digest = [], [], []
        for ids in encoded:
            counts.append(len(ids))
            ids_digest.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_digest.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(id_and_text(docs), run, schema)
