"""Language-model scores: an interpolated modified Kneser-Ney bigram model over all training texts.

Words and pairs of neighbouring words are counted in Spark: tasks sort and add up what they read, send
compressed blocks to shards of the 64-bit hash range, and each shard merges its blocks into sorted
arrays in the shared checkpoint folder. Workers map those files into memory and look up with binary
search. Nothing of the corpus passes through the driver but sums per shard, and what each task wrote: a file
that a worker does not find as it was written is an error.

Model, for a word w after a context c, with counts n and discounts D(1), D(2), D(3+):

    p(w | c) = (n(c w) - D(n(c w))) / n(c) + back(c) * p(w)
    p(w) = (left(w) - D'(left(w))) / pairs + back' / (V + 1)

``left`` is the number of different contexts of w, ``back`` is what the discounts took, and V + 1 counts
the training vocabulary and one unknown word. A context that was never seen gives p(w). Tokens are
words and one end per text; a text's first context is a start that is no token.

Rows: every document once per input row; repeated rows count as often as they stand in training. Null or
empty text is one token, the end. Without training texts every probability is 1 / (V + 1) = 1. The
order is 2: tables of triples would pass the disk limit (see README). Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from grantlens.llm.batches import id_and_text, map_slices, mix, slices, word_hashes
from grantlens.workspace import Workspace

# Training text behind each shard, about, and the bounds of their number (powers of two).
SHARD_BYTES = 16_000_000
FEWEST_SHARDS, MOST_SHARDS = 16, 8_192

# Entries that a task adds up before it sends them on.
HELD_ENTRIES = 3_000_000

END = np.uint64(0xE1D0E1D0E1D0E1D1)

_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(pow(_MULTIPLIERS[1], -1, 2**64))
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))
    h = h * np.uint64(pow(_MULTIPLIERS[0], -1, 2**64))
    return h ^ (h >> np.uint64(32))


# --- blocks ----------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Compress numbers: bytes of the same weight together, then zstd."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(block: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = pa.decompress(block, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def _sorted_block(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _sorted_keys(block: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(block, n, np.uint64), dtype=np.uint64)


def add_up(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys and sum each column over equal keys."""
    if not len(keys):
        return (keys, *columns)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    return (keys[start], *(np.add.reduceat(column[order], start) for column in columns))


BLOCKS = "shard int, n int, keys binary, counts binary"


def _blocks(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per shard - the top bits of the key - of sorted keys and their counts."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in rows], pa.int32()),
            pa.array([b - a for _, a, b in rows], pa.int32()),
            pa.array([_sorted_block(keys[a:b]) for _, a, b in rows], pa.binary()),
            pa.array([pack(counts[a:b].astype(np.uint32)) for _, a, b in rows], pa.binary()),
        ],
        ["shard", "n", "keys", "counts"],
    )


def _counted(texts: DataFrame, keys_of, bits: int) -> DataFrame:
    """Blocks of the keys that ``keys_of`` gives for a column of texts, added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                keys = keys_of(part.column("text"))
                keys, counts = np.unique(keys, return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size >= HELD_ENTRIES:
                    merged = add_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [merged], len(merged[0])
                    if size >= HELD_ENTRIES // 2:
                        yield _blocks(*merged, bits)
                        held, size = [], 0
        if size:
            yield _blocks(*add_up(*(np.concatenate(x) for x in zip(*held, strict=True))), bits)

    return texts.mapInArrow(run, BLOCKS)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = table.column("n").to_pylist()
    keys = [_sorted_keys(b, n) for b, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
    counts = [unpack(b, n, np.uint32) for b, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]
    return add_up(np.concatenate(keys), np.concatenate(counts).astype(np.uint64))


# --- files ------------------------------------------------------------------------------


def shared_folder(uri: str) -> str:
    """The local path of a folder that every worker has mounted, as memory mapping needs one."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted spark.checkpoint.dir, not {parsed.scheme}://")
    return unquote(parsed.path) if parsed.scheme else uri


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark understands it: without a scheme, it lies in the default file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


# Bytes at either end of an array that its checksum covers, so that checking does not read whole models.
CHECKED_BYTES = 65_536

FILES = "files array<struct<name:string,entries:bigint,checksum:bigint>>"
FILES_TYPE = pa.list_(pa.struct([("name", pa.string()), ("entries", pa.int64()), ("checksum", pa.int64())]))


def _checksum(values: np.ndarray) -> int:
    flat = values.reshape(-1)
    width = max(1, CHECKED_BYTES // values.itemsize)
    return zlib.crc32(flat[-width:].tobytes(), zlib.crc32(flat[:width].tobytes()))


class Manifest:
    """What the tasks that wrote the arrays of a folder said about them, as the driver heard it."""

    def __init__(self, folder: str, files: Iterable[Row]) -> None:
        self.folder = folder
        self.files = {f.name: (f.entries, f.checksum) for f in files}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Manifest) and (self.folder, self.files) == (other.folder, other.files)

    def __hash__(self) -> int:
        return hash((self.folder, len(self.files)))


def _save(folder: str, name: str, values: np.ndarray) -> dict[str, object]:
    """Write an array under its final name at once, so that a task that runs twice does no harm."""
    os.makedirs(folder, exist_ok=True)
    scratch = f"{folder}/.{name}-{uuid.uuid4().hex}.npy"
    np.save(scratch, values)
    os.replace(scratch, f"{folder}/{name}.npy")
    return {"name": name, "entries": len(values), "checksum": _checksum(values)}


def _load(manifest: Manifest, name: str, kind: type) -> np.ndarray:
    """Map an array that was written; one without entries need not have been.

    An array that this machine does not see, or sees otherwise, is an error: what it holds would be taken for
    words that were never seen.
    """
    entries, checksum = manifest.files.get(name, (0, 0))
    if entries == 0:
        return np.empty(0, kind)
    path = f"{manifest.folder}/{name}.npy"
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} was written but is not here; all workers must share spark.checkpoint.dir")
    values = np.load(path, mmap_mode="r")
    if len(values) != entries or _checksum(values) != checksum:
        raise ValueError(f"{path} is not what was written")
    return values.view(np.ndarray)


class HashTable:
    """Sorted hash arrays of one kind, a file per shard of the hash range."""

    def __init__(self, manifest: Manifest, name: str, bits: int) -> None:
        self.bits = bits
        self.keys = [_load(manifest, f"{name}-{k}-keys", np.uint64) for k in range(1 << bits)]
        self.counts = [_load(manifest, f"{name}-{k}-counts", np.uint32) for k in range(1 << bits)]
        self.starts = np.concatenate([[0], np.cumsum([len(k) for k in self.keys])])

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among all keys (-1: none) and count of each sought key, which are sorted."""
        place = np.full(len(sought), -1, dtype=np.int64)
        count = np.zeros(len(sought), dtype=np.int64)
        edges = np.searchsorted(sought >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)):
            keys, part = self.keys[k], sought[edges[k] : edges[k + 1]]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            place[edges[k] : edges[k + 1]] = np.where(hit, at + self.starts[k], -1)
            count[edges[k] : edges[k + 1]] = np.where(hit, self.counts[k][at], 0)
        return place, count


class DenseTable:
    """Rows of numbers by identifier, a file per range of identifiers."""

    def __init__(self, manifest: Manifest, name: str, block: int, shards: int, width: int) -> None:
        self.block, self.width = block, width
        self.parts = [_load(manifest, f"{name}-{k}", np.int64) for k in range(shards)]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        found = np.zeros((len(ids), self.width), dtype=np.int64)
        shard = ids // self.block
        for k in np.unique(shard):
            if len(self.parts[k]):
                mine = shard == k
                found[mine] = self.parts[k][ids[mine] - k * self.block]
        return found


@lru_cache(maxsize=4)
def _table(kind: type, *arguments) -> HashTable | DenseTable:
    return kind(*arguments)


# --- fitting ----------------------------------------------------------------------------


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) from how many entries have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    guess = np.array([0.0, 0.5, 1.0, 1.5])  # where counts of counts are missing
    if min(n1, n2, n3, n4) <= 0:
        return guess
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.concatenate([[0.0], np.clip(found[1:], 0.05, [0.95, 1.95, 2.95])])


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, with an end after each text's words, and how many each text has."""
    words, bounds = word_hashes(column)
    n_tokens = np.diff(bounds) + 1
    tokens = np.full(len(words) + len(n_tokens), END)
    inside = np.ones(len(tokens), dtype=bool)
    inside[np.cumsum(n_tokens) - 1] = False
    tokens[inside] = words
    return tokens, n_tokens


@dataclass(frozen=True)
class BigramModel:
    manifest: Manifest
    bits: int
    n_tokens: int  # N
    n_words: int  # V
    n_pairs: int  # different pairs
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    left_over: float  # weight of the uniform distribution

    @property
    def block(self) -> int:
        return max(1, -(-(self.n_words + 1) // (1 << self.bits)))

    def words(self) -> HashTable:
        return _table(HashTable, self.manifest, "word", self.bits)

    def pairs(self) -> HashTable:
        return _table(HashTable, self.manifest, "pair", self.bits)

    def contexts(self) -> DenseTable:
        return _table(DenseTable, self.manifest, "context", self.block, 1 << self.bits, 4)

    def lefts(self) -> DenseTable:
        return _table(DenseTable, self.manifest, "left", self.block, 1 << self.bits, 1)

    def identify(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifier (-1: unknown) and training count of each token."""
        unique, inverse = np.unique(tokens, return_inverse=True)
        place, count = self.words().find(unique)
        return place[inverse], count[inverse]

    def pair_keys(self, ids: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and hashed pairs of a sequence; the start has the identifier V."""
        context = np.concatenate([[self.n_words], ids[:-1]])
        context[np.cumsum(n_tokens)[:-1]] = self.n_words
        joined = (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        return context, mix(joined)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, n_tokens = _sequence(batch.column("text"))
            row = np.repeat(np.arange(len(n_tokens)), n_tokens)
            ids, count = self.identify(tokens)
            base = np.log10((count + 1) / (self.n_tokens + self.n_words + 1))
            chance = np.log10(self._chances(ids, n_tokens))

            def total(values: np.ndarray) -> np.ndarray:
                return np.bincount(row, weights=values, minlength=len(n_tokens))

            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_tokens.astype(np.int64)),
                    pa.array(total(count > 0).astype(np.int64)),
                    pa.array(np.full(len(n_tokens), self.n_tokens, dtype=np.int64)),
                    pa.array(total(base)),
                    pa.array(total(chance)),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return map_slices(id_and_text(docs), run, schema)

    def _chances(self, ids: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        """p(w | c) of each token."""
        known = ids >= 0
        word_d, pair_d = np.array(self.word_discounts), np.array(self.pair_discounts)
        alone = np.full(len(ids), self.left_over / (self.n_words + 1))
        if self.n_pairs:
            unique, inverse = np.unique(ids[known], return_inverse=True)
            left = self.lefts().rows(unique)[:, 0]
            own = np.maximum(left - word_d[np.minimum(left, 3)], 0) / self.n_pairs
            alone[known] += own[inverse]
        context, keys = self.pair_keys(np.maximum(ids, 0), n_tokens)
        unique, inverse = np.unique(keys, return_inverse=True)
        _, count = self.pairs().find(unique)
        count = count[inverse]
        # An unknown word was given the identifier 0 for its key: it has no pairs, on either side.
        before = np.concatenate([[True], known[:-1]])
        before[np.cumsum(n_tokens)[:-1]] = True
        count[~known | ~before] = 0
        unique, inverse = np.unique(context, return_inverse=True)
        stats = self.contexts().rows(unique)
        seen = stats[:, 0].astype(float)
        taken = stats[:, 1:] @ pair_d[1:]
        total, back = seen[inverse], np.divide(taken, seen, out=np.ones(len(seen)), where=seen > 0)[inverse]
        total[~before], back[~before] = 0.0, 1.0
        direct = np.maximum(count - pair_d[np.minimum(count, 3)], 0)
        return np.divide(direct, total, out=np.zeros(len(ids)), where=total > 0) + back * alone


def fit(docs: DataFrame) -> BigramModel:
    """Count all given documents and write the model's arrays below the checkpoint folder."""
    spark = docs.sparkSession
    folder = shared_folder(qualified(spark, Workspace(spark).path)) + "/bigrams"
    texts = id_and_text(docs).select("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, max(FEWEST_SHARDS, size // SHARD_BYTES))
    bits = int(shards - 1).bit_length()

    def word_keys(column: pa.Array) -> np.ndarray:
        return _sequence(column)[0]

    def save_words(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        files = [
            _save(folder, f"word-{key[0].as_py()}-keys", keys),
            _save(folder, f"word-{key[0].as_py()}-counts", counts.astype(np.uint32)),
        ]
        return pa.table({"n": [len(keys)], "total": [int(counts.sum())], "files": pa.array([files], FILES_TYPE)})

    # A row per shard comes to the driver.
    words = _counted(texts, word_keys, bits).groupBy("shard").applyInArrow(save_words, f"n long, total long, {FILES}")
    written = words.collect()
    n_words, n_tokens = sum(w.n for w in written), sum(w.total for w in written)
    files = [f for w in written for f in w.files]
    if n_words >= 2**32 - 1:
        raise ValueError("the vocabulary passes 32 bits")
    ids_only = BigramModel(Manifest(folder, files), bits, n_tokens, n_words, 0, (0.0,) * 4, (0.0,) * 4, 1.0)

    def pair_keys(column: pa.Array) -> np.ndarray:
        tokens, lengths = _sequence(column)
        ids, _ = ids_only.identify(tokens)
        return ids_only.pair_keys(ids, lengths)[1]

    block = ids_only.block
    partial = "kind int, part int, n int, ids binary, numbers binary, total long, n1 long, n2 long, n3 long, n4 long"
    partial += f", {FILES}"

    def save_pairs(key: tuple, table: pa.Table) -> pa.Table:
        """Write a shard's pairs; pass on what it adds to its contexts (kind 0) and to its words (kind 1)."""
        keys, counts = _merged(table)
        files = [
            _save(folder, f"pair-{key[0].as_py()}-keys", keys),
            _save(folder, f"pair-{key[0].as_py()}-counts", counts.astype(np.uint32)),
        ]
        joined = unmix(keys)
        one = np.ones(len(keys), np.uint64)
        kinds = [one * (counts == 1), one * (counts == 2), one * (counts >= 3)]
        context, *numbers = add_up(joined >> np.uint64(32), counts, *kinds)
        word, left = add_up(joined & np.uint64(0xFFFFFFFF), one)
        rows = [(0, *row) for row in _by_part(context, np.stack(numbers, axis=1), block)]
        rows += [(1, *row) for row in _by_part(word, left[:, None], block)]
        found = [len(keys), *_count_of_counts(counts)]
        columns = list(zip(*rows, strict=True))
        sums = [[x] + [0] * (len(rows) - 1) for x in found]  # once per shard
        names = ["kind", "part", "n", "ids", "numbers", "total", "n1", "n2", "n3", "n4", "files"]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 5 + [FILES_TYPE]
        listed = [files] + [[]] * (len(rows) - 1)
        return pa.table([pa.array(c, t) for c, t in zip([*columns, *sums, listed], kinds, strict=True)], names=names)

    def save_sums(key: tuple, table: pa.Table) -> pa.Table:
        """Add up a range of contexts or words into a dense array."""
        kind, part = (x.as_py() for x in key)
        width = 1 if kind else 4
        ids, numbers = [], []
        for n, i, x in zip(*(table.column(c).to_pylist() for c in ("n", "ids", "numbers")), strict=True):
            ids.append(_sorted_keys(i, n))
            numbers.append(unpack(x, n * width, np.uint64).reshape(n, width))
        dense = np.zeros((block, width), dtype=np.int64)
        np.add.at(dense, (np.concatenate(ids) - np.uint64(part * block)).astype(np.int64), np.concatenate(numbers).astype(np.int64))
        files = [f for row in table.column("files").to_pylist() for f in row]
        files.append(_save(folder, f"{'left' if kind else 'context'}-{part}", dense))
        seen = _count_of_counts(dense[:, 0]) if kind else [0] * 4
        more = int((dense[:, 0] >= 3).sum()) if kind else 0
        own = {f"n{k + 1}": [sum(table.column(f"n{k + 1}").to_pylist())] for k in range(4)}
        words = {f"w{k + 1}": [seen[k]] for k in range(4)}
        total = [sum(table.column("total").to_pylist())]
        return pa.table({"total": total, **own, **words, "w3up": [more], "files": pa.array([files], FILES_TYPE)})

    pairs = _counted(texts, pair_keys, bits).groupBy("shard").applyInArrow(save_pairs, partial)
    result = "total long, n1 long, n2 long, n3 long, n4 long, w1 long, w2 long, w3 long, w4 long, w3up long"
    names = [part.split()[0] for part in result.split(", ")]
    # Two rows per shard come to the driver.
    summed = pairs.groupBy("kind", "part").applyInArrow(save_sums, f"{result}, {FILES}").collect()
    sums = {name: sum(row[name] for row in summed) for name in names}
    files += [f for row in summed for f in row.files]
    pair_d = discounts(np.array([sums[f"n{k}"] for k in (1, 2, 3, 4)]))
    word_d = discounts(np.array([sums[f"w{k}"] for k in (1, 2, 3, 4)]))
    n_pairs = sums["total"]
    taken = word_d[1] * sums["w1"] + word_d[2] * sums["w2"] + word_d[3] * sums["w3up"]
    left_over = taken / n_pairs if n_pairs else 1.0
    manifest = Manifest(folder, files)
    return BigramModel(manifest, bits, n_tokens, n_words, n_pairs, tuple(pair_d), tuple(word_d), float(left_over))


def _by_part(ids: np.ndarray, numbers: np.ndarray, block: int):
    """Sorted identifiers and their numbers, cut into ranges of ``block`` identifiers and packed."""
    part = (ids // np.uint64(block)).astype(np.int64)
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(ids)), strict=True):
        yield int(part[a]), int(b - a), _sorted_block(ids[a:b]), pack(numbers[a:b].astype(np.uint64).ravel())
