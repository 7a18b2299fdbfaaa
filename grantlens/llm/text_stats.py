"""Counts over the words and bytes of whole texts, a column at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from grantlens.llm.batches import _BASE, _BYTE_VALUE, _INVERSE, _offsets, _power_table, mix

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_WIDE = _BYTES >= 0x80
_LETTER = _UPPER | _LOWER | _WIDE
_SHOUT = np.isin(_BYTES, [ord("!"), ord("?")])
_STOP = np.isin(_BYTES, [ord(c) for c in ".,;:!?"])
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#$%&*|~^<>{}[]\\=+@_"])
_TO_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)

# Second byte of two-byte capitals behind 0xC3 (the Latin-1 letters), which lower by 32.
_LATIN_LEAD = 0xC3


class Texts:
    """The bytes of a column of texts and where its rows and words are.

    A word is a run of bytes other than space and 0x09-0x0D.
    """

    def __init__(self, column: pa.Array) -> None:
        array = column.cast(pa.large_binary()).fill_null(b"")
        offsets = _offsets(array)
        self.data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n_rows = len(offsets) - 1
        self.n_bytes = np.diff(self.offsets)
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(self.data), dtype=bool)
        after[:-1] = inside[1:]
        self.begin = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.begin, self.offsets)
        self.n_words = np.diff(self.bounds)
        self.row = np.repeat(np.arange(self.n_rows), self.n_words)

    def bytes_of(self, kind: np.ndarray) -> np.ndarray:
        """How many bytes of each row are of a kind, given as a table of 256 flags."""
        return _sums(kind[self.data], self.offsets)

    def words_with(self, kind: np.ndarray) -> np.ndarray:
        """Per word, how many of its bytes are of a kind."""
        total = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.cumsum(kind[self.data], out=total[1:])
        return total[self.end] - total[self.begin]

    def distinct(self, hashes: np.ndarray) -> np.ndarray:
        """How many different words, given by hash, each row has."""
        seen = np.sort((hashes & np.uint64(2**44 - 1)) | (self.row.astype(np.uint64) << np.uint64(44)))
        fresh = np.ones(len(seen), dtype=bool)
        fresh[1:] = seen[1:] != seen[:-1]
        return np.bincount((seen[fresh] >> np.uint64(44)).astype(np.int64), minlength=self.n_rows)

    def per_row(self, flag: np.ndarray) -> np.ndarray:
        """Sum of a value per word over each row."""
        return np.bincount(self.row, weights=flag, minlength=self.n_rows)

    def hashes(self, data: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word over ``data`` (one byte per byte of the texts), skipping bytes not kept."""
        data = self.data if data is None else data
        if not len(self.begin):
            return np.empty(0, np.uint64)
        keep = ~_SPACE[self.data] if keep is None else keep & ~_SPACE[self.data]
        place = np.zeros(len(keep) + 1, dtype=np.int32)
        np.cumsum(keep, out=place[1:])
        kept = data[keep]
        first, last = place[self.begin], place[self.end]
        value = _BYTE_VALUE[kept] * _power_table(_BASE, "up", len(kept))[: len(kept)]
        total = np.zeros(len(kept) + 1, dtype=np.uint64)
        np.cumsum(value, out=total[1:])
        size = (last - first).astype(np.uint64)
        first_power = _power_table(_INVERSE, "down", len(kept) + 1)[first]
        return mix((total[last] - total[first]) * first_power + size * np.uint64(0x632BE59BD9B4E019))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_hash(word: str) -> int:
    """The hash that ``Texts.hashes`` gives a word."""
    return int(Texts(pa.array([word])).hashes()[0])


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes."""
    low = _TO_LOWER[data]
    behind = np.zeros(len(data), dtype=bool)
    behind[1:] = data[:-1] == _LATIN_LEAD
    capital = behind & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low[capital] += 0x20
    return low


def rate(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole, 0 where there is nothing."""
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)
