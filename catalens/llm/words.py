"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D. All functions take
whole columns; a document never shares a word with its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_CHUNK = 1 << 20
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Offsets that make one hash several.
STEPS = np.arange(1, 17, dtype=np.uint64) * _STEP

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SEPARATORS)] = False
#: Letters, digits and all bytes beyond ASCII: words without punctuation.
ALPHANUMERIC = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_EXACT[list(_SEPARATORS)] = 0
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]


@dataclass
class Texts:
    """Some documents: their bytes, where each starts, and where each word starts and ends."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per document the index of its first word; one more entry at the end
    inside: np.ndarray  # which byte values words are made of

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of every word; ``lower`` takes A-Z as a-z."""
        table = (_LOWER if lower else _EXACT) * self.inside
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, begin + _CHUNK, "right")))
            starts = self.starts[at:stop] - begin
            lengths = self.ends[at:stop] - self.starts[at:stop]
            values = table[self.data[begin : self.ends[stop - 1]]]
            spans = np.diff(np.append(starts, len(values)))
            place = np.arange(len(values)) - np.repeat(starts, spans)
            powers = _powers(int(spans.max()))
            values *= powers[place]
            out[at:stop] = mix(np.add.reduceat(values, starts) ^ (lengths.astype(np.uint64) * _STEP))
            at = stop
        return out

    def characters(self) -> np.ndarray:
        """Code points per document inside words."""
        lead = ((self.data & 0xC0) != 0x80) & self.inside[self.data]
        total = np.concatenate([[0], np.cumsum(lead)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word(self, index: int) -> bytes:
        return self.data[self.starts[index] : self.ends[index]].tobytes()

    def document(self, index: int) -> bytes:
        return self.data[self.offsets[index] : self.offsets[index + 1]].tobytes()


_POWERS = np.ones(1, np.uint64)


def _powers(count: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < count:
        powers = np.full(max(count, 64), np.uint64(0xC2B2AE3D27D4EB4F))
        powers[0] = 1
        _POWERS = np.multiply.accumulate(powers)
    return _POWERS


def split(column: pa.Array, word_bytes: np.ndarray = _IS_WORD) -> Texts:
    """The words of a string column; a null is a text without words."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    closes = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    return Texts(data, offsets, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets), word_bytes)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbours; position i covers i to i + width - 1."""
    count = max(len(hashes) - width + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(width):
        out *= _GRAM
        out += hashes[k : k + count]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about ``limit`` bytes of text, and one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
