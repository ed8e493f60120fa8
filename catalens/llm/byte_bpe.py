"""Byte-level BPE: texts to token ids and back, equal to the rank file's own library.

A text is cut by the pattern; each distinct piece of a batch is merged once.
Pieces of equal or similar length form a padded matrix, one row a piece. In each round
every row merges its leftmost pair of minimum rank; ranks come from a hash table
of pairs, rows without a pair left are taken out, and the matrix loses a column.
Pieces longer than ``LONG`` bytes are merged one by one with a heap, in
n log n steps and with the same result.

Ids are kept as little-endian unsigned 32-bit integers in a binary column.
Cases: a null or empty text has no ids and decodes to nothing; null ids decode to
nothing. Repeated rows are encoded alike. Columns of the input that carry the
name of a result are replaced, all others are kept. Memory is bounded by one
batch of about ``words.SLICE_BYTES`` of text, or one text, and the cache of parts.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalens.llm import words

LONG = 256
CACHED_PARTS = 400_000
_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two neighbouring tokens make, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            slots, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots], self.ranks[slots] = keys[put], rank[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        splits = [
            (self.rank[token[:i]], self.rank[token[i:]], rank)
            for token, rank in self.rank.items()
            for i in range(1, len(token))
            if token[:i] in self.rank and token[i:] in self.rank
        ]
        left, right, rank = np.array(splits, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank.astype(np.int32))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.rank.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(len(piece) if len(piece) <= 32 else 32 * (len(piece) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            for at in range(0, len(rows), 4096):
                self._merge_rows(pieces, rows[at : at + 4096], out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: list[int], out: list[bytes]) -> None:
        index = np.array(rows)
        lengths = np.array([len(pieces[i]) for i in rows])
        width = int(lengths.max())
        padded = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        tokens = self.byte[padded]
        ranks = np.full((len(rows), width), _NONE, np.int32)  # the last column has no right neighbour
        ranks[:, :-1] = self.pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(rows), -1)
        ranks[np.arange(width) >= lengths[:, None] - 1] = _NONE
        while len(index):
            best = ranks.argmin(1)
            line = np.arange(len(index))
            lowest = ranks[line, best]
            over = lowest == _NONE
            if over.any():
                packed, step = tokens[over].astype("<u4").tobytes(), 4 * tokens.shape[1]
                for n, (i, size) in enumerate(zip(index[over].tolist(), lengths[over].tolist())):
                    out[i] = packed[n * step : n * step + 4 * size]
                stay = ~over
                index, lengths, tokens, ranks, best, lowest = (x[stay] for x in (index, lengths, tokens, ranks, best, lowest))
                if not len(index):
                    return
                line = np.arange(len(index))
            tokens[line, best] = lowest
            keep = np.ones(tokens.shape, bool)
            keep[line, best + 1] = False
            width = tokens.shape[1] - 1
            # The pair to the right takes the place of the merged one; both neighbours are looked up anew.
            tokens, ranks = tokens[keep].reshape(-1, width), ranks[keep].reshape(-1, width)
            lengths = lengths - 1
            for place in (best, best - 1):
                valid = (place >= 0) & (place < lengths - 1)
                row, column = line[valid], place[valid]
                ranks[row, column] = self.pairs(tokens[row, column], tokens[row, column + 1])
                ranks[line[~valid & (place >= 0)], place[~valid & (place >= 0)]] = _NONE

    def _merge_long(self, piece: bytes) -> bytes:
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        following = list(range(1, len(parts) + 1))
        previous = list(range(-1, len(parts) - 1))
        heap = [(self.rank[pair], i, pair) for i in range(len(parts) - 1) if (pair := piece[i : i + 2]) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = following[i]
            if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(pair):
                continue
            parts[i], parts[j] = pair, None
            following[i] = following[j]
            if following[j] < len(parts):
                previous[following[j]] = i
            for a, b in ((previous[i], i), (i, following[i])):
                if a >= 0 and b < len(parts) and (new := parts[a] + parts[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[new], a, new))
        return b"".join(self.rank[part].to_bytes(4, "little") for part in parts if part is not None)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Packed ids of whole texts; remembers what it has merged.

    ``pattern`` must take a space that stands before a non-space together with
    it, as the public rank files' pattern does. A text cut at its spaces then
    falls into parts that are merged independently, and a part that occurs again
    is looked up. A text with a space next to other white space is cut by the
    pattern alone.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes | None] = {}

    def _merged(self, pieces: list[str]) -> dict[str, bytes]:
        distinct = list(set(pieces))
        return dict(zip(distinct, self.vocabulary.merge([piece.encode() for piece in distinct])))

    def _learn(self, parts: set[str]) -> None:
        """The ids of each part with a space before it; None if the part can't stand alone."""
        new = list(parts - self.known.keys())
        if len(self.known) + len(new) > CACHED_PARTS:
            self.known, new = {}, list(parts)
        alone = [part for part in new if part and not part[0].isspace() and not part[-1].isspace()]
        self.known.update(dict.fromkeys(new))
        pieces = self.pattern.findall(" " + " ".join(alone)) if alone else []
        merged = self._merged(pieces)
        begins = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        ids = list(map(merged.__getitem__, pieces))
        for part, i, j in zip(alone, begins, [*begins[1:], len(pieces)]):
            self.known[part] = ids[i] if j == i + 1 else b"".join(ids[i:j])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids by the pattern alone, in portions of pieces."""
        out = [b""] * len(texts)
        pieces: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            merged = self._merged(pieces)
            at = 0
            for i, count in owners:
                out[i] += b"".join(map(merged.__getitem__, pieces[at : at + count]))
                at += count
            pieces.clear()
            owners.clear()

        for i, text in enumerate(texts):
            found = (m.group() for m in self.pattern.finditer(text))
            while part := list(islice(found, 100_000)):
                pieces.extend(part)
                owners.append((i, len(part)))
                if len(pieces) >= 100_000:
                    flush()
        flush()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [text.split(" ") for text in texts]
        # The first part has no space before it.
        head = [part.pop(0) for part in parts]
        self._learn(set().union(*parts))
        ids = [list(map(self.known.__getitem__, part)) for part in parts]
        for i, text in enumerate(texts):
            if None in ids[i] or (parts[i] and head[i] and head[i][-1].isspace()):
                head[i], ids[i] = text, []
        return [start + b"".join(rest) for start, rest in zip(self._plain(head), ids)]


def _with(batch: pa.RecordBatch, names: list[str], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], [*names, *columns])


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids; ``ranks`` is a rank file that every executor has."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in words.slices(batches, text_col):
            ids = encoder(batch.column(text_col).fill_null("").to_pylist())
            yield _with(batch, names, {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(names).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the bytes that the ids stand for in ``decoded``."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(ranks).token.__getitem__
        for batch in words.slices(batches, ids_col):
            ids = batch.column(ids_col).to_pylist()
            yield _with(batch, names, {"decoded": pa.array([b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids], pa.binary())})

    return encoded.select(names).mapInArrow(run, T.StructType([*encoded.select(names).schema.fields, T.StructField("decoded", T.BinaryType())]))
