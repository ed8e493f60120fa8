"""Alignment of two tokenisations of the same bytes, and corpus-wide counts of aligned token pairs.

A text is encoded by a byte-level BPE (A, over a space and the text) and a sentencepiece
model (B, which adds that space itself). Where the byte offsets at which tokens end are common to
both, the text is cut into groups. The shorter list of ends drives a galloping search of the longer one, all
texts of a slice at once; common places cut the lists, and their differences are the sizes of the
overlaps. Every A token and B token of one group are linked.

A pair's count is the number of documents that hold it linked. Tasks write blocks of documents, send each
block's different pairs once, and get back their counts; so a pair that all documents hold is one row a block
in the shuffle. Blocks are of bounded size, a long text apart; links are expanded in pieces of bounded size.

A is encoded with the `tiktoken` library from the vocabulary of the JSON file, texts with a run of
``LONG`` letters or blanks with the `tokenizers` library; the ids are the same.

Cases: texts that are null, empty or do not come back byte by byte from either tokeniser have no tokens:
zeros and an empty ``groups``. Rows without an id, or that repeat one, are documents of their own. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm import words
from catalens.llm.galloping import common
from catalens.session import staged

LONG = 1000
BLOCK_BYTES = 16_000_000
LINKS = 4_000_000
#: A link of a text is one number: 21 bits of the A id, 24 of the B id, 18 of the text's place in its part.
_B_BITS, _TEXT_BITS = 24, 18


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class Pieces:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.length[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.data[shift + np.arange(len(shift))]


@cache
def _byte_bpe(path: str, pattern: str):
    """Encoder of lists of texts, and the pieces."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    model = json.load(open(path, encoding="utf-8"))
    vocab = {**model["model"]["vocab"], **{t["content"]: t["id"] for t in model["added_tokens"]}}
    special = {t["id"] for t in model["added_tokens"]}
    alphabet = byte_alphabet()
    tokens = [b""] * (max(vocab.values()) + 1)
    for entry, number in vocab.items():
        tokens[number] = entry.encode() if number in special else bytes(alphabet[c] for c in entry)
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"the merges of {path} are not in the order of their ids")
    fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if t and i not in special}, special_tokens={})

    @cache
    def slow() -> Tokenizer:
        """Read when a text asks for it: few workers meet one."""
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return whole

    def encode(texts: list[str], long: np.ndarray) -> list[list[int]]:
        return [slow().encode(t, add_special_tokens=False).ids if is_long else fast.encode_ordinary(t) for t, is_long in zip(texts, long)]

    return encode, Pieces(tokens)


@cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
    return partial(model.encode, num_threads=1), Pieces(tokens)


def _let_go() -> None:
    """Give back the vocabularies and buffers that encoding leaves in a worker which is used again."""
    _byte_bpe.cache_clear()
    _pieces.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    # Where the C library can, freed memory goes back to the machine.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _long(texts: list[bytes]) -> np.ndarray:
    """Which texts have a run of ``LONG`` bytes without a change between blank and other bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    blank = _BLANK[data]
    first = np.append(0, np.cumsum(size))
    changes = np.append(False, blank[1:] != blank[:-1]) if len(data) else np.empty(0, bool)
    changes[first[:-1][size > 0]] = True
    begin = np.append(np.flatnonzero(changes), len(data))
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(first, begin[:-1][np.diff(begin) >= LONG], "right") - 1] = True
    return out


def _widths(a: Pieces, b: Pieces) -> tuple[type, type]:
    """Types that hold the ids."""
    if len(a.length) > 1 << 63 - _B_BITS - _TEXT_BITS or len(b.length) > 1 << _B_BITS:
        raise ValueError("a vocabulary is too large")
    return tuple(np.uint16 if len(p.length) <= 65536 else np.uint32 for p in (a, b))


def _decimals(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every id with room for a sign behind them, and their number."""
    digits = np.char.mod("%d", np.arange(vocabulary)).astype("S")
    size = np.char.str_len(digits)
    table = np.zeros((vocabulary, digits.dtype.itemsize + 1), np.uint8)
    table[:, :-1] = digits.view(np.uint8).reshape(vocabulary, -1)
    return table, size


def cuts(ends_a: np.ndarray, docs_a: np.ndarray, ends_b: np.ndarray, docs_b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and B that end together; texts are numbered and follow one another."""
    a, b = docs_a << 40 | ends_a, docs_b << 40 | ends_b
    shorter = np.bincount(docs_a, minlength=count) <= np.bincount(docs_b, minlength=count)
    mine, theirs = np.flatnonzero(shorter[docs_a]), np.flatnonzero(~shorter[docs_b])
    one = common(a[mine], b)
    two = common(b[theirs], a)
    at_a, at_b = np.concatenate([mine[one[0]], two[1]]), np.concatenate([one[1], theirs[two[0]]])
    order = np.argsort(at_a)
    return at_a[order], at_b[order]


def links(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, owner: np.ndarray, most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, pair and number of occurrences of the links of groups that end at ``at_a`` and ``at_b``, in pieces.

    A piece holds whole texts' groups or a share of them: about ``most`` links. A pair of a text can come again.
    """
    start_a, start_b = np.append(0, at_a[:-1] + 1), np.append(0, at_b[:-1] + 1)
    n_a, n_b = at_a - start_a + 1, at_b - start_b + 1
    total = np.cumsum(n_a * n_b)
    low = 0
    while low < len(total):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + most, "right")))
        if total[high - 1] - before > most:  # one long group: its different ids, not its places
            ids_a, times_a = np.unique(a[start_a[low] : at_a[low] + 1], return_counts=True)
            ids_b, times_b = np.unique(b[start_b[low] : at_b[low] + 1], return_counts=True)
            step = max(1, most // len(ids_b))
            for k in range(0, len(ids_a), step):
                pair = (ids_a[k : k + step, None].astype(np.int64) << _B_BITS | ids_b).ravel()
                yield np.full(len(pair), owner[low]), pair, (times_a[k : k + step, None] * times_b).ravel()
        else:
            size = (n_a * n_b)[low:high]
            group = np.repeat(np.arange(low, high), size)
            place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
            pair = a[start_a[group] + place // n_b[group]].astype(np.int64) << _B_BITS | b[start_b[group] + place % n_b[group]]
            yield owner[group], pair, np.ones(len(pair), np.int64)
        low = high


def _starts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def _distinct(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair and occurrences of every different (text, pair), by pair."""
    key = pairs << _TEXT_BITS | docs
    if (times == 1).all():
        key.sort()
        start = _starts(key)
        times = np.diff(np.append(start, len(key)))
    else:
        order = np.argsort(key)
        key = key[order]
        start = _starts(key)
        times = np.add.reduceat(times[order], start)
    key = key[start]
    return key & (1 << _TEXT_BITS) - 1, key >> _TEXT_BITS, times


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _groups(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, owner: np.ndarray, count: int, text_a, text_b) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text: ids of each group."""
    start_a, start_b = np.append(0, at_a[:-1] + 1), np.append(0, at_b[:-1] + 1)
    n_a, n_b = at_a - start_a + 1, at_b - start_b + 1
    first = np.cumsum(n_a + n_b) - n_a - n_b
    total = int((n_a + n_b).sum())
    width = max(text_a[0].shape[1], text_b[0].shape[1])
    rows, sizes, sign = np.zeros((total, width), np.uint8), np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
    group_a, group_b = np.repeat(np.arange(len(at_a)), n_a), np.repeat(np.arange(len(at_b)), n_b)
    for ids, place, (table, digits) in ((a, first[group_a] + np.arange(len(a)) - start_a[group_a], text_a), (b, first[group_b] + n_a[group_b] + np.arange(len(b)) - start_b[group_b], text_b)):
        rows[place, : table.shape[1]] = table[ids]
        sizes[place] = digits[ids]
    sign[first + n_a - 1] = ord("|")
    sign[first + n_a + n_b - 1] = ord(";")
    rows[np.arange(total), sizes] = sign
    sizes += 1
    flat = rows[np.arange(width) < sizes[:, None]]
    ends = np.append(0, np.cumsum(sizes))
    token = np.append(first, total)
    group = np.searchsorted(owner, np.arange(count + 1))
    low, high = ends[token[group[:-1]]], ends[token[group[1:]]]
    return [flat[x : max(x, y - 1)].tobytes() for x, y in zip(low.tolist(), high.tolist())]


def _encode(byte_bpe: tuple[str, str], pieces: str, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, bytes_a), (encode_b, bytes_b) = _byte_bpe(*byte_bpe), _pieces(pieces)
        text_a, text_b = _decimals(len(bytes_a.length)), _decimals(len(bytes_b.length))
        press = zstandard.ZstdCompressor(3)
        small = _widths(bytes_a, bytes_b)
        block, filled = TaskContext.get().partitionId() << 32, 0
        most = 1 << _TEXT_BITS
        for batch in (part.slice(at, most) for part in words.slices(batches, "text", slice_bytes) for at in range(0, part.num_rows, most)):
            if filled >= BLOCK_BYTES:
                block, filled = block + 1, 0
            texts = [t or "" for t in batch.column("text").to_pylist()]
            spaced = [(" " + t).encode() if t else b"" for t in texts]
            filled += sum(map(len, spaced))
            a, n_a = _flat([e if s else [] for e, s in zip(encode_a([" " + t for t in texts], _long(spaced)), spaced)])
            b, n_b = _flat([e if s else [] for e, s in zip(encode_b(texts), spaced)])
            for ids, counts, vocabulary in ((a, n_a, bytes_a), (b, n_b, bytes_b)):
                same, edge = vocabulary.joined(ids).tobytes(), np.append(0, np.cumsum(vocabulary.length[ids]))[np.append(0, np.cumsum(counts))].tolist()
                for i, s in enumerate(spaced):
                    if s and same[edge[i] : edge[i + 1]] != s:
                        spaced[i] = b""
            good = np.array([bool(s) for s in spaced])
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            ends, docs = [], []
            for ids, counts, vocabulary in ((a, n_a, bytes_a), (b, n_b, bytes_b)):
                end = np.append(0, np.cumsum(vocabulary.length[ids]))
                first = np.cumsum(counts) - counts
                docs.append(np.repeat(np.arange(len(texts)), counts))
                ends.append(end[1:] - np.repeat(end[first], counts))
            at_a, at_b = cuts(ends[0], docs[0], ends[1], docs[1], len(texts))
            owner = docs[0][at_a]
            size = np.diff(np.append(-1, at_a)) * np.diff(np.append(-1, at_b))
            n_groups = np.bincount(owner, minlength=len(texts))
            at = np.append(0, np.cumsum(size))[np.searchsorted(owner, np.arange(len(texts) + 1))]
            strings = _groups(a, b, at_a, at_b, owner, len(texts), text_a, text_b)
            marks = []
            for places, total in ((at_a, len(a)), (at_b, len(b))):
                flags = np.zeros(total, bool)
                flags[places] = True
                marks.append(flags)
            data = press.compress(b"".join(x.tobytes() for x in (a.astype(small[0]), b.astype(small[1]), np.packbits(marks[0]), np.packbits(marks[1]))))
            hashed = [hashlib.sha256(s).hexdigest() if s else "" for s in strings]
            columns = [batch.column("key"), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, np.diff(at))), pa.array(hashed, pa.string())]
            whole = pa.array([0, len(texts)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.ListArray.from_arrays(whole, c) for c in columns), pa.array([data], pa.binary())], ["block", *_COLUMNS, "packed"])

    return run


_COLUMNS = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _read(row: pa.RecordBatch | pa.Table, wide: tuple[type, type]) -> tuple[np.ndarray, ...]:
    """Ids, places of common ends and texts of a slice written by `_encode`."""
    counts = [np.array(row.column(c)[0].as_py(), np.int64) for c in ("n_a", "n_b")]
    data, at = zstandard.ZstdDecompressor().decompress(row.column("packed")[0].as_py()), 0
    ids, marks = [], []
    for n, kind in zip(counts, wide):
        ids.append(np.frombuffer(data, kind, int(n.sum()), at))
        at += ids[-1].nbytes
    for n in counts:
        marks.append(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -(-int(n.sum()) // 8), at), count=int(n.sum()))))
        at += -(-int(n.sum()) // 8)
    return *(x.astype(np.int64) for x in ids), *marks, np.repeat(np.arange(len(counts[0])), counts[0])[marks[0]]


def _of_documents(read: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair and occurrences of every different (text, pair); pieces of a text of more than ``LINKS`` links are joined."""
    pieces = [_distinct(*piece) for piece in links(*read)]
    if len(pieces) == 1:
        return pieces[0]
    return _distinct(*(np.concatenate(x) for x in zip(*pieces))) if pieces else (np.empty(0, np.int64),) * 3


def _asked(wide: tuple[type, type]):
    """The different pairs of each block, with the number of its documents that hold them."""

    def told(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(pairs)
        pairs = pairs[order]
        start = _starts(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), block)), pa.array(pairs[start]), pa.array(np.add.reduceat(n[order], start))], ["block", "pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        block, held, size = None, [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("block")[row].as_py()
                if own != block or size > LINKS:
                    if held:
                        yield told(block, held)
                    block, held, size = own, [], 0
                _, pairs, _ = _of_documents(_read(batch.slice(row, 1), wide))
                start = _starts(pairs)
                if len(start):
                    held.append((pairs[start], np.diff(np.append(start, len(pairs)))))
                    size += len(start)
        if held:
            yield told(block, held)

    return run


def _sums(wide: tuple[type, type]):
    """Links with the highest count of their A id, and counts over all links, of a block's documents."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        # A worker that has encoded may get its first block here; buffers of the last block go too.
        _let_go()
        answers = answers.sort_by("pair")
        known, counts, best = (answers.column(c).to_numpy() for c in ("pair", "n", "best"))
        out = []
        for row in range(len(rows)):
            one = rows.slice(row, 1)
            columns = {c: one.column(c).combine_chunks().flatten() for c in _COLUMNS}
            total = np.zeros((2, len(columns["key"])), np.int64)
            text, pairs, times = _of_documents(_read(one, wide))
            start = _starts(pairs)
            at = np.repeat(np.searchsorted(known, pairs[start]), np.diff(np.append(start, len(pairs))))
            np.add.at(total[0], text, times * best[at])
            np.add.at(total[1], text, times * counts[at])
            last = columns.pop("groups_sha256")
            out.append(pa.table({**columns, "n_best": total[0], "count_sum": total[1], "groups_sha256": last}))
        return pa.concat_tables(out)

    return run


def align(docs: DataFrame, byte_bpe: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (a, b, n: documents, best).

    ``byte_bpe`` is the JSON file of a byte-level BPE with its ``pattern``, ``pieces`` a sentencepiece model.
    """
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    wide = _widths(_byte_bpe(byte_bpe, pattern)[1], _pieces(pieces)[1])
    kind = texts.schema["key"].dataType.simpleString()
    lists = ", ".join(f"{c} array<{kind if c == 'key' else 'string' if c == 'groups_sha256' else 'long'}>" for c in _COLUMNS)
    columns = f"block long, {lists}, packed binary"
    aligned = staged(texts.mapInArrow(_encode((byte_bpe, pattern), pieces, slice_bytes), columns), "aligned-documents")
    asked = staged(aligned.mapInArrow(_asked(wide), "block long, pair long, n long"), "aligned-pairs")
    counts = staged(asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", _B_BITS)), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    known = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    answers = asked.select("block", "pair").join(known, "pair")
    result = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    found = aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sums(wide), result)
    pairs = known.select(F.shiftright("pair", _B_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b"), "n", "best")
    return found.withColumnRenamed("key", id_col), pairs
