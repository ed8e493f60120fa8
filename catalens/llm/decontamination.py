"""Benchmark passages in documents, found by spaced seeds.

A mask of ones and zeros slides over the words and hashes only the words under
its ones, so that a changed word under a zero does not hide a passage. The masks
are chosen so that every run of ``WHOLE`` words or more with three quarters of them
equal, wherever the others stand, has a place for one of them; items shorter than
that have masks of their own. A filter of all item hashes, sent to every task, picks
the places in documents worth a look. It has ``SLOTS`` bytes a hash, between the stated
sizes, and tells how long the items of a hash are at most, so that a place carries
the words that they can cover and no more. Those hashes are joined
with the items' and every hit is verified: its diagonal counts if any run of
``min_words`` words (or all of a shorter item) has ``min_share`` of them equal.
Reported is the run with most equal words, without unequal ones at its edges as
long as it has words enough.

Words are runs of letters and digits, A-Z as a-z. Only places that pass the
filter are shuffled. Equal items are joined once and listed again at the end; a
passage in a third of all documents is as many independent rows.

Cases: a null or empty text or item has no words and no overlap; an item with
fewer than ``SHORT`` words is never sought, it is no evidence. Rows that repeat
give one result row per id and item. Null ids are reported as such. Empty tables
give no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm import blocks, words
from catalens.llm.names import fresh
from catalens.session import staged

SHORT, WHOLE = 5, 12
#: Bytes of the filter for each hash, and its least and largest size as powers of two (64 MB).
SLOTS, LEAST_BITS, MOST_BITS = 64, 22, 26
#: A run of 24 words has a half of at least its share, so covering 12 to 23 words covers all.
MASKS = ("111011", "1100001011", "11010011", "110100000011")
#: For items of 5 to 11 words, as wholes.
SHORT_MASKS = ("11011", "1111", "1100011", "10111", "11101")


def _seeds(hashes: np.ndarray, number: int, mask: str) -> np.ndarray:
    """Hash of the words under the mask's ones, for every place of the mask."""
    count = max(len(hashes) - len(mask) + 1, 0)
    out = np.full(count, words.STEPS[number])
    for k, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ hashes[k : k + count]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
    return out


def _masks(min_words: int, min_share: float) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Masks of items of ``WHOLE`` words or more, and of shorter ones."""
    if min_words >= WHOLE and min_share >= 0.75:
        return MASKS, SHORT_MASKS
    # Anything looser is sought by the longest run of equal words that no allowed pattern can do without.
    least = max(min(min_words, SHORT), 1)
    changed = {n: math.floor(n * (1 - min_share) + 1e-9) for n in range(least, 2 * max(min_words, WHOLE))}
    run = min(-(-(n - c) // (c + 1)) for n, c in changed.items())
    if run < 1:
        raise ValueError("min_share allows overlaps without an equal word")
    return ("1" * run,), ("1" * run,)


def _item_seeds(hashes: np.ndarray, masks: tuple[tuple[str, ...], tuple[str, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for number, mask in _numbered(masks, len(hashes) >= WHOLE, len(hashes) < WHOLE):
        found = _seeds(hashes, number, mask)
        yield found, np.arange(len(found))


def _numbered(masks: tuple[tuple[str, ...], tuple[str, ...]], long: bool, short: bool) -> list[tuple[int, str]]:
    """The masks of long or short items or both, each with its number among all."""
    return [(n, mask) for n, mask in enumerate(masks[0] + masks[1]) if (long if n < len(masks[0]) else short)]


def _first(seeds: np.ndarray, bits: int) -> np.ndarray:
    return (seeds >> np.uint64(64 - bits)).astype(np.int32)


def _second(seeds: np.ndarray, bits: int) -> np.ndarray:
    return _first(seeds * np.uint64(0x9E3779B97F4A7C15), bits)


def _places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each seed in the filter."""
    return _first(seeds, bits), _second(seeds, bits)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        text = words.split(batch.column("text"), words.ALPHANUMERIC)
        hashes = text.hashes(lower=True)
        tokens = [hashes[text.first[i] : text.first[i + 1]].tobytes() for i in range(len(text))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(tokens, pa.binary())], ["item_id", "tokens"])


def _seed_rows(masks: tuple[tuple[str, ...], tuple[str, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, tokens in zip(batch.column("item").to_pylist(), batch.column("tokens").to_pylist()):
                if len(tokens) < 8 * SHORT:
                    continue
                for seeds, places in _item_seeds(np.frombuffer(tokens, np.uint64), masks):
                    columns = [pa.array(seeds.view(np.int64)), pa.array([item] * len(seeds), pa.int64()), pa.array(places.astype(np.int32))]
                    columns.append(pa.array([len(tokens) // 8] * len(seeds), pa.int32()))
                    yield pa.RecordBatch.from_arrays(columns, ["seed", "item", "item_at", "n_words"])

    return run


def filter_size(seeds: int) -> int:
    """Bits of a place in a filter of so many seeds."""
    return min(max(math.ceil(math.log2(max(seeds, 1) * SLOTS)), LEAST_BITS), MOST_BITS)


def _filters(bits: int):
    """For every place of the filter 1 + the logarithm of its longest item's words, rounded up; 0 without an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            level = 1 + np.ceil(np.log2(batch.column("n_words").to_numpy())).astype(np.uint8)
            for place in _places(batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.maximum.at(table, place, level)
        yield blocks.cut(table, 16)

    return run


def _regions(shared, bits: int, masks: list[tuple[int, str]]):
    """Places that pass the filter, with the words around them up to the length of an item that can be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for batch in words.slices(batches):
            text = words.split(batch.column("text"), words.ALPHANUMERIC)
            hashes = text.hashes(lower=True)
            owner = text.document_of_word()
            at, seeds, reach = [], [], []
            for number, mask in masks:
                found = _seeds(hashes, number, mask)
                level = table[_first(found, bits)]
                hit = np.flatnonzero(level)
                # An item of the seed is in both places, so the lesser one bounds it.
                level = np.minimum(level[hit], table[_second(found[hit], bits)])
                kept = (level > 0) & (owner[hit] == owner[hit + len(mask) - 1])
                at.append(hit[kept])
                seeds.append(found[hit[kept]])
                reach.append(np.int64(1) << (level[kept].astype(np.int64) - 1))
            at, reach = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (at, reach))
            seeds = np.concatenate(seeds or [np.empty(0, np.uint64)])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, seeds, reach = at[order], seeds[order], reach[order]
            new = np.flatnonzero((np.diff(at) > np.maximum(reach[1:], reach[:-1])) | (np.diff(owner[at]) > 0)) + 1
            bounds = np.concatenate([[0], new, [len(at)]])
            lows = np.minimum.reduceat(at - reach, bounds[:-1])
            highs = np.maximum.reduceat(at + reach, bounds[:-1]) + WHOLE
            rows = []
            for a, b, low, high in zip(bounds[:-1], bounds[1:], lows, highs):
                document = owner[at[a]]
                low = max(text.first[document], low)
                high = min(text.first[document + 1], high)
                rows.append((document, low - text.first[document], hashes[low:high].tobytes(), seeds[a:b].view(np.int64), (at[a:b] - low).astype(np.int32)))
            which = pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(which),
                    batch.column("text_hash").take(which),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[4] for r in rows], pa.list_(pa.int32())),
                ],
                ["doc_id", "text_hash", "start", "words", "seeds", "places"],
            )

    return run


def best_run(equal: np.ndarray, need: int, min_share: float) -> tuple[int, int] | None:
    """Start and end of the run with most equal words, then fewest words, among those of ``need`` words with ``min_share`` equal."""
    if len(equal) < need or not equal.any():
        return None
    count = np.concatenate([[0], np.cumsum(equal)])
    level = count - min_share * np.arange(len(count))
    # The farthest end at which each start still has its share: more words have as many equal ones at least.
    highest = np.maximum.accumulate(level[::-1])
    end = len(level) - 1 - np.searchsorted(highest, level - 1e-9)
    start = np.arange(len(level))
    fit = np.flatnonzero(end - start >= need)
    if not len(fit):
        return None
    start, end = start[fit], end[fit]
    most = count[end] - count[start]
    start, end = start[most == most.max()], end[most == most.max()]
    # Unequal words at the edges go, the first ones first, while ``need`` are left.
    places = np.flatnonzero(equal)
    first, last = places[count[start]], places[count[end] - 1] + 1
    a = np.minimum(first, end - need)
    b = np.maximum(last, a + need)
    best = int(np.argmin(b - a))
    return int(a[best]), int(b[best])


def _verify(min_words: int, min_share: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (text, item, start, shifts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "tokens", "start", "shifts")))):
                text, item = np.frombuffer(text, np.uint64), np.frombuffer(item, np.uint64)
                best = None
                for shift in sorted(shifts):
                    low, high = max(0, -shift), min(len(item), len(text) - shift)
                    equal = text[low + shift : high + shift] == item[low:high]
                    run = best_run(equal, min(min_words, len(item)), min_share)
                    if run is None:
                        continue
                    a, b = run
                    found = (int(equal[a:b].sum()), a - b, start + low + a + shift, low + a)
                    if best is None or found[:2] > best[:2]:
                        best = found
                if best:
                    out.append((row, best[2], best[3], -best[1], best[0]))
            which = pa.array([o[0] for o in out], pa.int64())
            columns = [batch.column(c).take(which) for c in ("doc_id", "text_hash", "item")]
            columns += [pa.array([o[k] for o in out], pa.int32()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "item", "doc_word", "item_word", "n_words", "n_equal"])

    return verify


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_share: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, doc_word, item_word, n_words, n_equal: the best overlap of each document and item."""
    spark = docs.sparkSession
    raw = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    named = staged(raw.mapInArrow(_items, "item_id long, tokens binary"), "benchmark-items")
    items = staged(named.where(F.length("tokens") > 0).groupBy("tokens").agg(F.min(F.coalesce("item_id", F.lit(-1))).alias("item")), "benchmark-distinct")
    masks = _masks(min_words, min_share)
    seeds = staged(items.mapInArrow(_seed_rows(masks), "seed long, item long, item_at int, n_words int"), "benchmark-seeds")
    bits = filter_size(seeds.count())
    found = blocks.folded(seeds.mapInArrow(_filters(bits), blocks.SCHEMA), np.maximum, np.uint8)
    packed = bytes(1 << bits) if found is None else found.tobytes()
    # At most 2 ** MOST_BITS bytes, however long the benchmark is.
    shared = spark.sparkContext.broadcast(packed)
    long, short = items.agg(F.max(F.length("tokens") >= 8 * WHOLE), F.max(F.length("tokens").between(8 * SHORT, 8 * WHOLE - 8))).first()
    used = _numbered(masks, bool(long), bool(short))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    regions = staged(
        texts.mapInArrow(_regions(shared, bits, used), "doc_id long, text_hash long, start int, words binary, seeds array<long>, places array<int>").withColumn("region", F.xxhash64("doc_id", "text_hash", "start", F.get("places", 0))),
        "benchmark-regions",
    )
    hits = regions.select("region", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("places").alias("place"))))
    shifts = hits.join(seeds.drop("n_words"), "seed").groupBy("region", "item").agg(F.collect_set(F.col("place") - F.col("item_at")).alias("shifts"))
    # Rows that repeat a document repeat its regions.
    whole = regions.select("region", "doc_id", "text_hash", "start", "words").dropDuplicates(["region"])
    found = shifts.join(whole, "region").join(items, "item").select("doc_id", "text_hash", "item", "start", "words", "tokens", "shifts")
    best = found.mapInArrow(_verify(min_words, min_share), "doc_id long, text_hash long, item long, doc_word int, item_word int, n_words int, n_equal int")
    overlap = F.struct("n_equal", -F.col("n_words"), -F.col("doc_word"), "doc_word", "item_word", "n_words")
    per_item = best.groupBy("doc_id", "text_hash", "item").agg(F.max(overlap).alias("best"))
    again = named.join(items, "tokens").select("item", "item_id")
    return per_item.join(again, "item").select("doc_id", "text_hash", "item_id", "best.doc_word", "best.item_word", "best.n_words", "best.n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without an overlap; all columns as they are."""
    owner, owner_hash = fresh(docs, "id", "hash")
    gone = find_overlaps(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(owner), F.col("text_hash").alias(owner_hash)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(owner)) & (F.xxhash64(text_col) == F.col(owner_hash))
    return docs.join(gone, same, "left_anti")
