"""Words of passages that an earlier document already has are removed, by FM-indexes.

Every window of ``width`` words is named by the smallest hash among its runs of
``run`` words; neighbouring windows of one name are a segment. Equal windows have
equal names, so names that only one document holds drop out first, and the
segments of a name meet in one shard.

A shard holds each different segment once, with the smallest document that has it,
in an FM-index: suffixes in order of their first ``width`` words or more, their preceding
words in a wavelet tree kept level by level as packed bits with block counts.
Segments are streamed against it: a backward search over all positions at once
gives each position's matching statistic, cut at ``width`` and ended as soon as a
match is the position itself. Intervals that reach ``width`` tell the smallest
document among their suffixes.

A name with more than ``shard_segments`` different segments is split: its segments
are cut into windows, dealt by a hash of the window, so equal windows still meet.
Copies of a segment are one row before any shard sees them.

Cases: a null or empty text has no words; a text with fewer than ``width`` words stays
whole. Rows without an id are neither compared nor changed. Rows that repeat an id
are one document and lose alike. An empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm import words
from catalens.llm.shared_keys import shared_entries
from catalens.session import staged

_COUNT_BITS = 20


def segments(hashes: np.ndarray, first: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, text, first window (counted in the text) and number of windows of every segment."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64), *np.empty((3, 0), np.int64)
    grams = words.grams(hashes, run)
    span = width - run + 1
    name, done = grams, 1
    while done < span:  # minimum over ``span`` neighbours by doubling
        step = min(done, span - done)
        name = np.minimum(name[:-step], name[step:])
        done += step
    at = np.flatnonzero(owner[:count] == owner[width - 1 : width - 1 + count])
    if not len(at):
        return np.empty(0, np.uint64), *np.empty((3, 0), np.int64)
    name, text = name[at], owner[at]
    place = at - first[text]
    new = np.append(True, (name[1:] != name[:-1]) | (text[1:] != text[:-1]))
    new |= place % (1 << _COUNT_BITS - 1) == 0
    starts = np.flatnonzero(new)
    return name[starts], text[starts], place[starts], np.diff(np.append(starts, len(at)))


def _entries(width: int, run: int):
    def entries(batch: pa.RecordBatch):
        text = words.split(batch.column("text"))
        names, which, starts, counts = segments(text.hashes(lower=False), text.first, width, run)
        ids = batch.column("doc_id").to_numpy()
        return names, which, starts << _COUNT_BITS | counts, ids

    return entries


def _plain(text: words.Texts, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen words with a space after each, and where each begins."""
    starts, lengths = text.starts[chosen], text.ends[chosen] - text.starts[chosen] + 1
    begin = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], lengths)
    plain = text.data[np.minimum(source, max(len(text.data) - 1, 0))] if len(source) else np.empty(0, np.uint8)
    plain[begin[1:] - 1] = 32
    return plain, begin


def _cut(width: int):
    """The words of the wanted segments of each text, joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _texts(batches):
            plain, begin = _plain(text, np.arange(len(text.starts)))
            rows: list[tuple[int, int, int, bytes]] = []
            for i, found in enumerate(batch.column("found").to_pylist()):
                low, high = int(text.first[i]), int(text.first[i + 1])
                for name, span in zip(found["name"], found["span"]):
                    start, count = span >> _COUNT_BITS, span & (1 << _COUNT_BITS) - 1
                    a, b = low + start, low + start + count + width - 1
                    if b <= high:
                        rows.append((i, name, start, plain[begin[a] : begin[b] - 1].tobytes()))
            which = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column("doc_id").take(which), batch.column("text_hash").take(which), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            columns.append(pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "name", "start", "words"])

    return run


class WaveletTree:
    """Rank of a symbol among the first i symbols, by one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        self.bits = bits
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, bool)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, counts, len(ones) - int(counts[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the first ``places`` symbols' occurrences of the symbol end in the last level."""
        for level, (packed, counts, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            below = packed[places >> 6] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[places >> 6] + np.bitwise_count(below)
            places = np.where(symbols >> level & 1, zeros + ones, places - ones)
        return places


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols; symbol 0 separates texts."""

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int):
        n = len(symbols)
        rank, step = symbols.astype(np.int64), 1
        while step < depth:
            # Rank by twice as many symbols: the pair of ranks as one number. Equal suffixes may stand in any order.
            key = rank * (n + 1)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
            step *= 2
        self.order = order
        bits = max(1, int(sigma).bit_length())
        self.tree = WaveletTree(symbols[order - 1], bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.base = self.tree.descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them."""
        shift = self.before[symbols] - self.base[symbols]
        return self.tree.descend(symbols, low) + shift, self.tree.descend(symbols, high) + shift


def matches(symbols: np.ndarray, index: FMIndex, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last places among ``ends`` whose matching statistic reaches ``width``, with their intervals.

    A match that only the place itself makes is no match.
    """
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(symbols))
    for back in range(width):
        low, high = index.extend(symbols[ends - back], low, high)
        alive = high - low > 1
        ends, low, high = ends[alive], low[alive], high[alive]
    return ends, low, high


def _search(width: int):
    def search(table: pa.Table) -> pa.Table:
        text = words.split(table["words"].combine_chunks())
        names, inverse = np.unique(text.hashes(lower=False), return_inverse=True)
        counts = text.counts()
        # A separator after every segment.
        place = np.arange(len(inverse)) + text.document_of_word()
        symbols = np.zeros(len(inverse) + len(counts), np.int64)
        symbols[place] = inverse + 1
        first = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
        segment = np.repeat(np.arange(len(counts)), counts + 1)
        index = FMIndex(symbols, len(names), width)
        offset = np.arange(len(symbols)) - first[segment]
        ends = np.flatnonzero((offset >= width - 1) & (offset < counts[segment]))
        ends, low, high = matches(symbols, index, ends, width)
        smallest = table["smallest"].to_numpy()
        # Intervals of one length are equal or apart; each one's smallest document once.
        lows, which = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high
        bounds = np.stack([lows, highs], axis=1).ravel()
        documents = np.append(smallest[segment[index.order]], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(documents, bounds)[::2] if len(bounds) else np.empty(0, np.int64)
        found, at = segment[ends], offset[ends] - width + 1
        best = least[which] if len(which) else np.empty(0, np.int64)
        useful = best < smallest[found]
        return _runs(table, found[useful], at[useful], best[useful])

    return search


def _runs(table: pa.Table, found: np.ndarray, at: np.ndarray, best: np.ndarray) -> pa.Table:
    """Neighbouring windows of a segment with the same smallest document as one row."""
    new = np.append(True, (found[1:] != found[:-1]) | (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1))[: len(found)]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(found)) - 1
    which = pa.array(found[starts])
    shift = table["shift"].to_numpy()[found[starts]] if len(starts) else np.empty(0, np.int64)
    return pa.table({"s1": table["s1"].take(which), "s2": table["s2"].take(which), "from": at[starts] + shift, "to": at[ends[: len(starts)]] + shift, "best": best[starts]})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, so that the shuffle by document moves less."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in words.slices(batches):
        packed = [press.compress(t) for t in batch.column("text").fill_null("").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(packed, pa.binary())], ["doc_id", "text_hash", "packed"])


def _texts(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, words.Texts]]:
    """Batches with the words of their unpacked texts."""
    press = zstandard.ZstdDecompressor()
    for batch in words.slices(batches, "packed", limit):
        yield batch, words.split(pa.array([press.decompress(t) for t in batch.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string()))


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _texts(batches):
            change = np.zeros(len(text.starts) + 1, np.int64)
            hashes = batch.column("text_hash").to_pylist()
            for i, spans in enumerate(batch.column("gone").to_pylist()):
                low, high = text.first[i], text.first[i + 1]
                for span in spans or ():
                    # Rows that repeat an id with another text have spans of their own.
                    if span["hash"] == hashes[i]:
                        change[low + span["a"]] += 1
                        change[low + span["b"] + width] -= 1
            gone = np.cumsum(change)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            plain, begin = _plain(text, np.flatnonzero(~gone))
            bounds = begin[text.first - total[text.first]]
            kept = [plain[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            removed = total[text.first[1:]] - total[text.first[:-1]]
            columns = [batch.column("doc_id"), pa.array(text.counts()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, width: int = 13, run: int = 5, shard_segments: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = every.where(F.col("doc_id").isNotNull())
    shared = shared_entries(texts, _entries(width, run)).toDF("name", "doc_id", "span")
    wanted = staged(shared.groupBy("doc_id").agg(F.struct(F.collect_list("name").alias("name"), F.collect_list("span").alias("span")).alias("found")), "substring-spans")
    packed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_pack, "doc_id long, text_hash long, packed binary").repartition("doc_id")
    cut = packed.join(wanted, "doc_id").mapInArrow(_cut(width), "doc_id long, text_hash long, name long, start long, words string")
    cut = cut.withColumn("s1", F.xxhash64("words")).withColumn("s2", F.xxhash64(F.lit(1), "words"))
    distinct = staged(cut.groupBy("s1", "s2", "name", "words").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")), "substring-segments")
    # Written, so that the join has shuffles of its own, which adaptive execution may split at a name of many segments.
    many = staged(distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_segments).select("name", F.ceil(F.col("n") / shard_segments).alias("ways")), "substring-names")
    dealt = distinct.join(many, "name", "left")
    shard = F.pmod(F.xxhash64("name"), F.lit(shards))
    columns = ["s1", "s2", "words", "smallest", "shift", "shard", "way"]
    whole = dealt.where("ways IS NULL").withColumns({"shift": F.lit(0).cast("long"), "shard": shard, "way": F.lit(-1).cast("long")}).select(columns)
    parts = F.split("words", " ")
    windows = F.transform(F.sequence(F.lit(0), F.size(parts) - width), lambda i: F.array_join(F.slice(parts, i + 1, width), " "))
    split = (
        dealt.where("ways IS NOT NULL")
        .select("s1", "s2", "smallest", "ways", shard.alias("shard"), F.posexplode(windows).alias("at", "words"))
        .withColumns({"shift": F.col("at").cast("long"), "way": F.pmod(F.xxhash64("words"), "ways").cast("long")})
        .select(columns)
    )
    found = whole.unionByName(split).groupBy("shard", "way").applyInArrow(_search(width), "s1 long, s2 long, from long, to long, best long")
    # A segment that documents share goes from all but the first of them, whatever else its shard holds.
    copies = distinct.where("smallest < largest").select("s1", "s2", F.lit(0).cast("long").alias("from"), (F.size(parts) - width).cast("long").alias("to"), F.col("smallest").alias("best"))
    matched = staged(found.unionByName(copies), "substring-found")
    gone = (
        cut.select("s1", "s2", "doc_id", "text_hash", "start")
        .join(matched, ["s1", "s2"])
        .where(F.col("best") < F.col("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct(F.col("text_hash").alias("hash"), (F.col("start") + F.col("from")).alias("a"), (F.col("start") + F.col("to")).alias("b"))).alias("gone"))
    )
    result = "doc_id long, n_words long, n_removed long, kept_text string"
    kept = packed.join(gone, "doc_id", "left").mapInArrow(_remove(width), result)
    nameless = every.where(F.col("doc_id").isNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_pack, "doc_id long, text_hash long, packed binary")
    empty = F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")
    return kept.unionByName(nameless.select("*", empty).mapInArrow(_remove(width), result))
