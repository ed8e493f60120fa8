"""A hashed maximum-entropy language model over words.

Symbols are the most frequent training words and one for all others. A softmax over
classes of symbols, then one over the members of the class, gives a symbol's
probability. With enough words "all others" is the last class, alone in it, and needs the
first softmax only. Both sum the weights of hashed features of the context (the word
before, the pair before, and the words two and three before). Another word's
probability is that of "all others" times those of its turns in a binary tree of all
other known words, by the bits of their hashes: a logistic model of the same context at
every node. Words of one leaf, of which there are ``LEAVES`` a word, have their smoothed
shares of its counts. So every known word, and one unknown word, has a probability and
they sum to 1.

Texts are taken apart once, into written word hashes. Counts are exact and cover every training text. Weights start at the counts'
probabilities, at the nodes of the tree too, and are trained by rounds of distributed gradient updates: each
task takes sparse steps over its texts from the same weights, and rows are averaged
by how often each task has updated them. The rounds deal the positions of every
training text among them, so that each position gives one gradient.

Words that fewer than one in ``frequent`` training tokens are counted by a join;
the others, ``frequent`` words at most, are sent to the tasks with their counts.

Cases: a null or empty text is the end token alone. With no training text all counts
are 0. Rows without an id are scored, and are training texts if ``learn`` says
so. Rows that repeat count each and get equal scores. An empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm import blocks, words
from catalens.session import staged

END = np.uint64(0x1F83D9ABFB41BD6B)
SMOOTH = 0.1
CLASSES, MEMBERS = 32, 33
#: Leaves of the tree for each word, and at most; the leaves' counts are sent to the tasks.
LEAVES, MOST_LEAVES = 4, 1 << 21
#: Log odds at a node of which one side has no word. Words whose turns are at hand, and how often so many give a step.
SURE, _WORDS, _STRIDE = 60, 512, 8
_CHUNK = 4_096
_BATCH = 1_024


@dataclass(frozen=True)
class Shape:
    rows: int = 8192
    cells: int = 1 << 18  # a power of two
    rounds: int = 2
    rate: float = 0.05
    frequent: int = 1 << 20


@dataclass
class Counts:
    tokens: int
    distinct: int
    keys: np.ndarray  # frequent words in order of their hash
    counts: np.ndarray
    symbol: np.ndarray  # of each frequent word, or the symbol of all others
    symbol_keys: np.ndarray  # words of the symbols in order of their hash
    symbol_of_key: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray
    other_tokens: int
    other_distinct: int
    turns: np.ndarray  # log odds of 1 at each node of the tree of other words by their counts

    @property
    def depth(self) -> int:
        return len(self.turns).bit_length() - 1

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words, and whether the word is one."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return place, self.keys[place] == hashes


@dataclass
class Weights:
    classes: np.ndarray  # rows x CLASSES, by feature
    members: np.ndarray  # rows x MEMBERS, by feature and class
    cells: np.ndarray  # by feature and node of the tree


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as hashes of their words, with an end after each text."""
    for batch in words.slices(batches):
        text = words.split(batch.column("text"))
        first = text.first + np.arange(len(text.first))
        out = np.full(first[-1], END)
        out[np.arange(len(text.starts)) + text.document_of_word()] = text.hashes(lower=True)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(8 * first), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "learnt")), packed.cast(pa.binary())], ["doc_id", "text_hash", "learnt", "words"])


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of packed texts, and where each text starts."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    hashes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    return hashes, (offsets - offsets[0]) // 8


def _features(hashes: np.ndarray, place: np.ndarray, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Four hashed features of the context of the chosen positions; ``place`` counts positions in their text."""
    place, back = place[chosen], []
    at = np.arange(len(hashes))[chosen]
    for k in (1, 2, 3):
        back.append(np.where(place < k, np.uint64(k), hashes[np.maximum(at - k, 0)]))
    pair = words.mix(back[0] * np.uint64(0xD6E8FEB86659FD93) + back[1])
    return np.stack([words.mix(x + words.STEPS[k]) for k, x in enumerate((back[0], pair, back[1], back[2]))], axis=1)


def _rows(features: np.ndarray, groups: np.ndarray | None, rows: int) -> np.ndarray:
    """Rows of weights of features, or of features within a class."""
    if groups is not None:
        features = words.mix(features + groups[:, None].astype(np.uint64) * words.STEPS[9])
    return (features % np.uint64(rows)).astype(np.int64)


def _scores_of(table: np.ndarray, row: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Sums of the rows of weights of each position."""
    scores = table.take(row[:, 0], 0, mode="clip")
    for k in range(1, row.shape[1]):
        scores += table.take(row[:, k], 0, mode="clip")
    scores += bias.astype(np.float32, copy=False)
    return scores


def _exponentials(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums; where a sum leaves the range, all scores are shifted in place by the largest of their position."""
    with np.errstate(over="ignore"):
        found = np.exp(scores)
        total = np.einsum("ij->i", found)
    if len(total) and not (total.min() > 1e-30 and total.max() < 1e30):
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=found)
        total = np.einsum("ij->i", found)
    return found, total


def _log_target(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    total = _exponentials(scores)[1]
    return scores[np.arange(len(target)), target] - np.log(total)


def _whole_rows(table: np.ndarray) -> np.ndarray:
    """A view whose elements are whole rows, which are assigned faster."""
    return table.view(np.dtype((np.void, table.itemsize * table.shape[1])))[:, 0]


def _symbols(hashes: np.ndarray, counts: Counts) -> np.ndarray:
    """Symbols alone, from the words that have one: few enough to stay in a core's cache."""
    other = len(counts.symbol_keys)
    if not other:
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(counts.symbol_keys, hashes), other - 1)
    return np.where(counts.symbol_keys[place] == hashes, counts.symbol_of_key[place], other)


def _symbols_and_places(hashes: np.ndarray, counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, frequent = counts.look_up(hashes)
    other = len(counts.symbol_keys)
    return np.where(frequent, counts.symbol[place] if len(counts.keys) else other, other), place, frequent


def _log_probability(features: np.ndarray, symbols: np.ndarray, counts: Counts, weights: Weights) -> np.ndarray:
    out = np.empty(len(symbols))
    rows = len(weights.classes)
    several = np.isfinite(counts.member_bias).sum(1) > 1
    for at in range(0, len(symbols), _CHUNK):
        part = slice(at, at + _CHUNK)
        group, member = symbols[part] // MEMBERS, symbols[part] % MEMBERS
        found = _log_target(_scores_of(weights.classes, _rows(features[part], None, rows), counts.class_bias), group)
        # A class with one member needs no second step.
        wide = np.flatnonzero(several[group])
        found[wide] += _log_target(_scores_of(weights.members, _rows(features[part][wide], group[wide], rows), counts.member_bias[group[wide]]), member[wide])
        out[part] = found
    return out / np.log(10)


def _sums(slope: np.ndarray, origin: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of ``count`` rows of slopes each, from ``starts`` on, the largest counts first: most are of one row or a few, which are added in turns."""
    total = slope.take(origin[starts], 0, mode="clip")
    rising, done, more = count[::-1], 1, 0
    while done < 8:
        more = len(count) - int(np.searchsorted(rising, done, "right"))
        if not more:
            return total
        total[:more] += slope.take(origin[starts[:more] + done], 0, mode="clip")
        done += 1
    more = len(count) - int(np.searchsorted(rising, done, "right"))
    if more:
        left = count[:more] - done
        among = np.arange(left.sum()) + np.repeat(starts[:more] + done - np.cumsum(left) + left, left)
        total[:more] += np.add.reduceat(slope.take(origin[among], 0, mode="clip"), np.cumsum(left) - left, axis=0)
    return total


def _steps(features: np.ndarray, symbols: np.ndarray, counts: Counts, weights: Weights, touched: list[np.ndarray], rate: float) -> None:
    """Sparse gradient steps over small batches, in place."""
    rows = len(weights.classes)
    several = np.isfinite(counts.member_bias).sum(1) > 1
    for at in range(0, len(symbols), _BATCH):
        part = slice(at, at + _BATCH)
        group, member = symbols[part] // MEMBERS, symbols[part] % MEMBERS
        wide = np.flatnonzero(several[group])
        for table, bias, row, target, seen in (
            (weights.classes, counts.class_bias, _rows(features[part], None, rows), group, touched[0]),
            (weights.members, counts.member_bias[group[wide]], _rows(features[part][wide], group[wide], rows), member[wide], touched[1]),
        ):
            if not len(target):
                continue
            slope, sums = _exponentials(_scores_of(table, row, bias))
            slope *= (-1 / sums)[:, None]
            slope[np.arange(len(target)), target] += 1
            # Small numbers are sorted by their digits.
            flat = row.ravel().astype(np.uint16 if rows <= 1 << 16 else np.int64)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            count = np.diff(np.append(starts, len(flat)))
            fall = np.argsort((len(flat) - count).astype(np.uint16), kind="stable")
            starts, count = starts[fall], count[fall]
            total = _sums(slope, order // row.shape[1], starts, count)
            used = flat[starts]
            seen[used] += count
            # A row's step shrinks as it has been updated more often.
            total *= (rate / np.sqrt(count * np.minimum(1 + seen[used], 1e6) ** 0.5)).astype(np.float32)[:, None]
            total += table.take(used, 0, mode="clip")
            _whole_rows(table)[used] = _whole_rows(total)


def _turns(features: np.ndarray, hashes: np.ndarray, counts: Counts, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The turns of other words at the nodes they pass: whether to 1, the log odds by counts and in the context, and the cells of its features."""
    levels = np.arange(counts.depth, dtype=np.uint64)
    # Of a shift by all 64 bits nothing would be sure.
    node = ((hashes[:, None] >> np.uint64(1)) >> (np.uint64(63) - levels)) | (np.uint64(1) << levels)
    turn = ((hashes[:, None] >> (np.uint64(63) - levels)) & np.uint64(1)).astype(np.float32)
    bias = counts.turns.take(node.view(np.int64), mode="clip")
    shift = np.uint64(65 - len(weights).bit_length())
    node *= words.STEPS[0]
    node >>= shift
    cells = np.empty((features.shape[1], *node.shape), np.int64)
    odds = bias.copy()
    for k in range(len(cells)):
        np.bitwise_xor((features[:, k] >> shift)[:, None], node, out=cells[k].view(np.uint64))
        odds += weights.take(cells[k], mode="clip")
    return turn, bias, np.clip(odds, -SURE, SURE, out=odds), cells


def _tree_steps(features: np.ndarray, hashes: np.ndarray, counts: Counts, weights: np.ndarray, seen: np.ndarray, rate: float) -> None:
    """Sparse gradient steps at the nodes that other words pass, in place."""
    for at in range(0, len(hashes) if counts.depth else 0, _STRIDE * _WORDS):
        slopes, cells = [], []
        for begin in range(at, min(at + _STRIDE * _WORDS, len(hashes)), _WORDS):
            part = slice(begin, begin + _WORDS)
            turn, _, odds, cell = _turns(features[part], hashes[part], counts, weights)
            turn -= 1 / (1 + np.exp(-odds))
            slopes.append(np.tile(turn.ravel(), len(cell)))
            cells.append(cell.ravel())
        flat = np.concatenate(cells)
        count = np.bincount(flat, minlength=len(weights)).astype(np.float32)
        total = np.bincount(flat, np.concatenate(slopes), minlength=len(weights)).astype(np.float32)
        seen += count
        # As in `_steps`.
        total *= np.float32(rate) / np.sqrt(np.maximum(count, 1) * np.sqrt(np.minimum(1 + seen, 1e6)))
        weights += total


def _gains(features: np.ndarray, hashes: np.ndarray, counts: Counts, weights: Weights) -> np.ndarray:
    """log10 of other known words' shares of "all others" in their context, less those of their counts alone."""
    out = np.zeros(len(hashes))
    for at in range(0, len(hashes) if counts.depth else 0, _WORDS):
        part = slice(at, at + _WORDS)
        turn, bias, odds, _ = _turns(features[part], hashes[part], counts, weights.cells)
        side = 1 - 2 * turn
        out[part] = np.log((1 + np.exp(side * bias)) / (1 + np.exp(side * odds))).sum(1)
    return out / np.log(10)


def pack(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text, learnt) taken apart once and written as (doc_id, text_hash, learnt, words); all else reads these."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "learnt", "text")
    return staged(named.mapInArrow(_pack, f"doc_id {kind}, text_hash long, learnt boolean, words binary"), "model-words")


def count_words(docs: DataFrame, shape: Shape) -> tuple[DataFrame, Counts]:
    """The table (word, n) of all training words, and what the tasks need of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "words", 8_000_000):
            found, n = np.unique(stream(batch.column("words"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["word", "n"])

    table = staged(docs.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens, distinct = table.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens = tokens or 0
    # At most ``frequent`` words can reach this count.
    common = table.where(F.col("n") * shape.frequent >= tokens).toArrow()
    keys, n = common["word"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    best = np.lexsort((keys, -n))[: (CLASSES - 1) * MEMBERS]
    symbol = np.full(len(keys), len(best))
    symbol[best] = np.arange(len(best))
    weight = np.append(n[best], max(tokens - n[best].sum(), 0)) + SMOOTH
    padded = np.full(CLASSES * MEMBERS, -np.inf)
    padded[: len(weight)] = np.log(weight)
    padded = padded.reshape(CLASSES, MEMBERS)
    with np.errstate(divide="ignore"):
        class_bias = np.log(np.exp(padded).sum(1)) - np.log(weight.sum())
    named = np.sort(best)
    return table, Counts(tokens, distinct, keys, n, symbol, keys[named], symbol[named], class_bias, padded, int(tokens - n[best].sum()), distinct - len(best), _tree(table, keys[best], n[best], distinct - len(best)))


def _tree(table: DataFrame, named: np.ndarray, times: np.ndarray, distinct: int) -> np.ndarray:
    """Log odds at the nodes of the tree of the words that have no symbol; node i has the nodes 2i and 2i + 1 below it."""
    if distinct < 2:
        return np.zeros(1, np.float32)
    depth = (min(LEAVES * distinct, MOST_LEAVES) - 1).bit_length()
    leaf = F.shiftrightunsigned("word", 64 - depth)
    held = table.groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("words")).toArrow()
    mass = np.zeros((2, 1 << depth), np.int64)
    mass[:, held["leaf"].to_numpy()] = held["n"].to_numpy(), held["words"].to_numpy()
    own = (named >> np.uint64(64 - depth)).astype(np.int64)
    np.subtract.at(mass, (slice(None), own), np.stack([times, np.ones_like(times)]))
    turns = np.zeros(1 << depth, np.float32)
    while depth:
        depth -= 1
        low, high = (n + SMOOTH * several for n, several in (mass[:, 0::2], mass[:, 1::2]))
        with np.errstate(divide="ignore", invalid="ignore"):
            turns[1 << depth : 2 << depth] = np.nan_to_num(np.clip(np.log(high / low), -SURE, SURE))
        mass = mass[:, 0::2] + mass[:, 1::2]
    return turns


def train(docs: DataFrame, counts: Counts, shape: Shape) -> Weights:
    weights = Weights(np.zeros((shape.rows, CLASSES), np.float32), np.zeros((shape.rows, MEMBERS), np.float32), np.zeros(shape.cells, np.float32))
    for number in range(shape.rounds):
        shared = docs.sparkSession.sparkContext.broadcast((counts, weights))

        def run(batches: Iterator[pa.RecordBatch], number: int = number, shared=shared) -> Iterator[pa.RecordBatch]:
            counts, begin = shared.value
            own = Weights(begin.classes.copy(), begin.members.copy(), begin.cells.copy())
            touched = [np.zeros(n, np.float32) for n in (shape.rows, shape.rows, shape.cells)]
            for batch in words.slices(batches, "words"):
                hashes, first = stream(batch.column("words"))
                place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
                chosen = np.flatnonzero(place % shape.rounds == number)
                features, symbols = _features(hashes, place, chosen), _symbols(hashes[chosen], counts)
                _steps(features, symbols, counts, own, touched, shape.rate)
                other = np.flatnonzero(symbols == len(counts.symbol_keys))
                _tree_steps(features[other], hashes[chosen[other]], counts, own.cells, touched[2], shape.rate)
            shares = [own.classes * touched[0][:, None], own.members * touched[1][:, None], own.cells * touched[2], *touched]
            yield blocks.cut(np.concatenate([x.ravel() for x in shares]).astype(np.float32), 16)

        total = blocks.folded(docs.select("words").mapInArrow(run, blocks.SCHEMA), np.add, np.float32)
        if total is None:
            return weights
        sizes = [shape.rows * CLASSES, shape.rows * MEMBERS, shape.cells, shape.rows, shape.rows, shape.cells]
        *tables, _, _, _ = parts = np.split(total, np.cumsum(sizes)[:-1])
        before = (weights.classes, weights.members, weights.cells)
        tables, touched = [x.reshape(len(w), -1) for x, w in zip(tables, before)], [x[:, None] for x in parts[3:]]
        weights = Weights(*(np.where(t > 0, x / np.maximum(t, 1), w.reshape(x.shape)).reshape(w.shape) for x, t, w in zip(tables, touched, before)))
    return weights


def _rare_rows(shared):
    """Words of each text whose count is not at hand, with what those of no training text gain if they are known; the first of a text carries a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = shared.value
        for batch in words.slices(batches, "words"):
            hashes, first = stream(batch.column("words"))
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            rare = np.flatnonzero(~counts.look_up(hashes)[1])
            gains = np.zeros(len(rare))
            doubtful = np.flatnonzero(~batch.column("learnt").to_numpy(zero_copy_only=False)[owner[rare]])
            at = rare[doubtful]
            gains[doubtful] = _gains(_features(hashes, np.arange(len(hashes)) - first[owner], at), hashes[at], counts, weights)
            order = np.lexsort((hashes[rare], owner[rare]))
            owner, hashes, gains = owner[rare][order], hashes[rare][order], gains[order]
            starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owner) else np.empty(0, np.int64)
            times = np.diff(np.append(starts, len(owner)))
            which = owner[starts]
            mark = np.append(True, which[1:] != which[:-1])[: len(which)]
            columns = [batch.column(c).take(pa.array(which)) for c in ("doc_id", "text_hash")]
            gain = np.add.reduceat(gains, starts) if len(starts) else gains
            columns += [pa.array(hashes[starts].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(gain.astype(np.float32)), pa.array(mark.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "word", "times", "gain", "mark"])

    return run


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = shared.value
        for batch in words.slices(batches, "words"):
            hashes, first = stream(batch.column("words"))
            symbols, place, frequent = _symbols_and_places(hashes, counts)
            position = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
            features = _features(hashes, position)
            model = _log_probability(features, symbols, counts, weights)
            known = np.log10((counts.counts[place] if len(counts.keys) else np.zeros(len(place))) + SMOOTH) * frequent
            other = symbols == len(counts.symbol_keys)
            # All words of a training text are known.
            near = np.flatnonzero(other & (frequent | np.repeat(batch.column("learnt").to_numpy(zero_copy_only=False), np.diff(first))))
            model[near] += _gains(features[near], hashes[near], counts, weights)
            sums = [np.add.reduceat(x, first[:-1]) for x in (frequent.astype(np.int64), known, model, known * other, other.astype(np.int64))]
            columns = [*(batch.column(c) for c in ("doc_id", "text_hash", "learnt")), pa.array(np.diff(first)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "learnt", "n_tokens", "near_known", "near_log", "model_log", "other_log", "n_other"])

    return run


def score(docs: DataFrame, learn: Column, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learn`` is a condition on ``doc_id`` that says which rows are training texts.
    """
    context = docs.sparkSession.sparkContext
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = pack(named.withColumn("learnt", F.coalesce(learn, F.lit(False))))
    kind = texts.schema["doc_id"].dataType.simpleString()
    training = texts.where("learnt")
    table, counts = count_words(training, shape)
    weights = train(training, counts, shape)
    logs = F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)
    shared = context.broadcast((counts, weights))
    rare = texts.mapInArrow(_rare_rows(shared), f"doc_id {kind}, text_hash long, word long, times int, gain float, mark int")
    # Rows that repeat a document repeat its words, and its mark.
    far = (
        rare.join(table, "word", "left")
        .groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        .agg((F.sum(F.col("times") * logs) / F.sum("mark")).alias("far_log"), *[(F.sum(F.when(F.col("n") > 0, F.col(c))) / F.sum("mark")).alias(f"far_{name}") for c, name in (("times", "known"), ("gain", "gain"))])
    )
    schema = f"doc_id {kind}, text_hash long, learnt boolean, n_tokens long, near_known long, near_log double, model_log double, other_log double, n_other long"
    near = texts.mapInArrow(_scores(shared), schema)
    whole = near.join(far, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    base = float(np.log10(counts.tokens + SMOOTH * (counts.distinct + 1)))
    other = float(np.log10(counts.other_tokens + SMOOTH * (counts.other_distinct + 1)))
    return whole.select(
        "doc_id",
        "learnt",
        "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("near_log") + far_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model_log") + F.col("other_log") + far_log + F.coalesce("far_gain", F.lit(0.0)) - F.col("n_other") * other).alias("score"),
    )
