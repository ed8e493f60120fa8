"""Text quality from random-indexing word vectors and a small network.

A word's index vector is sparse and ternary, drawn from hashes of the word, its
first and last bytes and its shape. Its context vector is the sum of the index
vectors of its neighbours over the training texts, kept in a hashed table of
``Shape.rows`` rows. A document is the mean of both over its words, with a few
repetition figures. A two-layer network gives a logit, a temperature fitted on
training rows that the network has not seen makes it a probability.

Training takes at most ``max_train`` labelled rows, those with the smallest hash
of their id; table and network have a fixed size, so what the driver and the
tasks hold does not grow with the corpus. Scoring is one pass without a shuffle.

Cases: a null or empty text has no words and is scored like any other vector;
labels that are null, not 0 or 1, or of a null id are not learnt from; an id with
several labels counts with the larger one, several texts of an id with the first in
order. Without any label, or of one kind only, the score is the smoothed share of
good labels. Repeated rows get equal scores. Input columns with the name of a
result are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.llm import blocks, words
from catalens.session import staged

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>{}[]=~^\\@")] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_EXTRA = 9


@dataclass(frozen=True)
class Shape:
    dimensions: int = 48
    rows: int = 8192
    window: int = 2
    hidden: int = 32
    epochs: int = 300
    seed: int = 7


@dataclass
class Model:
    shape: Shape
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.tanh((features - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def _index_vectors(text: words.Texts, at: np.ndarray, hashes: np.ndarray, dimensions: int) -> np.ndarray:
    """Sparse ternary vectors of the words at the given places."""
    vectors = np.zeros((len(at), dimensions), np.int32)
    starts, lengths = text.starts[at], text.ends[at] - text.starts[at]
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[text.data])])
    digits = np.concatenate([[0], np.cumsum(_IS_DIGIT[text.data])])
    some_symbol = symbols[text.ends[at]] > symbols[starts]
    some_digit = digits[text.ends[at]] > digits[starts]
    head, tail = np.zeros((2, len(at)), np.uint64)
    for k in range(3):
        head = head << np.uint64(8) | text.data[starts + np.minimum(k, lengths - 1)]
        tail = tail << np.uint64(8) | text.data[text.ends[at] - 1 - np.minimum(k, lengths - 1)]
    form = np.minimum(lengths, 15) * 8 + some_symbol * 4 + some_digit * 2 + ((text.data[starts] >= 65) & (text.data[starts] <= 90))
    line = np.arange(len(at))
    for kind, (key, count) in enumerate(((hashes, 4), (head, 2), (tail, 2), (form.astype(np.uint64), 2))):
        key = words.mix(key + words.STEPS[kind])
        for k in range(count):
            place = (key >> np.uint64(10 * k)) % np.uint64(dimensions)
            np.add.at(vectors, (line, place.astype(np.int64)), np.where(key >> np.uint64(50 + k) & np.uint64(1), 1, -1).astype(np.int32))
    return vectors


def _distinct(column: pa.Array, dimensions: int):
    text = words.split(column)
    hashes = text.hashes(lower=True)
    distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return text, hashes, distinct, inverse, _index_vectors(text, first, distinct, dimensions)


def _context(column: pa.Array, shape: Shape, table: np.ndarray) -> None:
    """Add the neighbours' index vectors of every word to its row of the table."""
    text, hashes, _, inverse, vectors = _distinct(column, shape.dimensions)
    owner = text.document_of_word()
    row = (hashes % np.uint64(shape.rows)).astype(np.int64)
    for k in range(1, shape.window + 1):
        same = np.flatnonzero(owner[:-k] == owner[k:]) if len(owner) > k else np.empty(0, np.int64)
        for here, there in ((same, same + k), (same + k, same)):
            np.add.at(table, row[here], vectors[inverse[there]])


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each text's words; texts without words sum to 0."""
    out = np.zeros((len(first) - 1, values.shape[1]), np.float64)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        out[filled] = np.add.reduceat(values, first[filled], axis=0)
    return out


def features(column: pa.Array, shape: Shape, table: np.ndarray) -> np.ndarray:
    """One row per text."""
    text, hashes, distinct, inverse, vectors = _distinct(column, shape.dimensions)
    context = table[(distinct % np.uint64(shape.rows)).astype(np.int64)]
    pooled = _per_text(np.hstack([vectors.astype(np.float32), context])[inverse], text.first)
    owner = text.document_of_word()
    n = np.maximum(text.counts(), 1)[:, None]
    extra = np.zeros((len(text), _EXTRA))
    for k in (1, 2, 3):
        if len(owner) > k:
            again = (hashes[:-k] == hashes[k:]) & (owner[:-k] == owner[k:])
            extra[:, k - 1] = np.bincount(owner[:-k][again], minlength=len(text))
    different = np.unique(words.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    extra[:, 3] = np.bincount(owner[different], minlength=len(text))
    extra[:, 4] = text.characters()
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[text.data])])
    extra[:, 5] = symbols[text.offsets[1:]] - symbols[text.offsets[:-1]]
    lines = np.concatenate([[0], np.cumsum(text.data == 10)])
    extra[:, 6] = lines[text.offsets[1:]] - lines[text.offsets[:-1]]
    extra /= n
    extra[:, 7] = np.log1p(text.counts())
    extra[:, 8] = text.counts() == 0
    return np.hstack([pooled / n, extra])


def _partial_tables(shape: Shape, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((shape.rows, shape.dimensions), np.int32)
        for batch in words.slices(batches, text_col, 1_000_000):
            _context(batch.column(text_col), shape, table)
        yield blocks.cut(table.astype(np.int64).ravel(), 16)

    return run


def _train(x: np.ndarray, y: np.ndarray, table: np.ndarray, shape: Shape) -> Model:
    random = np.random.default_rng(shape.seed)
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(shape, table, x.mean(0) if len(x) else np.zeros(width), x.std(0) + 1e-3 if len(x) else np.ones(width), np.zeros((width, shape.hidden)), np.zeros(shape.hidden), np.zeros(shape.hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.first = random.normal(0, width**-0.5, (width, shape.hidden))
    model.second = random.normal(0, shape.hidden**-0.5, shape.hidden)
    aside = np.arange(len(y)) % 5 == 0
    z = ((x - model.mean) / model.scale)[~aside]
    target = y[~aside]
    weights = [model.first, model.first_bias, model.second, np.array([model.second_bias])]
    speed, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, shape.epochs + 1):
        hidden = np.tanh(z @ weights[0] + weights[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - target) / len(target)
        back = np.outer(error, weights[2]) * (1 - hidden**2)
        slopes = [z.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
        for w, slope, v, s in zip(weights, slopes, speed, square):
            v += 0.1 * (slope - v)
            s += 0.001 * (slope**2 - s)
            w -= 0.01 * (v / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.second_bias = float(weights[3][0])
    logits, target = model.logits(x[aside]), y[aside]
    losses = {t: np.logaddexp(0, np.where(target > 0, -logits, logits) / t).mean() for t in np.geomspace(0.5, 8, 60)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, shape: Shape = Shape(), max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the labels whose id satisfies ``learn``, a condition on ``doc_id``."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    # At most ``max_train`` rows of two numbers.
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = staged(known.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "quality-sample")
    sums = blocks.folded(sample.select("text").mapInArrow(_partial_tables(shape, "text"), blocks.SCHEMA), np.add, np.int64)
    table = np.zeros(shape.rows * shape.dimensions) if sums is None else sums
    table = table.reshape(shape.rows, shape.dimensions).astype(np.float32)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 1_000_000):
            rows = features(batch.column("text"), shape, shared.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.string()), "label": batch.column("label"), "vector": pa.array([r.tobytes() for r in rows], pa.binary())})

    rows = sorted((r.doc_id, r.label, r.vector) for r in sample.mapInArrow(pooled, "doc_id string, label int, vector binary").collect())
    width = 2 * shape.dimensions + _EXTRA
    x = np.array([np.frombuffer(r[2]) for r in rows]).reshape(-1, width)
    return _train(x, np.array([r[1] for r in rows], float), table, shape)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (probability of a good text) and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, text_col, 1_000_000):
            value = shared.value.probability(features(batch.column(text_col), shared.value.shape, shared.value.table))
            columns = [*(batch.column(c) for c in names), pa.array(value), pa.array((value >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(names).mapInArrow(run, schema)
