"""Text vectors and similarity of items to given items."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.functions import text as tx
from catalens.operators import products
from catalens.operators.stats import as_scalar
from catalens.session import ship, staged

# ---- fixed values -----------------------------------------------------------
MAX_TERMS = 1000
STOP_WORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers him his how i if in
into is it its just me more most my no nor not now of off on once only or other our out over own same she should so
some such than that the their them then there these they this those through to too under until up very was we were
what when where which while who whom why will with would you your
""".split()
# -----------------------------------------------------------------------------


def words(col: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Tokens without stop words."""
    return F.filter(tx.tokens(col), lambda w: ~w.isin(list(stop_words)))


def with_pairs(single: Column) -> Column:
    """Words followed by all pairs of neighbouring words."""
    last = F.greatest(F.size(single) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(single, 1, last), F.slice(single, 2, last), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(single, pairs)


def term_rows(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """One row per occurrence of a word or word pair: ``(key, term)``."""
    listed = df.select(F.col(key), words(F.col(text), stop_words).alias("__words"))
    return listed.select(key, F.explode(with_pairs(F.col("__words"))).alias("term"))


def _coded(frequent: pa.Array):
    """Texts' words as places among the frequent words; a run of others is one -1, none where a text begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("__words")
            counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(listed.flatten(), value_set=frequent), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            kept = code >= 0
            kept[1:] |= (code[:-1] >= 0) & (row[1:] == row[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(row[kept], code[kept], len(counts))], ["key", "codes"])

    return run


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One list of 32-bit numbers for each of ``n`` rows; ``row`` is in order."""
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _flat(listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a list column."""
    counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(counts)), counts), listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _neighbours(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every pair of neighbouring frequent words."""
    met = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
    return row[met], code[met] * size + code[met + 1]


def _count_pairs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(_neighbours(*_flat(batch.column("codes")), size)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    return run


def _summed(keys: pa.Array, row: np.ndarray, term: np.ndarray, times: np.ndarray, size: int) -> pa.RecordBatch:
    """One row a key with its terms and how often each occurs; keys without terms have none."""
    cell, place = np.unique(row * size + term, return_inverse=True)
    total = np.bincount(place, times, minlength=len(cell)).astype(np.int64)
    held, row = np.unique(cell // size, return_inverse=True)
    lists = [_lists(row, x, len(held)) for x in (cell % size, total)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(held)), *lists], ["key", "terms", "times"])


def _count_terms(word_terms: np.ndarray, pairs: np.ndarray, pair_terms: np.ndarray, size: int):
    """Occurrences of each term in a text; ``word_terms`` is the term of a frequent word or -1, ``pairs`` are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code = _flat(batch.column("codes"))
            term = np.where(code >= 0, word_terms[code], -1) if len(word_terms) else code
            near, pair = _neighbours(row, code, len(word_terms))
            place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            met = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
            row, term = np.append(row[term >= 0], near[met]), np.append(term[term >= 0], pair_terms[place[met]])
            yield _summed(batch.column(0), row, term, np.ones(len(row)), size)

    return run


def _merge_terms(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = _flat(batch.column("terms"))
            yield _summed(batch.column(0), row, term, _flat(batch.column("times"))[1], size)

    return run


def _weigh(terms: pa.Array, rarity: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term = _flat(batch.column("terms"))
            raw = _flat(batch.column("times"))[1] * rarity[term]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(term)), pa.array(raw / norm[row])], names)

    return run


def tfidf(
    df: DataFrame, key: str, text: str, max_terms: int = MAX_TERMS, stop_words: Sequence[str] = tuple(STOP_WORDS)
) -> DataFrame:
    """Sparse unit vectors ``(key, term, weight)`` over the most frequent terms.

    weight = tf * (ln((1 + N) / (1 + df)) + 1), then L2-normalised. No pair of words occurs more often than either
    word, so a pair among the ``max_terms`` most frequent terms has words as frequent as the last of the ``max_terms``
    most frequent words: only such words are kept of a text, as numbers, and only their pairs are counted. Terms
    are counted text by text, and what is shuffled or written of a text is one row of at most ``max_terms`` terms.
    A task holds the words that are as frequent as that.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    ship(spark)
    listed = df.select(F.col(key).alias("key"), words(F.col(text), stop_words).alias("__words"))
    single = staged(listed.select(F.explode("__words").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "word-counts")
    first = single.orderBy(F.desc("n"), "term").limit(max_terms).select("n").toArrow()["n"].to_pylist()
    least = min(first) if len(first) == max_terms else 0
    frequent = single.where(F.col("n") >= least).orderBy(F.desc("n"), "term").toArrow()
    named = frequent["term"].combine_chunks().cast(pa.string())
    coded = staged(listed.mapInArrow(_coded(named), f"key {kind}, codes array<int>"), "codes")
    size = len(named)
    pairs = coded.mapInArrow(_count_pairs(size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # The terms that may be among the first, by their order; words are found by their number.
    numbered = staged(spark.createDataFrame(pa.table({"code": np.arange(size), "term": named})), "words")
    left, right = (numbered.select(F.col("code").alias(f"c{i}"), F.col("term").alias(f"t{i}")) for i in (1, 2))
    split = pairs.select("pair", "n", F.expr(f"pair div {max(size, 1)}").alias("c1"), F.expr(f"pair % {max(size, 1)}").alias("c2"))
    spelt = split.join(F.broadcast(left), "c1").join(F.broadcast(right), "c2").select("pair", "n", F.concat("t1", F.lit(" "), "t2").alias("term"))
    # At most ``max_terms`` rows of each.
    best = spelt.orderBy(F.desc("n"), "term").limit(max_terms).toArrow().select(["pair", "n", "term"]).to_pylist()
    best += [{"code": i, "n": n, "term": t} for i, (t, n) in enumerate(zip(named[:max_terms].to_pylist(), frequent["n"].to_pylist()))]
    # Spark and DuckDB compare strings by their bytes.
    best = sorted(best, key=lambda x: (-x["n"], x["term"].encode()))[:max_terms]
    word_terms = np.full(size, -1)
    for i, x in enumerate(best):
        if "code" in x:
            word_terms[x["code"]] = i
    told = sorted((x["pair"], i) for i, x in enumerate(best) if "pair" in x)
    told = np.array(told, np.int64).reshape(-1, 2)
    schema = f"key {kind}, terms array<int>, times array<int>"
    counts = coded.mapInArrow(_count_terms(word_terms, told[:, 0], told[:, 1], max(len(best), 1)), schema)
    if coded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        both = counts.groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("terms", "times")])
        counts = both.mapInArrow(_merge_terms(max(len(best), 1)), schema)
    counts = staged(counts, "terms")
    held = {r.term: r.df for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    total = coded.count()
    rarity = np.array([math.log((1.0 + total) / (1.0 + held.get(i, 0))) + 1.0 for i in range(len(best))])
    terms = pa.array([x["term"] for x in best], pa.string())
    return counts.mapInArrow(_weigh(terms, rarity, [key, "term", "weight"]), f"`{key}` {kind}, term string, weight double")


# Sums arrive in any order on a cluster; scores closer than this count as ties.
TIE_DIGITS = 9


def _top(df: DataFrame, key: str, score: str, n: int | None) -> DataFrame:
    rounded = df.withColumn(score, F.round(score, TIE_DIGITS))
    return rounded if n is None else rounded.orderBy(F.desc(score), key).limit(n)


def similar_by_terms(vectors: DataFrame, key: str, item, n: int | None = 5) -> DataFrame:
    """Items closest by cosine to one item, itself excluded: ``(key, similarity)``.

    The item's own vector has at most ``MAX_TERMS`` entries, so it is sent to
    all tasks; the other vectors are read once and summed per item.
    """
    wanted = vectors.where(F.col(key) == item).select("term", F.col("weight").alias("own"))
    scored = (
        vectors.where(F.col(key) != item)
        .join(F.broadcast(wanted), "term")
        .groupBy(key)
        .agg(F.sum(F.col("weight") * F.col("own")).alias("similarity"))
    )
    return _top(scored, key, "similarity", n)


def _dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def similar_by_embedding(
    df: DataFrame, key: str, vector: str, item, n: int | None = 5, metric: str = "cosine"
) -> DataFrame:
    """Items closest to one item by dense vectors: cosine or Euclidean."""
    single = df.where(F.col(key) == item).agg(F.first(vector).alias("v"))
    target = as_scalar(single.select("v", F.sqrt(_dot(F.col("v"), F.col("v"))).alias("norm")))
    rest = df.where(F.col(key) != item).withColumn("__own", target)
    own, other = F.col("__own.v"), F.col(vector)
    if metric == "cosine":
        score = _dot(other, own) / (F.sqrt(_dot(other, other)) * F.col("__own.norm"))
        return _top(rest.select(key, score.alias("similarity")), key, "similarity", n)
    gaps = F.zip_with(other, own, lambda x, y: x.cast("double") - y.cast("double"))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x))
    scored = rest.select(key, F.round(distance, TIE_DIGITS).alias("distance"))
    return scored if n is None else scored.orderBy("distance", key).limit(n)


def similar_by_sets(df: DataFrame, key: str, items: str, item, n: int | None = 5) -> DataFrame:
    """Items closest to one item by Jaccard similarity of array columns."""
    own = as_scalar(df.where(F.col(key) == item).agg(F.first(items).alias("v")))["v"]
    union = F.size(F.array_union(items, own))
    score = F.when(union > 0, F.size(F.array_intersect(items, own)) / union).otherwise(0.0)
    return _top(df.where(F.col(key) != item).select(key, score.alias("similarity")), key, "similarity", n)


def spec_match_score(wanted: dict[str, object]) -> Column:
    """Share of the wanted specs a row meets.

    Text counts when equal; a number by closeness, ``min / max`` of the two.
    """
    parts = []
    for name, value in wanted.items():
        col = F.col(name)
        if isinstance(value, str):
            part = (col == value).cast("double")
        else:
            target = F.lit(float(value))
            part = F.when(col > 0, F.least(col, target) / F.greatest(col, target))
        parts.append(F.coalesce(part, F.lit(0.0)))
    return sum(parts, F.lit(0.0)) / len(parts)


def spec_match(df: DataFrame, key: str, wanted: dict[str, object], n: int | None = 5) -> DataFrame:
    return _top(df.select(key, spec_match_score(wanted).alias("similarity")), key, "similarity", n)


def blend(scores: Sequence[tuple[DataFrame, float]], key: str, score: str, n: int | None = None) -> DataFrame:
    """Weighted sum of several score tables ``(key, score)``; an absent score counts 0."""
    weighted = None
    for table, weight in scores:
        part = table.select(key, (F.col(score) * weight).alias("__part"))
        weighted = part if weighted is None else weighted.unionByName(part)
    return _top(weighted.groupBy(key).agg(F.sum("__part").alias("score")), key, "score", n)


def _split_terms(vectors: DataFrame, key: str, min_similarity: float) -> DataFrame:
    """Unit vectors with ``heavy``: the rarest terms, without which no cosine reaches ``min_similarity``.

    ``after`` is the squared length of what follows a term in the vector, rarest terms
    first; ``end`` is the place of the vector's last heavy term in the one order of all
    terms, and ``tail`` the squared length of what follows that.
    """
    spread = vectors.groupBy("term").agg(F.count("*").alias("df"))
    rare_first = Window.partitionBy(key).orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing)
    square = F.col("weight") * F.col("weight")
    rest = vectors.join(spread, "term").withColumn("rest", F.sum(square).over(rare_first))
    # What is left of the vector from this term on can still make the similarity.
    heavy = F.col("rest") >= min_similarity**2 - 10**-TIE_DIGITS
    rest = rest.withColumns({"heavy": heavy, "after": F.greatest(F.col("rest") - square, F.lit(0.0))})
    own = Window.partitionBy(key)
    marked = rest.withColumns(
        {"end": F.max(F.when(F.col("heavy"), F.struct("df", "term"))).over(own), "tail": F.min(F.when(F.col("heavy"), F.col("after"))).over(own)}
    )
    return marked.select(key, "term", "weight", "heavy", "after", "end", "tail")


def candidate_pairs(terms: DataFrame, key: str, items: DataFrame, min_similarity: float) -> DataFrame:
    """``(item, neighbour, part, own_first)`` of pairs that may reach ``min_similarity``; none that does is lost.

    ``terms`` are from `_split_terms`. The heavy terms that two vectors share, summed in
    ``part``, are all they share up to the end of the one that ends first (the item if
    ``own_first``). What they share beyond lies in that one's tail, and in the other
    after the last shared heavy term: those lengths bound the rest of the cosine.
    """
    heavy = terms.where("heavy").drop("heavy")
    wanted = heavy.join(items.select(key).distinct(), key, "left_semi")
    wanted = wanted.select(F.col(key).alias("item"), "term", *[F.col(c).alias(f"own_{c}") for c in ("weight", "after", "end", "tail")])
    met = wanted.join(heavy.withColumnRenamed(key, "neighbour"), "term").where("item <> neighbour")
    met = met.withColumn("own_first", F.col("own_end") <= F.col("end"))
    beyond = F.when(F.col("own_first"), F.col("own_tail") * F.col("after")).otherwise(F.col("own_after") * F.col("tail"))
    summed = met.groupBy("item", "neighbour").agg(
        F.sum(F.col("own_weight") * F.col("weight")).alias("part"), F.min(beyond).alias("beyond"), F.first("own_first").alias("own_first")
    )
    return summed.where(F.col("part") + F.sqrt("beyond") >= min_similarity - 10**-TIE_DIGITS).drop("beyond")


def similarity_table(vectors: DataFrame, key: str, items: DataFrame, n: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """Neighbours ``(item, neighbour, similarity, rank)`` of every item in a list of any length.

    ``vectors`` are unit vectors ``(key, term, weight)``. Exact for all neighbours of at least ``min_similarity``:
    blocks of vectors are multiplied (`products`), so the pairs are neither shuffled nor written. The best ``n`` per
    item are kept, by similarity, then key.
    """
    return products.nearest(vectors, key, items, n, min_similarity, TIE_DIGITS)


SLOTS = 64


def _slot(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(SLOTS)).cast("int")


def write_similarity_table(found: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a similarity table by hash of item, so that a lookup reads one slot."""
    found.withColumn("slot", _slot(F.col("item"))).repartition("slot").write.mode(mode).partitionBy("slot").parquet(path)


def read_similarity_table(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """A stored similarity table; ``kind`` is the type of its items."""
    return spark.read.schema(f"item {kind}, neighbour {kind}, similarity double, rank int, slot int").parquet(path)


def read_similar(spark: SparkSession, path: str, item, kind: str = "bigint") -> DataFrame:
    """The stored neighbours of one item: ``(neighbour, similarity, rank)``."""
    stored = read_similarity_table(spark, path, kind)
    own = F.lit(item).cast(kind)
    return stored.where((F.col("slot") == _slot(own)) & (F.col("item") == own)).select("neighbour", "similarity", "rank")
