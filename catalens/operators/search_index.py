"""A stored inverted index that is searched without reading texts, and kept up by segments.

Folders below the index path, all parquet::

    postings/segment=S/bucket=B   term, key, tf and the stored fields; B by hash of the term, sorted by term
    items/segment=S/slot=L        key, text and the stored fields; L by hash of the key
    gone/segment=S                keys whose rows in segments before S no longer count
    live/version=V                the segments that count

A segment is written in full before the next version of ``live`` names it, so a reader sees an index before or after
a change and never half of one; a job that dies leaves files that nothing names. `add` writes a delta
segment, `remove` only keys, `merge` makes one segment of all. Write from one job at a time.

A search reads the buckets of its words only. Filters and order use the stored fields beside the postings, and texts are fetched
for the rows of the result alone, from their slots. A word that most items hold is spread over ``SPREAD`` files.

Words are counted inside their row, slice by slice and in order of term, so postings are shuffled once, to the task of
their file, where they arrive in sorted runs. Only rows whose key repeats in the change are grouped by term and key.

Rows that repeat a key in one change count as one item with all their words and the largest stored fields.
Items without a key are left out; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from catalens.operators.vectors import words
from catalens.session import ship, staged

SPREAD = 8
SLICE_WORDS = 500_000


@dataclass(frozen=True)
class SearchIndex:
    """Where an index lies and which columns it is made of."""

    path: str
    key: str = "asin"
    text: str = "title"
    stored: tuple[str, ...] = ("brand", "price", "average_rating")
    parts: int = 64
    stop_words: tuple[str, ...] = ()


def _part(col: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")


def live_segments(spark: SparkSession, index: SearchIndex) -> tuple[int, dict[int, int]]:
    """Version, and the segments that count with the number of keys each takes from those before it; one row a segment."""
    try:
        rows = spark.read.schema("segment int, gone long, version int").parquet(f"{index.path}/live")
    except AnalysisException:
        return 0, {}
    last = rows.agg(F.max("version")).first()[0] or 0
    return last, {r.segment: r.gone for r in rows.where(F.col("version") == last).collect()}


def _commit(spark: SparkSession, index: SearchIndex, version: int, segments: dict[int, int]) -> None:
    rows = spark.createDataFrame([(s, g) for s, g in sorted(segments.items())], "segment int, gone long")
    rows.coalesce(1).write.parquet(f"{index.path}/live/version={version}")


def _counted(fields: Sequence[str]):
    """Postings (term, key, tf, stored fields) of rows whose first column lists their words, in order of term within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            total = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(0)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                before = total[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(total, before + SLICE_WORDS, "right")))
                batch, sizes = whole.slice(at, stop - at), np.diff(total[at:stop], prepend=before)
                at = stop
                coded = batch.column(0).flatten().dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                row = np.repeat(np.arange(len(sizes)), sizes)
                found, tf = np.unique(rank[coded.indices.to_numpy()] * len(sizes) + row, return_counts=True)
                term = coded.dictionary.take(pa.array(order[found // len(sizes)]))
                key, *stored = (batch.column(c).take(pa.array(found % len(sizes))) for c in fields)
                yield pa.RecordBatch.from_arrays([term, key, pa.array(tf.astype(np.int64)), *stored], ["term", fields[0], "tf", *fields[1:]])

    return run


def _rows(items: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame]:
    """Items, and postings with the stored fields beside them."""
    ship(items.sparkSession)
    named = items.where(F.col(index.key).isNotNull())
    each = named.groupBy(index.key).agg(F.max(index.text).alias(index.text), *[F.max(c).alias(c) for c in index.stored])
    fields = (index.key, *index.stored)
    key, *stored = (StructField(c, named.schema[c].dataType) for c in fields)
    schema = StructType([StructField("term", StringType()), key, StructField("tf", LongType()), *stored])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(words(F.col(index.text), index.stop_words).alias("__words"), *fields).mapInArrow(_counted(fields), schema)

    repeated = staged(named.groupBy(index.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(index.key), "index-repeats")
    if repeated.isEmpty():
        return each, counted(named)
    tf = counted(named.join(repeated, index.key, "left_semi")).groupBy("term", index.key).agg(F.sum("tf").alias("tf"))
    several = tf.join(each.drop(index.text), index.key).select("term", index.key, "tf", *index.stored)
    return each, counted(named.join(repeated, index.key, "left_anti")).union(several)


def _write(postings: DataFrame, items: DataFrame, index: SearchIndex, segment: int) -> None:
    bucketed = postings.withColumn("bucket", _part(F.col("term"), index.parts))
    spread = F.pmod(F.xxhash64("term", index.key), F.lit(SPREAD)).cast("int")
    # One file is one task, so sorted runs stay sorted in it.
    dealt = bucketed.repartitionById(index.parts * SPREAD, F.col("bucket") * SPREAD + spread)
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/postings/segment={segment}")
    slotted = items.withColumn("slot", _part(F.col(index.key), index.parts))
    slotted.repartition("slot").sortWithinPartitions("slot", index.key).write.partitionBy("slot").parquet(f"{index.path}/items/segment={segment}")


def _next(spark: SparkSession, index: SearchIndex, version: int) -> int:
    """A segment number that no version has used, also of a job that died."""
    try:
        used = spark.read.option("basePath", index.path).parquet(f"{index.path}/gone").agg(F.max("segment")).first()[0]
    except AnalysisException:
        used = None
    return max(version, used or 0) + 1


def create(spark: SparkSession, items: DataFrame, index: SearchIndex) -> None:
    """Write ``items`` as the whole index; an index that is there is replaced by its next version."""
    version, _ = live_segments(spark, index)
    segment = _next(spark, index, version)
    each, postings = _rows(items, index)
    _gone(items.select(index.key).limit(0), index, segment)
    _write(postings, each, index, segment)
    _commit(spark, index, version + 1, {segment: 0})


def _gone(keys: DataFrame, index: SearchIndex, segment: int) -> None:
    keys.select(index.key).distinct().write.parquet(f"{index.path}/gone/segment={segment}")


def _held(spark: SparkSession, index: SearchIndex, kind: str, segments: Sequence[int]) -> DataFrame:
    rows = spark.read.parquet(f"{index.path}/{kind}")
    return rows.where(F.col("segment").isin(list(segments)))


def _change(spark: SparkSession, index: SearchIndex, keys: DataFrame, rows: tuple[DataFrame, DataFrame] | None) -> None:
    version, segments = live_segments(spark, index)
    segment = _next(spark, index, version)
    old = _held(spark, index, "items", list(segments)).select(index.key)
    _gone(old.join(keys.select(index.key), index.key, "left_semi"), index, segment)
    count = spark.read.parquet(f"{index.path}/gone/segment={segment}").count()
    if rows:
        _write(rows[1], rows[0], index, segment)
    _commit(spark, index, version + 1, {**segments, segment: count})


def add(spark: SparkSession, items: DataFrame, index: SearchIndex) -> None:
    """A delta segment of new items, and of known ones in their new form."""
    each, postings = _rows(staged(items.select(index.key, index.text, *index.stored), "index-items"), index)
    _change(spark, index, each, (each, postings))


def remove(spark: SparkSession, keys: DataFrame, index: SearchIndex) -> None:
    """Items with these keys no longer count."""
    _change(spark, index, keys, None)


def _live(spark: SparkSession, index: SearchIndex, kind: str, keep: Column | None = None) -> DataFrame:
    """Rows that count; ``keep`` is applied first, so that it reaches the scan."""
    _, segments = live_segments(spark, index)
    rows = _held(spark, index, kind, list(segments))
    rows = rows if keep is None else rows.where(keep)
    if not any(segments.values()):
        return rows
    gone = _held(spark, index, "gone", [s for s, n in segments.items() if n]).groupBy(F.col(index.key).alias("__gone")).agg(F.max("segment").alias("__before"))
    return rows.join(gone, (F.col(index.key) == F.col("__gone")) & (F.col("segment") < F.col("__before")), "left_anti")


def postings(spark: SparkSession, index: SearchIndex) -> DataFrame:
    """``(term, key, tf)`` of all items that count."""
    return _live(spark, index, "postings").select("term", index.key, "tf")


def merge(spark: SparkSession, index: SearchIndex) -> None:
    """One segment of all rows that count; the files of older versions stay until the folder is removed."""
    version, segments = live_segments(spark, index)
    if len(segments) < 2 and not any(segments.values()):
        return
    segment = _next(spark, index, version)
    schema = StructType([f for f in spark.read.parquet(f"{index.path}/items").schema if f.name == index.key])
    _gone(spark.createDataFrame([], schema), index, segment)
    _write(_live(spark, index, "postings").drop("segment", "bucket"), _live(spark, index, "items").drop("segment", "slot"), index, segment)
    _commit(spark, index, version + 1, {segment: 0})


def search(
    spark: SparkSession,
    index: SearchIndex,
    query: str,
    min_rating: float | None = None,
    max_price: float | None = None,
    brands: Sequence[str] | None = None,
    sort_by: str = "relevance",
    limit: int = 10,
    price: str = "price",
    brand: str = "brand",
    rating: str = "average_rating",
) -> DataFrame:
    """The same result as `recommend.search` over the items that count, read from the index.

    relevance is the number of distinct query words found; ties by key.
    """
    wanted = list(dict.fromkeys(query.lower().split()))
    keep = F.col("term").isin(wanted) & F.col("bucket").isin([_part(F.lit(w), index.parts) for w in wanted])
    if min_rating is not None:
        keep = keep & (F.col(rating) >= min_rating)
    if max_price is not None:
        keep = keep & (F.col(price) <= max_price)
    if brands:
        keep = keep & F.col(brand).isin(list(brands))
    orders = {
        "relevance": [F.desc("relevance")],
        "rating": [F.desc(rating), F.desc("relevance")],
        "price": [F.asc(price), F.desc("relevance")],
    }
    if sort_by not in orders:
        raise ValueError(f"sort_by must be one of {sorted(orders)}")
    order = [*orders[sort_by], index.key]
    hits = _live(spark, index, "postings", keep).groupBy(index.key, "segment", *index.stored).agg(F.count(F.lit(1)).cast("int").alias("relevance"))
    best = hits.orderBy(*order).limit(limit).withColumn("slot", _part(F.col(index.key), index.parts))
    _, segments = live_segments(spark, index)
    texts = _held(spark, index, "items", list(segments)).select("segment", "slot", index.key, index.text)
    # At most ``limit`` rows are sent; their slots prune the scan of the texts.
    found = texts.join(F.broadcast(best), ["segment", "slot", index.key])
    return found.orderBy(*order).select(index.key, index.text, brand, price, rating, "relevance")
