"""Drop lines that many documents share.

Lines are exploded with their position, normalised and hashed; a hash held by
``min_docs`` documents or more loses its lines everywhere except in the largest
document id that holds it. The other lines are put together by position.

Only hashes and positions are shuffled for counting; counting combines before
each shuffle, so a line that a third of all documents hold is one row per task.
Joining the hot hash back is an ordinary join that adaptive execution splits.

Cases: a null or empty text is one empty line and stays as it is. Rows without
an id are neither counted nor changed. Rows that repeat an id count as one
document, and each loses its own lines. Columns ``n_lines`` and ``n_dropped`` of
the input are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.names import fresh
from catalens.session import staged

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z as a-z."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and n_lines (before), n_dropped."""
    body = docs.drop("n_lines", "n_dropped")
    text_hash, owner, owner_hash, gone, parts = fresh(body, "text_hash", "id", "hash", "drop", "lines")
    body = body.withColumn(text_hash, F.xxhash64(text_col))
    key = (
        body.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(text_hash).alias("text_hash"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
        .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Written, so that the join below has shuffles of its own, which adaptive execution may split.
    shared = staged(key.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs), "shared-lines")
    drops = (
        key.join(shared, ["h1", "h2"])
        .where(F.col("id") < F.col("keep"))
        .groupBy(F.col("id").alias(owner), F.col("text_hash").alias(owner_hash))
        .agg(F.collect_set("pos").alias(gone))
    )
    joined = body.join(drops, (F.col(id_col) == F.col(owner)) & (F.col(text_hash) == F.col(owner_hash)), "left")
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    # The one-row inline keeps the split lines a column, so that the lambda below does not split again for each line.
    whole = joined.select(*others, F.inline(F.array(F.struct(F.split(F.coalesce(text_col, F.lit("")), "\n", -1).alias(parts), F.col(gone)))))
    size = F.size(parts)
    kept = F.array_except(F.sequence(F.lit(0), size - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return whole.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in others],
        size.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
