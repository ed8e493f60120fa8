"""A stream cleaned with stored statistics equals the batch result row by row."""

from catalens.operators import clean
from catalens.session import scratch_path
from catalens.streaming import incremental
from catalens.workload.fixtures import WIDE, load


def test_stream_equals_batch(spark, folder):
    source, stats_path = scratch_path(spark, "stream-in"), scratch_path(spark, "stats")
    load(spark, folder, WIDE).write.parquet(source)
    raw = spark.read.parquet(source)
    incremental.write_statistics(incremental.table_statistics(raw), stats_path)
    stats = incremental.read_statistics(spark, stats_path)

    stream = spark.readStream.schema(raw.schema).parquet(source)
    cleaned = incremental.clean_stream(stream, stats).select("row_id", "rating", "text", "price_numeric")
    query = (
        cleaned.writeStream.format("memory").queryName("cleaned_reviews")
        .option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    streamed = {r.row_id: tuple(r) for r in spark.table("cleaned_reviews").collect()}
    batch = {r.row_id: tuple(r) for r in clean.clean_table(raw).select("row_id", "rating", "text", "price_numeric").collect()}
    assert batch and all(streamed[key] == row for key, row in batch.items())
