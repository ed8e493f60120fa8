"""Cleaning of arriving reviews with the statistics of an earlier batch run.

Row-wise stages are the batch expressions unchanged. Medians and price limits
describe a whole table, so a stream takes them from a stored statistics row
that a batch run writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.operators import clean
from catalens.operators.stats import exact_medians


def table_statistics(raw: DataFrame, roles: clean.Roles = clean.Roles()) -> DataFrame:
    """One row: median per imputed column, and the price limits of the cleaned table."""
    present = [c for c in roles.medians if c in raw.columns]
    limits = clean.outlier_limits(clean.clean_table(raw, roles, trim=False), "price_numeric")
    medians = exact_medians(clean.to_numbers(raw, present), present)
    return limits.select(*[medians[c].alias(f"median_{c}") for c in present], "low", "high")


def clean_stream(stream: DataFrame, statistics: dict[str, float], roles: clean.Roles = clean.Roles()) -> DataFrame:
    """Clean a streaming review table; ``statistics`` is the stored row as a dict.

    Rows are not deduplicated here: that needs a bounded watermark, which is
    the caller's choice (`dropDuplicatesWithinWatermark`).
    """
    rows = clean.clean_rows(stream, roles)
    present = [c for c in roles.medians if c in rows.columns]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(statistics[f"median_{c}"])) for c in present})
    rows = clean.drop_short_content(rows, roles.text, roles.title)
    return rows.where(F.col("price_numeric").between(statistics["low"], statistics["high"]))


def write_statistics(statistics: DataFrame, path: str) -> None:
    statistics.write.mode("overwrite").parquet(path)


def read_statistics(spark, path: str) -> dict[str, float]:
    return spark.read.parquet(path).first().asDict()
