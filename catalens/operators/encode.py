"""Scaling, label codes and their inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions import text as tx
from catalens.functions.bins import date_parts, to_moment
from catalens.operators.clean import select_existing
from catalens.operators.stats import as_scalar, number
from catalens.session import staged

# ---- fixed values -----------------------------------------------------------
PRODUCT_NUMBERS = ["average_rating", "rating_number"]
PRODUCT_LABELS = ["brand", "os", "color", "store"]
PRODUCT_TEXTS = ["title_y", "features"]
PRODUCT_ESSENTIALS = ["asin", "parent_asin", "price_usd", "price_myr", "price_category_myr"]
PRODUCT_SPECS = [
    "ram_gb", "storage_gb", "screen_size_inches", "storage_type", "ram_type", "processor_model",
    "gpu_model", "storage_category", "storage_display", "ram_category", "screen_category",
]
REVIEW_NUMBERS = ["rating", "helpful_vote"]
REVIEW_TEXTS = ["title_x", "text"]
REVIEW_ESSENTIALS = ["asin", "parent_asin", "user_id_encoded", "rating", "helpful_vote"]
RATING_SPAN = 5
# -----------------------------------------------------------------------------


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scaler state, one row per column: ``(column, min, max)``; missing counts as 0."""
    limits = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(F.coalesce(number(c), F.lit(0.0))).alias("min"),
            F.max(F.coalesce(number(c), F.lit(0.0))).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*limits).alias("limits")).select(F.inline("limits"))


def apply_minmax(df: DataFrame, scaler: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    wide = scaler.agg(
        *[F.max(F.when(F.col("column") == c, F.col("min"))).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(F.when(F.col("column") == c, F.col("max"))).alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    at = as_scalar(wide)

    def scaled(i: int, c: str) -> Column:
        lo, hi = at[f"lo_{i}"], at[f"hi_{i}"]
        shifted = F.coalesce(number(c), F.lit(0.0)) - lo
        return F.when(hi == lo, F.lit(0.0)).otherwise(shifted / (hi - lo))

    return df.withColumns({c + suffix: scaled(i, c) for i, c in enumerate(columns)})


def scale_minmax(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    return apply_minmax(df, fit_minmax(df, columns), columns, suffix)


def fit_labels(df: DataFrame, columns: Sequence[str], default: str = tx.UNKNOWN_NAME) -> DataFrame:
    """Encoder state ``(column, value, code)``: codes 0..k-1 in code-point order.

    Distinct values are range partitioned and numbered inside their partition;
    partition offsets then make the numbers dense, so no task ever sees all
    values. The ranged rows are written out first: their partition number has to
    be the same for the offsets and for the numbers.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(default)).alias("value")) for c in columns]
    )
    distinct = df.select(F.inline(pairs)).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(
        distinct.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id()), "labels"
    )
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("column", "part")
        .agg(F.count("*").alias("size"))
        .select("column", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("column", "part").orderBy("value")
    numbered = ranged.withColumn("number", F.row_number().over(inside))
    return numbered.join(offsets, ["column", "part"]).select(
        "column", "value", (F.col("offset") + F.col("number") - 1).alias("code")
    )


def apply_labels(
    df: DataFrame, encoder: DataFrame, columns: Sequence[str], default: str = tx.UNKNOWN_NAME
) -> DataFrame:
    """Add ``<column>_encoded``. The join is left to the optimizer: it broadcasts
    an encoder whose measured size allows it and shuffles a large one."""
    for c in columns:
        codes = encoder.where(F.col("column") == c).select(
            F.col("value").alias(f"__value_{c}"), F.col("code").alias(f"{c}_encoded")
        )
        named = F.coalesce(F.col(c).cast("string"), F.lit(default))
        df = df.withColumn("__name", named).join(codes, F.col("__name") == F.col(f"__value_{c}"), "left")
        df = df.drop("__name", f"__value_{c}")
    return df


def encode_labels(df: DataFrame, columns: Sequence[str], default: str = tx.UNKNOWN_NAME) -> DataFrame:
    return apply_labels(df, fit_labels(df, columns, default), columns, default)


def decode_labels(df: DataFrame, encoder: DataFrame | None, column: str, target: str | None = None) -> DataFrame:
    """Names for codes: from the encoder, else the code marked as encoded, else Unknown.

    A table that still has the plain column keeps its names.
    """
    target = target or f"{column}_display"
    code = f"{column}_encoded"
    if column in df.columns:
        return df.withColumn(target, F.col(column))
    if code not in df.columns:
        return df.withColumn(target, F.lit(tx.UNKNOWN_NAME))
    marked = F.concat(F.col(code).cast("string"), F.lit(" (encoded)"))
    if encoder is None:
        return df.withColumn(target, marked)
    names = encoder.where(F.col("column") == column).select(F.col("code").alias(code), F.col("value").alias(target))
    return df.join(names, code, "left")


def rescale_ratings(df: DataFrame, column: str = "rating", target: str = "rating_scaled") -> DataFrame:
    """Ratings on a 0-1 scale go back to 0-5; others are copied.

    The scale is judged by the maximum of the whole column.
    """
    top = as_scalar(df.agg(F.max(column).alias("top")))["top"]
    return df.withColumn(target, F.when(top <= 1.0, F.col(column) * RATING_SPAN).otherwise(F.col(column)))


def unscale(df: DataFrame, scaler: DataFrame, column: str, target: str) -> DataFrame:
    """True inverse of min-max scaling."""
    at = as_scalar(scaler.where(F.col("column") == column).select("min", "max"))
    return df.withColumn(target, F.col(column) * (at["max"] - at["min"]) + at["min"])


def normalize_products(df: DataFrame) -> DataFrame:
    """Scale, encode and clean the product table, then keep the output columns."""
    numbers = [c for c in PRODUCT_NUMBERS if c in df.columns]
    labels = [c for c in PRODUCT_LABELS if c in df.columns]
    texts = [c for c in PRODUCT_TEXTS if c in df.columns]
    if numbers:
        df = scale_minmax(df, numbers)
    if labels:
        df = encode_labels(df, labels)
    df = df.withColumns({f"{c}_clean": tx.clean_text(F.col(c)) for c in texts})
    wanted = (
        PRODUCT_ESSENTIALS + [f"{c}_encoded" for c in labels] + [f"{c}_clean" for c in texts] + numbers + PRODUCT_SPECS
    )
    return select_existing(df, wanted)


def normalize_reviews(df: DataFrame, moment: str = "timestamp", epoch_unit: str | None = None) -> DataFrame:
    """Scale, encode users, clean texts and take date parts of the review table."""
    numbers = [c for c in REVIEW_NUMBERS if c in df.columns]
    texts = [c for c in REVIEW_TEXTS if c in df.columns]
    if numbers:
        df = scale_minmax(df, numbers)
    if "user_id" in df.columns:
        df = encode_labels(df, ["user_id"], default="unknown")
    df = df.withColumns({f"{c}_clean": tx.clean_text(F.col(c)) for c in texts})
    if moment in df.columns:
        is_time = df.schema[moment].dataType.typeName().startswith("timestamp")
        df = df.withColumns(date_parts(F.col(moment) if is_time else to_moment(F.col(moment), epoch_unit)))
    wanted = REVIEW_ESSENTIALS + [f"{c}_clean" for c in texts] + ["year", "month", "day_of_week"]
    return select_existing(df, wanted)
