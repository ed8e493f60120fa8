"""Descriptive statistics. Each result is a small DataFrame, never a driver object."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions import bins
from catalens.operators.stats import as_scalar, exact_quantiles, histogram, number, quantile_row, summary_row, summary_rows

# ---- fixed values -----------------------------------------------------------
PRICE_CANDIDATES = ["price_myr", "price_usd", "price_numeric", "price"]
TOP_BRANDS = 10
TOP_SIZES = 5
REVIEW_MIN_LENGTH = 10
# -----------------------------------------------------------------------------

#: A distinct sketch has 2**12 registers, an error of 1.6 %.
SKETCH_LG_K = 12


def value_distribution(df: DataFrame, column: str, by_value: bool = False, top: int | None = None) -> DataFrame:
    """Rows per non-missing value, most frequent first (or by value); ``top`` keeps the first k."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = counts.orderBy("value") if by_value else counts.orderBy(F.desc("n"), "value")
    return ordered if top is None else ordered.limit(top)


def price_column(df: DataFrame) -> str:
    """The first known price column the table has."""
    for name in PRICE_CANDIDATES:
        if name in df.columns:
            return name
    raise ValueError("price column not found")


def price_summary(df: DataFrame, column: str | None = None) -> DataFrame:
    """min, max, mean, median, std, q25, q75 of the price."""
    column = column or price_column(df)
    row = summary_row(df, column, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return row.select("min", "max", "mean", "median", "std", "q25", "q75")


def bin_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Rows per label including empty labels, in label order: ``(rank, label, n)``."""
    counts = [
        F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), F.count_if(F.col(column) == label).alias("n"))
        for i, label in enumerate(labels)
    ]
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def group_ratings(df: DataFrame, group: str, rating: str, top: int = TOP_BRANDS) -> DataFrame:
    """Mean and count of a rating per group, biggest groups first."""
    grouped = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(number(rating)).alias("mean_rating"), F.count(number(rating)).alias("n")
    )
    return grouped.orderBy(F.desc("n"), group).limit(top)


def group_summary(df: DataFrame, group: str) -> DataFrame:
    """Number of groups, the biggest group, its size and the mean size."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_groups"),
        F.min_by(group, F.struct(-F.col("n"), F.col(group))).alias("most_popular"),
        F.max("n").alias("most_popular_count"),
        F.avg("n").alias("avg_per_group"),
    )


def rating_summary(df: DataFrame, column: str) -> DataFrame:
    return summary_row(df, column).select("mean", "median", "std", "min", "max")


def vote_summary(df: DataFrame, column: str) -> DataFrame:
    votes = number(column)
    return df.agg(F.sum(votes).alias("total_votes"), F.avg(votes).alias("avg_votes"), F.max(votes).alias("max_votes"))


def length_summary(df: DataFrame, column: str) -> DataFrame:
    size = F.length(F.coalesce(F.col(column), F.lit("")))
    return df.agg(
        F.count("*").alias("total"),
        F.avg(size).alias("avg_length"),
        F.max(size).cast("bigint").alias("max_length"),
        F.min(size).cast("bigint").alias("min_length"),
    )


def length_bins(df: DataFrame, column: str) -> DataFrame:
    size = F.length(F.coalesce(F.col(column), F.lit("")))
    return bin_counts(df.select(bins.length_bin(size).alias("bin")), "bin", bins.LENGTH_LABELS)


def spec_summary(df: DataFrame) -> DataFrame:
    """found, total, min, max, mean, std, median of every spec the table has."""
    wanted = {"ram": "ram_gb", "storage": "storage_gb", "screen": "screen_size_inches"}
    return summary_rows(df, {k: v for k, v in wanted.items() if v in df.columns})


def spec_distributions(df: DataFrame) -> DataFrame:
    """Long ``(dimension, value, n)`` of all spec categories and the top ten models."""
    whole = ["ram_category", "storage_category", "storage_type", "screen_category", "ram_type"]
    return distributions(df, {c: None for c in whole} | {"processor_model": 10, "gpu_model": 10})


def distributions(df: DataFrame, columns: Mapping[str, int | None]) -> DataFrame:
    """Value distributions of several columns in one table, each with its own top k.

    All columns are counted in one pass and one shuffle; the rank of a top k is
    limited in every task before its shuffle.
    """
    present = {c: top for c, top in columns.items() if c in df.columns}
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in present]
    long = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    whole = [c for c, top in present.items() if top is None]
    result = counts.where(F.col("dimension").isin(whole))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    for top in sorted({top for top in present.values() if top is not None}):
        limited = [c for c, wanted in present.items() if wanted == top]
        ranked = counts.where(F.col("dimension").isin(limited)).withColumn("rank", F.row_number().over(order))
        result = result.unionByName(ranked.where(F.col("rank") <= top).drop("rank"))
    return result


def spec_analysis(df: DataFrame, os_column: str = "os") -> DataFrame:
    """Common sizes of RAM, storage and screen, and the operating systems: ``(dimension, value, n)``."""
    wanted = {"ram_gb": TOP_SIZES, "storage_gb": TOP_SIZES, "screen_size_inches": TOP_SIZES, os_column: None}
    return distributions(df, wanted)


def score_summary(df: DataFrame) -> DataFrame:
    columns = ["cpu_benchmark_score", "gpu_benchmark_score", "total_benchmark_score"]
    return summary_rows(df, {c: c for c in columns})


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; the smallest of tied ones."""
    return value_distribution(df, column, top=1)


def _values(columns: Sequence[str]) -> Column:
    """One row ``(column, value)`` per column, values as text."""
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column in long form."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.select(_values(columns)).groupBy("column").agg(count("value").alias("n_distinct"))


def distinct_sketches(df: DataFrame, columns: Sequence[str], part: str | Column, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """A distinct sketch ``(part, column, sketch)`` per part of a table and column.

    ``part`` is what comes and goes as a whole, such as ``F.input_file_name()`` or
    a day. A sketch has a fixed size, about 2**lg_k bytes, so a stored table of them is
    small beside the rows; sketches of new parts are appended to it.
    """
    named = (F.col(part) if isinstance(part, str) else part).alias("part")
    return df.select(named, _values(columns)).groupBy("part", "column").agg(F.hll_sketch_agg("value", F.lit(lg_k)).alias("sketch"))


def merged_distinct_counts(sketches: DataFrame) -> DataFrame:
    """Estimated distinct values per column over all parts of stored sketches, without their rows.

    The standard error is about ``1.04 / 2**(lg_k / 2)``; sketches of different sizes
    are merged at the smaller one. A column without any value counts 0.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True)))
    return sketches.groupBy("column").agg(merged.alias("n_distinct"))


def quantile_thresholds(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    return exact_quantiles(df, column, fractions)


def correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.agg(F.corr(left, right).alias("correlation"))


def length_rating_points(df: DataFrame, text: str, rating: str) -> DataFrame:
    """Every (text length, rating) point with its multiplicity."""
    size = F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("review_length")
    return df.select(size, F.col(rating).alias("rating")).groupBy("review_length", "rating").agg(F.count("*").alias("n"))


def wide_summary(df: DataFrame, price: str = "price_numeric", brand: str = "brand", rating: str = "rating", text: str = "text") -> DataFrame:
    """One row over the cleaned wide table."""
    size = F.length(text)
    base = df.agg(
        F.count("*").alias("total_records"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.avg(price).alias("price_mean"),
        F.count_distinct(brand).alias("brands_count"),
        F.avg(rating).alias("rating_mean"),
        F.avg(size).alias("avg_review_length"),
        F.count_if(size > REVIEW_MIN_LENGTH).alias("total_reviews"),
    )
    median = as_scalar(quantile_row(df, rating, {"median": 0.5}))["median"]
    return base.withColumn("total_features", F.lit(len(df.columns))).withColumn("rating_median", median)


def _named(one_row: DataFrame, section: str) -> DataFrame:
    """One row as long ``(section, metric, value)``."""
    casts = [F.col(c).cast("double").alias(c) for c in one_row.columns]
    return one_row.select(*casts).unpivot([], one_row.columns, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "value"
    )


def product_summary(products: DataFrame, brand: str = "brand", price: str = "price_myr") -> DataFrame:
    base = products.agg(
        F.count("*").alias("total_products"),
        F.count_distinct(brand).alias("brands_count"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.avg(price).alias("price_mean"),
        F.avg("average_rating").alias("average_rating"),
    )
    result = _named(base, "products")
    wanted = {"ram": "ram_gb", "storage": "storage_gb", "screen": "screen_size_inches"}
    present = {label: c for label, c in wanted.items() if c in products.columns}
    if not present:
        return result
    specs = summary_rows(products, present, {})
    kept = ["found", "total", "mean", "min", "max"]
    long = specs.select("name", *[F.col(c).cast("double").alias(c) for c in kept]).unpivot("name", kept, "metric", "value")
    return result.unionByName(long.select(F.col("name").alias("section"), "metric", "value"))


def review_summary(reviews: DataFrame, user: str = "user_id", key: str = "asin", rating: str = "rating") -> DataFrame:
    base = reviews.agg(
        F.count("*").alias("total_reviews"),
        F.count_distinct(user).alias("unique_users"),
        F.count_distinct(key).alias("unique_products"),
        F.avg(rating).alias("rating_mean"),
    )
    median = as_scalar(quantile_row(reviews, rating, {"median": 0.5}))["median"]
    return _named(base.withColumn("rating_median", median), "reviews")


def split_summary(products: DataFrame, reviews: DataFrame, **columns: str) -> DataFrame:
    """Long summary of both tables, counted before identifying columns are projected away."""
    product_args = {k: v for k, v in columns.items() if k in ("brand", "price")}
    review_args = {k: v for k, v in columns.items() if k in ("user", "key", "rating")}
    return product_summary(products, **product_args).unionByName(review_summary(reviews, **review_args))


def insights(products: DataFrame, reviews: DataFrame, price: str, brand: str, rating: str, votes: str) -> DataFrame:
    """Thresholds, averages, correlation and the rating distribution in long form."""
    prices = quantile_row(products, price, {"budget_threshold": 0.25, "mid_range_threshold": 0.5, "high_end_threshold": 0.75})
    brands = products.agg((F.count_distinct(brand) + F.coalesce(F.max(F.col(brand).isNull().cast("int")), F.lit(0))).alias("brand_count"))
    high = as_scalar(quantile_row(reviews, rating, {"q": 0.8}))["q"]
    helpful = as_scalar(quantile_row(reviews, votes, {"q": 0.8}))["q"]
    base = reviews.agg(F.avg(rating).alias("average_rating"), F.corr(rating, votes).alias("correlation_rating_helpful"))
    rated = base.withColumns({"highly_rated_threshold": high, "helpful_reviews_threshold": helpful})
    spread = value_distribution(reviews, rating, by_value=True).select(
        F.lit("rating_distribution").alias("section"), F.col("value").cast("string").alias("metric"), F.col("n").cast("double").alias("value")
    )
    top = value_distribution(products, brand, top=TOP_BRANDS).select(
        F.lit("top_brands").alias("section"), F.col("value").cast("string").alias("metric"), F.col("n").cast("double").alias("value")
    )
    return (
        _named(prices, "price_insights")
        .unionByName(_named(rated, "rating_insights"))
        .unionByName(_named(brands, "brand_insights"))
        .unionByName(spread)
        .unionByName(top)
    )


def chart_histograms(df: DataFrame, bins_by_column: Mapping[str, int]) -> DataFrame:
    """Histograms of several columns in one long table."""
    result = None
    for column, count in bins_by_column.items():
        part = histogram(df, column, count).select(F.lit(column).alias("column"), "*")
        result = part if result is None else result.unionByName(part)
    return result


def popularity(df: DataFrame, key: str, target: str) -> DataFrame:
    """Number of rows of each key, put back on the rows; a missing key stays missing.

    Counting is combined before the shuffle and the counts are joined back, so
    a key that holds a third of the rows is never gathered in one task.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias(target))
    return df.join(counts, F.col(key) == F.col("__key"), "left").drop("__key")


def size_of(column: Column) -> Column:
    """Text length in characters; missing text has length 0."""
    return F.length(F.coalesce(column, F.lit("")))
