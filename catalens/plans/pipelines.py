"""The composite jobs: wide, split, exploration and score pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.functions import bins, specs
from catalens.functions import text as tx
from catalens.operators import clean, describe, encode, match, quality
from catalens.session import staged
from catalens.sources.report import report_lines

# ---- fixed values -----------------------------------------------------------
SPEC_TEXTS = ["title_y", "features", "details"]
# -----------------------------------------------------------------------------


def add_derived(df: DataFrame) -> DataFrame:
    """Price and rating bins, map specs, lengths, helpfulness and brand popularity."""
    new = {"review_length": describe.size_of(F.col("text")), "title_length": describe.size_of(F.col("title_x"))}
    if "price_numeric" in df.columns:
        new["price_category"] = bins.price_bin_usd(F.col("price_numeric"))
    if "rating" in df.columns:
        new["rating_category"] = bins.rating_bin(F.col("rating"))
    if "details_parsed" in df.columns:
        entries = F.col("details_parsed")
        new["ram_gb"] = specs.spec_from_map(entries, "RAM", "GB")
        new["storage_gb"] = specs.storage_from_map(entries)
        new["screen_size"] = specs.spec_from_map(entries, "Screen Size", "Inches")
        new["processor"] = specs.processor_from_map(entries)
    if {"helpful_vote", "num_reviews"} <= set(df.columns):
        new["helpfulness_ratio"] = bins.helpfulness_ratio(F.col("helpful_vote"), F.col("num_reviews"))
    df = df.withColumns(new)
    return describe.popularity(df, "brand", "brand_popularity") if "brand" in df.columns else df


def add_price_conversion(df: DataFrame, price: str = "price", rate: float = bins.EXCHANGE_RATE) -> DataFrame:
    """USD price, local price and local price bin."""
    df = df.withColumn("price_usd", tx.parse_price(F.col(price)))
    df = df.withColumn("price_myr", bins.to_local_price(F.col("price_usd"), rate))
    return df.withColumn("price_category_myr", bins.price_bin_local(F.col("price_myr")))


def wide_pipeline(raw: DataFrame, roles: clean.Roles = clean.Roles()) -> DataFrame:
    """Clean the wide table and add the derived columns."""
    return add_derived(clean.clean_table(raw, roles))


def split_tables(raw: DataFrame, roles: clean.Roles = clean.Roles(), texts: Sequence[str] = tuple(SPEC_TEXTS)) -> tuple[DataFrame, DataFrame]:
    """Cleaned product table with prices and specs, and cleaned review table.

    Both come from the cleaned rows written out once. The product table is
    written out too: scalers, encoders and reports each read it again.
    """
    cleaned = clean.clean_table(raw, roles)
    products, reviews = clean.split_products_reviews(cleaned, [roles.order], roles.key)
    return _specified(products, roles, texts), reviews


def _specified(products: DataFrame, roles: clean.Roles, texts: Sequence[str]) -> DataFrame:
    return staged(match.add_specs(add_price_conversion(products, roles.price), texts), "products")


def product_table(raw: DataFrame, roles: clean.Roles = clean.Roles(), texts: Sequence[str] = tuple(SPEC_TEXTS)) -> DataFrame:
    """The product table of `split_tables` alone; no review text is shuffled or written for it."""
    return _specified(clean.clean_products(raw, roles), roles, texts)


def normalized_products(products: DataFrame) -> DataFrame:
    """Normalised product table; a feature list is joined to text first."""
    if "features" in products.columns and isinstance(products.schema["features"].dataType, T.ArrayType):
        products = products.withColumn("features", tx.join_features(F.col("features")))
    return encode.normalize_products(products)


def split_pipeline(raw: DataFrame, roles: clean.Roles = clean.Roles()) -> tuple[DataFrame, DataFrame]:
    """Normalised product table and normalised review table."""
    products, reviews = split_tables(raw, roles)
    return normalized_products(products), encode.normalize_reviews(reviews)


def explore(raw: DataFrame, roles: clean.Roles = clean.Roles()) -> dict[str, DataFrame]:
    """All exploration results of a raw wide table, by name."""
    products, reviews = split_tables(raw, roles)
    valid = quality.drop_invalid(products)
    if "rating" in reviews.columns:
        reviews = encode.rescale_ratings(reviews, "rating", "rating")
    # Ten results read these rows.
    reviews = staged(reviews, "reviews")
    return {
        "price": describe.price_summary(valid, "price_myr"),
        "brands": describe.group_summary(valid, "brand"),
        "ratings": describe.rating_summary(reviews, "rating"),
        "votes": describe.vote_summary(reviews, "helpful_vote"),
        "lengths": describe.length_summary(reviews, "text"),
        "specs": describe.spec_analysis(valid),
        "validity": quality.validity_summary(products),
        "missing": quality.missing_share(valid),
        "insights": describe.insights(valid, reviews, "price_myr", "brand", "rating", "helpful_vote"),
        "report": report_lines(valid, reviews),
    }


def score_pipeline(
    products: DataFrame, key: str, cpu_scores: DataFrame, gpu_scores: DataFrame, texts: Sequence[str] = tuple(SPEC_TEXTS)
) -> DataFrame:
    """Specs, scores, tiers and gaming capability per product."""
    return match.add_scores(products, key, texts, cpu_scores, gpu_scores)
