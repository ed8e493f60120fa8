"""Recommendation, search and preference reports over a product table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import bins
from catalens.functions import text as tx
from catalens.operators.stats import as_scalar
from catalens.operators.vectors import TIE_DIGITS, spec_match_score, words

# ---- fixed values: our own weights, all parameters ---------------------------
MAX_RATING = 5.0
BRAND_BOOST = 0.2
USE_CASE_BOOST = 0.2
SPEC_BOOST = 0.1
USE_CASES = {
    "gaming": ["gaming", "geforce", "rtx", "gtx", "radeon"],
    "work": ["business", "core", "ryzen", "pro"],
    "student": ["celeron", "light", "portable", "inch"],
}
# -----------------------------------------------------------------------------


def add_value_score(
    products: DataFrame, price: str = "price", rating: str = "average_rating", reviews: str = "rating_number"
) -> DataFrame:
    """value_score = (rating / 5) * ln(1 + reviews) / (price / mean price)."""
    mean_price = as_scalar(products.agg(F.avg(price).alias("mean")))["mean"]
    quality = F.col(rating) / MAX_RATING * F.log1p(F.col(reviews))
    return products.withColumn("value_score", F.try_divide(quality, F.try_divide(F.col(price), mean_price)))


def _mentions(text: Column, wanted: Sequence[str]) -> Column:
    found = F.lower(text)
    hit = found.contains(wanted[0])
    for word in wanted[1:]:
        hit = hit | found.contains(word)
    return hit


def recommend(
    products: DataFrame,
    key: str,
    budget: float,
    brand_preference: str | None = None,
    use_case: str | None = None,
    specifications: dict[str, object] | None = None,
    n: int = 5,
    price: str = "price",
    brand: str = "brand",
    text: str = "title",
) -> DataFrame:
    """Best affordable products with score and explanation.

    score = value_score * (1 + boosts for preferred brand, use case, specs).
    """
    scored = add_value_score(products, price=price).where(F.col(price) <= budget)
    reasons = [F.format_string("price %.2f within budget %.2f", F.col(price), F.lit(float(budget)))]
    boost = F.lit(1.0)
    if brand_preference is not None:
        liked = F.col(brand) == brand_preference
        boost = boost + F.when(liked, BRAND_BOOST).otherwise(0.0)
        reasons.append(F.when(liked, F.lit(f"preferred brand {brand_preference}")))
    if use_case is not None:
        fits = _mentions(F.col(text), USE_CASES.get(use_case, [use_case.lower()]))
        boost = boost + F.when(fits, USE_CASE_BOOST).otherwise(0.0)
        reasons.append(F.when(fits, F.lit(f"suits {use_case}")))
    if specifications:
        share = spec_match_score(specifications)
        boost = boost + share * SPEC_BOOST
        reasons.append(F.format_string("specs matched %.0f%%", F.bround(share * 100, 0)))
    return (
        scored.select(key, brand, price, F.round(F.col("value_score") * boost, TIE_DIGITS).alias("score"), F.concat_ws("; ", *reasons).alias("explanation"))
        .orderBy(F.desc("score"), key)
        .limit(n)
    )


def search(
    products: DataFrame,
    key: str,
    query: str,
    text: str = "title",
    min_rating: float | None = None,
    max_price: float | None = None,
    brands: Sequence[str] | None = None,
    sort_by: str = "relevance",
    limit: int = 10,
    price: str = "price",
    brand: str = "brand",
    rating: str = "average_rating",
) -> DataFrame:
    """Products that hold a query word, filtered and sorted; ties by key.

    relevance is the number of distinct query words found.
    """
    wanted = list(dict.fromkeys(query.lower().split()))
    found = products
    if min_rating is not None:
        found = found.where(F.col(rating) >= min_rating)
    if max_price is not None:
        found = found.where(F.col(price) <= max_price)
    if brands:
        found = found.where(F.col(brand).isin(list(brands)))
    relevance = F.size(F.array_intersect(tx.tokens(F.col(text)), F.array(*[F.lit(w) for w in wanted])))
    found = found.withColumn("relevance", relevance).where(F.col("relevance") > 0)
    orders = {
        "relevance": [F.desc("relevance")],
        "rating": [F.desc(rating), F.desc("relevance")],
        "price": [F.asc(price), F.desc("relevance")],
    }
    if sort_by not in orders:
        raise ValueError(f"sort_by must be one of {sorted(orders)}")
    return found.orderBy(*orders[sort_by], key).limit(limit).select(key, text, brand, price, rating, "relevance")


def item_detail(products: DataFrame, key: str, item) -> DataFrame:
    return products.where(F.col(key) == item)


def preferences(reviews: DataFrame, user: str, brand: str, rating: str, price: str) -> DataFrame:
    """Per user: favourite brand and price band, mean rating, number of reviews.

    Counts per (user, brand, band) come first, so a very active user is a few
    combined rows before anything is gathered per user.
    """
    banded = reviews.select(user, brand, bins.price_bin_usd(F.col(price)).alias("band"), F.col(rating).cast("double").alias("rating"))
    combined = banded.groupBy(user, brand, "band").agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.count("rating").alias("rated"))
    favourites = []
    for column, name in ((brand, "favourite_brand"), ("band", "favourite_price_band")):
        per_value = combined.where(F.col(column).isNotNull()).groupBy(user, column).agg(F.sum("n").alias("n"))
        favourites.append(per_value.groupBy(user).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(name)))
    base = combined.groupBy(user).agg(
        F.sum("n").alias("n_reviews"), (F.sum("total") / F.sum("rated")).alias("mean_rating")
    )
    for favourite in favourites:
        base = base.join(favourite, user, "left")
    return base


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index as rows ``(term, key, tf)``; a frequent term is many rows, never one list."""
    return df.select(key, F.explode(words(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def index_terms(index: DataFrame, key: str) -> DataFrame:
    """``(term, documents, occurrences)`` of an inverted index."""
    return index.groupBy("term").agg(F.count(key).alias("documents"), F.sum("tf").alias("occurrences"))


def write_index(index: DataFrame, path: str, parts: int = 64) -> None:
    """Index as parquet, bucketed by term hash and sorted by term.

    A second hash on the whole row spreads a frequent term over several files.
    """
    bucketed = index.withColumn("bucket", F.pmod(F.hash("term"), F.lit(parts)))
    spread = F.pmod(F.hash(*index.columns), F.lit(8))
    bucketed.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(path)
