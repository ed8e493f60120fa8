"""Text report and quarantine export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.functions import bins
from catalens.operators import describe, quality
from catalens.sources.files import write_csv

# ---- fixed values -----------------------------------------------------------
REPORT_TITLE = "PRODUCT REVIEW DATASET ANALYSIS REPORT"
RULE = "=" * 60
SECTION_RULE = "-" * 30
TOP_BRANDS = 10
# -----------------------------------------------------------------------------


def _fixed(name: str, digits: int) -> Column:
    """A number for `%.nf`; ties round to even, as they do outside the JVM."""
    return F.bround(name, digits)


def _count(col: Column) -> Column:
    return F.format_string("%,d", col.cast("bigint"))


def _section(number: int, title: str, rows: DataFrame, *lines: Column) -> DataFrame:
    """Heading and one line per expression for every row of a small result."""
    listed = rows.select(F.posexplode(F.array(*lines)).alias("at", "line"))
    body = listed.select((F.lit(3) + F.col("at")).alias("line_no"), "line")
    head = rows.sparkSession.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("line_no"), F.lit(title).alias("line")),
                F.struct(F.lit(2).alias("line_no"), F.lit(SECTION_RULE).alias("line")),
            )
        )
    )
    return head.unionByName(body).select(F.lit(number).alias("section"), "line_no", "line")


def _listing(number: int, rows: DataFrame, rank: str, line: Column) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), (F.lit(100) + F.col(rank)).alias("line_no"), line.alias("line"))


def report_lines(
    products: DataFrame,
    reviews: DataFrame,
    price: str = "price_myr",
    price_bin: str = "price_category_myr",
    brand: str = "brand",
    rating: str = "rating",
    votes: str = "helpful_vote",
    text: str = "text",
    os_column: str = "os",
    currency: str = "RM",
    original_rating: str | None = None,
) -> DataFrame:
    """The analysis report as rows ``(section, line_no, line)``.

    ``original_rating`` is the column of ratings before they were rescaled, if they were.
    """
    spark = products.sparkSession
    start = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(0).alias("section"), F.lit(i).alias("line_no"), F.lit(line).alias("line"))
                    for i, line in enumerate([RULE, REPORT_TITLE, RULE])
                ]
            )
        )
    )
    sizes = (
        products.agg(F.count("*").alias("products"))
        .select("products", describe.as_scalar(reviews.agg(F.count("*").alias("n")))["n"].alias("reviews"))
    )
    overview = _section(
        1,
        "DATASET OVERVIEW",
        sizes,
        F.concat(F.lit("Products: "), _count(F.col("products")), F.lit(f" rows, {len(products.columns)} features")),
        F.concat(F.lit("Reviews: "), _count(F.col("reviews")), F.lit(f" rows, {len(reviews.columns)} features")),
    )
    prices = _section(
        2,
        "PRICE ANALYSIS",
        describe.price_summary(products, price),
        F.format_string(f"Price Range: {currency} %.2f - {currency} %.2f", _fixed("min", 2), _fixed("max", 2)),
        F.format_string(f"Average Price: {currency} %.2f", _fixed("mean", 2)),
        F.format_string(f"Median Price: {currency} %.2f", _fixed("median", 2)),
    )
    price_bins = _listing(
        2,
        describe.bin_counts(products, price_bin, bins.PRICE_LABELS),
        "rank",
        F.concat(F.lit("  "), F.col("label"), F.lit(": "), _count(F.col("n")), F.lit(" products")),
    )
    brands = _section(
        3,
        "BRAND ANALYSIS",
        describe.group_summary(products, brand),
        F.format_string("Total Brands: %d", "n_groups"),
        F.format_string("Most Popular Brand: %s", "most_popular"),
        F.format_string("Average Models per Brand: %.1f", _fixed("avg_per_group", 1)),
    )
    first = F.row_number().over(Window.orderBy(F.desc("n"), "value"))
    ranked = describe.value_distribution(products, brand, top=TOP_BRANDS).withColumn("rank", first)
    top_brands = _listing(
        3,
        ranked,
        "rank",
        F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), F.col("value"), F.lit(": "), _count(F.col("n")), F.lit(" products")),
    )
    top_head = spark.range(1).select(F.lit(3).alias("section"), F.lit(99).alias("line_no"), F.lit(f"Top {TOP_BRANDS} Brands:").alias("line"))
    ratings = _section(
        4,
        "RATING ANALYSIS",
        describe.rating_summary(reviews, rating),
        F.format_string("Average Rating: %.2f/5.0", _fixed("mean", 2)),
        F.format_string("Median Rating: %.2f/5.0", _fixed("median", 2)),
        F.format_string("Rating Range: %.1f - %.1f", "min", "max"),
    )
    helpful = describe.vote_summary(reviews, votes).select(
        F.lit(4).alias("section"),
        F.lit(100).alias("line_no"),
        F.format_string("Total Helpful Votes: %,.0f, average %.1f", "total_votes", _fixed("avg_votes", 1)).alias("line"),
    )
    texts = _section(
        5,
        "REVIEW ANALYSIS",
        describe.length_summary(reviews, text),
        F.concat(F.lit("Total Reviews: "), _count(F.col("total"))),
        F.format_string("Average Review Length: %.0f characters", _fixed("avg_length", 0)),
        F.format_string("Review Length Range: %d - %d characters", "min_length", "max_length"),
    )
    text_bins = _listing(
        5,
        describe.length_bins(reviews, text),
        "rank",
        F.concat(F.lit("  "), F.col("label"), F.lit(": "), _count(F.col("n")), F.lit(" reviews")),
    )
    result = start
    for part in (overview, prices, price_bins, brands, top_head, top_brands, ratings, helpful, texts, text_bins):
        result = result.unionByName(part)
    if original_rating is not None:
        unscaled = describe.rating_summary(reviews, original_rating)
        line = F.format_string("Original Rating Range: %.2f - %.2f", _fixed("min", 2), _fixed("max", 2))
        result = result.unionByName(unscaled.select(F.lit(4).alias("section"), F.lit(6).alias("line_no"), line.alias("line")))
    specs = {"RAM": "ram_gb", "Storage": "storage_gb"}
    for at, (label, column) in enumerate(specs.items()):
        if column in products.columns:
            result = result.unionByName(
                _section(
                    6 + at,
                    f"{label.upper()} ANALYSIS",
                    describe.summary_row(products, column, {}),
                    F.format_string(f"{label} Range: %.0f - %.0f GB", "min", "max"),
                    F.format_string(f"Average {label}: %.1f GB", _fixed("mean", 1)),
                )
            )
    if os_column in products.columns:
        result = result.unionByName(
            _section(8, "SYSTEM ANALYSIS", describe.most_common(products, os_column), F.format_string("Most Common OS: %s", "value"))
        )
    return result


def write_report(lines: DataFrame, path: str) -> None:
    """The report as one text file; it has a fixed number of lines."""
    lines.orderBy("section", "line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def export_invalid(df: DataFrame, path: str) -> DataFrame:
    """Write the invalid rows with notes as CSV; returns the export summary."""
    write_csv(quality.invalid_details(df), path)
    summary = quality.validity_summary(df)
    return summary.select(
        F.lit(path).alias("output_path"),
        F.col("total_invalid_records").alias("records_exported"),
        "ram_invalid_count",
        "storage_invalid_count",
        "both_invalid_count",
    )
