"""Descriptive statistics, validity and missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions import bins
from catalens.functions import text as tx
from catalens.operators import clean, describe, encode, match, quality
from catalens.operators.stats import histogram
from catalens.session import scratch_path
from catalens.workload import sqltext as q
from catalens.workload.fixtures import DIRTY_ORDERS, GAPPY, PRODUCTS, RATINGS, WIDE, load, plain, table
from catalens.workload.registry import query

SPEC = plain(PRODUCTS)
RATED = plain(RATINGS)
DIRTY = plain(DIRTY_ORDERS)
RAW = plain(WIDE)
STAGE = q.spec_stage(SPEC, ["title_y", "features"])


def _specs(spark, folder):
    return match.add_specs(load(spark, folder, PRODUCTS), ["title_y", "features"])


def _round(df, digits, *names):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("value_dist", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def value_dist(spark, folder):
    return describe.value_distribution(table(spark, folder, "part"), "p_brand")


@query("value_dist_sorted", f"SELECT rating AS value, count(*) AS n FROM ({RATED}) AS r GROUP BY 1")
def value_dist_sorted(spark, folder):
    return describe.value_distribution(load(spark, folder, RATINGS), "rating", by_value=True)


@query("value_dist_nulls", f"SELECT status AS value, count(*) AS n FROM ({DIRTY}) AS d WHERE status IS NOT NULL GROUP BY 1")
def value_dist_nulls(spark, folder):
    return describe.value_distribution(load(spark, folder, DIRTY_ORDERS), "status")


for _k in (5, 8, 10):

    @query(f"top_{_k}", f"SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT {_k}")
    def top_k(spark, folder, k=_k):
        return describe.value_distribution(table(spark, folder, "lineitem"), "l_partkey", top=k)


@query(
    "price_stats",
    """SELECT round(min(p), 4) AS min, round(max(p), 4) AS max, round(avg(p), 4) AS mean, round(median(p), 4) AS median,
    round(stddev_samp(p), 4) AS std, round(quantile_cont(p, 0.25), 4) AS q25, round(quantile_cont(p, 0.75), 4) AS q75
    FROM (SELECT o_totalprice AS p FROM orders) AS o""",
)
def price_stats(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_totalprice").alias("price_usd"))
    summary = describe.price_summary(orders)
    return _round(summary, 4, *summary.columns)


@query(
    "bin_counts",
    " UNION ALL ".join(
        f"SELECT {i} AS rank, '{label}' AS label, count(*) FILTER (WHERE {q.price_bin_usd('p_retailprice')} = '{label}') AS n FROM part"
        for i, label in enumerate(bins.PRICE_LABELS)
    ),
)
def bin_counts(spark, folder):
    binned = table(spark, folder, "part").select(bins.price_bin_usd(F.col("p_retailprice")).alias("bin"))
    return describe.bin_counts(binned, "bin", bins.PRICE_LABELS)


@query(
    "brand_rating_top",
    f"""SELECT p_brand, round(avg(rating), 6) AS mean_rating, count(rating) AS n FROM ({RATED}) AS r JOIN part ON asin = p_partkey
    GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""",
)
def brand_rating_top(spark, folder):
    rated = load(spark, folder, RATINGS).join(table(spark, folder, "part"), F.col("asin") == F.col("p_partkey"))
    return _round(describe.group_ratings(rated, "p_brand", "rating"), 6, "mean_rating")


@query(
    "brand_summary",
    """WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
    SELECT count(*) AS n_groups, first(p_brand ORDER BY n DESC, p_brand) AS most_popular, max(n) AS most_popular_count,
    round(avg(n), 6) AS avg_per_group FROM b""",
)
def brand_summary(spark, folder):
    return _round(describe.group_summary(table(spark, folder, "part"), "p_brand"), 6, "avg_per_group")


@query(
    "rating_stats",
    f"""SELECT round(avg(rating), 6) AS mean, median(rating) AS median, round(stddev_samp(rating), 6) AS std, min(rating) AS min,
    max(rating) AS max FROM ({RATED}) AS r""",
)
def rating_stats(spark, folder):
    return _round(describe.rating_summary(load(spark, folder, RATINGS), "rating"), 6, "mean", "std")


@query(
    "vote_stats",
    f"""SELECT CAST(sum(helpful_vote) AS DOUBLE) AS total_votes, round(avg(helpful_vote), 6) AS avg_votes,
    CAST(max(helpful_vote) AS DOUBLE) AS max_votes FROM ({RATED}) AS r""",
)
def vote_stats(spark, folder):
    return _round(describe.vote_summary(load(spark, folder, RATINGS), "helpful_vote"), 6, "avg_votes")


@query(
    "length_stats",
    "SELECT count(*) AS total, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length, min(length(text)) AS min_length FROM documents",
)
def length_stats(spark, folder):
    return _round(describe.length_summary(table(spark, folder, "documents"), "text"), 6, "avg_length")


@query(
    "length_bin_counts",
    " UNION ALL ".join(
        f"SELECT {i} AS rank, '{label}' AS label, count(*) FILTER (WHERE {q.length_bin('length(text)')} = '{label}') AS n FROM conversations"
        for i, label in enumerate(bins.LENGTH_LABELS)
    ),
)
def length_bin_counts(spark, folder):
    return describe.length_bins(table(spark, folder, "conversations"), "text")


@query(
    "spec_stats",
    f"WITH s AS MATERIALIZED ({STAGE}) "
    + " UNION ALL ".join(
        f"""SELECT '{label}' AS name, count({c}) AS found, count(*) AS total, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, median({c}) AS median FROM s"""
        for label, c in (("ram", "ram_gb"), ("storage", "storage_gb"), ("screen", "screen_size_inches"))
    ),
)
def spec_stats(spark, folder):
    return _round(describe.spec_summary(_specs(spark, folder)), 6, "mean", "std")


def _long_counts(columns):
    parts = []
    for column, top in columns.items():
        limit = "" if top is None else f" ORDER BY n DESC, value LIMIT {top}"
        value = column
        if column in ("ram_gb", "storage_gb", "screen_size_inches"):
            value = f"CAST({column} AS VARCHAR)"
        parts.append(
            f"(SELECT '{column}' AS dimension, {value} AS value, count(*) AS n FROM s WHERE {column} IS NOT NULL GROUP BY {column}{limit})"
        )
    return f"WITH s AS MATERIALIZED ({STAGE}) " + " UNION ALL ".join(parts)


@query(
    "spec_distributions",
    _long_counts(
        {"ram_category": None, "storage_category": None, "storage_type": None, "screen_category": None, "ram_type": None}
        | {"processor_model": 10, "gpu_model": 10}
    ),
)
def spec_distributions(spark, folder):
    return describe.spec_distributions(_specs(spark, folder))


@query(
    "spec_analysis",
    _long_counts({"ram_gb": 5, "storage_gb": 5, "screen_size_inches": 5, "p_type": None}),
)
def spec_analysis(spark, folder):
    return describe.spec_analysis(_specs(spark, folder), os_column="p_type")


@query("mode_value", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def mode_value(spark, folder):
    return describe.most_common(table(spark, folder, "part"), "p_type")


@query(
    "distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_returnflag")),
)
def distinct_counts(spark, folder):
    return describe.distinct_counts(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


SKETCHED = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")


@query(
    "distinct_sketches",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, true AS near FROM lineitem" for c in SKETCHED),
)
def distinct_sketches(spark, folder):
    """Exact counts, and whether sketches stored per month in two goes come within four standard errors of them."""
    rows, path = table(spark, folder, "lineitem"), scratch_path(spark, "sketches")
    late = F.coalesce(F.col("l_shipdate") >= F.lit("1997-01-01"), F.lit(False))
    for some in (~late, late):
        parts = describe.distinct_sketches(rows.where(some), SKETCHED, F.date_format("l_shipdate", "yyyy-MM"))
        parts.write.mode("append").parquet(path)
    told = describe.merged_distinct_counts(spark.read.parquet(path)).withColumnRenamed("n_distinct", "told")
    exact = describe.distinct_counts(rows, SKETCHED)
    error = 4 * 1.04 / 2 ** (describe.SKETCH_LG_K / 2)
    return exact.join(told, "column").select("column", "n_distinct", (F.abs(F.col("told") - F.col("n_distinct")) <= F.col("n_distinct") * error).alias("near"))


@query(
    "quantile_thresholds",
    " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS q, round(quantile_cont(value, {f}), 6) AS value FROM events" for f in (0.25, 0.5, 0.75, 0.8)),
)
def quantile_thresholds(spark, folder):
    return _round(describe.quantile_thresholds(table(spark, folder, "events"), "value", [0.25, 0.5, 0.75, 0.8]), 6, "value")


@query("correlation", f"SELECT round(corr(rating, helpful_vote), 6) AS correlation FROM ({RATED}) AS r")
def correlation(spark, folder):
    return _round(describe.correlation(load(spark, folder, RATINGS), "rating", "helpful_vote"), 6, "correlation")


@query(
    "wide_summary",
    f"""SELECT count(*) AS total_records, 6 AS total_features, min(p) AS price_min, max(p) AS price_max, round(avg(p), 4) AS price_mean,
    count(DISTINCT brand) AS brands_count, round(avg(r), 6) AS rating_mean, median(r) AS rating_median,
    round(avg(length(text)), 6) AS avg_review_length, count(*) FILTER (WHERE length(text) > 10) AS total_reviews
    FROM (SELECT {q.price('price')} AS p, brand, TRY_CAST(rating AS DOUBLE) AS r, text FROM ({RAW}) AS w) AS x""",
)
def wide_summary(spark, folder):
    raw = load(spark, folder, WIDE).select("asin", "price", "brand", "rating", "text")
    numbers = clean.to_numbers(raw, ["rating"]).withColumn("price_numeric", tx.parse_price(F.col("price")))
    return _round(_round(describe.wide_summary(numbers), 6, "rating_mean", "avg_review_length"), 4, "price_mean")


SPLIT_PRODUCTS = f"""SELECT p.*, p_retailprice * 4.75 AS price_myr, avg_rating AS average_rating FROM ({STAGE}) AS p
  JOIN (SELECT asin, avg(rating) AS avg_rating FROM ({RATED}) AS r GROUP BY asin) AS a ON p.p_partkey = a.asin"""


def _split(spark, folder):
    reviews = load(spark, folder, RATINGS)
    means = reviews.groupBy("asin").agg(F.avg("rating").alias("average_rating"))
    products = _specs(spark, folder).join(means, F.col("p_partkey") == F.col("asin")).drop("asin")
    return products.withColumn("price_myr", bins.to_local_price(F.col("p_retailprice"))), reviews


@query(
    "split_summary",
    f"""WITH p AS MATERIALIZED ({SPLIT_PRODUCTS}), r AS MATERIALIZED ({RATED}),
    t AS (SELECT 'products' AS section, unnest(['total_products', 'brands_count', 'price_min', 'price_max', 'price_mean', 'average_rating']) AS metric,
      unnest([CAST(count(*) AS DOUBLE), count(DISTINCT p_brand), min(price_myr), max(price_myr), avg(price_myr), avg(average_rating)]) AS value FROM p
    UNION ALL SELECT 'reviews', unnest(['total_reviews', 'unique_users', 'unique_products', 'rating_mean', 'rating_median']),
      unnest([CAST(count(*) AS DOUBLE), count(DISTINCT user_id), count(DISTINCT asin), avg(rating), median(rating)]) FROM r """
    + " ".join(
        f"""UNION ALL SELECT '{s}', unnest(['found', 'total', 'mean', 'min', 'max']),
        unnest([CAST(count({c}) AS DOUBLE), count(*), avg({c}), min({c}), max({c})]) FROM p"""
        for s, c in (("ram", "ram_gb"), ("storage", "storage_gb"), ("screen", "screen_size_inches"))
    )
    + ") SELECT section, metric, round(value, 4) AS value FROM t",
)
def split_summary(spark, folder):
    products, reviews = _split(spark, folder)
    return _round(describe.split_summary(products, reviews, brand="p_brand", user="user_id"), 4, "value")


@query(
    "insights",
    f"""WITH p AS MATERIALIZED ({SPLIT_PRODUCTS}), r AS MATERIALIZED ({RATED}),
    t AS (SELECT 'price_insights' AS section, unnest(['budget_threshold', 'mid_range_threshold', 'high_end_threshold']) AS metric,
      unnest([quantile_cont(price_myr, 0.25), median(price_myr), quantile_cont(price_myr, 0.75)]) AS value FROM p
    UNION ALL SELECT 'rating_insights', unnest(['average_rating', 'correlation_rating_helpful', 'highly_rated_threshold', 'helpful_reviews_threshold']),
      unnest([avg(rating), corr(rating, helpful_vote), quantile_cont(rating, 0.8), quantile_cont(CAST(helpful_vote AS DOUBLE), 0.8)]) FROM r
    UNION ALL SELECT 'brand_insights', 'brand_count', CAST(count(DISTINCT p_brand) AS DOUBLE) FROM p
    UNION ALL SELECT 'rating_distribution', CAST(rating AS VARCHAR), CAST(count(*) AS DOUBLE) FROM r GROUP BY rating
    UNION ALL (SELECT 'top_brands', p_brand, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10))
    SELECT section, metric, round(value, 4) AS value FROM t""",
)
def insights(spark, folder):
    products, reviews = _split(spark, folder)
    return _round(describe.insights(products, reviews, "price_myr", "p_brand", "rating", "helpful_vote"), 4, "value")


def histogram_sql(source: str, column: str, n: int) -> str:
    return f"""WITH s AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source}), l AS (SELECT min(v) AS lo, max(v) AS hi FROM s),
    c AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * {n}), {n - 1}) AS INT) AS bin, count(*) AS n FROM s, l WHERE v IS NOT NULL GROUP BY 1)
    SELECT CAST(g AS INT) AS bin, round(lo + (hi - lo) / {n} * g, 4) AS bin_lo, round(lo + (hi - lo) / {n} * (g + 1), 4) AS bin_hi,
    coalesce(c.n, 0) AS n FROM range({n}) AS t(g) CROSS JOIN l LEFT JOIN c ON c.bin = g"""


for _name, _source, _column, _bins in (
    ("histogram_price", "orders", "o_totalprice", 50),
    ("histogram_quantity", "lineitem", "l_quantity", 20),
    ("histogram_value", "events", "value", 30),
    ("histogram_size", "part", "p_size", 15),
):

    @query(_name, histogram_sql(_source, _column, _bins))
    def run_histogram(spark, folder, source=_source, column=_column, n=_bins):
        return _round(histogram(table(spark, folder, source), column, n), 4, "bin_lo", "bin_hi")


@query(
    "length_rating_points",
    "SELECT length(text) AS review_length, quality AS rating, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2",
)
def length_rating_points(spark, folder):
    rated = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return describe.length_rating_points(rated, "text", "quality")


BAD_RAM = "coalesce(ram_gb < 1 OR ram_gb > 128, false)"
BAD_DISK = "coalesce(storage_gb < 16 OR storage_gb > 8192, false)"


@query("validity_drop", f"SELECT p_partkey, ram_gb, storage_gb FROM ({STAGE}) AS s WHERE NOT ({BAD_RAM} OR {BAD_DISK})")
def validity_drop(spark, folder):
    return quality.handle_invalid(_specs(spark, folder), "drop").select("p_partkey", "ram_gb", "storage_gb")


@query("validity_mark", f"SELECT p_partkey, NOT {BAD_RAM} AS ram_valid, NOT {BAD_DISK} AS storage_valid FROM ({STAGE}) AS s")
def validity_mark(spark, folder):
    return quality.handle_invalid(_specs(spark, folder), "mark").select("p_partkey", "ram_valid", "storage_valid")


@query(
    "validity_detail",
    f"""SELECT p_partkey, {BAD_RAM} AS ram_invalid, {BAD_DISK} AS storage_invalid,
    concat_ws('; ', CASE WHEN {BAD_RAM} THEN 'RAM ' || CAST(ram_gb AS VARCHAR) || 'GB outside valid range (1-128GB)' END,
      CASE WHEN {BAD_DISK} THEN 'Storage ' || CAST(storage_gb AS VARCHAR) || 'GB outside valid range (16-8192GB)' END) AS validation_notes
    FROM ({STAGE}) AS s WHERE {BAD_RAM} OR {BAD_DISK}""",
)
def validity_detail(spark, folder):
    return quality.invalid_details(_specs(spark, folder)).select("p_partkey", "ram_invalid", "storage_invalid", "validation_notes")


@query(
    "validity_summary",
    f"""WITH c AS (SELECT count(*) AS total_records_original, count(*) FILTER (WHERE {BAD_RAM}) AS ram_invalid_count,
      count(*) FILTER (WHERE {BAD_DISK}) AS storage_invalid_count, count(*) FILTER (WHERE {BAD_RAM} AND {BAD_DISK}) AS both_invalid_count,
      count(*) FILTER (WHERE {BAD_RAM} OR {BAD_DISK}) AS total_invalid_records FROM ({STAGE}) AS s)
    SELECT *, total_invalid_records AS records_dropped, total_records_original - total_invalid_records AS total_records_final,
    'dropped_invalid_records' AS action_taken FROM c""",
)
def validity_summary(spark, folder):
    return quality.validity_summary(_specs(spark, folder))


DIRTY_TYPES = (
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("price", "string"), ("status", "string"),
    ("rating_raw", "string"), ("votes", "string"), ("verified", "boolean"),
)


@query(
    "null_profile",
    f"WITH d AS ({DIRTY}) "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM d"
        for i, (c, t) in enumerate(DIRTY_TYPES)
    ),
)
def null_profile(spark, folder):
    return quality.null_profile(load(spark, folder, DIRTY_ORDERS))


@query(
    "missing_pct",
    f"""WITH m AS (SELECT count(*) AS total_rows, CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c, _ in DIRTY_TYPES)}) AS BIGINT)
      AS missing_values FROM ({DIRTY}) AS d)
    SELECT total_rows, 8 AS total_columns, missing_values, round(missing_values * 100.0 / (total_rows * 8), 6) AS missing_percentage FROM m""",
)
def missing_pct(spark, folder):
    return _round(quality.missing_share(load(spark, folder, DIRTY_ORDERS)), 6, "missing_percentage")


GAPS = plain(GAPPY)
KNOWN = f"(SELECT CASE WHEN NOT isnan(quantity) THEN quantity END AS quantity, CASE WHEN NOT isnan(price_usd) THEN price_usd END AS price_usd FROM ({GAPS}) AS g)"


@query(
    "nan_summary",
    f"""SELECT round(min(p), 4) AS min, round(max(p), 4) AS max, round(avg(p), 4) AS mean, round(median(p), 4) AS median,
    round(stddev_samp(p), 4) AS std, round(quantile_cont(p, 0.25), 4) AS q25, round(quantile_cont(p, 0.75), 4) AS q75
    FROM (SELECT price_usd AS p FROM {KNOWN} AS k) AS o""",
)
def nan_summary(spark, folder):
    summary = describe.price_summary(load(spark, folder, GAPPY))
    return _round(summary, 4, *summary.columns)


@query(
    "nan_scale",
    f"""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN isnan(quantity) THEN 0 ELSE coalesce(quantity, 0) END AS v FROM ({GAPS}) AS g)
    SELECT l_orderkey, l_linenumber, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 9) AS quantity FROM v""",
)
def nan_scale(spark, folder):
    scaled = encode.scale_minmax(load(spark, folder, GAPPY).select("l_orderkey", "l_linenumber", "quantity"), ["quantity"])
    return _round(scaled, 9, "quantity")


@query("nan_histogram", histogram_sql(f"{KNOWN} AS k", "quantity", 10))
def nan_histogram(spark, folder):
    return _round(histogram(load(spark, folder, GAPPY), "quantity", 10), 4, "bin_lo", "bin_hi")


GAPPY_TYPES = (("l_orderkey", "bigint"), ("l_linenumber", "int"), ("quantity", "double"), ("price_usd", "double"))


@query(
    "nan_profile",
    f"WITH d AS ({GAPS}) "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL"
        + (f" OR isnan({c})" if t == "double" else "")
        + ") AS missing FROM d"
        for i, (c, t) in enumerate(GAPPY_TYPES)
    ),
)
def nan_profile(spark, folder):
    return quality.null_profile(load(spark, folder, GAPPY))


@query(
    "nan_missing_pct",
    f"""WITH m AS (SELECT count(*) AS total_rows, CAST(count(*) FILTER (WHERE quantity IS NULL OR isnan(quantity)) + count(*) FILTER (WHERE isnan(price_usd)) AS BIGINT)
      AS missing_values FROM ({GAPS}) AS d)
    SELECT total_rows, 4 AS total_columns, missing_values, round(missing_values * 100.0 / (total_rows * 4), 6) AS missing_percentage FROM m""",
)
def nan_missing_pct(spark, folder):
    return _round(quality.missing_share(load(spark, folder, GAPPY)), 6, "missing_percentage")
