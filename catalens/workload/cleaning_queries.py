"""Projection, cleaning, deduplication, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions import bins
from catalens.functions import text as tx
from catalens.operators import clean, describe, encode
from catalens.workload import sqltext as q
from catalens.workload.fixtures import DIRTY_ORDERS, PRODUCTS, RATINGS, WIDE, load, plain, table
from catalens.workload.registry import query

DIRTY = plain(DIRTY_ORDERS)
SPEC = plain(PRODUCTS)
RATED = plain(RATINGS)
RAW = plain(WIDE)


@query(
    "price_category_counts",
    f"""SELECT value, count(*) AS n FROM (
      SELECT {q.price_bin_local('local')} AS value FROM (SELECT {q.price('price')} * 4.75 AS local FROM ({DIRTY}) AS d) AS p
      WHERE local IS NOT NULL) AS b WHERE value IS NOT NULL GROUP BY value""",
)
def price_category_counts(spark, folder):
    priced = clean.parse_prices(load(spark, folder, DIRTY_ORDERS), "price")
    binned = priced.select(bins.price_bin_local(bins.to_local_price(F.col("price_numeric"))).alias("bin"))
    return describe.value_distribution(binned, "bin")


@query("price_parse", f"SELECT o_orderkey, {q.price('price')} AS price_numeric, TRY_CAST(votes AS DOUBLE) AS votes FROM ({DIRTY}) AS d")
def price_parse(spark, folder):
    raw = load(spark, folder, DIRTY_ORDERS)
    return raw.select("o_orderkey", tx.parse_price(F.col("price")).alias("price_numeric"), tx.to_number(F.col("votes")).alias("votes"))


@query("clean_text_pages", f"SELECT page_id, {q.clean('html')} AS clean FROM pages")
def clean_text_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.clean_text(F.col("html")).alias("clean"))


@query("clean_text_docs", f"SELECT doc_id, {q.clean('text')} AS clean FROM documents")
def clean_text_docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


@query("categorical_default", f"SELECT {q.category('status')} AS value, count(*) AS n FROM ({DIRTY}) AS d GROUP BY 1")
def categorical_default(spark, folder):
    filled = clean.fill_categories(load(spark, folder, DIRTY_ORDERS), ["status"])
    return describe.value_distribution(filled, "status")


@query(
    "median_impute",
    f"""WITH n AS (SELECT o_orderkey, TRY_CAST(rating_raw AS DOUBLE) AS rating_raw FROM ({DIRTY}) AS d)
    SELECT o_orderkey, coalesce(rating_raw, (SELECT median(rating_raw) FROM n)) AS rating_raw FROM n""",
)
def median_impute(spark, folder):
    numbers = clean.to_numbers(load(spark, folder, DIRTY_ORDERS), ["rating_raw"])
    return clean.fill_medians(numbers, ["rating_raw"]).select("o_orderkey", "rating_raw")


@query("zero_impute", f"SELECT o_orderkey, coalesce(TRY_CAST(votes AS DOUBLE), 0) AS votes FROM ({DIRTY}) AS d")
def zero_impute(spark, folder):
    numbers = clean.to_numbers(load(spark, folder, DIRTY_ORDERS), ["votes"])
    return clean.fill_zeros(numbers, ["votes"]).select("o_orderkey", "votes")


@query("bool_default", f"SELECT o_orderkey, coalesce(verified, false) AS verified FROM ({DIRTY}) AS d")
def bool_default(spark, folder):
    return clean.fill_false(load(spark, folder, DIRTY_ORDERS), "verified").select("o_orderkey", "verified")


@query("drop_unpriced", f"SELECT o_orderkey, {q.price('price')} AS price_numeric FROM ({DIRTY}) AS d WHERE {q.price('price')} IS NOT NULL")
def drop_unpriced(spark, folder):
    return clean.parse_prices(load(spark, folder, DIRTY_ORDERS), "price").select("o_orderkey", "price_numeric")


@query(
    "short_content_filter",
    f"""SELECT row_id, length(text) AS review_length, length(title_x) AS title_length FROM (
      SELECT row_id, {q.clean('text')} AS text, {q.clean('title_x')} AS title_x FROM ({RAW}) AS w) AS c
    WHERE NOT (length(text) < 10 AND length(title_x) < 5)""",
)
def short_content_filter(spark, folder):
    raw = load(spark, folder, WIDE).select("row_id", "text", "title_x")
    cleaned = clean.with_once(raw, {c: tx.clean_text(F.col(c)) for c in ("text", "title_x")})
    kept = clean.drop_short_content(cleaned, "text", "title_x")
    return kept.select(
        "row_id",
        describe.size_of(F.col("text")).cast("bigint").alias("review_length"),
        describe.size_of(F.col("title_x")).cast("bigint").alias("title_length"),
    )


@query(
    "outlier_trim",
    """WITH l AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
    SELECT o_orderkey, o_totalprice FROM orders, l WHERE o_totalprice BETWEEN lo AND hi""",
)
def outlier_trim(spark, folder):
    return clean.trim_outliers(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def distinct_rows(spark, folder):
    return clean.distinct_rows(table(spark, folder, "documents").select("text", "lang"))


@query(
    "distinct_rows_map",
    f"""SELECT min(row_id) AS row_id, asin, details FROM (
      SELECT row_id, asin, coalesce(details, '') AS details FROM ({RAW}) AS w) AS d GROUP BY asin, details""",
)
def distinct_rows_map(spark, folder):
    raw = load(spark, folder, WIDE).select("row_id", "asin", "details", tx.parse_details(F.col("details")).alias("parsed"))
    return clean.distinct_rows(raw, order="row_id").select("row_id", "asin", F.coalesce("details", F.lit("")).alias("details"))


@query(
    "keep_first",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1""",
)
def keep_first(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return clean.keep_first(lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@query(
    "split_products",
    f"""SELECT asin, parent_asin, title_y, brand, os, color, store, average_rating, rating_number, features, price FROM ({RAW}) AS w
    QUALIFY row_number() OVER (PARTITION BY asin ORDER BY row_id) = 1""",
)
def split_products(spark, folder):
    return clean.split_products_reviews(load(spark, folder, WIDE), ["row_id"])[0]


@query("split_reviews", f"SELECT asin, parent_asin, user_id, timestamp, rating, title_x, text, helpful_vote FROM ({RAW}) AS w")
def split_reviews(spark, folder):
    return clean.split_products_reviews(load(spark, folder, WIDE), ["row_id"])[1]


@query("project_existing", "SELECT p_partkey, p_brand FROM part")
def project_existing(spark, folder):
    return clean.select_existing(table(spark, folder, "part"), ["p_partkey", "no_such_column", "p_brand"])


@query(
    "details_parse",
    f"""SELECT p_partkey, CASE WHEN details IS NULL THEN 0 WHEN json_valid(details) THEN len(json_keys(details)) ELSE 1 END AS n_entries,
      json_extract_string(CASE WHEN json_valid(details) THEN details END, '$."RAM Size"') AS ram_size,
      CASE WHEN NOT json_valid(details) THEN details END AS raw_details FROM ({SPEC}) AS p""",
)
def details_parse(spark, folder):
    parsed = load(spark, folder, PRODUCTS).select("p_partkey", tx.parse_details(F.col("details")).alias("m"))
    return parsed.select(
        "p_partkey",
        F.size("m").cast("bigint").alias("n_entries"),
        F.try_element_at("m", F.lit("RAM Size")).alias("ram_size"),
        F.try_element_at("m", F.lit("raw_details")).alias("raw_details"),
    )


@query("props_parse", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_parse(spark, folder):
    parsed = table(spark, folder, "events").select("event_id", tx.parse_details(F.col("props")).alias("m"))
    return parsed.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


@query("array_join_features", f"SELECT p_partkey, array_to_string(list_filter(string_split(features, ' | '), lambda x: x <> ''), ' | ') AS joined FROM ({SPEC}) AS p")
def array_join_features(spark, folder):
    items = load(spark, folder, PRODUCTS).select("p_partkey", F.split("features", r" \| ").alias("items"))
    return items.select("p_partkey", tx.join_features(F.col("items")).alias("joined"))


@query("combine_text", f"SELECT p_partkey, concat_ws(' ', title_y, features, details) AS combined FROM ({SPEC}) AS p")
def combine_text(spark, folder):
    return load(spark, folder, PRODUCTS).select("p_partkey", tx.combine_text(F.col("title_y"), F.col("features"), F.col("details")).alias("combined"))


@query("price_bins_usd", f"SELECT {q.price_bin_usd('o_totalprice / 200')} AS value, count(*) AS n FROM orders GROUP BY 1")
def price_bins_usd(spark, folder):
    binned = table(spark, folder, "orders").select(bins.price_bin_usd(F.col("o_totalprice") / 200).alias("bin"))
    return describe.value_distribution(binned, "bin")


@query("price_conversion", f"SELECT p_partkey, round(p_retailprice * 4.75, 6) AS price_local, {q.price_bin_local('p_retailprice * 4.75')} AS price_bin FROM part")
def price_conversion(spark, folder):
    local = bins.to_local_price(F.col("p_retailprice"))
    return table(spark, folder, "part").select("p_partkey", F.round(local, 6).alias("price_local"), bins.price_bin_local(local).alias("price_bin"))


@query("rating_bins", f"SELECT l_orderkey, l_linenumber, asin, rating, {q.rating_bin('rating * 1.25 - 0.5')} AS rating_bin FROM ({RATED}) AS r")
def rating_bins(spark, folder):
    rated = load(spark, folder, RATINGS)
    return rated.select("l_orderkey", "l_linenumber", "asin", "rating", bins.rating_bin(F.col("rating") * 1.25 - 0.5).alias("rating_bin"))


@query("length_bins", f"SELECT doc_id, {q.length_bin('length(text)')} AS length_bin FROM documents")
def length_bins(spark, folder):
    return table(spark, folder, "documents").select("doc_id", bins.length_bin(F.length("text")).alias("length_bin"))


@query(
    "helpfulness_ratio",
    f"""SELECT row_id, round(coalesce(TRY_CAST(helpful_vote AS DOUBLE) / CASE WHEN TRY_CAST(num_reviews AS DOUBLE) = 0 THEN 1
      ELSE TRY_CAST(num_reviews AS DOUBLE) END, 0), 6) AS helpfulness_ratio FROM ({RAW}) AS w""",
)
def helpfulness_ratio(spark, folder):
    raw = clean.to_numbers(load(spark, folder, WIDE).select("row_id", "helpful_vote", "num_reviews"), ["helpful_vote", "num_reviews"])
    ratio = bins.helpfulness_ratio(F.col("helpful_vote"), F.col("num_reviews"))
    return raw.select("row_id", F.round(ratio, 6).alias("helpfulness_ratio"))


@query(
    "key_popularity",
    f"""SELECT row_id, brand, CASE WHEN brand IS NOT NULL THEN count(*) OVER (PARTITION BY brand) END AS brand_popularity FROM ({RAW}) AS w""",
)
def key_popularity(spark, folder):
    return describe.popularity(load(spark, folder, WIDE).select("row_id", "brand"), "brand", "brand_popularity")


@query("date_parts", "SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(isodow(ts) - 1 AS INT) AS day_of_week FROM events")
def date_parts(spark, folder):
    return table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in bins.date_parts(F.col("ts")).items()])


@query(
    "date_parts_epoch",
    """SELECT event_id, CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, CAST(isodow(t) - 1 AS INT) AS day_of_week
    FROM (SELECT event_id, make_timestamp(event_id * 3600000000) AS t FROM events) AS e""",
)
def date_parts_epoch(spark, folder):
    days = table(spark, folder, "events").select("event_id", bins.to_moment(F.col("event_id") * 3_600_000, "ms").alias("t"))
    return days.select("event_id", *[c.alias(n) for n, c in bins.date_parts(F.col("t")).items()])


@query(
    "rescale_ratings",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, asin, (rating - 1) / 4 AS scaled FROM ({RATED}) AS r)
    SELECT l_orderkey, l_linenumber, asin, CASE WHEN (SELECT max(scaled) FROM s) <= 1 THEN scaled * 5 ELSE scaled END AS rating_scaled FROM s""",
)
def rescale_ratings(spark, folder):
    scaled = encode.scale_minmax(load(spark, folder, RATINGS), ["rating"])
    return encode.rescale_ratings(scaled).select("l_orderkey", "l_linenumber", "asin", "rating_scaled")


@query(
    "step_audit",
    f"""WITH raw AS (SELECT * FROM ({RAW}) AS w),
    priced AS (SELECT *, {q.price('price')} AS price_numeric, {q.clean('text')} AS c_text, {q.clean('title_x')} AS c_title FROM raw
      WHERE {q.price('price')} IS NOT NULL),
    uniq AS (SELECT DISTINCT * FROM (SELECT asin, parent_asin, user_id, timestamp, TRY_CAST(rating AS DOUBLE) AS rating, c_title, c_text,
      coalesce(TRY_CAST(helpful_vote AS DOUBLE), 0) AS hv, TRY_CAST(num_reviews AS DOUBLE) AS nr, title_y, features, details,
      {q.category('brand')} AS brand, os, color, price, coalesce(verified_purchase, false) AS vp, price_numeric FROM priced) AS p),
    longer AS (SELECT * FROM uniq WHERE NOT (length(c_text) < 10 AND length(c_title) < 5)),
    lim AS (SELECT quantile_cont(price_numeric, 0.01) AS lo, quantile_cont(price_numeric, 0.99) AS hi FROM longer),
    kept AS (SELECT * FROM longer, lim WHERE price_numeric BETWEEN lo AND hi),
    c AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM priced) AS b, (SELECT count(*) FROM uniq) AS c,
      (SELECT count(*) FROM longer) AS d, (SELECT count(*) FROM kept) AS e)
    SELECT 1 AS step_no, 'price' AS step, a AS rows_in, b AS rows_out, a - b AS removed FROM c
    UNION ALL SELECT 2, 'duplicates', b, c, b - c FROM c UNION ALL SELECT 3, 'short_content', c, d, c - d FROM c
    UNION ALL SELECT 4, 'outliers', d, e, d - e FROM c""",
)
def step_audit(spark, folder):
    return clean.step_audit(load(spark, folder, WIDE))
