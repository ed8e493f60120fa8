"""Files, captured pages, report and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions import bins
from catalens.functions import text as tx
from catalens.operators import match
from catalens.session import scratch_path
from catalens.sources import files, report
from catalens.sources import pages as pg
from catalens.workload import sqltext as q
from catalens.workload.fixtures import ANSWER_PAGES, AWKWARD, CPU_SCORES, DIRTY_ORDERS, PRODUCTS, RATINGS, SCORE_ROWS, SCORED_PAGES, load, plain, table
from catalens.workload.registry import query

SPEC = plain(PRODUCTS)
ROWS = plain(SCORE_ROWS)
DIRTY = plain(DIRTY_ORDERS)
RATED = plain(RATINGS)


@query("load_parquet", "SELECT * FROM part")
def load_parquet(spark, folder):
    return files.read_table(spark, f"{folder}/part.parquet")


@query("csv_roundtrip", f"SELECT o_orderkey, price, status, rating_raw, verified FROM ({DIRTY}) AS d")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "csv")
    dirty = load(spark, folder, DIRTY_ORDERS).select("o_orderkey", "price", "status", "rating_raw", "verified")
    files.write_csv(dirty, path)
    return files.read_csv(spark, path, dirty.schema)


@query("csv_awkward_text", plain(AWKWARD))
def csv_awkward_text(spark, folder):
    path = scratch_path(spark, "csv")
    rows = load(spark, folder, AWKWARD)
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query(
    "csv_nested",
    f"SELECT p_partkey, CASE WHEN details IS NULL THEN '{{}}' WHEN json_valid(details) THEN replace(replace(details, '\": \"', '\":\"'), '\", \"', '\",\"') ELSE '{{\"raw_details\":\"not json\"}}' END AS details FROM ({SPEC}) AS p",
)
def csv_nested(spark, folder):
    path = scratch_path(spark, "csv")
    products = load(spark, folder, PRODUCTS).select("p_partkey", tx.parse_details(F.col("details")).alias("details"))
    files.write_csv(products, path)
    return files.read_csv(spark, path, "p_partkey bigint, details string")


@query("score_table_json", f"SELECT name, score, row_number() OVER (ORDER BY ord, name) - 1 AS ord FROM ({plain(CPU_SCORES)}) AS s")
def score_table_json(spark, folder):
    path = scratch_path(spark, "scores")
    files.write_score_document(load(spark, folder, CPU_SCORES), path)
    return files.read_score_document(spark, path).withColumn("ord", F.col("ord").cast("bigint"))


@query("score_table_lines", "SELECT 'part ' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS BIGINT) AS score, p_partkey AS ord FROM part")
def score_table_lines(spark, folder):
    path = scratch_path(spark, "scores")
    parts = table(spark, folder, "part")
    files.write_scores(
        parts.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("score"), F.col("p_partkey").alias("ord")), path
    )
    return files.read_scores(spark, path)


PAGE_NAME = "p_name || ' ' || CAST(p_size % 7 AS STRING)"


def _score_pages(spark, folder):
    """Forty rows per page: a bounded group, whatever the table's size."""
    rows = load(spark, folder, SCORE_ROWS)
    listed = F.array_sort(F.collect_list(F.struct("p_partkey", "row")))
    body = F.array_join(F.transform(listed, lambda r: r["row"]), "")
    mark = F.when(F.col("page_id") % 3 == 2, F.lit('class="chart"')).otherwise(F.lit('id="cputable"'))
    head = F.lit("<tr><th>n</th><th>s</th><th>r</th></tr>")
    paged = rows.groupBy("page_id").agg(body.alias("body"))
    return paged.select("page_id", F.concat(F.lit("<html><table "), mark, F.lit(">"), head, "body", F.lit("</table></html>")).alias("html"))


@query(
    "score_table_from_html",
    f"""SELECT {q.cpu_name(f'({PAGE_NAME})')} AS name, CAST(first(p_size * 1000 + p_partkey % 1000 ORDER BY p_partkey DESC) AS BIGINT) AS score
    FROM part WHERE p_size <> 13 GROUP BY 1""",
)
def score_table_from_html(spark, folder):
    return pg.scores_from_tables(_score_pages(spark, folder), "page_id").select("name", "score")


@query(
    "score_table_from_html_gpu",
    f"""SELECT {q.gpu_name(f'({PAGE_NAME})')} AS name, CAST(first(p_size * 1000 + p_partkey % 1000 ORDER BY p_partkey DESC) AS BIGINT) AS score
    FROM part WHERE p_size <> 13 GROUP BY 1""",
)
def score_table_from_html_gpu(spark, folder):
    return pg.scores_from_tables(_score_pages(spark, folder), "page_id", kind="gpu").select("name", "score")


ANSWER_TEXT = r"regexp_replace(html, '<[^>]+>', '', 'g')"
PATTERNS = [r"(?i)PassMark CPU Mark: (\d+)", r"(?i)CPU Mark: (\d+)", r"(?i)Benchmark: (\d+)", r"(?i)Score: (\d+)"]


@query(
    "score_from_page_text",
    f"SELECT {q.cpu_name('name')} AS name, CAST({q.first_match(ANSWER_TEXT, PATTERNS)} AS BIGINT) AS score FROM ({plain(ANSWER_PAGES)}) AS a",
)
def score_from_page_text(spark, folder):
    return pg.scores_from_texts(load(spark, folder, ANSWER_PAGES), "name", "html")


@query(
    "score_from_page_text_gpu",
    f"""SELECT {q.gpu_name('name')} AS name, CAST({q.first_match(ANSWER_TEXT, [r'(?i)PassMark G3D Mark: (\d+)', r'(?i)G3D Mark: (\d+)'] + PATTERNS[2:])} AS BIGINT) AS score
    FROM ({plain(ANSWER_PAGES)}) AS a""",
)
def score_from_page_text_gpu(spark, folder):
    return pg.scores_from_texts(load(spark, folder, ANSWER_PAGES), "name", "html", kind="gpu")


@query(
    "score_from_page_text_cached",
    f"""SELECT a.name, coalesce(CAST(a.paged AS BIGINT), s.score) AS score
    FROM (SELECT page_id, {q.cpu_name('name')} AS name, {q.first_match(ANSWER_TEXT, PATTERNS)} AS paged FROM ({plain(ANSWER_PAGES)}) AS x) AS a
    LEFT JOIN (SELECT p_partkey, CAST(p_size AS BIGINT) AS score FROM part WHERE p_partkey % 2 = 0) AS s ON page_id = p_partkey""",
)
def score_from_page_text_cached(spark, folder):
    pages = load(spark, folder, ANSWER_PAGES)
    known = table(spark, folder, "part").where("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("bigint").alias("score"))
    scores = pages.join(known, F.col("page_id") == F.col("p_partkey")).select(tx.normalize_cpu_name(F.col("name")).alias("name"), "score")
    return pg.scores_from_texts(pages, "name", "html", scores=scores)


@query("score_in_pages", f"SELECT page_id, CAST({q.first_match('html', PATTERNS)} AS BIGINT) AS score FROM ({plain(SCORED_PAGES)}) AS p")
def score_in_pages(spark, folder):
    return load(spark, folder, SCORED_PAGES).select("page_id", pg.score_in_text(F.col("html")).alias("score"))


STAGE = q.spec_stage(SPEC, ["title_y", "features"])
BAD_RAM = "coalesce(ram_gb < 1 OR ram_gb > 128, false)"
BAD_DISK = "coalesce(storage_gb < 16 OR storage_gb > 8192, false)"


@query(
    "quarantine_export",
    f"""SELECT count(*) FILTER (WHERE {BAD_RAM} OR {BAD_DISK}) AS records_exported, count(*) FILTER (WHERE {BAD_RAM}) AS ram_invalid_count,
    count(*) FILTER (WHERE {BAD_DISK}) AS storage_invalid_count, count(*) FILTER (WHERE {BAD_RAM} AND {BAD_DISK}) AS both_invalid_count
    FROM ({STAGE}) AS s""",
)
def quarantine_export(spark, folder):
    specced = match.add_specs(load(spark, folder, PRODUCTS), ["title_y", "features"])
    return report.export_invalid(specced, scratch_path(spark, "invalid")).drop("output_path")


@query(
    "quarantine_rows",
    f"""SELECT p_partkey, title_y, features, details, note, kind, {BAD_RAM} AS ram_invalid, {BAD_DISK} AS storage_invalid
    FROM ({STAGE}) AS s JOIN ({plain(AWKWARD)}) AS a USING (p_partkey) WHERE {BAD_RAM} OR {BAD_DISK}""",
)
def quarantine_rows(spark, folder):
    path = scratch_path(spark, "invalid")
    awkward = load(spark, folder, AWKWARD)
    specced = match.add_specs(load(spark, folder, PRODUCTS), ["title_y", "features"]).join(awkward, "p_partkey")
    report.export_invalid(specced, path)
    flags = "ram_invalid boolean, storage_invalid boolean, validation_notes string"
    schema = ", ".join(f"{name} {kind}" for name, kind in specced.dtypes) + ", " + flags
    return files.read_csv(spark, path, schema).select("p_partkey", "title_y", "features", "details", "note", "kind", "ram_invalid", "storage_invalid")


def _bin_lines(section: int, source: str, column: str, labels, noun: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {section}, {100 + i}, '  {label}: ' || format('{{:,}}', count(*) FILTER (WHERE {column} = '{label}')) || ' {noun}' FROM {source}"
        for i, label in enumerate(labels)
    )


REPORT_SQL = f"""WITH p AS MATERIALIZED (SELECT *, p_retailprice * 4.75 AS price_myr, {q.price_bin_local('p_retailprice * 4.75')} AS price_bin FROM ({STAGE}) AS s),
    r AS MATERIALIZED (SELECT x.*, p_name AS text, {q.length_bin('length(p_name)')} AS length_bin FROM ({RATED}) AS x JOIN part ON asin = p_partkey),
    b AS (SELECT p_brand, count(*) AS n FROM p GROUP BY 1),
    t(section, line_no, line) AS (
    SELECT 0, 0, repeat('=', 60) UNION ALL SELECT 0, 1, 'PRODUCT REVIEW DATASET ANALYSIS REPORT' UNION ALL SELECT 0, 2, repeat('=', 60)
    UNION ALL SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]), 1, unnest(['DATASET OVERVIEW', 'PRICE ANALYSIS', 'BRAND ANALYSIS', 'RATING ANALYSIS',
      'REVIEW ANALYSIS', 'RAM ANALYSIS', 'STORAGE ANALYSIS', 'SYSTEM ANALYSIS'])
    UNION ALL SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]), 2, repeat('-', 30)
    UNION ALL SELECT 1, 3, 'Products: ' || format('{{:,}}', count(*)) || ' rows, 24 features' FROM p
    UNION ALL SELECT 1, 4, 'Reviews: ' || format('{{:,}}', count(*)) || ' rows, 9 features' FROM r
    UNION ALL SELECT 2, unnest([3, 4, 5]), unnest([format('Price Range: RM {{:.2f}} - RM {{:.2f}}', round(min(price_myr), 2), round(max(price_myr), 2)),
      format('Average Price: RM {{:.2f}}', round(avg(price_myr), 2)), format('Median Price: RM {{:.2f}}', round(median(price_myr), 2))]) FROM p
    UNION ALL {_bin_lines(2, 'p', 'price_bin', bins.PRICE_LABELS, 'products')}
    UNION ALL SELECT 3, unnest([3, 4, 5]), unnest(['Total Brands: ' || count(*), 'Most Popular Brand: ' || first(p_brand ORDER BY n DESC, p_brand),
      format('Average Models per Brand: {{:.1f}}', avg(n))]) FROM b
    UNION ALL SELECT 3, 99, 'Top 10 Brands:'
    UNION ALL SELECT 3, CAST(100 + k AS INT), '  ' || k || '. ' || p_brand || ': ' || format('{{:,}}', n) || ' products'
      FROM (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM b) AS t WHERE k <= 10
    UNION ALL SELECT 4, 6, format('Original Rating Range: {{:.2f}} - {{:.2f}}', min(rating / 5), max(rating / 5)) FROM r
    UNION ALL SELECT 4, unnest([3, 4, 5]), unnest([format('Average Rating: {{:.2f}}/5.0', avg(rating)), format('Median Rating: {{:.2f}}/5.0', median(rating)),
      format('Rating Range: {{:.1f}} - {{:.1f}}', min(rating), max(rating))]) FROM r
    UNION ALL SELECT 4, 100, 'Total Helpful Votes: ' || format('{{:,}}', CAST(sum(helpful_vote) AS BIGINT)) || format(', average {{:.1f}}', avg(helpful_vote)) FROM r
    UNION ALL SELECT 5, unnest([3, 4, 5]), unnest(['Total Reviews: ' || format('{{:,}}', count(*)), format('Average Review Length: {{:.0f}} characters', avg(length(text))),
      'Review Length Range: ' || min(length(text)) || ' - ' || max(length(text)) || ' characters']) FROM r
    UNION ALL {_bin_lines(5, 'r', 'length_bin', bins.LENGTH_LABELS, 'reviews')}
    UNION ALL SELECT 6, unnest([3, 4]), unnest([format('RAM Range: {{:.0f}} - {{:.0f}} GB', min(ram_gb), max(ram_gb)), format('Average RAM: {{:.1f}} GB', avg(ram_gb))]) FROM p
    UNION ALL SELECT 7, unnest([3, 4]), unnest([format('Storage Range: {{:.0f}} - {{:.0f}} GB', min(storage_gb), max(storage_gb)),
      format('Average Storage: {{:.1f}} GB', avg(storage_gb))]) FROM p
    UNION ALL SELECT 8, 3, 'Most Common OS: ' || (SELECT p_type FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
    SELECT * FROM t"""


def _report(spark, folder):
    products = match.add_specs(load(spark, folder, PRODUCTS), ["title_y", "features"])
    local = bins.to_local_price(F.col("p_retailprice"))
    products = products.withColumns({"price_myr": local, "price_bin": bins.price_bin_local(local)})
    names = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("text"))
    reviews = load(spark, folder, RATINGS).join(names, F.col("asin") == F.col("p_partkey")).drop("p_partkey")
    reviews = reviews.withColumn("rating_before", F.col("rating") / 5)
    return report.report_lines(products, reviews, price_bin="price_bin", brand="p_brand", os_column="p_type", original_rating="rating_before")


@query("report_lines", REPORT_SQL)
def report_lines(spark, folder):
    return _report(spark, folder)


@query("report_file", f"SELECT line FROM ({REPORT_SQL}) AS r")
def report_file(spark, folder):
    path = scratch_path(spark, "report")
    report.write_report(_report(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
