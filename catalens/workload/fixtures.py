"""Dirty and spec-bearing inputs, derived row by row from the test tables.

The tables are clean and hold no product specs, so each fixture is SQL over
whole tables that Spark and DuckDB both read unchanged.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

DIRTY_ORDERS = """
SELECT o_orderkey, o_custkey, o_totalprice,
  CASE o_orderkey % 10
    WHEN 0 THEN NULL
    WHEN 1 THEN 'None'
    WHEN 2 THEN 'from $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
    WHEN 3 THEN '1.2.3'
    ELSE '$' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ','
         || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0') || '.50'
  END AS price,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Missing' ELSE o_orderstatus END AS status,
  CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST(1 + o_orderkey % 5 AS STRING) END AS rating_raw,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS STRING) END AS votes,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS verified
FROM {orders}
"""

SPEC_PRODUCTS = """
SELECT p_partkey, p_brand, p_type, p_retailprice,
  CASE p_partkey % 10
    WHEN 0 THEN 'Intel Core i5-' || CAST(1000 + p_size AS STRING) || 'G7'
    WHEN 1 THEN 'AMD Ryzen ' || CAST(3 + 2 * (p_size % 4) AS STRING) || ' ' || CAST(5000 + p_size AS STRING) || 'U'
    WHEN 2 THEN 'Intel Celeron N' || CAST(4000 + p_size AS STRING) || ' CPU @ 1.10GHz'
    WHEN 3 THEN 'Apple M' || CAST(1 + p_size % 3 AS STRING) || ' Pro'
    WHEN 4 THEN 'Intel Core i9-' || CAST(11900 + p_size % 10 AS STRING) || 'H Processor'
    WHEN 5 THEN CASE WHEN p_size > 25 THEN 'Snapdragon 8cx Gen 3 Compute Platform' ELSE 'unnamed chip' END
    WHEN 6 THEN 'Intel Pentium Gold 7505'
    WHEN 7 THEN 'AMD Athlon 300U Dual'
    WHEN 8 THEN 'AMD A6-9220 APU'
    ELSE 'Core i7 1165G7' END AS chip,
  CASE p_partkey % 7 WHEN 0 THEN 'Intel Iris Xe Graphics' WHEN 1 THEN 'NVIDIA GeForce RTX 3060 card'
    WHEN 2 THEN 'AMD Radeon Vega ' || CAST(3 + p_size % 6 AS STRING) WHEN 3 THEN 'Intel UHD Graphics 600'
    WHEN 4 THEN 'Iris Plus Graphics 655 by Intel' WHEN 5 THEN 'Radeon Graphics' ELSE 'none' END AS video,
  CASE p_partkey % 8 WHEN 0 THEN '4GB DDR4' WHEN 1 THEN '8 GB RAM' WHEN 2 THEN '16GB LPDDR5' WHEN 3 THEN '32GB memory'
    WHEN 4 THEN '64GB DDR5' WHEN 5 THEN '256GB DDR3' WHEN 6 THEN '1TB' ELSE '' END AS ram_text,
  CASE p_partkey % 9 WHEN 0 THEN '512GB SSD' WHEN 1 THEN '1TB NVMe SSD' WHEN 2 THEN '2TB HDD' WHEN 3 THEN '64GB eMMC storage'
    WHEN 4 THEN '1.5TB PCIe SSD' WHEN 5 THEN '8GB flash storage' WHEN 6 THEN '16TB hard drive' WHEN 7 THEN 'hybrid'
    ELSE '' END AS disk_text,
  CAST(11 + p_size % 8 AS STRING)
    || CASE p_partkey % 4 WHEN 0 THEN '.6 inch' WHEN 1 THEN '.3"' WHEN 2 THEN ' in' ELSE '' END AS screen_text,
  p_name, p_size,
  CASE p_partkey % 5
    WHEN 0 THEN NULL
    WHEN 1 THEN 'not json'
    ELSE '{{"RAM Size": "' || CAST(4 * (1 + p_size % 4) AS STRING) || ' GB", "Hard Drive": "'
      || CASE p_size % 2 WHEN 0 THEN '1 TB' ELSE '256 GB' END || '", "Screen Size": "' || CAST(11 + p_size % 8 AS STRING)
      || '.5 inches", "Processor Brand": "chip' || CAST(p_size % 3 AS STRING) || '"}}'
  END AS details
FROM {part}
"""

PRODUCTS = f"""
SELECT p_partkey, p_brand, p_type, p_retailprice, p_name, p_size, chip, video, details,
  p_name || ' ' || chip || ', ' || ram_text AS title_y,
  disk_text || ' | ' || screen_text || ' | ' || video AS features
FROM ({SPEC_PRODUCTS}) AS spec
"""

RATINGS = """
SELECT l_partkey AS asin, o_custkey AS user_id, l_orderkey, l_linenumber,
  CAST(1 + (l_orderkey + l_linenumber) % 5 AS DOUBLE) AS rating,
  CAST(l_quantity AS INT) % 20 AS helpful_vote, l_shipdate AS ts
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Catalogue: one row per product with its review statistics.
CATALOGUE = f"""
SELECT p.p_partkey AS asin, p.title_y AS title, p.features, p.p_brand AS brand, p.p_retailprice AS price,
  r.average_rating, r.rating_number
FROM ({PRODUCTS}) AS p
JOIN (SELECT asin, avg(rating) AS average_rating, count(*) AS rating_number FROM ({RATINGS}) AS x GROUP BY asin) AS r
  ON p.p_partkey = r.asin
"""

# Wide review table: one row per line item, some rows repeated, product columns repeated per review.
WIDE = f"""
SELECT ((l.l_orderkey * 10 + l.l_linenumber) * 1000000000 + l.l_partkey * 1000 + l.l_suppkey % 1000) * 2 + l.copy AS row_id, CAST(p.p_partkey AS STRING) AS asin, 'P' || CAST(p.p_size AS STRING) AS parent_asin,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE 'U' || CAST(o.o_custkey AS STRING) END AS user_id,
  l.l_shipdate AS timestamp,
  CASE l.l_linenumber WHEN 5 THEN NULL WHEN 6 THEN 'n/a' ELSE CAST(1 + (l.l_orderkey + l.l_linenumber) % 5 AS STRING) END AS rating,
  CASE WHEN l.l_quantity < 3 THEN 'ok' ELSE '<b>' || p.p_name || '</b>  "' || o.o_orderpriority || '"' END AS title_x,
  CASE WHEN l.l_quantity < 5 THEN 'good' 
    ELSE repeat('<p>' || p.p_type || ' *' || p.chip || '* </p> ',
      CAST(CASE WHEN l.l_quantity = 50 THEN 40 WHEN l.l_quantity = 49 THEN 20 ELSE floor(l.l_quantity / 6) + 1 END AS INT)) END AS text,
  CASE WHEN l.l_linenumber = 4 THEN NULL ELSE CAST(CAST(l.l_quantity AS INT) % 20 AS STRING) END AS helpful_vote,
  CAST(CAST(l.l_quantity AS INT) % 4 AS STRING) AS num_reviews,
  p.title_y, p.features, p.details,
  CASE WHEN p.p_size = 50 THEN NULL WHEN p.p_size = 49 THEN 'Missing' ELSE p.p_brand END AS brand,
  CASE WHEN p.p_size < 5 THEN NULL ELSE 'OS ' || p.p_type END AS os,
  CASE WHEN p.p_size < 9 THEN 'Missing' ELSE 'color ' || CAST(p.p_size % 6 AS STRING) END AS color,
  'store ' || CAST(p.p_size % 11 AS STRING) AS store,
  CASE p.p_size WHEN 10 THEN NULL ELSE CAST(1 + p.p_size % 5 AS STRING) END AS average_rating,
  CAST(10 * p.p_size AS STRING) AS rating_number,
  CASE WHEN p.p_size = 17 THEN NULL WHEN p.p_size = 18 THEN 'None'
    ELSE '$' || CAST(CAST(floor(p.p_retailprice * p.p_size / 10) AS BIGINT) AS STRING) || '.99' END AS price,
  CASE l.l_returnflag WHEN 'A' THEN true WHEN 'N' THEN NULL ELSE false END AS verified_purchase
FROM (SELECT *, 0 AS copy FROM {{lineitem}} UNION ALL SELECT *, 1 AS copy FROM {{lineitem}} WHERE l_quantity > 45) AS l
JOIN {{orders}} AS o ON l.l_orderkey = o.o_orderkey
JOIN ({PRODUCTS}) AS p ON l.l_partkey = p.p_partkey
"""

CPU_SCORES = """
SELECT name, CAST(max(score) AS BIGINT) AS score, CAST(min(ord) AS BIGINT) AS ord FROM (
  SELECT 'core i5-' || CAST(1000 + p_size AS STRING) || 'g7' AS name, 9000 + 100 * p_size AS score, p_size AS ord
    FROM {part} WHERE p_size > 10
  UNION ALL
  SELECT 'ryzen ' || CAST(3 + 2 * (p_size % 4) AS STRING) || ' ' || CAST(5000 + p_size AS STRING) || 'u', 13000 + p_size, 100 + p_size
    FROM {part} WHERE p_size < 40
  UNION ALL
  SELECT 'core i9-' || CAST(11900 + p_size % 10 AS STRING) || 'h', 22000 + 10 * (p_size % 10), 200 + p_size % 10
    FROM {part} WHERE p_size > 45
  UNION ALL SELECT 'celeron', 1500, 300
  UNION ALL SELECT 'm1', 14200, 301
  UNION ALL SELECT 'core i9', 21000, 302
  UNION ALL SELECT 'core i7-1165g7', 10400, 303
  UNION ALL SELECT 'a6-9220', 1300, 304
  UNION ALL SELECT 'snapdragon 8cx gen 3 compute platform', 8800, 305
) AS s GROUP BY name
"""

GPU_SCORES = """
SELECT name, CAST(max(score) AS BIGINT) AS score, CAST(min(ord) AS BIGINT) AS ord FROM (
  SELECT 'amd radeon vega ' || CAST(3 + p_size % 6 AS STRING) AS name, 1500 + 100 * (p_size % 6) AS score, p_size % 6 AS ord
    FROM {part} WHERE p_size > 30
  UNION ALL SELECT 'intel iris xe graphics', 2700, 10
  UNION ALL SELECT 'geforce rtx 3060', 16900, 11
  UNION ALL SELECT 'intel uhd graphics', 700, 12
  UNION ALL SELECT 'iris plus graphics 655 by intel', 1650, 13
  UNION ALL SELECT 'amd radeon graphics', 2100, 14
) AS s GROUP BY name
"""

# Captured score pages: forty products per page, every third page marked by class instead of id.
PAGE_SIZE = 40
SCORE_ROWS = f"""
SELECT CAST(floor(p_partkey / {PAGE_SIZE}) AS BIGINT) AS page_id, p_partkey,
  '<tr class="r"><td><a href="#">' || p_name || ' ' || CAST(p_size % 7 AS STRING) || '</a></td><td>'
    || CAST(p_size AS STRING) || ',' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '</td>'
    || CASE WHEN p_size = 13 THEN '' ELSE '<td>1</td>' END || '</tr>' AS row
FROM {{part}}
"""

# Numbers with NaN and NULL among them.
GAPPY = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 3 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_linenumber = 5 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END AS price_usd
FROM {lineitem}
"""

# Text with everything that CSV has to quote.
AWKWARD = """
SELECT p_partkey,
  CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN p_name || chr(10) || 'second' WHEN 3 THEN chr(13) || chr(10)
    WHEN 4 THEN 'a "quoted" word' WHEN 5 THEN ' one, two ' WHEN 6 THEN chr(9) || 'back' || chr(92) ELSE p_name END AS note,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE '"' || p_type || '"' END AS kind
FROM {part}
"""

# Captured pages with a stated score on most of them.
SCORED_PAGES = """
SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN ' Score: ' || CAST(100 + page_id AS STRING)
  WHEN 1 THEN ' cpu mark: ' || CAST(200 + page_id AS STRING) || ', score: 7' WHEN 2 THEN ' PassMark CPU Mark: ' || CAST(page_id AS STRING)
  ELSE '' END AS html
FROM {pages}
"""

# Documents that name a product's parts.
DOCUMENT_SPECS = f"""
SELECT doc_id, text || ' ' || title_y || ' ' || features AS text
FROM {{documents}} JOIN ({PRODUCTS}) AS p ON p_partkey = 1 + doc_id % 200
"""

# One result page per product name searched.
ANSWER_PAGES = """
SELECT p_partkey AS page_id, p_name || ' ' || CAST(p_partkey AS STRING) || ' Processor' AS name,
  '<html><body><h1>' || p_name || '</h1><p>'
  || CASE p_size % 7 WHEN 0 THEN 'PassMark CPU Mark: ' || CAST(1000 + p_size AS STRING)
       WHEN 1 THEN 'cpu mark: <b>' || CAST(2000 + p_size AS STRING) || '</b>'
       WHEN 2 THEN 'Score: ' || CAST(p_size AS STRING) || ', Benchmark: ' || CAST(3000 + p_size AS STRING)
       WHEN 3 THEN 'score: ' || CAST(4000 + p_size AS STRING)
       WHEN 4 THEN 'PassMark G3D Mark: ' || CAST(5000 + p_size AS STRING) || ', Score: 1'
       WHEN 5 THEN 'g3d mark: <b>' || CAST(6000 + p_size AS STRING) || '</b>'
       ELSE 'no result' END || '</p></body></html>' AS html
FROM {part}
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A fixture as DataFrame over the parquet tables it names."""
    named = {field for _, field, _, _ in string.Formatter().parse(sql) if field}
    return spark.sql(sql, **{name: table(spark, folder, name) for name in named})


def plain(sql: str) -> str:
    """A fixture as SQL over registered views of the same names."""
    return sql.format(**{name: name for name in TABLES})
