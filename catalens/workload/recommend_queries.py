"""Text vectors, similarity, collaborative filtering, search and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.operators import collab, lsh, match, recommend, search_index, vectors
from catalens.operators.stats import as_scalar
from catalens.session import scratch_path, staged
from catalens.workload import sqltext as q
from catalens.workload.fixtures import CATALOGUE, PRODUCTS, RATINGS, load, plain, table
from catalens.workload.registry import query

SPEC = plain(PRODUCTS)
RATED = plain(RATINGS)
SHOP = plain(CATALOGUE)
STOP = ", ".join(f"'{w}'" for w in vectors.STOP_WORDS)
ITEM, USER = 1, 1


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP}))"


def tfidf_sql(source: str, key: str, text: str, max_terms: int = vectors.MAX_TERMS) -> str:
    return f"""SELECT {key}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM (
      SELECT {key}, term, tf * (ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*) OVER (PARTITION BY term))) + 1.0) AS raw FROM (
        SELECT {key}, term, count(*) AS tf FROM (
          SELECT {key}, unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS term
          FROM (SELECT {key}, {words_sql(text)} AS w FROM {source}) AS a) AS b
        WHERE term IN (SELECT term FROM (
          SELECT unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS term
          FROM (SELECT {words_sql(text)} AS w FROM {source}) AS a) AS c GROUP BY term ORDER BY count(*) DESC, term LIMIT {max_terms})
        GROUP BY {key}, term) AS d) AS e"""


PRODUCT_TEXT = f"(SELECT p_partkey, title_y || ' ' || features AS text FROM ({SPEC}) AS p)"


def product_vectors(spark, folder):
    products = load(spark, folder, PRODUCTS).select("p_partkey", F.concat_ws(" ", "title_y", "features").alias("text"))
    return vectors.tfidf(products, "p_partkey", "text")


@query("tfidf", f"SELECT doc_id, term, round(weight, 6) AS weight FROM ({tfidf_sql('documents', 'doc_id', 'text')}) AS v")
def tfidf(spark, folder):
    found = vectors.tfidf(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_products", f"SELECT p_partkey, term, round(weight, 6) AS weight FROM ({tfidf_sql(PRODUCT_TEXT, 'p_partkey', 'text')}) AS v")
def tfidf_products(spark, folder):
    return product_vectors(spark, folder).select("p_partkey", "term", F.round("weight", 6).alias("weight"))


def similar_sql(vectors_sql: str, key: str, item: int) -> str:
    return f"""WITH v AS MATERIALIZED ({vectors_sql})
    SELECT a.{key}, round(sum(a.weight * b.weight), 9) AS similarity FROM v AS a JOIN v AS b ON a.term = b.term
    WHERE b.{key} = {item} AND a.{key} <> {item} GROUP BY a.{key}"""


@query(
    "tfidf_similar",
    f"""SELECT doc_id, round(similarity, 6) AS similarity FROM ({similar_sql(tfidf_sql('documents', 'doc_id', 'text'), 'doc_id', ITEM)}) AS s
    ORDER BY s.similarity DESC, doc_id LIMIT 5""",
)
def tfidf_similar(spark, folder):
    weights = vectors.tfidf(table(spark, folder, "documents"), "doc_id", "text")
    return vectors.similar_by_terms(weights, "doc_id", ITEM).withColumn("similarity", F.round("similarity", 6))


@query("similar_items", f"SELECT p_partkey, round(similarity, 6) AS similarity FROM ({similar_sql(tfidf_sql(PRODUCT_TEXT, 'p_partkey', 'text'), 'p_partkey', ITEM)}) AS s")
def similar_items(spark, folder):
    found = vectors.similar_by_terms(product_vectors(spark, folder), "p_partkey", ITEM, n=None)
    return found.withColumn("similarity", F.round("similarity", 6))


OWN = f"(SELECT embedding FROM embeddings WHERE vec_id = {ITEM})"


@query(
    "embedding_similar",
    f"""SELECT vec_id, round(list_dot_product(e, o) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(o, o))), 5) AS similarity
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST({OWN} AS DOUBLE[]) AS o FROM embeddings WHERE vec_id <> {ITEM}) AS x""",
)
def embedding_similar(spark, folder):
    found = vectors.similar_by_embedding(table(spark, folder, "embeddings"), "vec_id", "embedding", ITEM, n=None)
    return found.withColumn("similarity", F.round("similarity", 5))


@query(
    "embedding_euclid",
    f"""SELECT vec_id, round(list_distance(e, o), 5) AS distance
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST({OWN} AS DOUBLE[]) AS o FROM embeddings WHERE vec_id <> {ITEM}) AS x""",
)
def embedding_euclid(spark, folder):
    found = vectors.similar_by_embedding(table(spark, folder, "embeddings"), "vec_id", "embedding", ITEM, n=None, metric="euclidean")
    return found.withColumn("distance", F.round("distance", 5))


WORD_SETS = f"(SELECT p_partkey, list_distinct({words_sql('text')}) AS w FROM {PRODUCT_TEXT} AS t)"
JACCARD = f"""SELECT p_partkey, round(len(list_intersect(w, o)) / len(list_distinct(w || o)), 9) AS similarity
    FROM (SELECT p_partkey, w, (SELECT w FROM {WORD_SETS} AS s WHERE p_partkey = {ITEM}) AS o FROM {WORD_SETS} AS s WHERE p_partkey <> {ITEM}) AS x"""


def _word_sets(spark, folder):
    products = load(spark, folder, PRODUCTS).select("p_partkey", F.concat_ws(" ", "title_y", "features").alias("text"))
    return products.select("p_partkey", F.array_distinct(vectors.words(F.col("text"))).alias("w"))


@query("jaccard_similar", f"SELECT p_partkey, round(similarity, 6) AS similarity FROM ({JACCARD}) AS j")
def jaccard_similar(spark, folder):
    found = vectors.similar_by_sets(_word_sets(spark, folder), "p_partkey", "w", ITEM, n=None)
    return found.withColumn("similarity", F.round("similarity", 6))


WANTED = {"ram_gb": 16.0, "storage_gb": 512.0, "storage_type": "SSD"}
SPECCED = q.spec_stage(SPEC, ["title_y", "features"])
SPEC_SCORE = """(coalesce(CASE WHEN ram_gb > 0 THEN least(ram_gb, 16) / greatest(ram_gb, 16) END, 0)
  + coalesce(CASE WHEN storage_gb > 0 THEN least(storage_gb, 512) / greatest(storage_gb, 512) END, 0)
  + CASE WHEN storage_type = 'SSD' THEN 1.0 ELSE 0.0 END) / 3"""


def _specced(spark, folder):
    return match.add_specs(load(spark, folder, PRODUCTS), ["title_y", "features"])


@query("spec_match", f"SELECT p_partkey, round({SPEC_SCORE}, 6) AS similarity FROM ({SPECCED}) AS s")
def spec_match(spark, folder):
    found = vectors.spec_match(_specced(spark, folder), "p_partkey", WANTED, n=None)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "weighted_similar",
    f"""WITH t AS ({similar_sql(tfidf_sql(PRODUCT_TEXT, 'p_partkey', 'text'), 'p_partkey', ITEM)}), j AS ({JACCARD}),
    s AS (SELECT p_partkey, round({SPEC_SCORE}, 9) AS similarity FROM ({SPECCED}) AS x)
    SELECT p_partkey, round(coalesce(t.similarity, 0) * 0.5 + coalesce(j.similarity, 0) * 0.3 + coalesce(s.similarity, 0) * 0.2, 4) AS score
    FROM s LEFT JOIN t USING (p_partkey) LEFT JOIN j USING (p_partkey)""",
)
def weighted_similar(spark, folder):
    text = vectors.similar_by_terms(product_vectors(spark, folder), "p_partkey", ITEM, n=None)
    sets = vectors.similar_by_sets(_word_sets(spark, folder), "p_partkey", "w", ITEM, n=None)
    specs = vectors.spec_match(_specced(spark, folder), "p_partkey", WANTED, n=None)
    blended = vectors.blend([(text, 0.5), (sets, 0.3), (specs, 0.2)], "p_partkey", "similarity")
    return blended.withColumn("score", F.round("score", 4))


PAIRS = f"SELECT user_id AS user, asin AS item, avg(rating) AS rating FROM ({RATED}) AS r GROUP BY 1, 2"
USER_CF = f"""WITH r AS MATERIALIZED ({PAIRS}), n AS (SELECT "user", sqrt(sum(rating * rating)) AS norm FROM r GROUP BY 1),
  own AS (SELECT item, rating FROM r WHERE "user" = {USER}),
  s AS (SELECT r."user", sum(r.rating * own.rating) / (max(n.norm) * (SELECT norm FROM n WHERE "user" = {USER})) AS similarity
    FROM r JOIN own USING (item) JOIN n ON n."user" = r."user" WHERE r."user" <> {USER} GROUP BY r."user")
  SELECT item, round(sum(similarity * rating) / sum(similarity), 6) AS score, count(*) AS support FROM r JOIN s USING ("user")
  WHERE item NOT IN (SELECT item FROM own) GROUP BY item"""
ITEM_CF = f"""WITH r AS MATERIALIZED ({PAIRS}), n AS (SELECT item, sqrt(sum(rating * rating)) AS norm FROM r GROUP BY 1),
  own AS (SELECT item FROM r WHERE "user" = {USER}),
  sim AS (SELECT a.item AS mine, b.item, sum(a.rating * b.rating) AS dot FROM r AS a JOIN r AS b ON a."user" = b."user"
    WHERE a.item IN (SELECT item FROM own) AND b.item NOT IN (SELECT item FROM own) GROUP BY 1, 2)
  SELECT sim.item, round(sum(dot / (x.norm * y.norm)), 9) AS score FROM sim JOIN n AS x ON x.item = mine JOIN n AS y ON y.item = sim.item GROUP BY sim.item"""


def _pairs(spark, folder):
    return collab.one_rating_per_pair(load(spark, folder, RATINGS), "user_id", "asin", "rating")


@query("user_cf", USER_CF)
def user_cf(spark, folder):
    return collab.user_based(_pairs(spark, folder), USER, n=None).withColumn("score", F.round("score", 6))


@query("item_cf", f"SELECT item, round(score, 6) AS score FROM ({ITEM_CF}) AS s")
def item_cf(spark, folder):
    return collab.item_based(_pairs(spark, folder), USER, n=None).withColumn("score", F.round("score", 6))


@query("item_cf_top", f"SELECT item, round(score, 6) AS score FROM ({ITEM_CF}) AS s ORDER BY s.score DESC, item LIMIT 10")
def item_cf_top(spark, folder):
    return collab.item_based(_pairs(spark, folder), USER).withColumn("score", F.round("score", 6))


@query(
    "als_factors",
    f"""WITH r AS (SELECT DISTINCT user_id, asin FROM ({RATED}) AS x)
    SELECT least(10, (SELECT count(DISTINCT asin) FROM r) - (SELECT count(*) FROM r WHERE user_id = {USER})) AS recommended,
    CAST(0 AS BIGINT) AS seen, true AS fits""",
)
def als_factors(spark, folder):
    """How many items are recommended, how many of them the user knows, and whether the factors explain the ratings."""
    ratings = _pairs(spark, folder)
    factors = collab.fit_factors(ratings)
    chosen = collab.recommend_by_factors(factors, ratings, USER)
    known = ratings.where(F.col("user") == USER).select("item", F.lit(1).alias("known"))
    facts = chosen.join(known, "item", "left").agg(F.count("*").alias("recommended"), F.count("known").alias("seen"))
    error = F.col("prediction") - F.col("rating")
    fits = collab.fitted_by_factors(factors).agg((F.sqrt(F.avg(error * error)) < F.stddev_samp("rating")).alias("fits"))
    return facts.withColumn("fits", as_scalar(fits)["fits"])


@query(
    "hybrid",
    f"""WITH c AS ({ITEM_CF}), t AS ({similar_sql(tfidf_sql(PRODUCT_TEXT, 'p_partkey', 'text'), 'p_partkey', ITEM)})
    SELECT coalesce(c.item, t.p_partkey) AS item, round(coalesce(c.score, 0) * 0.6 + coalesce(t.similarity, 0) * 0.4, 4) AS score
    FROM c FULL JOIN t ON c.item = t.p_partkey""",
)
def hybrid(spark, folder):
    content = vectors.similar_by_terms(product_vectors(spark, folder), "p_partkey", ITEM, n=None)
    content = content.select(F.col("p_partkey").alias("item"), F.col("similarity").alias("score"))
    liked = collab.item_based(_pairs(spark, folder), USER, n=None)
    return vectors.blend([(liked, 0.6), (content, 0.4)], "item", "score").withColumn("score", F.round("score", 4))


VALUE = "average_rating / 5.0 * ln(1 + rating_number) / (price / (SELECT avg(price) FROM c))"


@query("value_score", f"WITH c AS MATERIALIZED ({SHOP}) SELECT asin, round({VALUE}, 6) AS value_score FROM c")
def value_score(spark, folder):
    return recommend.add_value_score(load(spark, folder, CATALOGUE)).select("asin", F.round("value_score", 6).alias("value_score"))


@query(
    "recommend",
    f"""WITH c AS MATERIALIZED ({SHOP}),
    g AS (SELECT *, brand = 'Brand#2' AS liked, (contains(lower(title), 'gaming') OR contains(lower(title), 'geforce') OR contains(lower(title), 'rtx')
      OR contains(lower(title), 'gtx') OR contains(lower(title), 'radeon')) AS fits FROM (SELECT * REPLACE (title || ' ' || features AS title) FROM c) AS t)
    SELECT asin, brand, price, round(round({VALUE} * (1.0 + CASE WHEN liked THEN 0.2 ELSE 0 END + CASE WHEN fits THEN 0.2 ELSE 0 END), 9), 6) AS score,
    concat_ws('; ', format('price {{:.2f}} within budget 1000.00', price), CASE WHEN liked THEN 'preferred brand Brand#2' END,
      CASE WHEN fits THEN 'suits gaming' END) AS explanation
    FROM g WHERE price <= 1000 ORDER BY score DESC, asin LIMIT 5""",
)
def recommend_items(spark, folder):
    shop = load(spark, folder, CATALOGUE).withColumn("title", F.concat_ws(" ", "title", "features"))
    found = recommend.recommend(shop, "asin", 1000.0, brand_preference="Brand#2", use_case="gaming")
    return found.withColumn("score", F.round("score", 6))


SEARCHED = f"""SELECT asin, title, brand, price, round(average_rating, 6) AS average_rating, relevance FROM (
      SELECT *, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]{{2,}}')), ['ryzen', 'ddr4', 'widget'])) AS INT) AS relevance
      FROM ({SHOP}) AS c) AS s
    WHERE relevance > 0 AND average_rating >= 2.5 AND price <= 1000 AND brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')
    ORDER BY s.average_rating DESC, relevance DESC, asin LIMIT 10"""


@query("search", SEARCHED)
def search(spark, folder):
    brands = [f"Brand#{i}" for i in range(1, 6)]
    found = recommend.search(load(spark, folder, CATALOGUE), "asin", "Ryzen DDR4 widget", min_rating=2.5, max_price=1000, brands=brands, sort_by="rating")
    return found.withColumn("average_rating", F.round("average_rating", 6))


@query("search_indexed", SEARCHED)
def search_indexed(spark, folder):
    """The same search through a stored index of whose items half came, with other texts before, as a later change."""
    shop = staged(load(spark, folder, CATALOGUE).select("asin", "title", "brand", "price", "average_rating"), "catalogue")
    index = search_index.SearchIndex(scratch_path(spark, "search"), parts=8)
    cheap = F.col("price") < 1000
    search_index.create(spark, shop.withColumn("title", F.when(cheap, F.concat(F.lit("ryzen ddr4 widget "), "title")).otherwise(F.col("title"))), index)
    search_index.add(spark, shop.where(cheap), index)
    brands = [f"Brand#{i}" for i in range(1, 6)]
    found = search_index.search(spark, index, "Ryzen DDR4 widget", min_rating=2.5, max_price=1000, brands=brands, sort_by="rating")
    return found.withColumn("average_rating", F.round("average_rating", 6))


@query("item_detail", f"SELECT asin, title, brand, price, rating_number FROM ({SHOP}) AS c WHERE asin = {ITEM}")
def item_detail(spark, folder):
    return recommend.item_detail(load(spark, folder, CATALOGUE), "asin", ITEM).select("asin", "title", "brand", "price", "rating_number")


@query(
    "preferences",
    f"""WITH r AS MATERIALIZED (SELECT user_id, rating, p_brand AS brand, {q.price_bin_usd('p_retailprice * p_size / 20')} AS band FROM ({RATED}) AS x
      JOIN part ON asin = p_partkey),
    b AS (SELECT user_id, brand, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT user_id, band, count(*) AS n FROM r GROUP BY ALL)
    SELECT user_id, n_reviews, mean_rating, favourite_brand, favourite_price_band FROM
    (SELECT user_id, count(*) AS n_reviews, round(avg(rating), 6) AS mean_rating FROM r GROUP BY 1) AS a
    JOIN (SELECT user_id, first(brand ORDER BY n DESC, brand) AS favourite_brand FROM b GROUP BY 1) AS fb USING (user_id)
    JOIN (SELECT user_id, first(band ORDER BY n DESC, band) AS favourite_price_band FROM p GROUP BY 1) AS fp USING (user_id)""",
)
def preferences(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"), (F.col("p_retailprice") * F.col("p_size") / 20).alias("price"))
    reviews = load(spark, folder, RATINGS).join(parts, F.col("asin") == F.col("p_partkey"))
    return recommend.preferences(reviews, "user_id", "brand", "rating", "price").withColumn("mean_rating", F.round("mean_rating", 6))


INDEX = f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({words_sql('text')}) AS term FROM documents) AS d GROUP BY 1, 2"


@query("inverted_index", INDEX)
def inverted_index(spark, folder):
    return recommend.postings(table(spark, folder, "documents"), "doc_id", "text")


@query("index_terms", f"SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences FROM ({INDEX}) AS i GROUP BY 1")
def index_terms(spark, folder):
    return recommend.index_terms(recommend.postings(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


@query("index_segments", INDEX)
def index_segments(spark, folder):
    """An index created with other texts, then changed, cut and merged, read back whole."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    index = search_index.SearchIndex(scratch_path(spark, "segments"), "doc_id", "text", ("lang",), parts=8, stop_words=tuple(vectors.STOP_WORDS))
    other = F.col("lang") != "en"
    search_index.create(spark, docs.withColumn("text", F.when(other, F.concat("lang", F.lit(" "), F.reverse("text"))).otherwise(F.col("text"))), index)
    search_index.remove(spark, docs.where("lang = 'de'"), index)
    search_index.add(spark, docs.where(other), index)
    search_index.merge(spark, index)
    return search_index.postings(spark, index)


HALF = "TIMESTAMP '2024-01-15 00:00:00'"


@query(
    "ranking_metrics",
    f"""WITH train AS (SELECT user_id AS "user", event_type AS item, count(*) AS score FROM events WHERE ts < {HALF} GROUP BY 1, 2),
    truth AS (SELECT DISTINCT user_id AS "user", event_type AS item FROM events WHERE ts >= {HALF} AND value > 20),
    recs AS (SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM train QUALIFY rank <= 3),
    u AS (SELECT "user", count(*) AS relevant FROM truth GROUP BY 1),
    h AS (SELECT "user", count(*) AS hits, sum(1.0 / log2(rank + 1)) AS dcg FROM recs JOIN truth USING ("user", item) GROUP BY 1),
    m AS (SELECT coalesce(hits, 0) / 3 AS p, coalesce(hits, 0) / relevant AS r,
      coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 3) + 1), lambda i: 1.0 / log2(i + 1))) AS g FROM u LEFT JOIN h USING ("user"))
    SELECT count(*) AS users, round(avg(p), 6) AS precision_at_k, round(avg(r), 6) AS recall_at_k, round(avg(g), 6) AS ndcg_at_k,
    round((SELECT count(DISTINCT item) FROM recs) / (SELECT count(DISTINCT event_type) FROM events), 6) AS coverage FROM m""",
)
def ranking_metrics(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("item"), "ts", "value")
    half = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    train = events.where(F.col("ts") < half).groupBy("user", "item").agg(F.count("*").alias("score"))
    truth = events.where((F.col("ts") >= half) & (F.col("value") > 20)).select("user", "item").distinct()
    metrics = collab.ranking_metrics(collab.top_per_user(train, 3), truth, 3, events.select("item").distinct())
    return metrics.withColumns({c: F.round(c, 6) for c in metrics.columns if c != "users"})


SIMILAR_SQL = f"""WITH v AS MATERIALIZED ({tfidf_sql(PRODUCT_TEXT, 'p_partkey', 'text')}),
    s AS (SELECT b.p_partkey AS item, a.p_partkey AS neighbour, round(sum(a.weight * b.weight), 9) AS similarity FROM v AS a JOIN v AS b ON a.term = b.term
      WHERE a.p_partkey <> b.p_partkey GROUP BY 1, 2)
    SELECT item, neighbour, round(similarity, 6) AS similarity,
    CAST(row_number() OVER (PARTITION BY item ORDER BY s.similarity DESC, neighbour) AS INT) AS rank FROM s WHERE s.similarity >= 0.6 QUALIFY rank <= 5"""


def _similar_products(spark, folder):
    stored = staged(product_vectors(spark, folder), "vectors")
    return vectors.similarity_table(stored, "p_partkey", table(spark, folder, "part"), n=5, min_similarity=0.6)


@query("similarity_table", SIMILAR_SQL)
def similarity_table(spark, folder):
    return _similar_products(spark, folder).withColumn("similarity", F.round("similarity", 6))


@query("similarity_stored", SIMILAR_SQL)
def similarity_stored(spark, folder):
    path = scratch_path(spark, "similar")
    vectors.write_similarity_table(_similar_products(spark, folder), path)
    return vectors.read_similarity_table(spark, path).drop("slot").withColumn("similarity", F.round("similarity", 6))


NEAR_DOCS = f"""WITH v AS MATERIALIZED ({tfidf_sql('documents', 'doc_id', 'text')}),
    s AS (SELECT b.doc_id AS item, a.doc_id AS neighbour, round(sum(a.weight * b.weight), 9) AS similarity FROM v AS a JOIN v AS b ON a.term = b.term
      WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
    SELECT item, neighbour, similarity, CAST(row_number() OVER (PARTITION BY item ORDER BY similarity DESC, neighbour) AS INT) AS rank
    FROM s WHERE similarity >= 0.8 QUALIFY rank <= 5"""


def _document_vectors(spark, folder):
    return staged(vectors.tfidf(table(spark, folder, "documents"), "doc_id", "text"), "vectors")


@query("lsh_similar", f"SELECT item, neighbour, round(similarity, 6) AS similarity, rank FROM ({NEAR_DOCS}) AS n")
def lsh_similar(spark, folder):
    """The five nearest of every document by text; with so many bands that a lost pair is a matter of one in 10,000."""
    found = lsh.similar_all(_document_vectors(spark, folder), "doc_id", n=5, min_similarity=0.8, recall=0.9999)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("lsh_recall", f"SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS wrong, true AS recalled FROM ({NEAR_DOCS}) AS n")
def lsh_recall(spark, folder):
    """Exact pairs, pairs found with another similarity, and whether nine of ten are found with the usual number of bands."""
    stored = _document_vectors(spark, folder)
    exact = staged(vectors.similarity_table(stored, "doc_id", stored, n=5, min_similarity=0.8), "exact")
    found = staged(lsh.similar_all(stored, "doc_id", n=5, min_similarity=0.8), "found")
    both = exact.join(found.select("item", "neighbour", F.col("similarity").alias("told")), ["item", "neighbour"])
    wrong = as_scalar(both.agg(F.count_if(F.abs(F.col("told") - F.col("similarity")) > 1e-6).alias("n")))["n"]
    return lsh.recall_of(found, exact).select("pairs", wrong.alias("wrong"), (F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("recalled"))


NEAR_SETS = f"""WITH w AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS word FROM documents),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
    c AS (SELECT a.doc_id AS item, b.doc_id AS neighbour, count(*) AS c FROM w AS a JOIN w AS b ON a.word = b.word WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    s AS (SELECT item, neighbour, round(c / (x.n + y.n - c), 9) AS similarity FROM c JOIN n AS x ON x.doc_id = item JOIN n AS y ON y.doc_id = neighbour)
    SELECT item, neighbour, similarity, CAST(row_number() OVER (PARTITION BY item ORDER BY similarity DESC, neighbour) AS INT) AS rank
    FROM s WHERE similarity >= 0.5 QUALIFY rank <= 5"""


def _document_words(spark, folder):
    return staged(table(spark, folder, "documents").select("doc_id", vectors.words(F.col("text")).alias("w")), "word-sets")


@query("minhash_similar", f"SELECT item, neighbour, round(similarity, 6) AS similarity, rank FROM ({NEAR_SETS}) AS n")
def minhash_similar(spark, folder):
    """The five nearest of every document by Jaccard similarity of words."""
    found = lsh.similar_sets_all(_document_words(spark, folder), "doc_id", "w", n=5, min_similarity=0.5, recall=0.99)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("minhash_recall", f"SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS wrong, true AS recalled FROM ({NEAR_SETS}) AS n")
def minhash_recall(spark, folder):
    """As `lsh_recall`; the exact pairs are all that share a word."""
    sets = _document_words(spark, folder)
    exact = staged(lsh.exact_sets(sets, "doc_id", "w", n=5, min_similarity=0.5), "exact")
    found = staged(lsh.similar_sets_all(sets, "doc_id", "w", n=5, min_similarity=0.5), "found")
    both = exact.join(found.select("item", "neighbour", F.col("similarity").alias("told")), ["item", "neighbour"])
    wrong = as_scalar(both.agg(F.count_if(F.abs(F.col("told") - F.col("similarity")) > 1e-6).alias("n")))["n"]
    return lsh.recall_of(found, exact).select("pairs", wrong.alias("wrong"), (F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("recalled"))
