"""Names, substring counts, dictionary matching and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions import text as tx
from catalens.operators import describe, match
from catalens.plans import pipelines
from catalens.session import staged
from catalens.sources import pages as pg
from catalens.workload import sqltext as q
from catalens.workload.fixtures import ANSWER_PAGES, CPU_SCORES, GPU_SCORES, PRODUCTS, load, plain, table
from catalens.workload.registry import query

SPEC = plain(PRODUCTS)
CPU_TABLE = plain(CPU_SCORES)
GPU_TABLE = plain(GPU_SCORES)
TEXTS = ["title_y", "features", "details"]
ALL_TEXT = f"SELECT p_partkey, lower(concat_ws(' ', title_y, features, details)) AS t FROM ({SPEC}) AS p"


def cpu_scores(spark, folder):
    return staged(load(spark, folder, CPU_SCORES), "cpu-scores")


def gpu_scores(spark, folder):
    return staged(load(spark, folder, GPU_SCORES), "gpu-scores")


@query("normalize_cpu_name", f"SELECT p_partkey, {q.cpu_name('chip')} AS name FROM ({SPEC}) AS p")
def normalize_cpu_name(spark, folder):
    return load(spark, folder, PRODUCTS).select("p_partkey", tx.normalize_cpu_name(F.col("chip")).alias("name"))


@query("normalize_gpu_name", f"SELECT p_partkey, {q.gpu_name('video')} AS name FROM ({SPEC}) AS p")
def normalize_gpu_name(spark, folder):
    return load(spark, folder, PRODUCTS).select("p_partkey", tx.normalize_gpu_name(F.col("video")).alias("name"))


@query(
    "substring_count",
    f"SELECT doc_id, {q.occurrences('text', p := chr(39) + 'ene' + chr(39))} AS n FROM documents",
)
def substring_count(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", tx.count_occurrences(F.col("text"), F.lit("ene")).cast("bigint").alias("n"))


@query(
    "substring_offsets",
    """SELECT doc_id, array_to_string(list_transform(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 3) = 'ene'), lambda i: i - 1), ',')
    AS offsets FROM (SELECT doc_id, lower(text) AS t FROM documents) AS d""",
)
def substring_offsets(spark, folder):
    offsets = tx.occurrence_offsets(F.lower("text"), F.lit("ene"))
    return table(spark, folder, "documents").select("doc_id", F.array_join(offsets.cast("array<string>"), ",").alias("offsets"))


def best_sql(texts: str, key: str, text: str, patterns: str) -> str:
    """Best dictionary name per text by comparing every pair."""
    return f"""SELECT {key}, first(pattern ORDER BY share DESC, ord) AS best_pattern, max(share) AS match_score FROM (
      SELECT {key}, pattern, ord, length(pattern) * {q.occurrences('lt', 'ln')} / length(lt) AS share
      FROM (SELECT {key}, lower({text}) AS lt FROM {texts}) AS a,
        (SELECT name AS pattern, lower(name) AS ln, ord FROM {patterns}) AS b
      WHERE lt <> '' AND contains(lt, ln)) AS c GROUP BY {key}"""


BENCH_PATTERNS = "(SELECT text AS name, item_id AS ord FROM benchmark) AS bp"


@query("best_match", f"SELECT doc_id, best_pattern, round(match_score, 6) AS match_score FROM ({best_sql('documents', 'doc_id', 'text', BENCH_PATTERNS)}) AS r")
def best_match(spark, folder):
    patterns = table(spark, folder, "benchmark").select(F.col("text").alias("name"), F.col("item_id").alias("ord"))
    found = match.best_match(table(spark, folder, "documents"), "doc_id", "text", patterns)
    return found.select("doc_id", "best_pattern", F.round("match_score", 6).alias("match_score"))


@query(
    "best_match_names",
    f"""SELECT p_partkey, best_pattern, round(match_score, 6) AS match_score FROM (
    {best_sql(f'({ALL_TEXT}) AS alltext', 'p_partkey', 't', f'({CPU_TABLE}) AS ct')}) AS r""",
)
def best_match_names(spark, folder):
    texts = load(spark, folder, PRODUCTS).select("p_partkey", tx.combine_text(*[F.col(c) for c in TEXTS]).alias("t"))
    found = match.best_match(texts, "p_partkey", "t", cpu_scores(spark, folder))
    return found.select("p_partkey", "best_pattern", F.round("match_score", 6).alias("match_score"))


def lookup_sql(name: str, scores: str, default: int, column: str) -> str:
    best = best_sql("open_names", "name", "name", "sc")
    return f"""WITH n AS (SELECT p_partkey, {name} AS name FROM ({SPEC}) AS p),
    sc AS ({scores}),
    open_names AS (SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT name FROM sc)),
    fz AS (SELECT f.name, sc.score FROM ({best}) AS f JOIN sc ON f.best_pattern = sc.name WHERE match_score > 0.1)
    SELECT n.p_partkey, n.name, coalesce(sc.score, fz.score, {default}) AS score,
    CASE WHEN sc.score IS NOT NULL THEN 'exact' WHEN fz.score IS NOT NULL THEN 'fuzzy' ELSE 'default' END AS source
    FROM n LEFT JOIN sc ON n.name = sc.name LEFT JOIN fz ON n.name = fz.name"""


@query("score_lookup", lookup_sql(q.cpu_name("chip"), CPU_TABLE, 3000, "chip"))
def score_lookup(spark, folder):
    return match.score_lookup(load(spark, folder, PRODUCTS), "p_partkey", "chip", cpu_scores(spark, folder))


@query("score_lookup_gpu", lookup_sql(q.gpu_name("video"), GPU_TABLE, 500, "video"))
def score_lookup_gpu(spark, folder):
    return match.score_lookup(load(spark, folder, PRODUCTS), "p_partkey", "video", gpu_scores(spark, folder), kind="gpu")


ANSWER_TEXT = r"regexp_replace(html, '<[^>]+>', '', 'g')"
ANSWER_SCORE = "CAST(" + q.first_match(
    ANSWER_TEXT, [r"(?i)PassMark CPU Mark: (\d+)", r"(?i)CPU Mark: (\d+)", r"(?i)Benchmark: (\d+)", r"(?i)Score: (\d+)"]
) + " AS BIGINT)"


@query(
    "score_lookup_paged",
    f"""WITH a AS (SELECT page_id, {q.cpu_name('name')} AS name, {ANSWER_SCORE} AS paged FROM ({plain(ANSWER_PAGES)}) AS p)
    SELECT page_id, name, coalesce(paged, 3000) AS score, CASE WHEN paged IS NULL THEN 'default' ELSE 'page' END AS source FROM a""",
)
def score_lookup_paged(spark, folder):
    answers = load(spark, folder, ANSWER_PAGES)
    paged = pg.scores_from_texts(answers, "name", "html")
    return match.score_lookup(answers, "page_id", "name", cpu_scores(spark, folder), paged=paged)


def text_score_sql(rules: match.TextRules, scores: str) -> str:
    """Score from free text: all candidates of all rules, joined to the scores in order."""
    parts = []
    for number, (pattern, family, model) in enumerate(rules.rules):
        head, *tail = model.split("{}")
        if len(tail) == 1:
            group = "trim(m)" if rules.strip else "m"
            name = f"CASE WHEN m <> '' THEN '{head}' || {group} END"
            listed = f"list_transform(regexp_extract_all(t, '{pattern}', 1), lambda m: {name})"
        else:
            listed = (
                f"list_transform(list_zip(regexp_extract_all(t, '{pattern}', 1), regexp_extract_all(t, '{pattern}', 2)), "
                f"lambda m: '{head}' || m[1] || '{tail[0]}' || m[2])"
            )
        parts.append(
            f"SELECT p_partkey, {number} AS rule_no, '{family}' AS family, unnest({listed}) AS model, "
            f"unnest(range(len({listed}))) AS match_no FROM base"
        )
    words = " ".join(f"WHEN contains(t, '{word}') THEN '{family}'" for family, ws in rules.keywords for word in ws)
    return f"""WITH base AS ({ALL_TEXT}), sc AS ({scores}),
    cand AS ({' UNION ALL '.join(parts)}),
    keyed AS (SELECT p_partkey, rule_no, match_no, 0 AS k, model AS name, 'exact' AS kind FROM cand WHERE model IS NOT NULL
      UNION ALL SELECT p_partkey, rule_no, match_no, 1, family, 'family' FROM cand),
    hit AS (SELECT keyed.*, sc.score FROM keyed JOIN sc ON keyed.name = sc.name
      QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rule_no, match_no, k) = 1),
    tried AS (SELECT p_partkey, count(DISTINCT model) AS tried FROM cand WHERE model IS NOT NULL GROUP BY p_partkey),
    rest AS (SELECT * FROM base WHERE p_partkey NOT IN (SELECT p_partkey FROM hit)),
    fz AS (SELECT f.p_partkey, f.best_pattern, sc.score FROM ({best_sql('rest', 'p_partkey', 't', 'sc')}) AS f
      JOIN sc ON f.best_pattern = sc.name WHERE match_score > 0.1),
    kw AS (SELECT p_partkey, CASE {words} END AS keyword FROM base)
    SELECT base.p_partkey, coalesce(hit.score, fz.score, ks.score, {rules.default}) AS score,
    coalesce(hit.name, fz.best_pattern, kw.keyword, 'unknown') AS matched_name,
    CASE WHEN hit.score IS NOT NULL THEN hit.kind WHEN fz.score IS NOT NULL THEN 'fuzzy'
      WHEN kw.keyword IS NOT NULL THEN 'keyword_fallback' ELSE 'default' END AS match_type,
    coalesce(tried.tried, 0) AS tried
    FROM base LEFT JOIN hit USING (p_partkey) LEFT JOIN fz USING (p_partkey) LEFT JOIN kw USING (p_partkey)
    LEFT JOIN sc AS ks ON kw.keyword = ks.name LEFT JOIN tried USING (p_partkey)"""


CPU_TEXT_SQL = text_score_sql(match.CPU, CPU_TABLE)
GPU_TEXT_SQL = text_score_sql(match.GPU, GPU_TABLE)


def _all_text(spark, folder):
    products = load(spark, folder, PRODUCTS)
    return products.select("p_partkey", tx.searchable(tx.combine_text(*[F.col(c) for c in TEXTS])).alias("t"))


@query("cpu_score_text", f"SELECT p_partkey, score FROM ({CPU_TEXT_SQL}) AS r")
def cpu_score_text(spark, folder):
    return match.score_from_text(_all_text(spark, folder), "p_partkey", "t", cpu_scores(spark, folder), match.CPU).select("p_partkey", "score")


@query("gpu_score_text", f"SELECT p_partkey, score FROM ({GPU_TEXT_SQL}) AS r")
def gpu_score_text(spark, folder):
    return match.score_from_text(_all_text(spark, folder), "p_partkey", "t", gpu_scores(spark, folder), match.GPU).select("p_partkey", "score")


@query("match_provenance", CPU_TEXT_SQL)
def match_provenance(spark, folder):
    return match.score_from_text(_all_text(spark, folder), "p_partkey", "t", cpu_scores(spark, folder), match.CPU)


@query("match_provenance_gpu", GPU_TEXT_SQL)
def match_provenance_gpu(spark, folder):
    return match.score_from_text(_all_text(spark, folder), "p_partkey", "t", gpu_scores(spark, folder), match.GPU)


@query(
    "match_trace",
    f"""SELECT p_partkey, string_agg(model, '; ' ORDER BY rule_no, match_no) AS models FROM (
      {CPU_TEXT_SQL[:CPU_TEXT_SQL.index('keyed AS')].rstrip().rstrip(',')} SELECT * FROM cand) AS c WHERE model IS NOT NULL GROUP BY p_partkey""",
)
def match_trace(spark, folder):
    tried = match.tried_models(_all_text(spark, folder), "p_partkey", "t", match.CPU)
    listed = F.array_sort(F.collect_list(F.struct("pos", "model_name")))
    return tried.groupBy("p_partkey").agg(F.array_join(F.transform(listed, lambda x: x["model_name"]), "; ").alias("models"))


TIER = """CASE WHEN total_benchmark_score >= 20000 THEN 'Ultra High' WHEN total_benchmark_score >= 15000 THEN 'High'
  WHEN total_benchmark_score >= 10000 THEN 'Medium-High' WHEN total_benchmark_score >= 7000 THEN 'Medium'
  WHEN total_benchmark_score >= 4000 THEN 'Low-Medium' ELSE 'Low' END"""
GAMING = """CASE WHEN g.score >= 8000 AND c.score >= 12000 THEN 'High-End Gaming' WHEN g.score >= 5000 AND c.score >= 8000 THEN 'Mid-Range Gaming'
  WHEN g.score >= 3000 AND c.score >= 6000 THEN 'Casual Gaming' WHEN g.score >= 1500 THEN 'Light Gaming' ELSE 'No Gaming' END"""
SCORED = f"""SELECT *, {TIER} AS performance_tier FROM (
  SELECT c.p_partkey, c.score AS cpu_benchmark_score, g.score AS gpu_benchmark_score,
  round_even(c.score * 0.7 + g.score * 0.3, 0) AS total_benchmark_score, {GAMING} AS gaming_capability
  FROM ({CPU_TEXT_SQL}) AS c JOIN ({GPU_TEXT_SQL}) AS g ON c.p_partkey = g.p_partkey) AS s"""
SCORE_COLUMNS = "p_partkey, cpu_benchmark_score, gpu_benchmark_score, total_benchmark_score, performance_tier, gaming_capability"


def scored_products(spark, folder):
    products = load(spark, folder, PRODUCTS)
    return pipelines.score_pipeline(products, "p_partkey", cpu_scores(spark, folder), gpu_scores(spark, folder), TEXTS)


@query("score_stage", f"SELECT {SCORE_COLUMNS} FROM ({SCORED}) AS x")
def score_stage(spark, folder):
    return scored_products(spark, folder).select(*SCORE_COLUMNS.split(", "))


@query(
    "score_stats",
    f"WITH x AS MATERIALIZED ({SCORED}) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count({c}) AS found, count(*) AS total, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(median({c}) AS DOUBLE) AS median FROM x"""
        for c in ("cpu_benchmark_score", "gpu_benchmark_score", "total_benchmark_score")
    ),
)
def score_stats(spark, folder):
    stats = describe.score_summary(staged(scored_products(spark, folder), "scored"))
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "score_distributions",
    f"WITH x AS MATERIALIZED ({SCORED}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM x GROUP BY {c}" for c in ("performance_tier", "gaming_capability")),
)
def score_distributions(spark, folder):
    return describe.distributions(scored_products(spark, folder), {"performance_tier": None, "gaming_capability": None})


@query("tier_counts", f"SELECT performance_tier AS value, count(*) AS n FROM ({SCORED}) AS x GROUP BY 1")
def tier_counts(spark, folder):
    return describe.value_distribution(scored_products(spark, folder), "performance_tier")
