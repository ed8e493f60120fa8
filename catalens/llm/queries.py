"""Queries of the dealt operators over their whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import (
    byte_bpe,
    cross_tokenizer,
    decontamination,
    fertility,
    language_model,
    license_scan,
    line_dedup,
    ngram_join,
    quality_classifier,
    sharding,
    source_divergence,
    substring_dedup,
    warc,
)
from catalens.llm.ship import ship
from catalens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, folder), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = """
lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}))),
shared AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id < s.keep AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key AND length(l.key) >= 20),
line_kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
"""
ORACLES["op4_line_dedup"] = f"""
WITH {LINE_DEDUP_SQL.format(docs="documents")}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM line_kept
"""


@_query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, folder).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded.select("doc_id", "n_tokens", "ids"), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op7_fertility(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder).select("doc_id", "lang", "text")
    paths = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return fertility.fertility_rules(docs, *paths).drop("text", "lang")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_classifier.Model:
    return quality_classifier.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@_query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder).select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_model(docs, _table(spark, folder, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


@_query
def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder).select("doc_id", "text")
    return license_scan.scan(docs, license_scan.train(docs))


@_query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_overlaps(_table(spark, folder), _table(spark, folder, "benchmark")).drop("text_hash")


@_query
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_documents(_table(spark, folder)).drop("text_hash")


@_query
def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.score(_table(spark, folder), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.source_divergence(_table(spark, folder))


ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
counted AS (SELECT lang, source, row, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM counted GROUP BY ALL HAVING count(*) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(t.term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept t USING (lang) GROUP BY lang),
held AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM counted JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(h.n), 0) + 2 * any_value(s.v) AS d FROM groups g JOIN sizes s USING (lang) LEFT JOIN held h USING (lang, source) GROUP BY g.lang, g.source),
lang_totals AS (SELECT s.lang, coalesce(sum(h.n), 0) + 2 * any_value(s.v) AS d FROM sizes s LEFT JOIN held h USING (lang) GROUP BY s.lang),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(h.n, 0) AS n, 1 + 1000000000 * (coalesce(h.n, 0) + 2) // t.d AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)),
lang_shares AS (
  SELECT k.lang, k.term, 1 + 1000000000 * (sum(h.n) + 2) // any_value(t.d) AS p FROM kept k JOIN held h USING (lang, term) JOIN lang_totals t USING (lang) GROUP BY k.lang, k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
terms AS (
  SELECT s.lang, s.source, s.term AS item, (s.p - l.p) * (s.p - l.p) // (s.p + l.p) AS value
  FROM shares s JOIN lang_shares l USING (lang, term) WHERE s.n > 0 AND s.p > l.p),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@_query
def op12_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return cross_tokenizer.align(_table(spark, folder), *paths)[0]


@_query
def op13_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), archives)
    captures = warc.read_archives(spark, archives).where("record_type IN ('response', 'revisit')")
    ordered = warc.capture_index(captures)
    columns = [warc.page_of(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).cast("long").alias("refers_to")]
    return ordered.select(*columns)


ORACLES["op13_warc_index"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, payload_bytes, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN head > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head > page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON h.payload_digest = p.payload_digest AND h.payload_bytes = p.payload_bytes
"""
