"""Scores from captured web pages held in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions import text as tx

# ---- fixed values -----------------------------------------------------------
TABLE_ID = "cputable"  # of both kinds of pages
TABLE_CLASS = "chart"
MIN_CELLS = 3
CPU_SCORE_PATTERNS = [
    r"PassMark CPU Mark: (\d+)",
    r"CPU Mark: (\d+)",
    r"Benchmark: (\d+)",
    r"Score: (\d+)",
]
GPU_SCORE_PATTERNS = [
    r"PassMark G3D Mark: (\d+)",
    r"G3D Mark: (\d+)",
    r"Benchmark: (\d+)",
    r"Score: (\d+)",
]
# -----------------------------------------------------------------------------


def _table(html: Column, attribute: str, value: str) -> Column:
    pattern = rf"""(?is)<table\b[^>]*\b{attribute}\s*=\s*["']?(?:[^"'>]*\s)?{value}(?:\s[^"'>]*)?["']?[^>]*>(.*?)</table>"""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _plain(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<[^>]+>", "")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return F.trim(text)


def scores_from_tables(pages: DataFrame, order: str, html: str = "html", kind: str = "cpu") -> DataFrame:
    """Score table ``(name, score, ord)`` from the score tables of all pages.

    The table is found by id, else by class; the header row and rows with fewer
    than three cells are skipped. Of a repeated name the last row counts.
    """
    source = F.col(html)
    body = F.coalesce(_table(source, "id", TABLE_ID), _table(source, "class", TABLE_CLASS))
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    lines = pages.select(order, F.posexplode(rows).alias("row", "line")).where(F.col("row") > 0)
    cells = F.regexp_extract_all("line", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    split = lines.select(order, "row", cells.alias("cells")).where(F.size("cells") >= MIN_CELLS)
    raw_name = _plain(F.get("cells", F.lit(0)))
    digits = F.regexp_replace(_plain(F.get("cells", F.lit(1))), r"[^\d]", "")
    normalize = tx.normalize_cpu_name if kind == "cpu" else tx.normalize_gpu_name
    named = split.select(
        normalize(raw_name).alias("name"),
        raw_name.alias("raw_name"),
        digits.try_cast("bigint").alias("score"),
        F.struct(order, "row").alias("at"),
    ).where((F.col("raw_name") != "") & F.col("score").isNotNull())
    last = named.groupBy("name").agg(F.max_by("score", "at").alias("score"), F.min("at").alias("at"))
    return last.select("name", "score", F.col(f"at.{order}").alias("page"), F.col("at.row").cast("bigint").alias("row"))


def score_in_text(text: Column, kind: str = "cpu") -> Column:
    """Score stated in a page text: first pattern that occurs."""
    patterns = CPU_SCORE_PATTERNS if kind == "cpu" else GPU_SCORE_PATTERNS
    found = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found).try_cast("bigint")


def scores_from_texts(
    pages: DataFrame, name: str, text: str, scores: DataFrame | None = None, kind: str = "cpu"
) -> DataFrame:
    """``(name, score)`` per page of a searched name; the score table fills the gaps."""
    normalize = tx.normalize_cpu_name if kind == "cpu" else tx.normalize_gpu_name
    found = pages.select(normalize(F.col(name)).alias("name"), score_in_text(_plain(F.col(text)), kind).alias("paged"))
    best = found.groupBy("name").agg(F.max("paged").alias("paged"))
    if scores is None:
        return best.select("name", F.col("paged").alias("score"))
    cached = scores.select("name", F.col("score").alias("cached"))
    return best.join(cached, "name", "left").select("name", F.coalesce("paged", "cached").alias("score"))
