"""Bins, categories, ratios and scores as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
EXCHANGE_RATE = 4.75
PRICE_LABELS = ["Budget", "Mid-range", "High-end", "Premium"]
LOCAL_PRICE_EDGES = [0, 2375, 4750, 9500, None]
USD_PRICE_EDGES = [0, 500, 1000, 2000, None]
RATING_LABELS = ["Poor", "Fair", "Good", "Excellent"]
RATING_EDGES = [0, 2, 3, 4, 5]
LENGTH_LABELS = ["Short", "Medium", "Long", "Very Long"]
LENGTH_EDGES = [0, 100, 500, 1000, None]
STORAGE_STEPS = [
    (256, "Small (<256GB)"),
    (512, "Medium (256-512GB)"),
    (1000, "Large (512GB-1TB)"),
    (None, "Very Large (>1TB)"),
]
RAM_STEPS = [
    (8, "Low (<8GB)"),
    (16, "Medium (8-16GB)"),
    (32, "High (16-32GB)"),
    (None, "Very High (>32GB)"),
]
SCREEN_STEPS = [
    (13, 'Small (<13")'),
    (15, 'Medium (13-15")'),
    (17, 'Large (15-17")'),
    (None, 'Very Large (>17")'),
]
CPU_WEIGHT = 0.7
GPU_WEIGHT = 0.3
TIERS = [
    (20000, "Ultra High"),
    (15000, "High"),
    (10000, "Medium-High"),
    (7000, "Medium"),
    (4000, "Low-Medium"),
]
LOWEST_TIER = "Low"
GAMING_RULES = [
    (8000, 12000, "High-End Gaming"),
    (5000, 8000, "Mid-Range Gaming"),
    (3000, 6000, "Casual Gaming"),
    (1500, None, "Light Gaming"),
]
NO_GAMING = "No Gaming"
# -----------------------------------------------------------------------------


def cut(col: Column, edges: Sequence[float | None], labels: Sequence[str], closed_low: bool = True) -> Column:
    """Right-closed intervals; the lowest edge belongs to the first bin if ``closed_low``.

    A last edge of ``None`` leaves the last bin open; values outside are NULL.
    """
    low = col >= edges[0] if closed_low else col > edges[0]
    result = F.when(col.isNull() | ~low | F.isnan(col.cast("double")), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        result = result.when(F.lit(True) if edge is None else col <= edge, F.lit(label))
    return result


def steps(col: Column, rules: Sequence[tuple[float | None, str]], missing: str = "Unknown") -> Column:
    """Left-closed steps: the first rule whose limit exceeds the value."""
    result = F.when(col.isNull(), F.lit(missing))
    for limit, label in rules:
        result = result.when(F.lit(True) if limit is None else col < limit, F.lit(label))
    return result


def to_local_price(usd: Column, rate: float = EXCHANGE_RATE) -> Column:
    return usd * F.lit(rate)


def price_bin_local(col: Column) -> Column:
    return cut(col, LOCAL_PRICE_EDGES, PRICE_LABELS)


def price_bin_usd(col: Column) -> Column:
    return cut(col, USD_PRICE_EDGES, PRICE_LABELS)


def rating_bin(col: Column) -> Column:
    return cut(col, RATING_EDGES, RATING_LABELS)


def length_bin(col: Column) -> Column:
    """Length 0 falls outside the first bin."""
    return cut(col, LENGTH_EDGES, LENGTH_LABELS, closed_low=False)


def storage_category(col: Column) -> Column:
    return steps(col, STORAGE_STEPS)


def ram_category(col: Column) -> Column:
    return steps(col, RAM_STEPS)


def screen_category(col: Column) -> Column:
    return steps(col, SCREEN_STEPS)


def storage_display(gb: Column) -> Column:
    """`1.5TB` from 1024 GB on, else `512GB`; ties round to even."""
    tera = F.format_string("%.1fTB", F.bround(gb / 1024, 1).cast("double"))
    giga = F.format_string("%.0fGB", F.bround(gb, 0).cast("double"))
    return F.when(gb >= 1024, tera).when(gb.isNotNull(), giga)


def helpfulness_ratio(votes: Column, reviews: Column) -> Column:
    """Votes per review; zero reviews count as one, missing gives 0."""
    return F.coalesce(votes / F.when(reviews == 0, 1).otherwise(reviews), F.lit(0.0))


def to_moment(col: Column, unit: str | None = None) -> Column:
    """Text, or an epoch in ``unit`` (s, ms, us, ns), as timestamp; unreadable values are NULL."""
    if unit is None:
        return F.try_to_timestamp(col.cast("string"))
    epoch = col.try_cast("bigint")
    micros = {"s": epoch * 1_000_000, "ms": epoch * 1_000, "us": epoch, "ns": F.floor(epoch / 1_000)}[unit]
    return F.timestamp_micros(micros.cast("bigint"))


def date_parts(moment: Column) -> dict[str, Column]:
    """`year`, `month` and `day_of_week` (Monday = 0) of a timestamp."""
    return {"year": F.year(moment), "month": F.month(moment), "day_of_week": F.weekday(moment)}


def total_score(cpu: Column, gpu: Column) -> Column:
    """Weighted score, rounded half to even."""
    return F.bround(cpu * CPU_WEIGHT + gpu * GPU_WEIGHT, 0)


def performance_tier(score: Column) -> Column:
    result = F
    for limit, label in TIERS:
        result = result.when(score >= limit, F.lit(label))
    return result.otherwise(F.lit(LOWEST_TIER))


def gaming_capability(cpu: Column, gpu: Column) -> Column:
    result = F
    for gpu_min, cpu_min, label in GAMING_RULES:
        hit = gpu >= gpu_min
        result = result.when(hit if cpu_min is None else hit & (cpu >= cpu_min), F.lit(label))
    return result.otherwise(F.lit(NO_GAMING))
