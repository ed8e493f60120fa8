"""Specification extraction from lower-cased free text and from detail maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.functions.text import title_case

# ---- fixed values -----------------------------------------------------------
NUMBER = r"(\d+(?:\.\d+)?)"
RAM_PATTERNS = [
    NUMBER + r"\s*gb\s*(?:ddr\d*|ram|memory)",
    NUMBER + r"\s*gb",
    NUMBER + r"\s*tb\s*(?:ddr\d*|ram|memory)",
    NUMBER + r"\s*tb",
]
STORAGE_TB_PATTERN = NUMBER + r"\s*tb\s*(?:ssd|hdd|hard\s*drive|storage|flash\s*storage|nvme|pcie)"
STORAGE_GB_PATTERN = NUMBER + r"\s*gb\s*(?:ssd|hdd|hard\s*drive|storage|flash\s*storage|nvme|pcie)"
PLAIN_TB_PATTERN = NUMBER + r"\s*tb"
PLAIN_GB_PATTERN = NUMBER + r"\s*gb"
RAM_WORDS = ["ram", "memory", "ddr", "lpddr"]
SCREEN_PATTERNS = [NUMBER + r"\s*inch", NUMBER + r'\s*"', NUMBER + r"\s*in"]
# Label, then the alternatives of words that must all occur.
STORAGE_TYPES = [
    ("NVMe SSD", [["ssd", "nvme"]]),
    ("PCIe SSD", [["ssd", "pcie"]]),
    ("SSD", [["ssd"]]),
    ("HDD", [["hdd"], ["hard drive"], ["hard disk"]]),
    ("Hybrid", [["hybrid"], ["sshdd"]]),
    ("eMMC", [["emmc"]]),
    ("Flash Storage", [["flash"]]),
]
RAM_TYPES = ["ddr5", "ddr4", "ddr3"]
LOW_POWER_RAM_TYPES = ["lpddr5", "lpddr4", "lpddr3"]
CPU_MODEL_PATTERNS = [
    r"(intel\s+core\s+i[3579]-\d+[a-z]*\d*)",
    r"(amd\s+ryzen\s+[3579]\s+\d+[a-z]*\d*)",
    r"(intel\s+celeron\s+[a-z]*\d*)",
    r"(intel\s+pentium\s+[a-z]*\d*)",
    r"(amd\s+athlon\s+\d+[a-z]*)",
    r"(apple\s+m\d+\s*[a-z]*)",
]
GPU_MODEL_PATTERNS = [
    r"(intel\s+uhd\s+graphics\s*\d*)",
    r"(intel\s+iris\s+xe\s+graphics\s*[a-z0-9]*)",
    r"(amd\s+radeon\s+vega\s*\d+)",
    r"(amd\s+radeon\s+graphics)",
    r"(nvidia\s+geforce\s+gtx\s*\d{4}[a-z]*)",
    r"(nvidia\s+geforce\s+rtx\s*\d{4}[a-z]*)",
    r"(nvidia\s+quadro\s*[a-z0-9]+)",
    r"(amd\s+radeon\s+rx\s*\d{4}[a-z]*)",
    r"(amd\s+radeon\s+pro\s*\d{4}[a-z]*)",
]
STORAGE_KEYS = ["hard drive", "ssd", "storage", "flash memory"]
STORAGE_VALUE_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*(?:GB|TB)"
# -----------------------------------------------------------------------------


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Leftmost match of the first pattern that occurs anywhere."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def ram_gb(text: Column) -> Column:
    value = first_match(text, RAM_PATTERNS).cast("double")
    in_tera = text.contains("tb") & ~text.contains("gb")
    return F.when(in_tera, value * 1024).otherwise(value)


def storage_gb(text: Column) -> Column:
    def amount(pattern: str) -> Column:
        return first_match(text, [pattern]).cast("double")

    plain = F.when(
        ~_contains_any(text, RAM_WORDS),
        F.coalesce(amount(PLAIN_TB_PATTERN) * 1024, amount(PLAIN_GB_PATTERN)),
    )
    return F.coalesce(amount(STORAGE_TB_PATTERN) * 1024, amount(STORAGE_GB_PATTERN), plain)


def screen_inches(text: Column) -> Column:
    return first_match(text, SCREEN_PATTERNS).cast("double")


def storage_type(text: Column) -> Column:
    """Label of the first kind that the text names."""

    def named(alternatives: Sequence[Sequence[str]]) -> Column:
        return reduce(or_, (reduce(and_, (text.contains(word) for word in words)) for words in alternatives))

    return F.coalesce(*[F.when(named(alternatives), F.lit(label)) for label, alternatives in STORAGE_TYPES])


def ram_type(text: Column, strict: bool = False) -> Column:
    """Memory type; ``strict`` reports the low-power kinds separately."""
    kinds = (LOW_POWER_RAM_TYPES if strict else []) + RAM_TYPES
    return F.coalesce(*[F.when(text.contains(kind), F.lit(kind.upper())) for kind in kinds])


def cpu_model(text: Column, trim: bool = False) -> Column:
    """Processor model; the last family may end with a blank unless ``trim``."""
    model = title_case(first_match(text, CPU_MODEL_PATTERNS))
    return F.rtrim(model) if trim else model


def gpu_model(text: Column, trim: bool = False) -> Column:
    """Graphics model; families with optional numbers may end with a blank unless ``trim``."""
    model = title_case(first_match(text, GPU_MODEL_PATTERNS))
    return F.rtrim(model) if trim else model


def _first_value(details: Column, keep, value) -> Column:
    entries = F.filter(F.map_entries(details), lambda e: keep(F.lower(e["key"])) & (F.coalesce(e["value"], F.lit("")) != ""))
    values = F.filter(F.transform(entries, lambda e: value(e["value"])), lambda v: v.isNotNull())
    return F.get(values, F.lit(0))


def spec_from_map(details: Column, key: str, unit: str) -> Column:
    """First entry whose key contains ``key`` and whose value is a number with ``unit``."""
    pattern = rf"(?i)(\d+(?:\.\d+)?)\s*{unit}"
    return _first_value(
        details,
        lambda k: k.contains(key.lower()),
        lambda v: F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")).cast("double"),
    )


def storage_from_map(details: Column) -> Column:
    def value(text: Column) -> Column:
        number = F.nullif(F.regexp_extract(text, STORAGE_VALUE_PATTERN, 1), F.lit("")).cast("double")
        return F.when(F.upper(text).contains("TB"), number * 1024).otherwise(number)

    return _first_value(details, lambda k: _contains_any(k, STORAGE_KEYS), value)


def processor_from_map(details: Column) -> Column:
    return _first_value(details, lambda k: k.contains("processor"), lambda v: v)
