"""Text, price and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Whitespace and word classes follow Unicode, as in Python's `re`.
SPACE_CLASS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
TAG_PATTERN = r"<[^>]++>"
# Plain letters and digits are told by one table lookup, before the Unicode classes are asked.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
SPACES_PATTERN = rf"[[^{PLAIN}.,!?*-]&&{SPACE_CLASS}]+"
# For text whose white space is single blanks by then.
JUNK_PATTERN = rf"[[^{PLAIN} .,!?-]&&[^\p{{L}}\p{{N}}]]"
PRICE_JUNK_PATTERN = r"[^\d.,]"
UNICODE_SPACES = (
    "\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CPU_NOISE = ["processor", "cpu", "apu", "dual", "quad"]
CPU_CLOCK_PATTERN = r"@\s*\d+\.?\d*ghz"
GPU_NOISE = ["graphics", "card", "gpu"]
UNKNOWN_NAME = "Unknown"
FEATURE_SEPARATOR = " | "
# -----------------------------------------------------------------------------


def to_number(col: Column) -> Column:
    """Numeric coercion: unreadable text and NaN become NULL."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_price(col: Column) -> Column:
    """Messy price text to double; sign and currency marks are dropped."""
    digits = F.regexp_replace(col.cast("string"), PRICE_JUNK_PATTERN, "")
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def clean_text(col: Column) -> Column:
    """Drop tags, collapse whitespace, keep word characters and `.,!?-`."""
    text = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), TAG_PATTERN, "")
    text = F.regexp_replace(text, SPACES_PATTERN, " ")
    return F.trim(F.regexp_replace(text, JUNK_PATTERN, ""))


def default_category(col: Column, missing: str = "Missing", default: str = UNKNOWN_NAME) -> Column:
    """NULL and the literal marker become the default category."""
    return F.when(col.isNull() | (col == missing), F.lit(default)).otherwise(col)


def join_features(col: Column, separator: str = FEATURE_SEPARATOR) -> Column:
    """Array of strings to one string; empty items are skipped."""
    items = F.filter(col, lambda item: item.isNotNull() & (item != ""))
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def parse_details(col: Column) -> Column:
    """JSON text to map; unreadable text is kept under `raw_details`."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    parsed = F.from_json(col, "map<string,string>")
    raw = F.create_map(F.lit("raw_details"), col)
    return F.when(col.isNull() | (col == "nan"), empty).otherwise(F.coalesce(parsed, raw))


def combine_text(*cols: Column) -> Column:
    """All present texts in order, space separated."""
    return F.concat_ws(" ", *cols)


def searchable(col: Column) -> Column:
    """Lower-cased text whose exotic blanks are plain blanks, for the spec patterns."""
    return F.translate(F.lower(col), UNICODE_SPACES, " " * len(UNICODE_SPACES))


def title_case(col: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the others.

    A fold over the characters, so that the text is evaluated once.
    """
    start = F.struct(F.lit("").alias("done"), F.lit(False).alias("inside"))

    def step(state: Column, char: Column) -> Column:
        shown = F.when(state["inside"], F.lower(char)).otherwise(F.upper(char))
        return F.struct(F.concat(state["done"], shown).alias("done"), char.rlike(r"^\p{L}$").alias("inside"))

    return F.aggregate(F.split(col, ""), start, step, lambda state: state["done"])


def _collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE_CLASS + "+", " "))


def normalize_cpu_name(col: Column) -> Column:
    """Processor name in the form the score tables use as key."""
    name = _collapse(F.lower(col))
    for word in CPU_NOISE:
        name = F.replace(name, F.lit(word), F.lit(""))
    name = _collapse(F.regexp_replace(name, CPU_CLOCK_PATTERN, ""))
    return F.when(col.isNull() | (col == UNKNOWN_NAME), F.lit(UNKNOWN_NAME)).otherwise(name)


def normalize_gpu_name(col: Column) -> Column:
    """Graphics name in the form the score tables use as key."""
    name = _collapse(F.lower(col))
    for word in GPU_NOISE:
        name = F.replace(name, F.lit(word), F.lit(""))
    unknown = col.isNull() | col.isin(UNKNOWN_NAME, "0")
    return F.when(unknown, F.lit(UNKNOWN_NAME)).otherwise(_collapse(name))


def quoted(pattern: Column) -> Column:
    """A literal as regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def count_occurrences(text: Column, pattern: Column) -> Column:
    """Overlapping occurrences of a literal pattern."""
    ahead = F.concat(F.lit("(?="), quoted(pattern), F.lit(")"))
    return F.when(F.length(pattern) > 0, F.regexp_count(text, ahead)).otherwise(0)


def occurrence_offsets(text: Column, pattern: Column) -> Column:
    """0-based start offsets of all, also overlapping, occurrences, in one pass.

    Every position yields one item: the pattern where it starts, else nothing.
    """
    each = F.concat(F.lit("(?s)(?=("), quoted(pattern), F.lit("))|."))
    marks = F.regexp_extract_all(text, each, F.lit(1))
    at = F.transform(marks, lambda mark, i: F.when(mark != "", i))
    found = F.filter(at, lambda i: i.isNotNull())
    return F.when(F.length(pattern) > 0, found).otherwise(F.array().cast("array<int>"))


def grams(text: Column, width: int) -> Column:
    """All overlapping character n-grams, in text order, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def tokens(col: Column, pattern: str = r"[\p{L}\p{N}_]{2,}") -> Column:
    """Lower-cased words of two or more characters, in text order."""
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))
