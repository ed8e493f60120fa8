"""Table-wide statistics: exact quantiles, scalar attachment, histograms.

A statistic is a one-row DataFrame. `as_scalar` turns it into a scalar
subquery, so it runs once and reaches the executors as a value; no row is
joined to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.session import staged

DEFAULT_ACCURACY = 10_000
#: A bracket of a quantile with no more rows than this is read whole.
KEPT_ROWS = 10_000


def as_scalar(one_row: DataFrame) -> Column:
    """The single row as a struct-valued scalar subquery."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def number(column: str | Column) -> Column:
    """A column as double with NaN as missing, for every statistic."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value), value)


def missing(df: DataFrame, name: str) -> Column:
    """Whether a cell is missing: NULL, or NaN in a floating-point column."""
    absent = F.col(name).isNull()
    return absent | F.isnan(name) if dict(df.dtypes)[name] in ("double", "float") else absent


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per non-missing value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))


@dataclass
class _Search:
    """A wanted rank of a column: it lies strictly between two values, of which ``below`` rows are at most the lower one."""

    column: int
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    found: float | None = None

    def holds(self, value: Column) -> Column:
        between = value.isNotNull()
        between = between if self.low is None else between & (value > F.lit(self.low))
        return between if self.high is None else between & (value < F.lit(self.high))


def _values(wanted: Sequence[_Search], values: DataFrame, keep: int) -> None:
    """Ranks from the different values of what their brackets hold: at most ``keep`` rows each come to the driver."""
    brackets = list({(s.column, s.low, s.high): s for s in wanted}.values())
    if not brackets:
        return
    held = F.array(*[F.struct(F.lit(k).alias("k"), F.when(s.holds(F.col(f"v{s.column}")), F.col(f"v{s.column}")).alias("v")) for k, s in enumerate(brackets)])
    rows = values.select(F.inline(held)).where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count("*").alias("n")).collect()
    lists: dict[int, list[tuple[float, int]]] = {}
    for r in rows:
        lists.setdefault(r.k, []).append((r.v, r.n))
    place = {(s.column, s.low, s.high): k for k, s in enumerate(brackets)}
    for s in wanted:
        upto = s.below
        for value, n in sorted(lists[place[s.column, s.low, s.high]]):
            upto += n
            if upto > s.rank:
                s.found = value
                break


def _narrow(wanted: Sequence[_Search], values: DataFrame, accuracy: int) -> None:
    """Each bracket cut to the part that holds the rank, by a sketch of it and a count around what the sketch names."""
    slack = 3.0 / accuracy
    near = [(s.rank - s.below + 0.5) / s.inside for s in wanted]
    guess = values.agg(
        *[
            F.percentile_approx(F.when(s.holds(F.col(f"v{s.column}")), F.col(f"v{s.column}")), [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias(f"e{k}")
            for k, (s, q) in enumerate(zip(wanted, near))
        ]
    ).first()
    counts = []
    for k, s in enumerate(wanted):
        v, (a, b) = F.col(f"v{s.column}"), guess[f"e{k}"]
        parts = (v < a, v == a, (v > a) & (v < b), (v == b) & (v != a))
        counts += [F.count_if(s.holds(v) & p).alias(f"c{k}_{i}") for i, p in enumerate(parts)]
    told = values.agg(*counts).first()
    for k, s in enumerate(wanted):
        (a, b), n = guess[f"e{k}"], [told[f"c{k}_{i}"] for i in range(4)]
        after = [s.below + sum(n[: i + 1]) for i in range(4)]
        if s.rank < after[0]:  # the sketch was too high: what is below it is looked at next
            s.high, s.inside = a, n[0]
        elif s.rank < after[1]:
            s.found = a
        elif s.rank < after[2]:
            s.low, s.high, s.below, s.inside = a, b, after[1], n[2]
        elif s.rank < after[3]:
            s.found = b
        else:
            s.low, s.below, s.inside = b, after[3], s.below + s.inside - after[3]


def column_quantiles(
    df: DataFrame, columns: Sequence[str], fractions: Sequence[float], accuracy: int = DEFAULT_ACCURACY, keep: int = KEPT_ROWS
) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns, as rows ``(name, q, n, value)``.

    The columns are written once, as numbers. Every wanted rank has a bracket, at first the whole column. As long as
    a bracket holds more than ``keep`` rows a sketch names two values around the rank, and a count of the rows below, at and
    between them cuts the bracket to a share of about ``6 / accuracy``, or finds the rank on a value that many
    rows hold. What a task or the driver holds is a sketch, some counts and at most ``keep`` values, whatever the size and
    the skew of the column; a sketch that misses costs one more round. A column without values has no rows.
    """
    values = staged(df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(columns)]), "quantiles")
    totals = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    ranks = {(i, q): q * (totals[f"n{i}"] - 1) for i in range(len(columns)) for q in fractions if totals[f"n{i}"]}
    needed = sorted({(i, end(rank)) for (i, _), rank in ranks.items() for end in (math.floor, math.ceil)})
    search = {(i, rank): _Search(i, rank, inside=totals[f"n{i}"]) for i, rank in needed}
    while open_ := [s for s in search.values() if s.found is None and s.inside > keep]:
        _narrow(open_, values, accuracy)
    _values([s for s in search.values() if s.found is None], values, keep)
    rows = []
    for (i, q), rank in ranks.items():
        lower, upper = search[i, math.floor(rank)].found, search[i, math.ceil(rank)].found
        rows.append((columns[i], float(q), totals[f"n{i}"], lower if lower == upper else lower + (upper - lower) * (rank - math.floor(rank))))
    return df.sparkSession.createDataFrame(rows, "name string, q double, n long, value double")


def exact_quantiles(
    df: DataFrame, column: str, fractions: Sequence[float], accuracy: int = DEFAULT_ACCURACY
) -> DataFrame:
    """Exact quantiles of one column as rows ``(q, value)``."""
    return column_quantiles(df, [column], fractions, accuracy).select("q", "value")


def quantile_row(
    df: DataFrame, column: str, names: dict[str, float], accuracy: int = DEFAULT_ACCURACY
) -> DataFrame:
    """Exact quantiles as one row, one column per name."""
    rows = exact_quantiles(df, column, sorted(set(names.values())), accuracy)
    return rows.agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for n, q in names.items()])


def exact_medians(df: DataFrame, columns: Sequence[str], accuracy: int = DEFAULT_ACCURACY) -> dict[str, Column]:
    """Medians of several columns as scalars, from one pair of passes."""
    rows = column_quantiles(df, columns, [0.5], accuracy)
    at = as_scalar(rows.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns]))
    return {c: at[c] for c in columns}


def summary_rows(
    df: DataFrame,
    columns: dict[str, str],
    quantiles: dict[str, float] | None = None,
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """Per label: found, total, min, max, mean, std (n-1) and exact quantiles.

    All columns share one aggregation pass and one pair of quantile passes.
    """
    quantiles = {"median": 0.5} if quantiles is None else quantiles

    def entry(label: str, column: str) -> Column:
        value = number(column)
        return F.struct(
            F.lit(label).alias("name"),
            F.count(value).alias("found"),
            F.count("*").alias("total"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
        )

    entries = F.array(*[entry(label, column) for label, column in columns.items()])
    base = df.agg(entries.alias("entries")).select(F.inline("entries"))
    if not quantiles:
        return base
    rows = column_quantiles(df.select(*[F.col(c).alias(label) for label, c in columns.items()]), list(columns), sorted(set(quantiles.values())), accuracy)
    wide = rows.groupBy("name").agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for n, q in quantiles.items()])
    return base.join(wide, "name", "left")


def summary_row(
    df: DataFrame,
    column: str,
    quantiles: dict[str, float] | None = None,
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """`summary_rows` of one column, without the label."""
    return summary_rows(df, {column: column}, quantiles, accuracy).drop("name")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width histogram with a closed last bin: ``(bin, bin_lo, bin_hi, n)``.

    Empty bins are kept, missing values are not counted. A constant column spans
    half a unit on both sides.
    """
    value = number(column)
    raw = as_scalar(df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    constant = raw["lo"] == raw["hi"]
    lo = F.when(constant, raw["lo"] - 0.5).otherwise(raw["lo"])
    hi = F.when(constant, raw["hi"] + 0.5).otherwise(raw["hi"])
    counted = (
        df.where(value.isNotNull())
        .select(F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return frame.join(counted, "bin", "left").select(
        "bin",
        (lo + width * F.col("bin")).alias("bin_lo"),
        (lo + width * (F.col("bin") + 1)).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
