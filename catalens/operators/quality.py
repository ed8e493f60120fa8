"""Range validity, quarantine and missing-value profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.operators.stats import missing as absent

# ---- fixed values -----------------------------------------------------------
VALID_RAM = (1, 128)
VALID_STORAGE = (16, 8192)
ACTIONS = ("drop", "mark")
NOTE = "{label} %sGB outside valid range ({low}-{high}GB)"
VALID_FLAGS = ("ram_valid", "storage_valid")
INVALID_FLAGS = ("ram_invalid", "storage_invalid")
NOTES_COLUMN = "validation_notes"
DROPPED, KEPT_ALL = "dropped_invalid_records", "no_action_needed"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Range:
    """Valid values of one column; a missing value is valid."""

    column: str
    label: str
    low: float
    high: float

    def invalid(self) -> Column:
        value = F.col(self.column)
        return F.coalesce((value < self.low) | (value > self.high), F.lit(False))

    def note(self) -> Column:
        form = NOTE.format(label=self.label, low=self.low, high=self.high)
        text = F.format_string(form, F.col(self.column).cast("string"))
        return F.when(self.invalid(), text)


RAM = Range("ram_gb", "RAM", *VALID_RAM)
STORAGE = Range("storage_gb", "Storage", *VALID_STORAGE)


def drop_invalid(df: DataFrame, ram: Range = RAM, storage: Range = STORAGE) -> DataFrame:
    return df.where(~(ram.invalid() | storage.invalid()))


def mark_invalid(df: DataFrame, ram: Range = RAM, storage: Range = STORAGE) -> DataFrame:
    return df.withColumns({name: ~limits.invalid() for name, limits in zip(VALID_FLAGS, (ram, storage))})


def invalid_details(df: DataFrame, ram: Range = RAM, storage: Range = STORAGE) -> DataFrame:
    """The invalid rows with flags and notes."""
    flags = {name: limits.invalid() for name, limits in zip(INVALID_FLAGS, (ram, storage))}
    return df.where(ram.invalid() | storage.invalid()).withColumns(flags | {NOTES_COLUMN: F.concat_ws("; ", ram.note(), storage.note())})


def validity_summary(df: DataFrame, ram: Range = RAM, storage: Range = STORAGE) -> DataFrame:
    """One row of counts, in one pass over the input."""
    bad_ram, bad_storage = ram.invalid(), storage.invalid()
    counts = df.agg(
        F.count("*").alias("total_records_original"),
        F.count_if(bad_ram).alias("ram_invalid_count"),
        F.count_if(bad_storage).alias("storage_invalid_count"),
        F.count_if(bad_ram & bad_storage).alias("both_invalid_count"),
        F.count_if(bad_ram | bad_storage).alias("total_invalid_records"),
    )
    dropped = F.col("total_invalid_records")
    return counts.withColumns(
        {
            "records_dropped": dropped,
            "total_records_final": F.col("total_records_original") - dropped,
            "action_taken": F.when(dropped > 0, DROPPED).otherwise(KEPT_ALL),
        }
    )


def handle_invalid(df: DataFrame, action: str = "drop") -> DataFrame:
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}, expected one of {sorted(ACTIONS)}")
    return drop_invalid(df) if action == "drop" else mark_invalid(df)


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, type, rows, missing)`` per column, in one pass."""
    columns = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.count("*").alias("rows"),
            F.count_if(absent(df, name)).alias("missing"),
        )
        for position, (name, kind) in enumerate(df.dtypes)
    ]
    return df.agg(F.array(*columns).alias("profile")).select(F.inline("profile"))


def missing_share(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and their percentage, in one pass."""
    width = len(df.columns)
    cells = sum((absent(df, name).cast("bigint") for name in df.columns), F.lit(0).cast("bigint"))
    base = df.agg(F.count("*").alias("total_rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("missing_values"))
    share = F.try_divide(F.col("missing_values") * 100.0, F.col("total_rows") * F.lit(width))
    return base.select("total_rows", F.lit(width).alias("total_columns"), "missing_values", share.alias("missing_percentage"))
