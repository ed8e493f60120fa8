"""Names for columns of our own that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names`` behind as many underscores as keep them apart from all columns, whatever their case."""
    used = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in used for n in names):
        prefix += "_"
    return tuple(prefix + n for n in names)
