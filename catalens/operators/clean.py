"""Cleaning, imputation, deduplication and splitting."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.functions import text as tx
from catalens.operators.stats import as_scalar, column_quantiles, exact_medians
from catalens.session import staged

# ---- fixed values -----------------------------------------------------------
CATEGORY_COLUMNS = ["brand", "os", "color", "store", "main_category"]
MEDIAN_COLUMNS = ["rating", "average_rating"]
ZERO_COLUMNS = ["helpful_vote", "rating_number", "num_reviews", "avg_helpful_votes"]
TEXT_COLUMNS = ["title_x", "text", "title_y"]
PRODUCT_COLUMNS = [
    "asin", "parent_asin", "title_y", "brand", "os", "color", "store",
    "average_rating", "rating_number", "features", "price", "images_y",
]
REVIEW_COLUMNS = ["asin", "parent_asin", "user_id", "timestamp", "rating", "title_x", "text", "helpful_vote"]
MIN_TEXT, MIN_TITLE = 10, 5
TRIM_LOW, TRIM_HIGH, TRIM_ROWS = 0.01, 0.99, 10
# Bits of a bitmap for each repeated row, at most, and in one of Spark's bitmaps.
BITS, MOST_BITS, BLOCK = 16, 1 << 29, 1 << 15
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Roles:
    """Which columns play which part; columns a table lacks are left out."""

    key: str = "asin"
    price: str = "price"
    text: str = "text"
    title: str = "title_x"
    order: str = "row_id"
    verified: str = "verified_purchase"
    features: str = "features"
    details: str = "details"
    categories: Sequence[str] = field(default_factory=lambda: CATEGORY_COLUMNS)
    medians: Sequence[str] = field(default_factory=lambda: MEDIAN_COLUMNS)
    zeros: Sequence[str] = field(default_factory=lambda: ZERO_COLUMNS)
    texts: Sequence[str] = field(default_factory=lambda: TEXT_COLUMNS)


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are evaluated exactly once per row.

    A later filter on a plain projection is moved below it and repeats its
    expressions; expensive ones, such as text cleaning, go through a one-row
    `inline` that filters cannot cross.
    """
    kept = [c for c in df.columns if c not in columns]
    once = F.inline(F.array(F.struct(*[col.alias(name) for name, col in columns.items()])))
    order = [*df.columns, *[name for name in columns if name not in df.columns]]
    return df.select(*kept, once).select(*order)


def select_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The listed columns that the table has, in list order."""
    return df.select(*[c for c in wanted if c in df.columns])


def fill_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: tx.default_category(F.col(c)) for c in columns if c in df.columns})


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: tx.to_number(F.col(c)) for c in columns if c in df.columns})


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numbers become the exact median of their column."""
    present = [c for c in columns if c in df.columns]
    return _coalesce(df, exact_medians(df, present)) if present else df


def _coalesce(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), default) for c, default in defaults.items()})


def fill_zeros(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns if c in df.columns})


def fill_false(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(False))) if column in df.columns else df


def parse_prices(df: DataFrame, column: str, target: str = "price_numeric") -> DataFrame:
    """Parsed price; rows without a readable price are dropped."""
    return with_once(df, {target: tx.parse_price(F.col(column))}).where(F.col(target).isNotNull())


def short_content(text: Column, title: Column) -> Column:
    return (F.length(text) < MIN_TEXT) & (F.length(title) < MIN_TITLE)


def drop_short_content(df: DataFrame, text: str, title: str) -> DataFrame:
    return df.where(~short_content(F.col(text), F.col(title)))


def outlier_limits(df: DataFrame, column: str) -> DataFrame:
    """One row ``(low, high)``; open limits when there are too few rows to trim."""
    limits = column_quantiles(df, [column], [TRIM_LOW, TRIM_HIGH]).agg(
        F.max("n").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    enough = F.col("n") > TRIM_ROWS
    return limits.select(
        F.when(enough, F.col("low")).otherwise(F.lit(float("-inf"))).alias("low"),
        F.when(enough, F.col("high")).otherwise(F.lit(float("inf"))).alias("high"),
    )


def trim_outliers(df: DataFrame, column: str, counted: DataFrame | None = None) -> DataFrame:
    """Keep values between the 1 % and 99 % quantiles, both included; those of ``counted``, if it is given.

    The two limits are written as one row, so that whatever reads the trimmed
    table does not look for them again.
    """
    limits = as_scalar(staged(outlier_limits(df if counted is None else counted, column), "limits"))
    return df.where((F.col(column) >= limits["low"]) & (F.col(column) <= limits["high"]))


def _groupable(df: DataFrame, column: str) -> Column:
    """A key for whole-row comparison; maps compare by their sorted entries."""
    if isinstance(df.schema[column].dataType, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
    return F.col(column)


def distinct_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Whole-row distinct; ``order`` is not compared and keeps its smallest value.

    Equal rows are combined before the shuffle, so one value repeated in a
    third of the table costs one row per task. A numeric ``order`` keeps this a
    hash aggregation; a text order or a map column makes Spark sort.
    """
    compared = [c for c in df.columns if c != order]
    maps = [c for c in compared if isinstance(df.schema[c].dataType, T.MapType)]
    if not maps and order is None:
        return df.distinct()
    keys = [_groupable(df, c).alias(f"__key_{i}") if c in maps else F.col(c) for i, c in enumerate(compared)]
    kept = [F.first(c).alias(c) for c in maps] + ([F.min(order).alias(order)] if order else [])
    return df.groupBy(*keys).agg(*kept).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by an explicit order.

    `min_by` combines before the shuffle: a key that holds a third of all rows
    sends one row per task, where a window would sort it in a single task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"__first.{c}") for c in df.columns])


def code_mapping(df: DataFrame, code: str, name: str) -> DataFrame:
    return df.select(code, name).distinct()


def split_products_reviews(
    df: DataFrame,
    order: Sequence[str],
    key: str = "asin",
    product_columns: Sequence[str] = tuple(PRODUCT_COLUMNS),
    review_columns: Sequence[str] = tuple(REVIEW_COLUMNS),
) -> tuple[DataFrame, DataFrame]:
    """Product table (first row per key) and review table (all rows)."""
    wanted = [c for c in product_columns if c in df.columns]
    products = keep_first(df.select(*wanted, *[c for c in order if c not in wanted]), [key], order)
    return products.select(*wanted), select_existing(df, review_columns)


def compared_rows(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Categories, numbers, prices, texts and flags cleaned row by row."""
    df = fill_categories(df, roles.categories)
    df = to_numbers(df, [*roles.medians, *roles.zeros])
    df = fill_zeros(df, roles.zeros)
    if roles.price in df.columns:
        df = parse_prices(df, roles.price)
    texts = {c: tx.clean_text(F.col(c)) for c in roles.texts if c in df.columns}
    df = with_once(df, texts) if texts else df
    return fill_false(df, roles.verified)


def content_columns(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """`features_clean` and `details_parsed`: copies of other columns in another form."""
    if roles.features in df.columns:
        is_list = isinstance(df.schema[roles.features].dataType, T.ArrayType)
        df = df.withColumn("features_clean", tx.join_features(F.col(roles.features)) if is_list else F.col(roles.features))
    if roles.details in df.columns:
        is_text = isinstance(df.schema[roles.details].dataType, T.StringType)
        df = df.withColumn("details_parsed", tx.parse_details(F.col(roles.details)) if is_text else F.col(roles.details))
    return df


def clean_rows(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """All row-wise cleaning. Medians stay missing, so it also runs on a stream."""
    return content_columns(compared_rows(df, roles), roles)


def _order(df: DataFrame, roles: Roles) -> str | None:
    return roles.order if roles.order in df.columns else None


def _imputed_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows cleaned one by one, with the medians of the raw table for missing numbers."""
    present = [c for c in roles.medians if c in df.columns]
    cleaned = compared_rows(df, roles)
    return _coalesce(cleaned, exact_medians(to_numbers(df, present), present)) if present else cleaned


def clean_table(df: DataFrame, roles: Roles = Roles(), trim: bool = True) -> DataFrame:
    """Full cleaning: impute, parse, clean texts, deduplicate, drop short rows, trim prices.

    Medians are taken over the raw table, before unpriced rows go. The
    cleaned rows are written out once, and those that may occur twice are shuffled: the price
    limits and everything after them read these tables instead of cleaning and shuffling again.
    Columns that only repeat another one are added after the shuffle.
    """
    cleaned = _distinct_written(_imputed_rows(df, roles), _order(df, roles))
    cleaned = drop_short_content(cleaned, roles.text, roles.title)
    if trim and "price_numeric" in cleaned.columns:
        cleaned = trim_outliers(cleaned, "price_numeric")
    return content_columns(cleaned, roles)


def _row_hashes(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes that equal rows share. A hash passes over NULL, so it also takes in where NULL stands."""
    # Equal rows may have 0.0 and -0.0.
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    parts = [part for c in columns for part in (F.col(c) + F.lit(0.0) if c in numbers else F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"__hash_{seed}") for seed in (0, 1)]


def _distinct_written(df: DataFrame, order: str | None) -> DataFrame:
    """As `distinct_rows`, from rows written as they are: of most rows only a hash is shuffled.

    Hashes that occur more than once are marked in a bitmap of at most ``MOST_BITS`` bits, which is sent to
    the tasks. Rows whose bit is not set have no equal; the others are shuffled and compared whole. More repeated
    hashes, or others that share their bits, only shuffle more rows.
    """
    plain = [f.name for f in df.schema.fields if f.name != order and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    rows = staged(df.withColumn("__hash", _row_hashes(df, plain)[0]), "clean")
    repeated = staged(rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__hash"), "repeated")
    blocks = max(1, min(MOST_BITS, BITS * repeated.count()) // BLOCK)
    bit = F.pmod("__hash", F.lit(blocks * BLOCK))
    block, place = F.floor(bit / BLOCK).cast("int"), bit % BLOCK
    marks = repeated.groupBy(block.alias("__block")).agg(F.bitmap_construct_agg(place).alias("__marks"))
    byte = F.conv(F.hex(F.substring("__marks", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__block", block).join(F.broadcast(marks), "__block", "left")
    known = met.withColumn("__met", F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0, F.lit(False)))
    several = staged(distinct_rows(known.where("__met").select(*df.columns), order), "distinct")
    return known.where("NOT __met").select(*df.columns).unionByName(several)


def _identity(df: DataFrame, order: str | None) -> list[Column]:
    """Narrow columns that equal rows share, whatever their ``order``. Columns of lists, structs or maps, whose hashes
    would not tell where NULL stands inside them, are compared as they are."""
    nested = [f.name for f in df.schema.fields if f.name != order and isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    hashed = _row_hashes(df, [c for c in df.columns if c != order and c not in nested])
    return [*hashed, *[_groupable(df, c).alias(f"__key_{i}") for i, c in enumerate(nested)]]


def clean_products(df: DataFrame, roles: Roles = Roles(), product_columns: Sequence[str] = tuple(PRODUCT_COLUMNS)) -> DataFrame:
    """The product table that `split_products_reviews` takes from `clean_table`, without the review texts.

    The first of equal rows is the first of its key too, so duplicates count for the price limits only. They are told by
    two 64-bit hashes, and the columns of the products are written where their rows are: a key's rows that lie together
    stay together, and are combined before the shuffle.
    """
    rows = drop_short_content(_imputed_rows(df, roles), roles.text, roles.title)
    same = _identity(rows, roles.order)
    names = [f"__same_{i}" for i in range(len(same))]
    wanted = [c for c in product_columns if c in rows.columns]
    price = ["price_numeric"] if "price_numeric" in rows.columns else []
    rows = staged(rows.select(*[c.alias(n) for c, n in zip(same, names)], *price, *wanted, roles.order), "product-rows")
    if price:
        rows = trim_outliers(rows, *price, rows.select(*names, *price).distinct())
    return keep_first(rows.select(*wanted, roles.order), [roles.key], [roles.order]).select(*wanted)


def step_audit(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rows in, rows out and rows removed for every dropping step of cleaning.

    Only counts are wanted, so different rows are told by two 64-bit hashes, and no text is shuffled or written.
    """
    rows = compared_rows(df, roles)
    kept = (~short_content(F.col(roles.text), F.col(roles.title))).alias("long_enough")
    narrow = rows.select(*_identity(rows, _order(df, roles)), "price_numeric", kept)
    unique = staged(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")), "audit")
    long_enough = unique.where("long_enough")
    figures = as_scalar(unique.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("priced"), F.count("*").alias("different"), F.count_if("long_enough").alias("long_enough")))
    names = ["price", "duplicates", "short_content", "outliers"]
    counts = [as_scalar(df.agg(F.count("*").alias("n")))["n"], figures["priced"], figures["different"], figures["long_enough"]]
    counts.append(as_scalar(trim_outliers(long_enough, "price_numeric").agg(F.count("*").alias("n")))["n"])
    steps = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), counts[i].alias("rows_in"), counts[i + 1].alias("rows_out"))
            for i, name in enumerate(names)
        ]
    )
    one = df.sparkSession.range(1)
    return one.select(F.inline(steps)).withColumn("removed", F.col("rows_in") - F.col("rows_out"))
