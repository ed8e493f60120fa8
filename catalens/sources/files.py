"""Tables and score tables on files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How missing, empty and broken text is told apart in CSV.
CSV_FORM = {"header": True, "escape": '"', "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
EMPTY_MARK = "\u0000"
DOCUMENT_NAMES = 100_000


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table from parquet, ORC, JSON or CSV; text formats take a declared schema."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"declare the schema of a {fmt} source")
    return reader.load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """The default sink: parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header and without row numbers; nested columns become JSON text.

    Text is quoted where it holds a comma, quote or line break; empty text is
    quoted and a missing value is not, so both come back as they were.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).options(emptyValue='""', **CSV_FORM).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What `write_csv` wrote. A cell may hold line breaks, so a file is one split; write many files."""
    found = read_table(spark, path, "csv", schema, multiLine=True, emptyValue=EMPTY_MARK, **CSV_FORM)
    texts = [f.name for f in found.schema.fields if isinstance(f.dataType, T.StringType)]
    # The reader takes quoted empty text for missing unless it stands for something else.
    return found.withColumns({c: F.when(F.col(c) == EMPTY_MARK, "").otherwise(F.col(c)) for c in texts})


def read_score_document(spark: SparkSession, path: str) -> DataFrame:
    """Score tables kept as JSON objects ``{name: score}``, one on each line or one per file, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    objects = whole.select("file", F.posexplode(F.split("value", r"(?<=\})\s*\n(?=\{)")).alias("part", "object"))
    parsed = objects.select("file", "part", F.map_entries(F.from_json("object", "map<string,bigint>")).alias("entries"))
    # One row per object: the names before it give its first place.
    sizes = parsed.select("file", "part", F.size("entries").alias("size"))
    before = F.sum("size").over(Window.orderBy("file", "part")) - F.col("size")
    placed = parsed.join(sizes.select("file", "part", before.alias("before")), ["file", "part"])
    listed = placed.select("before", F.posexplode("entries").alias("at", "entry"))
    return listed.select(F.col("entry.key").alias("name"), F.col("entry.value").alias("score"), (F.col("before") + F.col("at")).alias("ord"))


def write_score_document(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A score table as JSON objects ``{name: score}``, one for every ``DOCUMENT_NAMES`` names.

    A table of fewer names is a single object. Any number of names is written,
    in files that follow each other in order; no task holds more than its own.
    """
    documents = scores.withColumn("document", F.floor(F.col("ord") / DOCUMENT_NAMES))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "score"))), lambda r: F.struct(r["name"], r["score"]))
    objects = documents.groupBy("document").agg(F.to_json(F.map_from_entries(rows)).alias("value"))
    objects.sort("document").select("value").write.mode(mode).text(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Score table as JSON lines ``{name, score, ord}`` of any size."""
    scores.select("name", "score", "ord").write.mode(mode).json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "json", "name string, score bigint, ord bigint")
