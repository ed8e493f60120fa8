"""Specification extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions import bins, specs
from catalens.functions import text as tx
from catalens.operators import match
from catalens.workload import sqltext as q
from catalens.workload.fixtures import DOCUMENT_SPECS, PRODUCTS, load, plain, table
from catalens.workload.registry import query

SPEC = plain(PRODUCTS)
TEXT = f"SELECT p_partkey, lower(concat_ws(' ', title_y, features)) AS t FROM ({SPEC}) AS p"
STAGE = q.spec_stage(SPEC, ["title_y", "features", "details"])


def _text(spark, folder):
    products = load(spark, folder, PRODUCTS)
    return products.select("p_partkey", tx.searchable(tx.combine_text(F.col("title_y"), F.col("features"))).alias("t"))


def _one(name, function, sql):
    @query(name, f"SELECT p_partkey, {sql} AS value FROM ({TEXT}) AS x")
    def run(spark, folder):
        return _text(spark, folder).select("p_partkey", function(F.col("t")).alias("value"))

    return run


_one("spec_ram", specs.ram_gb, q.ram("t"))
_one("spec_storage", specs.storage_gb, q.storage("t"))
_one("spec_screen", specs.screen_inches, q.screen("t"))
_one("spec_storage_type", specs.storage_type, q.storage_type("t"))
_one("spec_ram_type", specs.ram_type, q.ram_type("t"))
_one("spec_ram_type_strict", lambda t: specs.ram_type(t, strict=True), f"CASE WHEN contains(t, 'lpddr5') THEN 'LPDDR5' ELSE {q.ram_type('t')} END")
_one("spec_cpu", specs.cpu_model, q.cpu_model("t"))
_one("spec_gpu", specs.gpu_model, q.gpu_model("t"))
_one("spec_gpu_trimmed", lambda t: specs.gpu_model(t, trim=True), f"rtrim({q.gpu_model('t')})")

SPEC_OUT = (
    "p_partkey, ram_gb, storage_gb, screen_size_inches, storage_type, ram_type, processor_model, gpu_model, "
    "storage_category, storage_display, ram_category, screen_category"
)


@query("spec_stage", f"SELECT {SPEC_OUT} FROM ({STAGE}) AS s")
def spec_stage(spark, folder):
    return match.add_specs(load(spark, folder, PRODUCTS), ["title_y", "features", "details"]).select(*SPEC_OUT.split(", "))


@query("documents_specs", f"SELECT doc_id, {q.spec_columns('t')} FROM (SELECT doc_id, lower(text) AS t FROM ({plain(DOCUMENT_SPECS)}) AS x) AS d")
def documents_specs(spark, folder):
    docs = load(spark, folder, DOCUMENT_SPECS).select("doc_id", tx.searchable(F.col("text")).alias("t"))
    return docs.select("doc_id", *[c.alias(n) for n, c in match.spec_columns(F.col("t")).items()])


@query(
    "storage_display",
    f"SELECT o_orderkey, {q.storage_display('v')} AS value FROM (SELECT o_orderkey, o_totalprice / 100 AS v FROM orders) AS o",
)
def storage_display(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", bins.storage_display(F.col("o_totalprice") / 100).alias("value"))


MAP_RAM = q.map_value("details", "contains(lower(k), 'ram')", r"nullif(regexp_extract($v, '(\d+(?:\.\d+)?)\s*[gG][bB]', 1), '')")
MAP_SCREEN = q.map_value("details", "contains(lower(k), 'screen size')", r"nullif(regexp_extract($v, '(?i)(\d+(?:\.\d+)?)\s*inches', 1), '')")
MAP_DISK = q.map_value(
    "details",
    "contains(lower(k), 'hard drive') OR contains(lower(k), 'ssd') OR contains(lower(k), 'storage') OR contains(lower(k), 'flash memory')",
    r"CAST(nullif(regexp_extract($v, '(?i)(\d+(?:\.\d+)?)\s*(?:gb|tb)', 1), '') AS DOUBLE) * CASE WHEN contains(upper($v), 'TB') THEN 1024 ELSE 1 END",
)
MAP_CPU = q.map_value("details", "contains(lower(k), 'processor')", "nullif($v, '')")


@query(
    "map_spec",
    f"SELECT p_partkey, CAST({MAP_RAM} AS DOUBLE) AS ram_gb, CAST({MAP_SCREEN} AS DOUBLE) AS screen_size FROM ({SPEC}) AS p",
)
def map_spec(spark, folder):
    details = load(spark, folder, PRODUCTS).select("p_partkey", tx.parse_details(F.col("details")).alias("m"))
    return details.select(
        "p_partkey",
        specs.spec_from_map(F.col("m"), "RAM", "GB").alias("ram_gb"),
        specs.spec_from_map(F.col("m"), "Screen Size", "Inches").alias("screen_size"),
    )


@query("map_storage", f"SELECT p_partkey, CAST({MAP_DISK} AS DOUBLE) AS storage_gb FROM ({SPEC}) AS p")
def map_storage(spark, folder):
    details = load(spark, folder, PRODUCTS).select("p_partkey", tx.parse_details(F.col("details")).alias("m"))
    return details.select("p_partkey", specs.storage_from_map(F.col("m")).alias("storage_gb"))


@query("map_processor", f"SELECT p_partkey, {MAP_CPU} AS processor FROM ({SPEC}) AS p")
def map_processor(spark, folder):
    details = load(spark, folder, PRODUCTS).select("p_partkey", tx.parse_details(F.col("details")).alias("m"))
    return details.select("p_partkey", specs.processor_from_map(F.col("m")).alias("processor"))


@query(
    "spec_from_map_stage",
    f"""SELECT p_partkey, CAST({MAP_RAM} AS DOUBLE) AS ram_gb, CAST({MAP_DISK} AS DOUBLE) AS storage_gb,
    CAST({MAP_SCREEN} AS DOUBLE) AS screen_size, {MAP_CPU} AS processor FROM ({SPEC}) AS p""",
)
def spec_from_map_stage(spark, folder):
    details = load(spark, folder, PRODUCTS).withColumn("details_parsed", tx.parse_details(F.col("details")))
    return match.add_map_specs(details).select("p_partkey", "ram_gb", "storage_gb", "screen_size", "processor")
