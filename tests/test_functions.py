"""Scalar expressions on literal rows; expected values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalens.functions import bins, specs
from catalens.functions import text as tx
from catalens.sources import pages


def evaluate(spark, build, values, kind):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [row[0] for row in frame.orderBy("i").select(build(F.col("x"))).collect()]


CASES = [
    ("price", tx.parse_price, "string", {"$1,299.99": 1299.99, "1,299": 1299.0, "None": None, "1.2.3": None, "-5": 5.0, "": None, ".": None}),
    ("clean", tx.clean_text, "string", {'<b>Hi</b>  "you" é_1!': "Hi you é_1!", "a\u00a0\u2003b": "a b", "5 < 6 > 4": "5 4", "日本, 語?": "日本, 語?"}),
    ("category", tx.default_category, "string", {"Missing": "Unknown", "x": "x"}),
    ("number", tx.to_number, "string", {"1.5": 1.5, "n/a": None, "NaN": None}),
    ("local", bins.price_bin_local, "double", {0.0: "Budget", 2375.0: "Budget", 2375.01: "Mid-range", 9500.0: "High-end", 9500.01: "Premium", -1.0: None}),
    ("usd", bins.price_bin_usd, "double", {500.0: "Budget", 500.5: "Mid-range", 2000.0: "High-end", 2001.0: "Premium"}),
    ("rating", bins.rating_bin, "double", {0.0: "Poor", 2.0: "Poor", 3.0: "Fair", 4.0: "Good", 5.0: "Excellent", 5.1: None}),
    ("length", bins.length_bin, "int", {0: None, 100: "Short", 101: "Medium", 1000: "Long", 1001: "Very Long"}),
    ("storage", bins.storage_category, "double", {255.0: "Small (<256GB)", 256.0: "Medium (256-512GB)", 512.0: "Large (512GB-1TB)", 1000.0: "Very Large (>1TB)"}),
    ("display", bins.storage_display, "double", {512.0: "512GB", 1024.0: "1.0TB", 1536.0: "1.5TB", 512.5: "512GB", 513.5: "514GB"}),
    ("ram", bins.ram_category, "double", {7.9: "Low (<8GB)", 8.0: "Medium (8-16GB)", 16.0: "High (16-32GB)", 32.0: "Very High (>32GB)"}),
    ("screen", bins.screen_category, "double", {12.9: 'Small (<13")', 13.0: 'Medium (13-15")', 15.0: 'Large (15-17")', 17.0: 'Very Large (>17")'}),
    ("tier", bins.performance_tier, "double", {20000.0: "Ultra High", 19999.0: "High", 4000.0: "Low-Medium", 3999.0: "Low"}),
    ("ram_gb", specs.ram_gb, "string", {"8gb ddr4 512gb ssd": 8.0, "512gb ssd": 512.0, "1tb": 1024.0, "none": None, "512gb ssd 16 gb ram": 16.0, "1tb ssd 8gb": 8.0}),
    ("storage_gb", specs.storage_gb, "string", {"8gb ram 1tb ssd": 1024.0, "512gb": 512.0, "16gb ram": None, "8gb frame": None, "1.5tb nvme": 1536.0}),
    ("screen_in", specs.screen_inches, "string", {"15.6 inch": 15.6, '13.3"': 13.3, "11 intel": 11.0, "14": None}),
    ("disk_type", specs.storage_type, "string", {"nvme ssd": "NVMe SSD", "pcie ssd": "PCIe SSD", "ssd": "SSD", "hard disk": "HDD", "emmc flash": "eMMC", "flash": "Flash Storage", "x": None}),
    ("ram_type", specs.ram_type, "string", {"lpddr5": "DDR5", "ddr3l": "DDR3", "x": None}),
    ("ram_strict", lambda c: specs.ram_type(c, strict=True), "string", {"lpddr5": "LPDDR5", "ddr4": "DDR4"}),
    ("cpu", specs.cpu_model, "string", {"intel core i5-1135g7": "Intel Core I5-1135G7", "apple m1 pro, 8gb": "Apple M1 Pro", "amd athlon 300u": "Amd Athlon 300U"}),
    ("gpu", specs.gpu_model, "string", {"intel uhd graphics | x": "Intel Uhd Graphics ", "nvidia geforce rtx 3060ti": "Nvidia Geforce Rtx 3060Ti"}),
    ("cpu_name", tx.normalize_cpu_name, "string", {"Intel  Core i5 Processor @ 2.40GHz": "intel core i5", "Unknown": "Unknown", "AMD A6 APU Dual": "amd a6"}),
    ("gpu_name", tx.normalize_gpu_name, "string", {"Intel UHD Graphics 600": "intel uhd 600", "0": "Unknown", "RTX GPU card": "rtx"}),
    ("answer", pages.score_in_text, "string", {"Score: 5, Benchmark: 7": 7, "passmark cpu mark: 12": 12, "CPU Mark: x": None}),
]


@pytest.mark.parametrize("name,build,kind,cases", CASES, ids=[c[0] for c in CASES])
def test_literals(spark, name, build, kind, cases):
    assert evaluate(spark, build, list(cases), kind) == list(cases.values())


def test_missing_values(spark):
    assert evaluate(spark, bins.storage_category, [None], "double") == ["Unknown"]
    assert evaluate(spark, bins.storage_display, [None], "double") == [None]
    assert evaluate(spark, tx.clean_text, [None], "string") == [""]
    assert evaluate(spark, tx.normalize_cpu_name, [None], "string") == ["Unknown"]
    assert evaluate(spark, specs.ram_gb, [None], "string") == [None]


def test_unicode_blank_between_number_and_unit(spark):
    assert evaluate(spark, lambda c: specs.ram_gb(tx.searchable(c)), ["16\u00a0GB RAM"], "string") == [16.0]


def test_occurrences_overlap(spark):
    found = evaluate(spark, lambda c: tx.count_occurrences(c, F.lit("aa")), ["aaaa", "", "b"], "string")
    assert found == [3, 0, 0]
    offsets = evaluate(spark, lambda c: tx.occurrence_offsets(c, F.lit("aa")), ["aaaa", "xaa\nyaa", "b"], "string")
    assert offsets == [[0, 1, 2], [1, 5], []]
    assert evaluate(spark, lambda c: tx.count_occurrences(c, F.lit(r"\E.")), [r"a\E.\E."], "string") == [2]


def test_gaming_rules(spark):
    rows = [(8000, 12000), (8000, 6000), (1499, 99999), (5000, 8000), (1500, 1)]
    frame = spark.createDataFrame(rows, "gpu int, cpu int")
    got = [r[0] for r in frame.select(bins.gaming_capability(F.col("cpu"), F.col("gpu"))).collect()]
    assert got == ["High-End Gaming", "Casual Gaming", "No Gaming", "Mid-Range Gaming", "Light Gaming"]


def test_total_score_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(5, 0), (15, 0)], "cpu int, gpu int")
    assert [r[0] for r in frame.select(F.bround(F.col("cpu") * 0.5, 0)).collect()] == [2.0, 8.0]
    assert frame.select(bins.total_score(F.lit(9900), F.lit(2700))).first()[0] == 7740.0


def test_dates(spark):
    frame = spark.createDataFrame([("2024-01-01",), ("bad",)], "d string")
    parts = bins.date_parts(bins.to_moment(F.col("d")))
    rows = [tuple(r) for r in frame.select(*parts.values()).collect()]
    assert rows == [(2024, 1, 0), (None, None, None)]
    epoch = spark.createDataFrame([(1704067200000000000,)], "t bigint")
    moment = epoch.select(bins.to_moment(F.col("t"), "ns")).first()[0]
    assert moment.date() == datetime.date(2024, 1, 1)


def test_details_and_maps(spark):
    frame = spark.createDataFrame(
        [('{"RAM Size": "16 GB", "Hard Drive": "1 TB", "Processor": "x"}',), ("bad",), (None,)], "d string"
    ).select(tx.parse_details(F.col("d")).alias("m"))
    rows = frame.select(
        "m", specs.spec_from_map(F.col("m"), "RAM", "GB"), specs.storage_from_map(F.col("m")), specs.processor_from_map(F.col("m"))
    ).collect()
    assert tuple(rows[0])[1:] == (16.0, 1024.0, "x")
    assert rows[1][0] == {"raw_details": "bad"} and rows[2][0] == {}


def test_helpfulness(spark):
    frame = spark.createDataFrame([(4.0, 2.0), (3.0, 0.0), (None, 1.0)], "v double, n double")
    assert [r[0] for r in frame.select(bins.helpfulness_ratio(F.col("v"), F.col("n"))).collect()] == [2.0, 3.0, 0.0]


def test_features_joined(spark):
    frame = spark.createDataFrame([(["a", "", None, "b"],), (None,)], "f array<string>")
    assert [r[0] for r in frame.select(tx.join_features(F.col("f"))).collect()] == ["a | b", ""]


def test_clean_text_equals_the_plain_classes_for_every_character(spark):
    """Letters, white space and junk as the plain Unicode classes tell them, alone, in runs and between words."""
    points = spark.range(0x20000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    texts = points.select(F.explode(F.array(F.col("c"), F.concat(F.lit("a"), "c", "c", F.lit(" "), "c", F.lit("b *")), F.concat(F.lit("<x"), "c", F.lit(">é "), "c", F.lit("<")))).alias("t"))
    plain = F.regexp_replace(F.regexp_replace("t", "<[^>]+>", ""), tx.SPACE_CLASS + "+", " ")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s\p{Z}.,!?-]", ""))
    assert texts.where(~tx.clean_text(F.col("t")).eqNullSafe(plain)).count() == 0
    assert texts.where(plain != "").count() > 50_000
