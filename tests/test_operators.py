"""Operators against brute force on small, also skewed, tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.operators import clean, collab, describe, encode, match, quality, recommend, vectors
from catalens.operators.stats import column_quantiles, exact_quantiles, histogram
from catalens.sources import files
from catalens.sources import pages as pg
from catalens.session import scratch_path

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.8, 0.99, 1.0]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 1802, 5003])
@pytest.mark.parametrize("accuracy", [100, 1000, 100_000])
def test_quantiles_match_numpy(spark, size, accuracy):
    if accuracy == 1000 and size < 100:
        pytest.skip("same path as the largest accuracy")
    rng = np.random.default_rng(size)
    values = np.round(rng.lognormal(3, 2, size), 3)
    values[: size // 3] = 7.0  # one value holds a third of all rows
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    got = {r.q: r.value for r in exact_quantiles(frame, "v", FRACTIONS, accuracy).collect()}
    for q in FRACTIONS:
        assert got[q] == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("keep", [1, 5, 100])
@pytest.mark.parametrize("shape", ["hot", "hot ends", "wide", "few", "infinite"])
def test_quantiles_in_rounds(spark, shape, keep):
    rng = np.random.default_rng(keep)
    values = np.round(rng.normal(0, 1, 4001), 4)
    if shape == "hot":
        values[:3000] = 0.5
    elif shape == "hot ends":
        values[:1500], values[1500:3000] = values.min(), values.max()
    elif shape == "wide":
        values = 10.0 ** rng.integers(-300, 300, 4001) * rng.choice([-1, 1], 4001)
    elif shape == "few":
        values = rng.integers(0, 3, 4001).astype(float)
    else:
        values[:100], values[100:200] = -np.inf, np.inf
    frame = spark.createDataFrame([(float(v), None) for v in values] + [(None, None), (float("nan"), None)], "v double, nothing double").repartition(4)
    # A sketch this coarse misses, and every bracket takes several rounds.
    rows = column_quantiles(frame, ["v", "nothing"], FRACTIONS, accuracy=20, keep=keep).collect()
    ordered = np.sort(values)
    assert {(r.name, r.n) for r in rows} == {("v", 4001)} and len(rows) == len(FRACTIONS)
    for r in rows:
        rank = r.q * 4000
        low, high = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
        assert r.value == pytest.approx(low if low == high else low + (high - low) * (rank - np.floor(rank)), rel=1e-12)


def test_quantiles_of_columns_with_missing(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (9.0, None)], "a double, b double")
    rows = {(r.name, r.q): r.value for r in column_quantiles(frame, ["a", "b"], [0.5]).collect()}
    assert rows == {("a", 0.5): 2.0}


def test_quantile_plan_has_no_join_window_or_error(spark):
    frame = spark.range(1000).withColumn("v", F.col("id").cast("double"))
    plan = exact_quantiles(frame, "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Join", "collect_list", "Window", "raise_error"))


def test_histogram_edges_and_constant(spark):
    frame = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert [r.n for r in histogram(frame, "v", 5).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(r.n for r in histogram(constant, "v", 4).collect()) == 2


def test_distinct_rows_with_map_and_order(spark):
    rows = [(3, {"a": "1", "b": "2"}), (1, {"b": "2", "a": "1"}), (2, {"a": "9"})]
    frame = spark.createDataFrame(rows, "row_id int, m map<string,string>")
    kept = clean.distinct_rows(frame, order="row_id").collect()
    assert sorted(r.row_id for r in kept) == [1, 2]


def test_keep_first_of_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(500, 0, -1)] + [(f"k{i}", 1, "x") for i in range(50)]
    frame = spark.createDataFrame(rows, "k string, o int, v string").repartition(8)
    first = clean.keep_first(frame, ["k"], ["o"])
    assert first.count() == 51
    assert first.where("k = 'hot'").first().v == "v1"
    assert "Window" not in first._jdf.queryExecution().executedPlan().toString()


def test_outliers_kept_for_few_rows(spark):
    few = spark.createDataFrame([(float(i),) for i in range(10)], "p double")
    assert clean.trim_outliers(few, "p").count() == 10
    more = spark.createDataFrame([(float(i),) for i in range(100)], "p double")
    assert clean.trim_outliers(more, "p").count() == 98


def test_labels_are_dense_sorted_and_invertible(spark):
    values = [f"u{i % 997}" for i in range(3000)] + ["hot"] * 1500 + [None, "Zed", "a"]
    frame = spark.createDataFrame([(v,) for v in values], "u string").repartition(8)
    encoder = encode.fit_labels(frame, ["u"])
    expected = {v: i for i, v in enumerate(sorted({v or "Unknown" for v in values}))}
    assert {r.value: r.code for r in encoder.collect()} == expected
    coded = encode.apply_labels(frame, encoder, ["u"])
    assert coded.count() == len(values)
    back = encode.decode_labels(coded.drop("u"), encoder, "u")
    assert sorted(r.u_display for r in back.collect()) == sorted(v or "Unknown" for v in values)


def test_minmax(spark):
    frame = spark.createDataFrame([(3.0, None), (3.0, 1.0), (3.0, 2.0)], "a double, b double")
    rows = [tuple(r) for r in encode.scale_minmax(frame, ["a", "b"]).collect()]
    assert rows == [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0)]


def test_rescale_only_unit_ratings(spark):
    unit = spark.createDataFrame([(0.0,), (1.0,)], "rating double")
    assert [r.rating_scaled for r in encode.rescale_ratings(unit).collect()] == [0.0, 5.0]
    full = spark.createDataFrame([(1.0,), (5.0,)], "rating double")
    assert [r.rating_scaled for r in encode.rescale_ratings(full).collect()] == [1.0, 5.0]


NAMES = [("core i5", 10, 0), ("i5", 20, 1), ("core i5-1135g7", 30, 2), ("m1", 40, 3), ("aa", 5, 4), ("x", 7, 5), ("Ryzen", 8, 6)]
TEXTS = ["Intel Core i5-1135G7", "aaaa", "core i5 core i5", "nothing", "m1", "", "RYZEN 5 x", "core " * 50, "é" * 3 + "m1"]


def brute_best(text):
    text, best, top = text.lower(), None, 0.0
    for name, _, _ in NAMES:
        low = name.lower()
        hits = sum(text.startswith(low, i) for i in range(len(text)))
        if hits and len(name) * hits / len(text) > top:
            best, top = name, len(name) * hits / len(text)
    return best, top


def test_best_match_equals_brute_force(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    names = spark.createDataFrame(NAMES, "name string, score int, ord int")
    got = {r.id: (r.best_pattern, r.match_score) for r in match.best_match(texts, "id", "t", names).collect()}
    want = {i: brute_best(t) for i, t in enumerate(TEXTS) if t and brute_best(t)[0]}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    for key, (_, score) in got.items():
        assert score == pytest.approx(want[key][1])


def test_score_from_text_order_of_resort(spark):
    scores = spark.createDataFrame([("core i5-1135g7", 9900, 0), ("celeron", 1500, 1), ("core i9", 21000, 2), ("snapdragon", 77, 3)], "name string, score int, ord int")
    rows = [
        (1, "Intel Core i5-1135G7 notebook", 9900, "exact"),
        (2, "Intel Celeron N4020", 1500, "family"),
        (3, "core i9", 21000, "fuzzy"),
        (4, "with a core i7 inside and a long description of everything else", 3000, "keyword_fallback"),
        (5, "plain", 3000, "default"),
        (6, "snapdragon 8", 77, "fuzzy"),
        (7, None, 3000, "default"),
    ]
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "id int, t string")
    got = {r.id: (r.score, r.match_type) for r in match.score_from_text(frame, "id", "t", scores, match.CPU).collect()}
    assert got == {r[0]: (r[2], r[3]) for r in rows}


def test_smoke_products(spark):
    """The five sample products: models as extracted and scored with an invented table."""
    rows = [
        ("Intel Core i5-1135G7 and Intel Iris Xe Graphics", 9900, 2700, "Intel Core I5-1135G7"),
        ("AMD Ryzen 5 5500U and AMD Radeon Vega 7", 13100, 1900, "Amd Ryzen 5 5500U"),
        ("Intel Celeron N4020 and Intel UHD Graphics 600", 1500, 700, "Intel Celeron N4020"),
    ]
    cpu = spark.createDataFrame([("core i5-1135g7", 9900, 0), ("ryzen 5 5500u", 13100, 1), ("celeron", 1500, 2)], "name string, score int, ord int")
    gpu = spark.createDataFrame([("intel iris xe graphics", 2700, 0), ("amd radeon vega 7", 1900, 1), ("intel uhd graphics", 700, 2)], "name string, score int, ord int")
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, title_y string")
    got = {r.id: r for r in match.add_scores(frame, "id", ["title_y"], cpu, gpu).collect()}
    for i, (_, c, g, model) in enumerate(rows):
        assert (got[i].cpu_benchmark_score, got[i].gpu_benchmark_score, got[i].processor_model) == (c, g, model)
    assert got[0].total_benchmark_score == 7740.0 and got[0].performance_tier == "Medium"


def test_validity_partitions_input(spark):
    frame = spark.createDataFrame([(1, 8.0, 512.0), (2, 256.0, 8.0), (3, None, None), (4, 0.5, 16.0)], "id int, ram_gb double, storage_gb double")
    assert sorted(r.id for r in quality.drop_invalid(frame).collect()) == [1, 3]
    detail = {r.id: r.validation_notes for r in quality.invalid_details(frame).collect()}
    assert detail[2] == "RAM 256.0GB outside valid range (1-128GB); Storage 8.0GB outside valid range (16-8192GB)"
    summary = quality.validity_summary(frame).first()
    assert (summary.total_invalid_records, summary.both_invalid_count, summary.total_records_final) == (2, 1, 2)
    with pytest.raises(ValueError):
        quality.handle_invalid(frame, "delete")


def test_tfidf_against_numpy(spark):
    docs = ["red apple red", "green apple pie", "apple", "unrelated words here"]
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    got = {(r.id, r.term): r.weight for r in vectors.tfidf(frame, "id", "t", stop_words=["here"]).collect()}
    idf = {"red": np.log(5 / 2) + 1, "apple": np.log(5 / 4) + 1}
    pairs = np.log(5 / 2) + 1
    norm = np.sqrt((2 * idf["red"]) ** 2 + idf["apple"] ** 2 + pairs**2 + pairs**2)
    assert got[(0, "red")] == pytest.approx(2 * idf["red"] / norm)
    assert got[(2, "apple")] == pytest.approx(1.0)
    assert (3, "here") not in got
    near = vectors.similar_by_terms(vectors.tfidf(frame, "id", "t"), "id", 2).collect()
    assert [r.id for r in near] == [1, 0]


def test_similarity_table_equals_pairs(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = [" ".join(rng.choice(["w%d" % k for k in range(12)], 6)) for _ in range(40)] + ["w1 w2 w3 w4 w5 w6"] * 20
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, t string")
    weights = vectors.tfidf(frame, "id", "t")
    for least in (0.2, 0.5):
        rows = vectors.similarity_table(weights, "id", frame.where("id in (0, 7, 45)").select("id"), n=4, min_similarity=least).collect()
        for item in (0, 7, 45):
            got = [(r.neighbour, round(r.similarity, 8)) for r in sorted(rows, key=lambda r: r.rank) if r.item == item]
            want = [(r.id, round(r.similarity, 8)) for r in vectors.similar_by_terms(weights, "id", item, 4).collect() if r.similarity >= least]
            assert got == want
    table = vectors.similarity_table(weights, "id", frame.select("id"), n=3, min_similarity=0.99)
    assert table.count() == 20 * 3
    vectors.write_similarity_table(table, str(tmp_path / "similar"))
    assert [(r.neighbour, r.rank) for r in vectors.read_similar(spark, str(tmp_path / "similar"), 45, "int").orderBy("rank").collect()] == [(40, 1), (41, 2), (42, 3)]


def ratings_matrix(spark):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((30, 15)) < 0.4, rng.integers(1, 6, (30, 15)), 0)
    dense[0, :4] = 5
    dense[0, 4:8] = 0
    dense[:, 0] = 3  # an item everybody rated
    rows = [(int(u), int(i), float(dense[u, i])) for u in range(30) for i in range(15) if dense[u, i]]
    return dense.astype(float), spark.createDataFrame(rows, "user int, item int, rating double").repartition(4)


def test_collaborative_scores(spark):
    dense, ratings = ratings_matrix(spark)
    unseen = [i for i in range(15) if dense[0, i] == 0]
    unit_users = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    similarity = unit_users @ unit_users[0]
    similarity[0] = 0
    by_user = {r.item: r.score for r in collab.user_based(ratings, 0, None).collect()}
    for i in unseen:
        rated = dense[:, i] > 0
        want = (similarity * dense[:, i]).sum() / similarity[rated].sum()
        assert by_user[i] == pytest.approx(want, abs=1e-8)
    unit_items = dense / np.linalg.norm(dense, axis=0, keepdims=True)
    by_item = {r.item: r.score for r in collab.item_based(ratings, 0, None).collect()}
    owned = [i for i in range(15) if dense[0, i] > 0]
    for i in unseen:
        assert by_item[i] == pytest.approx((unit_items[:, owned].T @ unit_items[:, i]).sum(), abs=1e-8)
    assert set(by_user) == set(by_item) == set(unseen)


def test_ranking_metrics(spark):
    shown = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "user int, item string, rank int")
    truth = spark.createDataFrame([(1, "b"), (3, "z")], "user int, item string")
    catalogue = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "item string")
    row = collab.ranking_metrics(shown, truth, 2, catalogue).first()
    assert row.users == 2
    assert row.precision_at_k == pytest.approx(0.25) and row.recall_at_k == pytest.approx(0.5)
    assert row.ndcg_at_k == pytest.approx(1 / np.log2(3) / 2) and row.coverage == pytest.approx(0.75)


def test_search_rejects_unknown_sort(spark):
    shop = spark.createDataFrame([(1, "red ryzen", "b", 1.0, 4.0)], "id int, title string, brand string, price double, average_rating double")
    assert recommend.search(shop, "id", "ryzen").count() == 1
    with pytest.raises(ValueError):
        recommend.search(shop, "id", "ryzen", sort_by="colour")


def test_popularity_keeps_rows_and_missing(spark):
    frame = spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "k string")
    counts = sorted((r.k or "", r.n) for r in describe.popularity(frame, "k", "n").collect() if r.k)
    assert counts == [("a", 5)] * 5 + [("b", 1)]
    assert describe.popularity(frame, "k", "n").where("k is null").first().n is None


def test_score_pages(spark):
    html = (
        '<table class="other"><tr><td>no</td></tr></table><table id="cputable"><tr><th>h</th></tr>'
        "<tr><td><a>Fast CPU</a></td><td>1,200</td><td>1</td></tr><tr><td>two</td><td>5</td></tr>"
        "<tr><td>fast</td><td>1,300</td><td>1</td></tr><tr><td>bad</td><td>n/a</td><td>1</td></tr></table>"
    )
    by_class = "<table class='wide chart'><tr><td>h</td></tr><tr><td>slow</td><td>7</td><td>1</td></tr></table>"
    frame = spark.createDataFrame([(1, html), (2, by_class), (3, "<p>none</p>")], "page int, html string")
    got = {r.name: r.score for r in pg.scores_from_tables(frame, "page").collect()}
    assert got == {"fast": 1300, "slow": 7}


def test_score_document_roundtrip(spark):
    scores = spark.createDataFrame([("z", 1, 0), ("a", 2, 1)], "name string, score bigint, ord int")
    path = scratch_path(spark, "test")
    files.write_score_document(scores, path)
    assert [(r.name, r.score, r.ord) for r in files.read_score_document(spark, path).orderBy("ord").collect()] == [("z", 1, 0), ("a", 2, 1)]


def test_text_sources_need_a_schema(spark):
    with pytest.raises(ValueError):
        files.read_table(spark, "x", "csv")


def test_distinct_sketches_merge_to_the_whole(spark):
    rows = [(i % 5, i % 3000, None if i % 2 else f"v{i % 700}", None) for i in range(20000)]
    table = spark.createDataFrame(rows, "value int, a long, b string, c string")
    parts = describe.distinct_sketches(table, ["a", "b", "c", "value"], "value")
    assert parts.count() == 20
    merged = {r.column: r.n_distinct for r in describe.merged_distinct_counts(parts).collect()}
    whole = {r.column: r.n_distinct for r in describe.merged_distinct_counts(describe.distinct_sketches(table, ["a", "b", "c", "value"], F.lit(1))).collect()}
    exact = {r.column: r.n_distinct for r in describe.distinct_counts(table, ["a", "b", "c", "value"]).collect()}
    assert exact == {"a": 3000, "b": 350, "c": 0, "value": 5}
    for name, n in exact.items():
        # Merged and direct sketches hold the same registers, but their estimators may differ a little.
        assert abs(merged[name] - n) <= 0.065 * n and abs(whole[name] - n) <= 0.065 * n
    assert describe.merged_distinct_counts(parts.where("false")).collect() == []


def test_texts_of_one_file_are_dealt_to_all_tasks(spark, monkeypatch):
    written = []
    real = match.staged
    monkeypatch.setattr(match, "staged", lambda df, name="stage": written.append((name, df)) or real(df, name))
    rows = spark.range(0, 4000, 1, 1).select("id", F.concat(F.lit("Intel Core i5-1035G7 "), F.col("id").cast("string")).alias("t"))
    names = spark.createDataFrame([("core i5-1035g7", 9000, 0)], "name string, score long, ord long")
    scored = match.add_scores(rows, "id", ["t"], names, names)
    assert {(r.cpu_benchmark_score, r.gpu_benchmark_score) for r in scored.collect()} == {(9000, 9000)}
    dealt = dict(written)["scored-rows"]
    assert dealt.count() == 4000 and "RepartitionByExpression [id" in dealt._jdf.queryExecution().toString()


def test_step_audit_shuffles_and_writes_no_text(spark, monkeypatch):
    """The counted rows are hashes, a price and a mark, with NULL told apart by its place; equal rows are one."""
    written = []
    monkeypatch.setattr(clean, "staged", lambda df, name: written.append(df.columns) or scratch(df))

    def scratch(df):
        return df.localCheckpoint()

    long = "a text of some length"
    rows = [(1, "x", None, "5", long, "title"), (2, None, "x", "5", long, "title"), (3, "x", None, "5", f"<b>{long}</b>", "title"), (4, "x", None, "none", long, "title"), (5, "x", "x", "5", "a", "b")]
    frame = spark.createDataFrame(rows, "row_id int, brand string, os string, price string, text string, title_x string")
    audit = {r.step: (r.rows_in, r.rows_out, r.removed) for r in clean.step_audit(frame.withColumn("tags", F.array(F.lit(None).cast("string"), "brand"))).collect()}
    assert audit == {"price": (5, 4, 1), "duplicates": (4, 3, 1), "short_content": (3, 2, 1), "outliers": (2, 2, 0)}
    assert not {"text", "title_x", "features", "details"} & set(written[0])


@pytest.mark.parametrize("details", ["string", "map<string,string>"])
def test_products_alone_equal_those_of_the_clean_table(spark, monkeypatch, details):
    """Same rows without a review text in any table written; copies count once for the price limits."""
    written = []
    staged = clean.staged
    rng = np.random.default_rng(6)
    rows = []
    for n in range(600):
        item = int(rng.integers(60))
        price = ["1.00", "9999.00", None, "$20.50"][item % 9] if item % 9 < 4 else f"{10 + item}.5"
        rating = [None, "3", "x", "4"][n % 4]
        row = (f"a{item}", f"title {n % 7}" if n % 5 else "ok", f"a review text {n % 9}" if n % 3 else "good", rating, price, f"product {n % 4}", f"b{n % 3}")
        rows += [(*row, 1000 - n)] + [(*row, 5000 + 10 * n + i) for i in range(200 if price == "9999.00" and n < 40 else n % 3)]
    made = spark.createDataFrame(rows, "asin string, title_x string, text string, rating string, price string, title_y string, brand string, row_id long")
    body = F.concat(F.lit("d"), F.length("text"))
    made = made.withColumn("details", body if details == "string" else F.create_map(F.lit("k"), body)).repartition(5)
    want, _ = clean.split_products_reviews(clean.clean_table(made), ["row_id"])
    monkeypatch.setattr(clean, "staged", lambda df, name: written.append(df.columns) or staged(df, name))
    got = clean.clean_products(made)
    assert got.columns == want.columns and got.count() > 30
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert written and not any({"text", "title_x"} & set(columns) for columns in written)


@pytest.mark.parametrize("bits", [16, 1])
def test_rows_without_an_equal_are_not_shuffled(spark, monkeypatch, bits):
    """Of the rows only those that may occur twice meet; NULL, -0.0, NaN, lists and maps compare as in a plain distinct."""
    met = []
    plain = clean.distinct_rows
    monkeypatch.setattr(clean, "distinct_rows", lambda df, order: met.append(df.count()) or plain(df, order))
    monkeypatch.setattr(clean, "BITS", bits)
    rng = np.random.default_rng(9)
    values = [(f"t{int(rng.integers(1 << 30))}", None if n % 3 else "x", [0.0, -0.0, float("nan"), None][n % 4], ["a", None][: n % 3], {"k": "v", "l": str(n % 2)}) for n in range(2000)]
    odd = [(None, "x", 0.0, [], {}), (None, "x", -0.0, [], {}), ("x", None, 0.0, [], {}), ("x", None, 0.0, [None], {}), ("x", None, float("nan"), None, None)]
    rows = [(*v, n) for n, v in enumerate([*values, *values[:100], *values[:50], *odd, *odd])]
    frame = spark.createDataFrame(rows, "a string, b string, c double, d array<string>, e map<string,string>, row_id long").repartition(5)
    want = plain(frame, "row_id")
    got = clean._distinct_written(frame, "row_id")
    assert got.columns == frame.columns
    assert sorted(r.row_id for r in got.collect()) == sorted(r.row_id for r in want.collect())
    assert 260 <= met[0] < (600 if bits == 16 else 2161)
    some = frame.select("a", "b", "c").distinct()
    assert clean._distinct_written(some, None).count() == some.count()
    assert clean._distinct_written(some.limit(0), None).count() == 0
