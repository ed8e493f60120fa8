"""Neighbours by bands and the stored search index against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.operators import lsh, recommend, search_index, vectors
from catalens.operators.vectors import STOP_WORDS
from catalens.session import scratch_path


def _crowd(rng):
    """Sets with copies, a large group of near copies, and others of their own."""
    base = [f"b{k}" for k in range(40)]
    sets = [base] * 150
    sets += [base[:k] + [f"x{k}"] + base[k + 1 :] for k in range(40)] + [[*base, f"y{k}"] for k in range(120)]
    sets += [[f"z{v}" for v in rng.integers(0, 4000, 40)] for _ in range(150)]
    return [(i, list(dict.fromkeys(s))) for i, s in enumerate(sets)]


def _exact(rows, similarity, least, n=5):
    out = {}
    for i, a in rows:
        near = sorted(((-round(similarity(a, b), 9), j) for j, b in rows if j != i and a and b), key=lambda x: x)
        out[i] = [(j, -s) for s, j in near if -s >= least][:n]
    return out


def _table(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.item, []).append((r.rank, r.neighbour, r.similarity))
    return {i: [(j, s) for _, j, s in sorted(v)] for i, v in out.items()}


def _recall(got, want):
    pairs = sum(len(v) for v in want.values())
    # Of a crowd of equally near items any may be told.
    hits = sum(len([s for _, s in got.get(i, []) if s >= v[-1][1] - 1e-9][: len(v)]) for i, v in want.items() if v)
    return hits / pairs


def _jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def _cosine(a, b):
    return len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5


@pytest.mark.parametrize("max_bucket", [200, 15])
def test_neighbours_of_a_crowd(spark, max_bucket):
    rows = _crowd(np.random.default_rng(1))
    frame = spark.createDataFrame([*rows, (9000, []), (9001, None)], "id long, w array<string>").repartition(4)
    want = _exact(rows, _jaccard, 0.5)
    exact = _table(lsh.exact_sets(frame, "id", "w"))
    assert exact == {i: v for i, v in want.items() if v}
    got = _table(lsh.similar_sets_all(frame, "id", "w", max_bucket=max_bucket))
    assert _recall(got, want) >= 0.9
    truth = dict(rows)
    assert all(s == pytest.approx(_jaccard(truth[i], truth[j]), abs=1e-8) and i != j for i, v in got.items() for j, s in v)
    weights = frame.where("id < 9000").select("id", F.explode("w").alias("term"), (1 / F.sqrt(F.size("w"))).alias("weight"))
    got = _table(lsh.similar_all(weights, "id", max_bucket=max_bucket))
    assert _recall(got, _exact(rows, _cosine, 0.8)) >= 0.9
    assert all(s == pytest.approx(_cosine(truth[i], truth[j]), abs=1e-8) for i, v in got.items() for j, s in v)


def test_candidates_of_a_crowd_grow_in_proportion(spark):
    """One value that all keys share in all bands gives at most ``max_bucket`` partners a key and band."""
    bands = spark.range(2000).select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("band"), F.lit(1).cast("long").alias("value"), F.lit(2).cast("long").alias("fine"), F.xxhash64("id").alias("whole"))
    assert lsh.candidates(bands, "id", 50).count() <= 2 * 2000 * 50 / 2
    assert lsh.candidates(bands.limit(0), "id", 50).count() == 0


SHOP = "asin long, title string, brand string, price double, average_rating double"


def _shop(keys, word):
    return [(k, f"Common {word}{k % 7} item{k} {'rare' if k % 50 == 0 else ''}", f"B{k % 3}", float(k % 90), float(k % 5)) for k in keys]


def test_search_index_after_changes(spark):
    index = search_index.SearchIndex(scratch_path(spark, "index"), parts=4, stop_words=tuple(STOP_WORDS))
    rows = {r[0]: r for r in _shop(range(300), "old")}

    def same():
        plain = spark.createDataFrame([r for r in rows.values() if r[0] is not None], SHOP)
        for query, options in (
            ("common rare old3", {}),
            ("Rare nothing", {"sort_by": "price", "max_price": 80.0}),
            ("new1 old1 common", {"sort_by": "rating", "brands": ["B1"], "min_rating": 2.0, "limit": 7}),
            ("absent", {}),
        ):
            want = recommend.search(plain, "asin", query, **options).collect()
            assert search_index.search(spark, index, query, **options).collect() == want
        want = recommend.postings(plain, "asin", "title").collect()
        assert sorted(map(tuple, search_index.postings(spark, index).collect())) == sorted(map(tuple, want))

    def frame(some):
        return spark.createDataFrame(some, SHOP)

    search_index.create(spark, frame(list(rows.values())), index)
    same()
    new = _shop(range(250, 400), "new") + [(None, "common rare", "B0", 1.0, 1.0)]
    search_index.add(spark, frame(new), index)
    rows.update({r[0]: r for r in new if r[0] is not None})
    same()
    search_index.remove(spark, frame(_shop(range(100, 280), "")).select("asin"), index)
    for k in range(100, 280):
        rows.pop(k)
    same()
    back = _shop(range(120, 140), "new")
    search_index.add(spark, frame(back), index)
    rows.update({r[0]: r for r in back})
    same()
    # A change that died before its commit counts for nothing.
    frame(_shop(range(5), "ghost")).withColumn("slot", F.lit(0)).write.partitionBy("slot").parquet(f"{index.path}/items/segment=99")
    search_index.merge(spark, index)
    assert len(search_index.live_segments(spark, index)[1]) == 1
    same()
    search_index.create(spark, frame(_shop(range(10), "old")), index)
    rows = {r[0]: r for r in _shop(range(10), "old")}
    same()


def test_search_reads_the_buckets_of_its_words_only(spark):
    index = search_index.SearchIndex(scratch_path(spark, "index"), parts=16)
    search_index.create(spark, spark.createDataFrame(_shop(range(500), "old"), SHOP), index)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = search_index.search(spark, index, "rare", max_price=50.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "term#" in line)
    assert "bucket" in scan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "EqualTo(term,rare)" in scan and "LessThanOrEqual(price" in scan and "title" not in scan.partition("ReadSchema")[2]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8])
def test_bounded_candidates_lose_no_pair(spark, least):
    rng = np.random.default_rng(11)
    weights = np.where(rng.random((150, 40)) < 0.15 + 0.5 * (np.arange(40) < 3), rng.random((150, 40)), 0)
    weights[100:] = weights[:50] + 0.1 * rng.random((50, 40)) * (rng.random((50, 40)) < 0.2)
    weights[7] = 0
    weights[9] = weights[10]
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    unit = np.divide(weights, norms, out=np.zeros_like(weights), where=norms > 0)
    rows = [(int(i), f"t{t}", float(unit[i, t])) for i, t in zip(*np.nonzero(unit))]
    table = spark.createDataFrame(rows, "id int, term string, weight double").cache()
    cosines = unit @ unit.T
    near = {(i, j) for i, j in zip(*np.nonzero(cosines >= least)) if i != j}
    terms = vectors._split_terms(table, "id", least).cache()
    found = {(r.item, r.neighbour) for r in vectors.candidate_pairs(terms, "id", table, least).collect()}
    assert near and near <= found
    assert len(found) < ((cosines > 0).sum() - 150) / 2
    some = vectors.candidate_pairs(terms, "id", table.where("id < 20"), least).collect()
    assert {(r.item, r.neighbour) for r in some} == {(i, j) for i, j in found if i < 20}
    scored = vectors.similarity_table(table, "id", table, 200, least)
    told = {(r.item, r.neighbour): r.similarity for r in scored.collect()}
    assert set(told) == near
    assert all(abs(told[i, j] - cosines[i, j]) < 1e-8 for i, j in near)


def test_a_crowd_of_vectors_is_not_cut(spark):
    """Unlike vectors that are all near each other: no pair is lost to a full bucket."""
    rng = np.random.default_rng(3)
    made = 1 + rng.random((400, 30))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = [(i, f"t{j}", float(x)) for i, v in enumerate(made) for j, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "id long, term string, weight double")
    got = _table(lsh.similar_all(frame, "id", n=3, recall=0.9999, max_bucket=10))
    scores = np.round(made @ made.T, 6)
    np.fill_diagonal(scores, -1)
    for i in range(400):
        assert [round(s, 6) for _, s in got[i]] == pytest.approx(sorted(scores[i], reverse=True)[:3], abs=2e-6)


def test_postings_of_single_rows_are_not_shuffled(spark, monkeypatch):
    """Words are counted inside their row, in slices; only rows whose key repeats meet, with all their words and the largest stored fields."""
    monkeypatch.setattr(search_index, "SLICE_WORDS", 50)
    index = search_index.SearchIndex(scratch_path(spark, "index"), "k", "t", ("f",), parts=4, stop_words=("the",))
    rng = np.random.default_rng(4)
    names = ["zeta", "Ähre", "日本", "mid", "word_1", "the", "x1"]
    rows = [(k, " ".join(rng.choice(names, rng.integers(0, 40))), f"f{rng.integers(9)}") for k in range(200)]
    rows += [(200, None, "f1"), (201, "", None), (None, "zeta", "f1")]

    def wanted(some):
        tf, best = {}, {}
        for k, t, f in some:
            if k is not None:
                best[k] = max(best.get(k) or "", f or "") or None
                for w in (x for x in (t or "").lower().split() if x != "the"):
                    tf[w, k] = tf.get((w, k), 0) + 1
        return sorted((w, k, n, best[k]) for (w, k), n in tf.items())

    def postings(some):
        return search_index._rows(spark.createDataFrame(some, "k long, t string, f string"), index)[1]

    once = postings(rows)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, once.collect())) == wanted(rows)
    again = rows + [(k, "zeta mid mid fresh", f"f{k % 9}") for k in range(0, 50, 3)] * 3
    assert sorted(map(tuple, postings(again).collect())) == wanted(again)
    search_index.create(spark, spark.createDataFrame(again, "k long, t string, f string"), index)
    assert sorted(map(tuple, search_index.postings(spark, index).collect())) == [x[:3] for x in wanted(again)]
    files = {}
    for r in spark.read.parquet(f"{index.path}/postings").select(F.input_file_name().alias("file"), "term", F.monotonically_increasing_id().alias("at")).orderBy("at").collect():
        files.setdefault(r.file, []).append(r.term)
    assert all(found == sorted(found, key=str.encode) for found in files.values())
