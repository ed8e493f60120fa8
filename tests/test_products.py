"""Products of blocks against plain numpy, and what they write."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalens.operators import lsh, products, vectors


def _unit(rng, items, terms, share):
    weights = np.where(rng.random((items, terms)) < share, rng.random((items, terms)), 0)
    weights[5] = weights[6] = weights[items - 1]
    weights[8] = 0
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    return np.divide(weights, norms, out=np.zeros_like(weights), where=norms > 0)


def _rows(unit, name):
    return [(name(int(i)), f"t{t}", float(unit[i, t])) for i, t in zip(*np.nonzero(unit))]


@pytest.mark.parametrize("least", [0.0, 0.4])
@pytest.mark.parametrize("share", [0.02, 0.5])
def test_blocks_give_the_best_of_all_pairs(spark, monkeypatch, share, least):
    monkeypatch.setattr(products, "ASKED", 30)
    monkeypatch.setattr(products, "ALL", 50)
    unit = _unit(np.random.default_rng(3), 120, 60, share * np.linspace(2, 0.1, 60))
    rows = _rows(unit, lambda i: f"k{i}")
    frame = spark.createDataFrame([*rows, (None, "t1", 1.0), ("k1", None, 1.0)], "k string, term string, weight double")
    asked = spark.createDataFrame([(f"k{i}",) for i in range(0, 120, 3)] * 2, "k string")
    got = {}
    for r in vectors.similarity_table(frame, "k", asked, 4, least).collect():
        got.setdefault(r.item, []).append((r.rank, r.neighbour, r.similarity))
    cosines = np.round(unit @ unit.T, 9)
    met = ((unit > 0) @ (unit > 0).T.astype(int)) > 0
    want = {}
    for i in range(0, 120, 3):
        near = sorted((-cosines[i, j], f"k{j}") for j in range(120) if j != i and met[i, j] and cosines[i, j] >= least)[:4]
        if near:
            want[f"k{i}"] = [(n + 1, k, -s) for n, (s, k) in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("dense", [0, 5, 2048])
def test_pieces_of_a_product(monkeypatch, dense):
    for name, value in (("_SCORES", 500), ("_PARTS", 300), ("_DENSE", dense)):
        monkeypatch.setattr(products, name, value)
    unit = _unit(np.random.default_rng(5), 70, 40, 0.3 * np.linspace(2, 0.1, 40))

    def block(part):
        entries = [np.flatnonzero(row) for row in part]
        data = [np.array([len(e) for e in entries]), np.concatenate(entries), np.concatenate([row[e] for row, e in zip(part, entries)])]
        return products._Block(pa.array(range(len(part))), b"".join(x.tobytes() for x in data))

    own, other = block(unit[:50]), block(unit[20:])
    sides, spread = products._common(own, other)
    pieces = list(products._chunks(own, other, sides, spread))
    assert len(pieces) > 1
    wanted = unit[:50] @ unit[20:].T
    assert np.allclose(np.concatenate([scores for _, scores in pieces]), wanted, atol=1e-12)
    rows, places, scores = products._few(sides, len(other.keys))
    assert list(zip(rows, places)) == list(zip(*np.nonzero(wanted))) and np.allclose(scores, wanted[rows, places], atol=1e-12)


@pytest.mark.parametrize("sets", [False, True])
def test_no_pair_of_a_crowd_is_written(spark, monkeypatch, sets):
    """400 items that are all alike give written rows in proportion to the items, not to the pairs."""
    rng = np.random.default_rng(4)
    unit = 1 + 0.1 * rng.random((400, 6))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    frame = spark.createDataFrame(_rows(unit, int), "k int, term string, weight double").coalesce(2)
    words = spark.createDataFrame([(i, [*"abcdefgh", f"w{i}"]) for i in range(400)], "k int, w array<string>").coalesce(2)
    written = []
    for module in (vectors, products, lsh):
        plain = module.staged

        def counted(df, name, plain=plain):
            table = plain(df, name)
            written.append(table.count())
            return table

        monkeypatch.setattr(module, "staged", counted)
    found = lsh.exact_sets(words, "k", "w", 3, 0.5) if sets else vectors.similarity_table(frame, "k", frame, 3, 0.8)
    assert found.groupBy("item").agg(F.max("rank").alias("n")).where("n = 3").count() == 400
    assert sum(written) < 400 * 30


def test_tfidf_counts_texts_one_by_one(spark):
    """The terms and weights of plain counting, ties and repeated keys included; no term of a text is shuffled."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30)], rng.integers(0, 15))) for _ in range(80)] + ["w1 w2 w1 w2", "", None, "w3 ü3 w3"]
    rows = [(i % 70 if i else None, t) for i, t in enumerate(texts)]
    listed = [(k, (t or "").split()) for k, t in rows]
    listed = [(k, w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for k, w in ((k, [x for x in w if len(x) > 1]) for k, w in listed)]
    every = Counter(x for _, w in listed for x in w)
    for size in (1000, 40, 12, 3):
        kept = {t for t, _ in sorted(every.items(), key=lambda x: (-x[1], x[0].encode()))[:size]}
        found = {}
        for k, w in listed:
            found.setdefault(k, Counter()).update(x for x in w if x in kept)
        df = Counter(t for c in found.values() for t in c)
        want = {}
        for k, c in found.items():
            raw = {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
            want |= {(k, t): x / math.sqrt(sum(v * v for v in raw.values())) for t, x in raw.items()}
        made = vectors.tfidf(spark.createDataFrame(rows, "id int, t string").repartition(3), "id", "t", max_terms=size, stop_words=[])
        assert {(r.id, r.term): r.weight for r in made.collect()} == pytest.approx(want)
        assert not any(x in made._jdf.queryExecution().toString() for x in ("Exchange", "Window"))
    assert vectors.tfidf(spark.createDataFrame([], "id string, t string"), "id", "t").collect() == []
