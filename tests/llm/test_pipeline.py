"""The pipeline's stages one after another against what each of them is to do."""

import pytest
from conftest import frame, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from catalens.session import staged
from test_llm_operators import _components, _plain_lines, _shingles


@pytest.fixture(scope="module")
def steps(spark, folder, odd_rows):
    """The rows each stage gets and returns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = frame(spark, odd_rows).where("doc_id > 900000 OR doc_id IS NULL").select(docs.columns)
    docs = docs.unionByName(extra).withColumn("__extra", F.lit("x"))
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        out[name] = docs
    return out


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(steps):
    names = list(steps)
    assert names[1:] == ["quality_classifier", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]
    assert all(steps[n].columns == steps["start"].columns for n in names[:-1])


def test_quality_keeps_good_documents(spark, steps, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {i for i, _ in _rows(steps["quality_classifier"])}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_lines(steps):
    got = sorted((i or -1, t or "") for i, t in _rows(steps["line_dedup"]))
    assert got == sorted((i, t) for i, _, _, t in _plain_lines(_rows(steps["quality_classifier"])))
    assert all(r.n_chars == len(r.text or "") for r in steps["line_dedup"].collect())


def test_one_of_each_group_stays(steps):
    before = _rows(steps["line_dedup"])
    heads = _components({i: _shingles(t) for i, t in before if i is not None})
    wanted = sorted([(i, t) for i, t in set(before) if i is not None and heads[i] == i], key=str)
    wanted += [(i, t) for i, t in before if i is None]
    assert sorted(_rows(steps["ngram_join"]), key=str) == sorted(wanted, key=str)


def test_no_benchmark_passage_stays(spark, steps, folder):
    items = [words(r.text, lower=True) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 13]) for w in items for k in range(len(w) - 12)}

    def holds(text):
        w = words(text, lower=True)
        return any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))

    before, after = _rows(steps["ngram_join"]), _rows(steps["decontamination"])
    assert not any(holds(t) for _, t in after)
    assert set(after) >= {(i, t) for i, t in before if not holds(t)}


def test_tokens_decode(steps):
    rows = steps["byte_bpe"].collect()
    assert len(rows) == steps["decontamination"].count()
    assert all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in rows)


def test_registered():
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in entry.queries()}
