"""Words on Arrow buffers, keys that several owners hold, folded arrays, components."""

import random

import numpy as np
import pyarrow as pa
from conftest import WORD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalens.llm import blocks, components, shared_keys, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x85\U0001f600", max_size=12)), max_size=8), st.integers(0, 3))
def test_words_of_slices(texts, skip):
    column = pa.array(texts, pa.string())[skip:]
    texts = texts[skip:]
    found = words.split(column)
    own = [WORD.findall(t or "") for t in texts]
    got = [[found.word(i).decode() for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])]
    assert got == own
    assert found.characters().tolist() == [sum(map(len, w)) for w in own]
    assert [found.document(i).decode() for i in range(len(texts))] == [t or "" for t in texts]
    flat = [w for line in own for w in line]
    exact, lower = found.hashes(False), found.hashes(True)
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (exact[i] == exact[j]) == (a == b)
            assert (lower[i] == lower[j]) == (a.replace("A", "a") == b.replace("A", "a"))


def test_hash_of_a_word_does_not_depend_on_its_place(monkeypatch):
    random.seed(1)
    texts = [" ".join("".join(random.choice("abc") for _ in range(random.randrange(1, 40))) for _ in range(60)) for _ in range(20)]
    whole = words.split(pa.array(texts)).hashes(True)
    monkeypatch.setattr(words, "_CHUNK", 50)
    parts = [words.split(pa.array([t])).hashes(True) for t in texts]
    assert (whole == np.concatenate(parts)).all()


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 30, 3, 3, 3, 50)] + [None]})
    cut = list(words.slices(iter([batch, batch.slice(0, 0)]), limit=10))
    assert [r for b in cut for r in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(b.num_rows for b in cut) < 8


def test_shared_entries(spark):
    """Keys of one owner drop out, wherever their entries are; a hot key keeps all its entries."""
    random.seed(2)
    rows = [(i, f"{random.randrange(400)} 7 {random.randrange(10**9)} {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "owner long, text string").repartition(5)

    def entries(batch):
        owners = batch.column("owner").to_numpy()
        own = [(int(w), n, n + 5) for n, t in enumerate(batch.column("text").to_pylist()) for w in t.split()]
        keys, places, payloads = (np.array(x) for x in zip(*own))
        return keys.astype(np.uint64), places, payloads, owners

    got = shared_keys.shared_entries(docs, entries, slice_bytes=2_000).select("key", "owner").distinct().collect()
    held = {}
    for i, t in rows:
        for w in t.split():
            held.setdefault(int(w), set()).add(i)
    assert {(r["key"], r["owner"]) for r in got} == {(k, i) for k, owners in held.items() if len(owners) > 1 for i in owners}


def test_folded(spark):
    def run(batches):
        total = np.zeros(10, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("id").to_numpy() % 10, 1)
        yield blocks.cut(total, 3)

    found = blocks.folded(spark.range(0, 1005, 1, 7).mapInArrow(run, blocks.SCHEMA), np.add, np.int64)
    assert found.tolist() == [101] * 5 + [100] * 5
    assert blocks.folded(spark.range(0).select(F.lit(0).alias("block"), F.lit(b"").alias("data")), np.add, np.int64) is None


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
