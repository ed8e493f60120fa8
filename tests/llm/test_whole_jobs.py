"""What the operators promise, against brute force over every case it allows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from catalens.llm import decontamination, language_model, license_scan


def _found(rows):
    return {(r.doc_id, r.item_id): (r.doc_word, r.item_word, r.n_words, r.n_equal) for r in rows}


def _longest_qualifying(equal, need, share):
    """(equal words, -words) of the best run, by trying all."""
    runs = [(sum(equal[a:b]), a - b) for a in range(len(equal)) for b in range(a + need, len(equal) + 1) if sum(equal[a:b]) >= share * (b - a)]
    return max(runs, default=None)


def test_every_allowed_pattern_holds_a_seed():
    for n in range(5, 24):
        masks = decontamination.MASKS if n >= 12 else decontamination.SHORT_MASKS
        places = [{k + at for k, bit in enumerate(m) if bit == "1"} for m in masks for at in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n // 4):
            assert any(p.isdisjoint(changed) for p in places), (n, changed)


def test_best_run_against_all_runs():
    random.seed(9)
    for _ in range(3000):
        equal = np.array([random.random() < random.choice((0.6, 0.75, 0.9)) for _ in range(random.randrange(1, 40))])
        need, share = random.choice((5, 12)), random.choice((0.75, 0.8, 0.9))
        run = decontamination.best_run(equal, need, share)
        wanted = _longest_qualifying(equal.tolist(), need, share)
        assert (run and (int(equal[run[0] : run[1]].sum()), run[0] - run[1])) == wanted


def test_decontamination_finds_changed_items(spark):
    """Items of 5 to 20 words with up to a quarter of the words changed, at every place or at drawn ones."""
    random.seed(6)
    items, docs, lost = [], [], []
    for n in range(5, 21):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for count in range(1, n // 4 + 2):
            patterns = list(itertools.combinations(range(n), count))
            for changed in random.sample(patterns, min(len(patterns), 150)):
                text = ["x%d" % random.randrange(10**9) if k in changed else w for k, w in enumerate(item)]
                around = [[f"d{random.randrange(10**9)}" for _ in range(random.randrange(9))] for _ in range(2)]
                equal = [False] * len(around[0]) + [k not in changed for k in range(n)] + [False] * len(around[1])
                best = _longest_qualifying(equal[len(around[0]) : len(around[0]) + n], min(12, n), 0.75)
                lost.append((len(docs), n, best))
                docs.append((len(docs), " ".join(around[0] + text + around[1])))
    rows = decontamination.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {k: (v[3], -v[2]) for k, v in _found(rows).items()}
    assert found == {(i, n): best for i, n, best in lost if best}


def test_decontamination_regions_follow_the_items_hit():
    """A place carries the words that its own items can cover, however long another item is."""
    rng = np.random.default_rng(5)
    items = {1: rng.integers(0, 1 << 62, 20).astype(np.uint64), 2: rng.integers(0, 1 << 62, 5000).astype(np.uint64)}
    masks = decontamination._masks(12, 0.75)
    batch = pa.RecordBatch.from_pydict({"item": list(items), "tokens": [t.tobytes() for t in items.values()]})
    seeds = pa.Table.from_batches(decontamination._seed_rows(masks)([batch]))
    assert set(seeds.column_names) == {"seed", "item", "item_at", "n_words"}
    bits = decontamination.filter_size(len(seeds))
    assert len(seeds) * decontamination.SLOTS <= 1 << bits
    (cut,) = decontamination._filters(bits)(seeds.to_batches())
    table = np.concatenate([np.frombuffer(x, np.uint8) for x in cut.column("data").to_pylist()])
    for number in (1, 2):
        own = seeds.filter(pa.compute.equal(seeds.column("item"), number)).column("seed").to_numpy().view(np.uint64)
        level = np.minimum(*(table[place] for place in decontamination._places(own, bits)))
        assert (1 << (level.astype(int) - 1) >= len(items[number])).all()
        assert np.mean(1 << (level.astype(int) - 1) < 2 * len(items[number])) > 0.9
    assert decontamination.filter_size(0) == decontamination.LEAST_BITS
    assert decontamination.filter_size(10**12) == decontamination.MOST_BITS


def test_decontamination_of_short_and_very_long_items(spark):
    """Items of 6 to 3,000 words in one text, near each other and overlapping the text's ends, are found with their places."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    items = [word(n) for n in (6, 13, 20, 40, 300, 3000)]
    parts, places = word(3), []
    for item in (items[0], items[1], items[2], items[1], items[4], items[5], items[3], items[0]):
        places.append(len(parts))
        parts += item + word(int(rng.integers(0, 15)))
    docs = spark.createDataFrame([(1, " ".join(parts)), (2, " ".join(items[5][100:2000])), (3, " ".join(items[4][-12:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.doc_word, r.item_word, r.n_words, r.n_equal) for r in decontamination.find_overlaps(docs, bench).collect()}
    assert set(got) == {(1, i) for i in range(6)} | {(2, 5), (3, 4)}
    for item, place in ((0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (3, 6)):
        assert got[1, item] == (places[place], 0, len(items[item]), len(items[item]))
    assert got[2, 5] == (0, 100, 1900, 1900)
    assert got[3, 4] == (0, 288, 12, 12)


def test_decontamination_with_looser_parameters(spark):
    item = [f"w{k}" for k in range(20)]
    changed = [f"x{k}" if k % 3 == 2 else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontamination.find_overlaps(docs, bench).count() == 0
    assert _found(decontamination.find_overlaps(docs, bench, min_share=0.65).collect()) == {(1, 1): (0, 0, 20, 14)}
    with pytest.raises(ValueError):
        decontamination.find_overlaps(docs, bench, min_share=0.0)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_language_model_trains_on_every_position(spark, monkeypatch, rounds):
    """Each token of each text gives one gradient over all rounds, short texts and beginnings like any other."""
    taken = []
    steps = language_model._steps
    monkeypatch.setattr(language_model, "_steps", lambda features, symbols, *rest: taken.append(len(symbols)) or steps(features, symbols, *rest))

    class Frame:
        """Runs the training function in this process, to see what it takes."""

        def __init__(self, text):
            rows = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array([0] * len(text)), pa.array([True] * len(text)), pa.array(text)], ["doc_id", "text_hash", "learnt", "text"])
            self.sparkSession, (self.batch,) = spark, language_model._pack(iter([rows]))

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter([self.batch])))

    monkeypatch.setattr(language_model.blocks, "folded", lambda parts, *_: np.concatenate([np.frombuffer(x, np.float32) for b in parts for x in b.column("data").to_pylist()]))
    texts = ["a b c d e f g", "x y", None, " ".join(f"w{i}" for i in range(50))]
    shape = language_model.Shape(rounds=rounds)
    counts = language_model.count_words(language_model.pack(spark.createDataFrame([(n, t, True) for n, t in enumerate(texts)], "doc_id long, text string, learnt boolean")), shape)[1]
    language_model.train(Frame(texts), counts, shape)
    assert sum(taken) == counts.tokens == 8 + 3 + 1 + 51


def test_language_model_learns_the_middle_of_short_texts(spark):
    """A pair of words at the third and fourth place only is learnt."""
    random.seed(3)
    rows = []
    for n in range(3000):
        kind = n % 2
        rows.append((n, f"{random.choice('abcdefgh')} {random.choice('abcdefgh')} {('left', 'right')[kind]} {('port', 'starboard')[kind]} {random.choice('abcdefgh')}"))
    docs = spark.createDataFrame([*rows, (9001, "a b left port c"), (9002, "a b left starboard c")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in language_model.score(docs, F.col("doc_id") < 9000).where("doc_id > 9000").collect()}
    assert found[9001] - found[9002] > 0.1


def test_license_scan_finds_notices_inside_long_lines(spark, odd):
    random.seed(12)
    words = sorted({w for r in odd.where("doc_id < 900000").select("text").limit(60).collect() for w in (r.text or "").lower().split() if w.isalpha()})
    words = [w for w in words if "licen" not in w]
    rows, wanted = [], {}
    for n in (20, 200, 20_000):
        for family in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"):
            for place in (0.0, 0.37, 0.5, 1.0):
                around = [random.choice(words) for _ in range(n)]
                at = int(place * n)
                wanted[len(rows)] = [family]
                rows.append((len(rows), " ".join([*around[:at], license_scan.TEMPLATES[family][0], *around[at:]])))
        wanted[len(rows)] = []
        rows.append((len(rows), " ".join(random.choice(words) for _ in range(n))))
    scanner = license_scan.train(odd)
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()
    assert {r.doc_id: r.families for r in found} == wanted
    assert all(r.n_paragraphs == 1 and r.n_license == len(wanted[r.doc_id]) for r in found)


def test_license_training_counts_every_window(spark, odd, monkeypatch):
    """Every window of every text with an id is counted, none is sampled."""
    tables = {}
    staged = license_scan.staged
    monkeypatch.setattr(license_scan, "staged", lambda df, name: tables.setdefault(name, staged(df, name)))
    license_scan.train(odd)
    body = odd.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    sizes = license_scan._paragraphs(body).select(F.size(license_scan.tokens(F.col("line"))).alias("w")).collect()
    step = license_scan.SPAN - license_scan.SHARED
    wanted = sum(1 + -(-max(r.w - license_scan.SPAN, 0) // step) for r in sizes)
    assert tables["licence-sets"].agg(F.sum("n")).first()[0] == wanted > 4_000


def test_all_other_words_need_one_softmax(spark):
    """The symbol of most words is alone in its class, beside 1,023 words with a symbol of their own."""
    text = " ".join(f"w{n} " * (1 + n % 3) for n in range(3000))
    counts = language_model.count_words(language_model.pack(spark.createDataFrame([(1, text, True)], "doc_id long, text string, learnt boolean")), language_model.Shape())[1]
    assert len(counts.symbol_keys) == 1023
    assert np.isfinite(counts.member_bias[1023 // language_model.MEMBERS]).sum() == 1
    known = np.append(counts.keys, np.uint64(7))
    assert (language_model._symbols(known, counts) == language_model._symbols_and_places(known, counts)[0]).all()


@pytest.mark.parametrize("shift", [0, 300, -300])
def test_softmax_of_scores_beyond_floats(shift):
    scores = (np.random.default_rng(2).normal(size=(50, 33)) * 3 + shift).astype(np.float32)
    wanted = scores.astype(float)
    wanted -= wanted.max(1, keepdims=True)
    wanted = np.exp(wanted) / np.exp(wanted).sum(1, keepdims=True)
    found, total = language_model._exponentials(scores)
    assert found / total[:, None] == pytest.approx(wanted, abs=1e-4)
    assert language_model._log_target(scores, np.zeros(50, int)) == pytest.approx(np.log(wanted[:, 0]), abs=1e-3)


def _with_rare_pairs(spark):
    """1,100 frequent words, and two rarer ones of equal counts, of which each stands after a word of its own and before any."""
    random.seed(5)
    filler = [f"f{n}" for n in range(1100)]
    rows = []
    for n in range(5000):
        text = random.choices(filler, k=60)
        text[20:20] = [("f1", "port"), ("f2", "starboard")][n % 2] if n < 400 else ()
        rows.append((n, " ".join(text)))
    random.shuffle(rows)
    rows += [(k + n, f"{pair} f{9 * n}") for k, pair in ((9000, "f1 port"), (9200, "f1 starboard")) for n in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("frequent", [1 << 20, 1330])
def test_words_without_a_symbol_are_told_apart_by_context(spark, frequent):
    """Beyond the 1,023 words with a symbol, too, what stands before a word counts; whether its count is at the tasks or comes by a join."""
    docs = _with_rare_pairs(spark)
    kind = F.col("doc_id") < 9200
    rows = language_model.score(docs, F.col("doc_id") < 9000, language_model.Shape(frequent=frequent)).where("doc_id >= 9000").groupBy(kind.alias("own")).agg(F.avg("score").alias("score")).collect()
    found = {r.own: r.score for r in rows}
    assert found[True] - found[False] > 0.05


def test_turns_of_other_words_are_a_distribution(spark):
    """The shares of all other known words sum to 1 in any context, by their counts alone and after training."""
    docs = language_model.pack(_with_rare_pairs(spark).withColumn("learnt", F.lit(True)))
    shape = language_model.Shape()
    counts = language_model.count_words(docs, shape)[1]
    weights = language_model.train(docs, counts, shape)
    other = counts.symbol == len(counts.symbol_keys)
    keys, shares = counts.keys[other], counts.counts[other] + language_model.SMOOTH
    assert len(keys) == counts.other_distinct > 70 and np.abs(weights.cells).sum() > 0
    for context in ([1, 2, 3, 4], [5, 6, 7, 8]):
        gains = language_model._gains(np.repeat(np.array([context], np.uint64), len(keys), 0), keys, counts, weights)
        assert np.abs(gains).max() > 0
        assert (10**gains * shares).sum() / shares.sum() == pytest.approx(1, abs=1e-4)
