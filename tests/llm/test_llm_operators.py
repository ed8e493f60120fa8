"""Each operator on odd documents against a plain restatement, and on an empty table."""

import base64
import collections
import math
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import words  # tests/llm/conftest.py
from pyspark.sql import functions as F

from catalens.llm import (
    byte_bpe,
    components,
    decontamination,
    fertility,
    language_model,
    license_scan,
    line_dedup,
    ngram_join,
    quality_classifier,
    sharding,
    substring_dedup,
)
from catalens.operators.vectors import STOP_WORDS

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FERTILITY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


def test_sharding(odd, odd_rows, empty):
    rows = sharding.shard_by_bytes(odd, 4, bucket_groups=40).collect()
    assert len(rows) == len(odd_rows)
    shard_of = {}
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    wanted = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in odd_rows)
    assert sorted((r.size, r.text_crc32) for r in rows) == wanted
    # One text is larger than a fair share and stands alone; the other shards are level.
    groups = collections.Counter()
    for r in rows:
        groups[r.size, r.text_crc32] += r.size
    *level, top = sorted(size.values())
    assert top == max(groups.values()) and max(level) <= 1.01 * min(level)
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_differencing_is_tight():
    random.seed(1)
    sizes = [random.randrange(1, 10_000) for _ in range(3000)]
    slots = [row[0] for row in sharding.differencing([[s] + [0] * 7 for s in sizes])]
    sums = np.bincount(slots, sizes, minlength=8)
    assert sums.max() - sums.min() <= 10
    assert sharding.differencing([[5, 0]]) in ([[0, -1]], [[1, -1]])


def _components(sets):
    """Smallest id reachable by links, by comparing all pairs."""
    ids = list(sets)
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                head[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def _shingles(text, width=5):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def test_ngram_join(odd, odd_rows, empty):
    rows = ngram_join.link_documents(odd).collect()
    assert len(rows) == len(odd_rows)
    sets = {i: _shingles(t) for i, t in odd_rows}
    heads = _components({i: s for i, s in sets.items() if i is not None})
    for r in rows:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else heads[r.doc_id])
    assert heads[900_005] == heads[900_006] == 900_004 and heads[900_009] == 900_008
    assert ngram_join.link_documents(empty).count() == 0


def test_ngram_join_in_small_chunks(spark):
    """Chains and groups of near copies, with blocks cut into pairs of chunks."""
    random.seed(5)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for _ in range(25):
            copy = list(base)
            for at in random.sample(range(60), random.randrange(0, 4)):
                copy[at] = f"x{random.randrange(10_000)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = ngram_join.class_links(docs, chunk=7)
    described = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(ngram_join._describe(5), "doc_id long, text_hash long, n long, class long")
    joined = described.join(components.components(links), F.col("class") == F.col("node"), "left").collect()
    heads = _components({i: _shingles(t) for i, t in rows})
    found = {r.doc_id: r.component if r.component is not None else r["class"] for r in joined}
    for a in heads:
        for b in heads:
            assert (heads[a] == heads[b]) == (found[a] == found[b])


def test_signature_tree_keeps_every_link():
    random.seed(2)
    sets = []
    for _ in range(40):
        base = np.unique(np.array([random.getrandbits(64) for _ in range(random.randrange(20, 90))], np.uint64))
        for _ in range(5):
            keep = base[np.array([random.random() > 0.06 for _ in base])]
            sets.append(np.unique(np.append(keep, np.array([random.getrandbits(64) for _ in range(2)], np.uint64))))
    sizes = np.array([len(s) for s in sets])
    bits = np.stack([np.frombuffer(ngram_join._bitmap(s), np.uint64)[:4] if len(ngram_join._bitmap(s)) == 32 else ngram_join._fold(np.frombuffer(ngram_join._bitmap(s), np.uint64)[None], 4)[0] for s in sets])
    tree = ngram_join.SignatureTree(sizes, bits)
    found = {(min(a, b), max(a, b)) for x, y, _ in ngram_join.traverse(tree, tree) for a, b in zip(x.tolist(), y.tolist()) if a != b}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found
    assert len(found) < 40 * 30


def test_decontamination(spark, odd, empty):
    random.seed(4)
    item = [f"q{i}" for i in range(30)]
    changed = list(item)
    changed[7], changed[15] = "not", "it"
    cut = item[5:24]
    short = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, " ".join(short)), (4, "of the"), (5, None), (6, "")], "item_id long, text string")
    filler = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame(
        [
            (1, " ".join(filler[:50] + item + filler[50:])),
            (2, ", ".join(filler[:9] + changed).upper()),
            (3, " ".join(filler + cut)),
            (4, " ".join(filler[:3] + short + filler[3:9])),
            (5, " ".join(filler)),
            (6, "of the"),
            (7, " ".join(item[:8] + filler + item[20:27])),
            (7, " ".join(item[:8] + filler + item[20:27])),
            (None, " ".join(item)),
        ],
        "doc_id long, text string",
    )
    rows = decontamination.find_overlaps(docs, bench).collect()
    found = {(r.doc_id, r.item_id): (r.doc_word, r.item_word, r.n_words, r.n_equal) for r in rows}
    assert len(found) == len(rows)
    wanted = {(1, 1): (50, 0, 30, 30), (2, 1): (9, 0, 30, 28), (3, 1): (200, 5, 19, 19), (4, 3): (3, 0, 6, 6), (None, 1): (0, 0, 30, 30)}
    wanted |= {(i, 2): x for (i, j), x in wanted.items() if j == 1}
    assert found == wanted
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()) == [5, 6, 7, 7]
    assert decontamination.find_overlaps(odd, bench).count() == 0
    assert decontamination.find_overlaps(empty, bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


def _plain_lines(rows):
    keys = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
                if len(key) >= 20:
                    keys[key].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := keys[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})]) < 3 or i == max(h)]
        out.append((i or -1, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(odd, odd_rows, empty):
    kept = line_dedup.dedup_lines(odd)
    assert set(odd.columns) <= set(kept.columns)
    rows = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.text or "") for r in kept.collect())
    assert rows == _plain_lines(odd_rows)
    assert any(r[2] for r in rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_byte_bpe(odd, odd_rows, empty):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decoded = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS)
    assert set(odd.columns) <= set(decoded.columns)
    rows = collections.defaultdict(set)
    for r in decoded.collect():
        rows[r.doc_id].add((bytes(r.ids), r.n_tokens, bytes(r.decoded)))
    for i, t in odd_rows:
        ids = library.encode_ordinary(t or "")
        assert rows[i] == {(np.array(ids, "<u4").tobytes(), len(ids), (t or "").encode())}
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_merges_like_the_library():
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.rank, special_tokens={})
    random.seed(6)
    texts = ["".join(random.choice("etaoin 's1\n\té　\U0001f600") for _ in range(random.randrange(120))) for _ in range(400)]
    texts += ["".join(random.choice("etaoinsh") for _ in range(n)) for n in (31, 32, 33, 255, 256, 257, 900)] + [" ", "  a", "a  ", "\n a b"]
    for text, ids in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_language_model(odd, odd_rows, empty):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = language_model.score(odd, ~held_out).collect()
    assert len(rows) == len(odd_rows)
    text_of = dict(odd_rows)
    tokens = {i: [*words(t, lower=True), None] for i, t in odd_rows}
    counts = collections.Counter()
    for i, t in odd_rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(t, lower=True), None])
    total = sum(counts.values())
    base = math.log10(total + 0.1 * (len(counts) + 1))
    for r in rows:
        own = tokens[r.doc_id]
        assert r.learnt == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 != 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) for w in own) - len(own) * base)
    outside = [r for r in rows if not r.learnt and len(text_of[r.doc_id] or "") > 200]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)
    assert language_model.score(empty, ~held_out).count() == 0


def test_language_model_is_a_distribution(odd):
    """Over all symbols the probabilities of any context sum to 1."""
    shape = language_model.Shape(rounds=1)
    docs = language_model.pack(odd.select("doc_id", "text", F.lit(True).alias("learnt")))
    counts = language_model.count_words(docs, shape)[1]
    weights = language_model.train(docs, counts, shape)
    symbols = np.arange(len(counts.symbol_keys) + 1)
    context = np.array([[1, 2, 3, 4]], np.uint64)
    logs = language_model._log_probability(np.repeat(context, len(symbols), 0), symbols, counts, weights)
    assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_fertility(odd, odd_rows, empty):
    found = fertility.fertility_rules(odd, *FERTILITY)
    assert set(odd.columns) <= set(found.columns)
    rows = collections.defaultdict(list)
    for r in found.collect():
        rows[r.doc_id].append(r)
    for i, t in odd_rows:
        own = words(t)
        grams = collections.Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
        covered = {k + j for k in range(len(own) - 2) if grams[tuple(own[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        for r in rows[i]:
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(own), sum(map(len, own)), len(covered))
            assert (r.n_symbols, r.n_dup_lines) == (sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
            assert r.base_failed == (len(own) < 50 or 100 * len(covered) > 50 * len(own))
            assert not (r.base_failed and r.kept)
    assert fertility.fertility_rules(empty, *FERTILITY).count() == 0


def test_fertility_bands(spark):
    """Random bytes and text of foreign scripts under an English label fall outside the band."""
    random.seed(8)
    nouns = "river hills towns people morning work road bridge market stone house garden window letter bread winter harvest music ship cloud forest paper".split()
    prose = " ".join(random.choice(STOP_WORDS + nouns * 3) for _ in range(300))
    noise = " ".join("".join(random.choice("0123456789abcdef$%&") for _ in range(12)) for _ in range(200))
    kana = " ".join("".join(chr(random.randrange(0x3041, 0x3090)) for _ in range(6)) for _ in range(200))
    docs = spark.createDataFrame([(1, prose, "en"), (2, noise, "en"), (3, kana, "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.fertility_rules(docs, *FERTILITY).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_quality_classifier(spark, odd, empty, folder):
    labels = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality_classifier.fit(docs, labels, fold != 0)
    scored = quality_classifier.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(fold == 0).collect()
    assert len(scored) > 30
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in scored) >= 0.9 * len(scored)
    rows = quality_classifier.score(odd, model)
    assert set(odd.columns) <= set(rows.columns)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.collect())
    assert quality_classifier.score(empty, model).count() == 0
    blind = quality_classifier.fit(empty, labels.limit(0), fold != 0)
    assert {r.score for r in quality_classifier.score(docs.limit(5), blind).collect()} == {0.5}


def test_license_scan(spark, odd, odd_rows, empty):
    notices = [(n, f"{odd_rows[n][1]}\n{text}\nmore of it") for n, text in enumerate(("Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "licensed under CC BY-NC 4.0"))]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(950_000 + n, t) for n, t in notices], "doc_id long, text string"))
    scanner = license_scan.train(docs)
    rows = license_scan.scan(docs, scanner).collect()
    assert len(rows) == len(odd_rows) + 3
    families = {r.doc_id: r.families for r in rows}
    assert [families[950_000 + n] for n in range(3)] == [["Apache-2.0"], ["MIT"], ["CC-BY-NC-4.0"]]
    named = {i for i, t in odd_rows if "icense" in (t or "")}
    assert all(bool(families[i]) == (i in named) for i, _ in odd_rows)
    lines = {i: len((t or "").split("\n")) for i, t in odd_rows}
    assert all(r.n_paragraphs == lines[r.doc_id] for r in rows if r.doc_id in lines)
    assert license_scan.scan(empty, scanner).count() == 0


@pytest.fixture(scope="module")
def scanner(odd):
    return license_scan.train(odd.select("doc_id", "text"))


@pytest.mark.parametrize("columns", [40, 60, 72])
def test_license_scan_finds_wrapped_notices(spark, odd, odd_rows, scanner, columns):
    """Templates of several lines, as they are and as comments after code, are found nine times of ten."""
    plain = [t for i, t in odd_rows if t and "icense" not in t and "\n" not in t.strip()][:2]
    wrapped = {(f, t): textwrap.wrap(t, columns) for f, ts in license_scan.TEMPLATES.items() for t in ts}
    wrapped = {k: v for k, v in wrapped.items() if len(v) > 1}
    rows, wanted = [], []
    for (family, _), lines in wrapped.items():
        for start, text in ((0, "\n".join(lines)), (2, "import os\n\n" + "\n".join(f"# {x}" for x in lines) + "\n\n" + plain[0])):
            wanted.append((family, range(start, start + len(lines))))
            rows.append((len(rows), text))
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    right = sum(wanted[i][0] in found[i].families for i in found)
    assert right >= 0.9 * len(rows), (right, len(rows))
    # A notice lies in its run, at the first line if no line has it alone.
    assert all(n.position in wanted[i][1] for i, r in found.items() for n in r.notices)
    assert not any(r.families for r in license_scan.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"), scanner).collect())


def test_license_paragraphs_against_plain_runs(spark):
    long = "x" * (license_scan.WRAPPED + 1)
    texts = ["", "a", "a\nb", "a\n\nb", f"a\nb\n{long}\nc\n \nd\ne\nf", f"{long}\n{long}", "\n\n", "a\nb\n"]
    wanted = []
    for i, text in enumerate(texts):
        lines = text.split("\n")
        wanted += [(i, k, 1, line) for k, line in enumerate(lines) if line]
        k = 0
        while k < len(lines):
            n = k
            while n < len(lines) and lines[n].strip() and len(lines[n]) <= license_scan.WRAPPED:
                n += 1
            if n - k > 1:
                wanted.append((i, k, n - k, " ".join(lines[k:n])))
            k = max(n, k + 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert sorted(tuple(r) for r in license_scan._paragraphs(docs).collect()) == sorted(wanted)


def _plain_repeats(rows, width=13):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        own = words(t)
        for k in range(len(own) - width + 1):
            first.setdefault(tuple(own[k : k + width]), i)
    out = []
    for i, t in rows:
        own = words(t)
        gone = [False] * len(own)
        for k in range(len(own) - width + 1):
            if i is not None and first[tuple(own[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i or -1, len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("split", [200_000, 2])
def test_substring_dedup(odd, odd_rows, empty, split):
    rows = [(r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(odd, shard_segments=split).collect()]
    assert sorted(rows) == _plain_repeats([(i, t or "") for i, t in odd_rows])
    assert any(r[2] for r in rows)
    assert split == 2 or substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("width", [5, 14, 20, 33, 50])
def test_substring_dedup_of_other_widths(spark, width):
    random.seed(width)
    shared = [" ".join(f"w{random.randrange(3)}" for _ in range(120)) for _ in range(4)]
    rows = []
    for i in range(60):
        part = random.choice(shared).split(" ")
        at = random.randrange(60)
        rows.append((i, " ".join([f"a{random.randrange(3)}" for _ in range(30)] + part[at : at + 60] + [f"b{random.randrange(3)}" for _ in range(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, width=width).collect()]
    assert sorted(found) == _plain_repeats(rows, width)
    assert any(r[2] for r in found)


CLASHING = ["__id", "__hash", "__drop", "__lines", "__text_hash", "__text", "__row", "_id", "_hash", "_ROW", "_place", "_drop", "_lines", "_text_hash"]


def test_columns_with_names_of_our_own(spark, odd):
    """Columns named as temporary ones come through every operator that returns the whole table."""
    docs = odd.select("doc_id", "text", *[F.lit(f"value {c}").alias(c) for c in CLASHING if c != "_ROW"], F.lit("row").alias("_ROW"))
    bench = spark.createDataFrame([(1, "a shared line of some length that no document has at all, not one of them")], "item_id long, text string")
    for done in (line_dedup.dedup_lines(docs), decontamination.drop_contaminated(docs, bench), ngram_join.keep_heads(docs)):
        assert done.columns[: len(docs.columns)] == docs.columns
        values = done.select([c for c in docs.columns if c not in ("doc_id", "text")]).distinct().collect()
        assert [tuple(v) for v in values] == [(*(f"value {c}" for c in CLASHING if c != "_ROW"), "row")]


def test_of_repeated_rows_the_first_stays(spark):
    rows = [(1, "one text of a few words here", c) for c in ("z", "b", None, "a")] + [(2, "another text that nobody else has", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    kept = {(r.doc_id, r.n_chars) for k in (1, 4) for r in ngram_join.keep_heads(docs.repartition(k)).collect()}
    assert kept == {(1, "a"), (2, "x")}


def test_fm_index_counts_like_a_scan():
    random.seed(9)
    symbols = np.array([random.randrange(1, 4) if random.random() > 0.05 else 0 for _ in range(600)] + [0])
    index = substring_dedup.FMIndex(symbols, 3, 16)
    for _ in range(200):
        pattern = [random.randrange(1, 4) for _ in range(random.randrange(1, 8))]
        low, high = np.array([0]), np.array([len(symbols)])
        for c in reversed(pattern):
            low, high = index.extend(np.array([c]), low, high)
        wanted = sum(symbols[i : i + len(pattern)].tolist() == pattern for i in range(len(symbols)))
        assert high[0] - low[0] == wanted


