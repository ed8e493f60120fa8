"""Source divergence, cross-tokenizer alignment and archives against plain restatements."""

import bisect
import collections
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalens.llm import cross_tokenizer, galloping, source_divergence, warc
from catalens.session import scratch_path

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("size", [0, 1, 5, 64, 65, 1000])
def test_galloping(size):
    rng = np.random.default_rng(size)
    b = np.unique(rng.integers(0, 5000, 3000))
    for a in (np.unique(rng.integers(0, 5000, size)), np.arange(size), 4990 + np.arange(size)):
        for x, y in ((a, b), (b, a)):
            i, j = galloping.common(x, y)
            assert x[i].tolist() == y[j].tolist() == np.intersect1d(x, y).tolist()
        low = np.zeros(len(a), np.int64)
        assert galloping.gallop(a, b, low, low + len(b)).tolist() == [bisect.bisect_left(b.tolist(), v) for v in a.tolist()]


# --- source divergence ---------------------------------------------------------


def _letters(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def _divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", collections.Counter(_letters(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in d[2])
        kept = sorted((t for t in seen if seen[t] >= min_docs), key=str.encode)
        count = collections.defaultdict(collections.Counter)
        for _, source, terms in mine:
            for t in kept:
                count[source][t] += terms[t]
        whole = collections.Counter()
        for c in count.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        sources = {d[1] for d in mine}
        p = {s: shares(count[s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pair = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            term = [(-((a - b) ** 2 // (a + b)), t) for a, b, t in zip(p[s], q, kept) if count[s][t] and a > b]
            for part, items in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, o, -v, k) for k, (v, o) in enumerate(items, 1)]
    return sorted(out)


def _sources(spark, rows):
    data = [(i, t, lang, s, i, 0.5, "p", "v", 1) for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, value long, rank double, part string, item string, total int").repartition(5)


def test_source_divergence(spark, odd_rows):
    random.seed(5)
    rows = [(t, random.choice(["en", "de"]), random.choice(["a", "a", "a", "b", "ä", None])) for _, t in odd_rows]
    rows += [(f"alone {k} only", "xx", "one") for k in range(3)] + [("few words", "yy", s) for s in "ab"] + [(None, None, None), ("", "en", "silent"), ("tie ZÉ. tie zé!\0nul", None, "b")] * 4
    for min_docs, bucket in ((3, 20_000), (10, 10**9)):
        got = source_divergence.source_divergence(_sources(spark, rows), min_docs, 10, bucket)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == _divergence(rows, min_docs, 10)


def test_source_divergence_of_hot_source_and_empty(spark):
    random.seed(6)
    rows = [(" ".join(f"{random.choice('abcdefgh')}{random.choice('xyz')}" for _ in range(30)), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(300)]
    assert sorted(map(tuple, source_divergence.source_divergence(_sources(spark, rows)).collect())) == _divergence(rows, 10, 10)
    assert source_divergence.source_divergence(_sources(spark, [])).count() == 0


def test_shares_of_large_counts_are_exact():
    count = np.array([0, 1, 10**10, 7 * 10**14, 8 * 10**15], np.int64)
    for total in (3, 10**10 + 7, 9 * 10**15):
        assert source_divergence.share(count[count < total], total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in count if c < total]


# --- cross-tokenizer alignment ---------------------------------------------------


def _alignment(rows):
    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    alphabet = cross_tokenizer.byte_alphabet()
    docs, held = [], collections.Counter()
    for key, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((key, 0, 0, [], collections.Counter()))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (bytes_a, bytes_b)]
        both = set(ends[0]) & set(ends[1])
        groups, part = [], ([], [])
        i = j = 0
        for end in sorted(both):
            while i < len(a) and ends[0][i] <= end:
                part[0].append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= end:
                part[1].append(b[j])
                j += 1
            groups.append(part)
            part = ([], [])
        links = collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        docs.append((key, len(a), len(b), groups, links))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for key, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        n_best = sum(n for p, n in links.items() if held[p] == top[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        out.append((key, n_a, n_b, len(groups), sum(links.values()), n_best, total, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), held, top


ODD_TEXTS = [
    " leading blank",
    "two  blanks   three ",
    "tab\tand\nline\r\n",
    "▁ a piece sign",
    "ﬁ ½ Ａ ² compatibility",
    "<|endoftext|> as <s> text </s> <unk> <0x41>",
    "\U0001f468‍\U0001f469‍\U0001f467 日本語テキスト ñandú",
    "nul\0inside",
    "\U0001f600" * 300,
    "ab" * 3000,
    " " * 2500 + "x",
    "é decomposed",
]


def test_alignment(spark, odd_rows):
    rows = odd_rows + [(910_000 + k, t) for k, t in enumerate(ODD_TEXTS)] * 2
    data = [(i, t, "k", 7, "g") for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, key string, block int, n_a string").repartition(5)
    want, held, top = _alignment(rows)
    found, pairs = cross_tokenizer.align(docs, *PATHS, slice_bytes=100_000)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert {((r.a, r.b), r.n, r.best) for r in pairs.collect()} == {(p, n, n == top[p[0]]) for p, n in held.items()}


def test_alignment_of_string_ids_and_empty(spark):
    docs = spark.createDataFrame([("x", "some text"), (None, None)], "name string, body string")
    found, _ = cross_tokenizer.align(docs, *PATHS, id_col="name", text_col="body")
    assert {(r["name"], r["n_a"] > 0) for r in found.collect()} == {("x", True), (None, False)}
    assert cross_tokenizer.align(docs.limit(0), *PATHS, id_col="name", text_col="body")[0].count() == 0


def test_links_of_a_long_group_in_pieces():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 50), rng.integers(0, 9, 70)
    at_a, at_b, owner = np.array([0, 1, 44, 49]), np.array([0, 2, 65, 69]), np.array([0, 0, 0, 1])
    want = collections.Counter()
    for x, y, p, q, d in ((0, 1, 0, 1, 0), (1, 2, 1, 3, 0), (2, 45, 3, 66, 0), (45, 50, 66, 70, 1)):
        for i in a[x:y].tolist():
            for j in b[p:q].tolist():
                want[d, i << 24 | j] += 1
    for most in (1, 20, 30, 10_000):
        got = collections.Counter()
        for d, p, n in cross_tokenizer.links(a, b, at_a, at_b, owner, most):
            assert len(d) <= max(most, 9)
            for key in zip(d.tolist(), p.tolist(), n.tolist()):
                got[key[:2]] += key[2]
        assert got == want


# --- archives ----------------------------------------------------------------------

INNER = "GET\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nx: y\r\n\r\n"


def _pages():
    random.seed(2)
    body = ["".join(random.choice("abc é\n") for _ in range(n)) for n in (1000, 1500, 999, 3000)]
    rows = [(k, f"http://www.Site{k % 4}.example.org:80/p{k % 5}?q=1#f", body[k % 4]) for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "no address", "x" * 70_000), (103, "http://h/\r\nWARC-Type: x", INNER * 40), (104, "http://h/", INNER * 40)]
    rows += [(105, "http://h", "WARC/1.1"), (106, "//h/a", "\r\nWARC/1.1\r\n\r\n" * 100), (107, "http://h/e", "end\r\n\r\n"), (108, "http://h/e", "\r\n\r\n")]
    rows += [(200, "http://dup/", "d" * 2000), (200, "http://dup/", "d" * 2000), (150, "http://dup/", "d" * 2000), (None, "http://dup/", "d" * 2000), (None, "http://n/", "nobody"), (None, "http://n/", "u" * 1200)]
    rows += [(k, "http://hot.example/", f"hot {k}") for k in range(1000, 1200)]
    return rows


def _plain_pages(rows):
    largest = {}
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(largest.get(html, key), key)
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        head = largest.get(html) if len(body) >= 1000 else None
        head = head if head is not None and (key is None or key < head) else None
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "response" if head is None else "revisit", head))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("split", ["128m", "3000"])
def test_archives(spark, compression, split):
    rows = _pages()
    pages = spark.createDataFrame([(k, u, h, "x", 1, 2) for k, u, h in rows], "page_id long, url string, html string, file string, offset int, key int").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        read = warc.read_archives(spark, path)
        captures = [r for r in read.collect() if r.record_type != "warcinfo"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r.intact is not False for r in captures)
    names = read.where("record_type <> 'warcinfo'").select(warc.page_of(F.col("record_id")).alias("k"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("r"))
    got = [(r.k and int(r.k), r.payload_bytes, r.payload_digest, r.record_type, r.r and int(r.r)) for r in names.collect()]
    assert sorted(got, key=str) == _plain_pages(rows)
    # A record lies in its file where its row says.
    for r in captures:
        with open(r.file.removeprefix("file:").replace("//", "/"), "rb") as file:
            data = file.read() if compression == "none" else gzip.decompress(file.read())
        record = data[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {r.record_id}\r\n".encode() in record
        assert data[r.offset + r.length :][:4] == b"\r\n\r\n"


def test_capture_index(spark):
    rows = _pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    captures = warc.read_archives(spark, path).where("record_type <> 'warcinfo'")
    want = sorted((r.url_key, r.seconds, r.record_id, r.file, r.offset) for r in captures.collect())
    for run_rows, range_rows in ((7, 20), (50, 100), (100_000, 200_000)):
        index = warc.capture_index(captures, run_rows, range_rows)
        got = sorted(index.collect(), key=lambda r: (r.range, r.place))
        assert [(r.url_key, r.seconds, r.record_id, r.file, r.offset) for r in got] == want
        assert (len({r.range for r in got}) > 3) == (range_rows == 20) or range_rows == 100
        seen = collections.Counter()
        for r in got:
            seen[r.url_key] += 1
            assert r.capture_no == seen[r.url_key]


def test_loser_tree():
    random.seed(4)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(random.randrange(50) for _ in range(random.randrange(20))) for _ in range(k)]
        got = [(runs[r][p], r, p) for r, p in warc.loser_tree(runs)]
        assert got == sorted((v, r, p) for r, run in enumerate(runs) for p, v in enumerate(run))


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id string, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    captures = warc.read_archives(spark, path)
    assert captures.count() == 0 and warc.capture_index(captures).count() == 0


def test_a_foreign_record_cut_by_a_split_is_refused(spark, tmp_path):
    body = (INNER * 200).encode()
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a:b>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    (tmp_path / "a.warc").write_bytes(record)
    assert [(r.record_id, r.length) for r in warc.read_archives(spark, str(tmp_path)).collect()] == [("<a:b>", len(record) - 4)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        with pytest.raises(Exception, match="goes on beyond its split|longer than it says|content-length"):
            warc.read_archives(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_url_keys():
    assert warc.url_key("HTTP://user@WWW2.Example.COM:8080/A?b#c") == "com,example)/A?b"
    assert warc.url_key("https://example.org") == "org,example)/"
    assert warc.url_key(None) == ""
