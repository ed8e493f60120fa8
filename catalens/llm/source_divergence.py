"""How far the word use of sources of one language is apart, by pairs of sources and by term.

Tasks count terms (runs of letters, A-Z as a-z) in slices of text and send them packed by a hash of
the term. A bucket keeps, for each language, the terms that ``min_docs`` documents hold, numbers them in the
order of their bytes, and writes each group's sorted (term id, count) arrays in parts of ``PART`` terms.
The arrays of two sources meet by part, one row for each unordered pair, and a galloping intersection prices
the terms that both, only one or neither of them holds; a pair's parts are then added up. So what a task holds is
a bucket of counts or two parts, whatever the vocabulary, and a source with a third of all text has arrays no longer than others.

A term's share is p = 1 + floor(1e9 * (count + 2) / (N + 2 V)), the distance of two shares
floor((p - q)^2 / (p + q)), both exact in whole numbers.

Cases: null text, language or source is ''. Every row is a document, also one that repeats an id. A group without terms has
shares like any other. A language without kept terms gives pairs of value 0. A source alone in its language has
no pairs. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm import words
from catalens.llm.galloping import common
from catalens.session import staged

PART = 4096
SLICE_BYTES = 4_000_000
LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / total), exact for counts below 9e15: three digits at a time."""
    rest, out = np.asarray(count, np.int64) + 2, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tight(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()))).tobytes()


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // count}").astype(np.int64)


def _counts(buckets: int):
    """Counts of (group, term) in slices, packed by bucket of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", SLICE_BYTES):
            text = words.split(batch.column("text"), LETTERS)
            if not len(text.starts):
                continue
            number: dict[tuple[str, str], int] = {}
            group = np.array([number.setdefault(g, len(number)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())])
            names = list(number)
            by_group = np.argsort(group, kind="stable")  # documents of a group are neighbours
            rank = np.empty(len(group), np.int64)
            rank[by_group] = np.arange(len(group))
            hashes, sample, term = np.unique(text.hashes(lower=True), return_index=True, return_inverse=True)
            key = term * len(group) + rank[text.document_of_word()]
            key.sort()
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(start, len(key)))
            term, owner = key[start] // len(group), group[by_group][key[start] % len(group)]
            start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])))
            count, docs = np.add.reduceat(times, start), np.diff(np.append(start, len(term)))
            term, owner = term[start], owner[start]
            bucket = ((hashes >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
            # Terms bucket by bucket; their entries follow them.
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            entry = np.argsort(place[term], kind="stable")
            term, owner, count, docs = place[term][entry], owner[entry], count[entry], docs[entry]
            lower = _LOWER[text.data]
            spelt = [lower[a:b].tobytes() for a, b in zip(text.starts[sample[order]].tolist(), text.ends[sample[order]].tolist())]
            hashes, bucket = hashes[order], bucket[order]
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            cuts = np.searchsorted(term, edges)
            rows: list[list] = [[] for _ in _PACKED]
            for a, b, x, y in zip(edges[:-1], edges[1:], cuts[:-1], cuts[1:]):
                used, mine = np.unique(owner[x:y], return_inverse=True)
                values = (int(bucket[a]), *([names[g][k] for g in used] for k in (0, 1)), hashes[a:b].tobytes(), spelt[a:b])
                values += tuple(map(_tight, (np.bincount(term[x:y] - a, minlength=b - a), mine, count[x:y], docs[x:y])))
                for column, value in zip(rows, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, _PACKED.values())], list(_PACKED))

    return run


_NAMES = pa.list_(pa.string())
_PACKED = {"bucket": pa.int32(), "langs": _NAMES, "sources": _NAMES, "hashes": pa.binary(), "terms": pa.list_(pa.binary()), **{c: pa.binary() for c in ("groups", "owner", "count", "docs")}}
_PACKED_SQL = "bucket int, langs array<string>, sources array<string>, hashes binary, terms array<binary>, groups binary, owner binary, count binary, docs binary"
_ARRAYS_SQL = "lang string, source string, part long, size int, ids binary, counts binary, n long, terms array<string>"


def _arrays(min_docs: int):
    """A bucket's kept terms of each language, and each group's arrays over them."""

    def run(table: pa.Table) -> pa.Table:
        group_of: dict[tuple[str, str], int] = {}
        parts = []
        for row in range(len(table)):
            hashes = np.frombuffer(table.column("hashes")[row].as_py(), np.uint64)
            term = np.repeat(np.arange(len(hashes)), _wide(table.column("groups")[row].as_py(), len(hashes)))
            owner, count, docs = (_wide(table.column(c)[row].as_py(), len(term)) for c in ("owner", "count", "docs"))
            local = np.array([group_of.setdefault(g, len(group_of)) for g in zip(*(table.column(c)[row].as_py() for c in ("langs", "sources")))], np.int64)
            parts.append((hashes[term], local[owner], count, docs, hashes))
        hashes, owner, count, docs, spelt_as = (np.concatenate(x) for x in zip(*parts))
        spelt = pc.list_flatten(table.column("terms")).combine_chunks()
        langs, lang_of = np.unique(np.array([g[0] for g in group_of], object), return_inverse=True)
        sources = [g[1] for g in group_of]
        different, term = np.unique(hashes, return_inverse=True)
        known, sample = np.unique(spelt_as, return_index=True)
        out: list[tuple] = []
        for lang in range(len(langs)):
            mine = np.flatnonzero(lang_of[owner] == lang)
            held = np.bincount(term[mine], docs[mine], len(different))
            kept = np.flatnonzero(held >= min_docs)
            if not len(kept):
                continue
            names = spelt.take(pa.array(sample[np.searchsorted(known, different[kept])]))
            names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
            order = pc.sort_indices(names).to_numpy()
            names, number = names.take(pa.array(order)), np.full(len(different), -1)
            number[kept[order]] = np.arange(len(kept))
            mine = mine[number[term[mine]] >= 0]
            key = owner[mine] * len(kept) + number[term[mine]]
            cells, cell = np.unique(key, return_inverse=True)
            total = np.bincount(cell, count[mine], len(cells)).astype(np.int64)
            ids, group = cells % len(kept), cells // len(kept)
            base = int(table.column("bucket")[0].as_py()) << 24
            whole = np.bincount(ids, total, len(kept)).astype(np.int64)
            spelt_out = names.cast(pa.string()).to_pylist()
            for at in range(0, len(kept), PART):
                piece = whole[at : at + PART]
                out.append((langs[lang], None, base + at // PART, len(piece), None, piece.tobytes(), int(piece.sum()), spelt_out[at : at + PART]))
            edge = group * (len(kept) // PART + 1) + ids // PART
            start = np.append(np.flatnonzero(np.append(True, edge[1:] != edge[:-1])), len(edge)) if len(edge) else [0]
            for a, b in zip(start[:-1], start[1:]):
                at = int(ids[a]) // PART
                out.append((langs[lang], sources[group[a]], base + at, None, (ids[a:b] - at * PART).astype(np.int32).tobytes(), total[a:b].tobytes(), int(total[a:b].sum()), None))
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string())]
        columns = list(zip(*out)) if out else [()] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _ARRAYS_SQL.split(", ")])

    return run


def _sparse(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, shares and the share of an absent term of one side."""
    ids, counts, total = (batch.column(f"{c}{side}")[row].as_py() for c in ("ids", "counts", "total"))
    return np.frombuffer(ids or b"", np.int32), share(np.frombuffer(counts or b"", np.int64), total), int(share(np.zeros(1, np.int64), total)[0])


def pair_value(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], size: int) -> int:
    """Distances summed over ``size`` terms, of which each side lists the ids and shares it holds."""
    mine, theirs = common(a[0], b[0])
    value = int(distance(a[1][mine], b[1][theirs]).sum())
    for (_, shares, _), hit, absent in ((a, mine, b[2]), (b, theirs, a[2])):
        alone = np.ones(len(shares), bool)
        alone[hit] = False
        value += int(distance(shares[alone], absent).sum())
    neither = size - len(a[0]) - len(b[0]) + len(mine)
    return value + neither * int(distance(np.int64(a[2]), np.int64(b[2])))


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_pylist()
        values = [pair_value(_sparse(batch, i, "_a"), _sparse(batch, i, "_b"), sizes[i]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source_a", "source_b")), pa.array(values, pa.int64())], ["lang", "source_a", "source_b", "value"])


def _excess(top: int):
    """The ``top`` terms of each part that the group holds more of than its language; ties by id, which is by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, values = [], [], []
            for i in range(batch.num_rows):
                mine, shares, _ = _sparse(batch, i, "")
                whole = np.frombuffer(batch.column("lang_counts")[i].as_py(), np.int64)[mine]
                theirs = share(whole, batch.column("lang_total")[i].as_py())
                more = np.flatnonzero(shares > theirs)
                value = distance(shares[more], theirs[more])
                best = np.lexsort((mine[more], -value))[:top]
                rows += [i] * len(best)
                ids += mine[more][best].tolist()
                values += value[best].tolist()
            which = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(which) for c in ("lang", "source", "part")), pa.array(ids, pa.int32()), pa.array(values, pa.int64())], ["lang", "source", "part", "id", "value"]
            )

    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, bucket_bytes: int = 16_000_000, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: every other source, and the ``top_terms`` terms in excess."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = texts.mapInArrow(_counts(-(-size // bucket_bytes) or 1), _PACKED_SQL)
    arrays = staged(packed.groupBy("bucket").applyInArrow(_arrays(min_docs), _ARRAYS_SQL), "divergence-arrays")
    whole, own = arrays.where("source IS NULL").drop("source", "ids"), arrays.where("source IS NOT NULL").drop("size", "terms")
    per_lang = whole.groupBy("lang").agg(F.sum("size").alias("kept"), F.sum("n").alias("lang_n"))
    per_group = own.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = texts.select("lang", "source").distinct().join(per_lang, "lang", "left").join(per_group, ["lang", "source"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("kept", "lang_n", "n")}
    totals = staged(groups.select("lang", "source", (zero["n"] + 2 * zero["kept"]).alias("total"), (zero["lang_n"] + 2 * zero["kept"]).alias("lang_total")), "divergence-groups")
    cells = staged(totals.join(whole.select("lang", "part", "size"), "lang").join(own.drop("n"), ["lang", "source", "part"], "left"), "divergence-cells")

    def side(name: str) -> DataFrame:
        return cells.select("lang", "part", *(["size"] if name == "_a" else []), *(F.col(c).alias(c + name) for c in ("source", "total", "ids", "counts")))

    meet = side("_a").join(side("_b"), ["lang", "part"]).where("source_a < source_b")
    priced = meet.mapInArrow(_price, "lang string, source_a string, source_b string, value long").groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    both = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    both = both.withColumns({"source_a": F.least("source", "item"), "source_b": F.greatest("source", "item")}).join(priced, ["lang", "source_a", "source_b"], "left")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    against = cells.where("ids IS NOT NULL").join(whole.select("lang", "part", F.col("counts").alias("lang_counts")), ["lang", "part"])
    excess = against.mapInArrow(_excess(top_terms), "lang string, source string, part long, id int, value long")
    terms = whole.select("lang", "part", F.posexplode("terms").alias("id", "item"))
    best = excess.join(terms, ["lang", "part", "id"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    ranked = pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
