"""Documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more, exactly.

1. Equal sets are one class. A set's prefix, its smallest hashes, is chosen so long
   that two linked sets share several of them; hashes that only one class holds
   drop out, and with them every class that has too few shared ones left.
2. Hashes held by the same classes make one block; a class may be in several.
3. In a block, classes are the leaves of a signature tree. A node holds the OR of its
   leaves' token bitmaps, the range of their sizes and the largest count by which a
   leaf has more tokens than bits. A dual traversal follows only pairs of nodes whose
   sizes fit and whose largest possible overlap suffices for a link, down to pairs
   of leaves. Blocks of more than ``chunk`` classes are cut; each pair of chunks is
   traversed on its own.
4. A first traversal gives each class its likeliest partner and the block's most
   connected class; those pairs are verified on whole sets and joined to
   components. A second traversal gives all pairs of different components that may
   be linked; verified, they complete the components.

Every pair that is linked is either verified or lies inside a component that
verified links already hold together, so no link between components is lost, and
members of a group of copies are not paired with each other. What remains is the
square of the classes in one block that are alike but neither linked nor ruled out
by sizes; it is spread over chunk pairs and done on bitmaps.

Cases: a null text, or one without words, has an empty set and is linked with
nothing; fewer than ``width`` words are one n-gram. Rows without an id get no
component. Repeated rows are one class. Empty tables give no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm import blocks, words
from catalens.llm.components import components
from catalens.llm.names import fresh
from catalens.llm.shared_keys import shared_entries
from catalens.session import staged

PERCENT = 80
_FAN = 16


def needed(sizes: np.ndarray) -> np.ndarray:
    """Least overlap of a set of this size with any set it is linked with."""
    return -(-PERCENT * sizes // 100)


def extra(sizes: np.ndarray) -> np.ndarray:
    """How many hashes of their prefixes two linked sets share, as a function of the size."""
    return 1 + sizes // 16


def sets(column: pa.Array, width: int) -> tuple[list[np.ndarray], words.Texts]:
    """The sorted distinct n-gram hashes of every text."""
    text = words.split(column)
    hashes = text.hashes(lower=True)
    found = words.grams(hashes, width)
    out = []
    for a, b in zip(text.first[:-1].tolist(), text.first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(found[a : b - width + 1]))
        elif b > a:
            out.append(words.mix(words.grams(hashes[a:b], b - a) + words.STEPS[b - a]))
        else:
            out.append(np.empty(0, np.uint64))
    return out, text


def class_of(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(found):
        return 0
    return int((words.mix(found + words.STEPS[8]).sum(dtype=np.uint64) ^ np.uint64(len(found))).view(np.int64))


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            found, _ = sets(batch.column("text"), width)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in found], pa.int64()), pa.array([class_of(s) for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "class"])

    return run


def _prefixes(width: int):
    def entries(batch: pa.RecordBatch):
        distinct = {class_of(s): s for s in sets(batch.column("text"), width)[0] if len(s)}
        owners = np.array(list(distinct), np.int64)
        found = list(distinct.values())
        sizes = np.array([len(s) for s in found], np.int64)
        lengths = np.minimum(sizes, sizes - needed(sizes) + extra(sizes))
        keys = np.concatenate([np.empty(0, np.uint64), *(s[:n] for s, n in zip(found, lengths))])
        places = np.repeat(np.arange(len(owners)), lengths)
        return keys, places, sizes[places] if len(places) else np.empty(0, np.int64), owners

    return entries


def _whole_sets(shared, bits: int, width: int):
    """Class, size and packed hashes of the sets that pass the filter of wanted classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in words.slices(batches):
            rows = {}
            for s in sets(batch.column("text"), width)[0]:
                name = class_of(s)
                if len(s) and wanted[name & (1 << bits) - 1]:
                    rows[name] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], ["class", "tokens"])

    return run


def _filter_parts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[batch.column("class").to_numpy() & (1 << bits) - 1] = True
        yield blocks.cut(np.packbits(table), 16)

    return run


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for every token; four to eight bits a token, always a power of two."""
    bits = 1 << max(8, min(16, int(4 * len(tokens) - 1).bit_length()))
    table = np.zeros(bits, bool)
    table[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little").tobytes()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([len(t) for t in tokens], pa.int64()), pa.array([_bitmap(t) for t in tokens], pa.binary())], ["class", "n", "bitmap"])


class SignatureTree:
    """Leaves in order of size; nodes of ``_FAN`` leaves."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.bitmaps = sizes[self.order], bitmaps[self.order]
        self.slack = self.sizes - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        self.starts = np.arange(0, len(sizes), _FAN)
        self.ors = np.bitwise_or.reduceat(self.bitmaps, self.starts, axis=0)
        self.low = self.sizes[self.starts]
        self.high = np.maximum.reduceat(self.sizes, self.starts)
        self.most = np.maximum.reduceat(self.slack, self.starts)

    def leaves(self, node: int) -> slice:
        return slice(self.starts[node], self.starts[node] + _FAN)


def _least(a, b):
    """Overlap that sets of these sizes need to be linked."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def traverse(one: SignatureTree, two: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of leaves (places in the order given) that may be linked, and the largest overlap they can have."""
    for node in range(len(one.starts)):
        fits = np.flatnonzero((PERCENT * one.low[node] <= 100 * two.high) & (PERCENT * two.low <= 100 * one.high[node]))
        bound = np.minimum(one.most[node], two.most[fits]) + np.bitwise_count(two.ors[fits] & one.ors[node]).sum(1, dtype=np.int64)
        fits = fits[bound >= _least(one.low[node], two.low[fits])]
        if not len(fits):
            continue
        mine = one.leaves(node)
        theirs = (two.starts[fits][:, None] + np.arange(_FAN)).ravel()
        theirs = theirs[theirs < len(two.sizes)]
        common = np.stack([np.bitwise_count(two.bitmaps[theirs] & leaf).sum(1, dtype=np.int64) for leaf in one.bitmaps[mine]])
        bound = common + np.minimum(one.slack[mine][:, None], two.slack[theirs])
        a, b = np.nonzero(bound >= _least(one.sizes[mine][:, None], two.sizes[theirs]))
        yield one.order[mine][a], two.order[theirs[b]], bound[a, b]


def _fold(bitmaps: np.ndarray, width: int) -> np.ndarray:
    while bitmaps.shape[1] > width:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] | bitmaps[:, half:]
    return bitmaps


def _candidates(table: pa.Table, first: bool) -> pa.Table:
    """Pairs that may be linked among one chunk pair of a block."""
    chunk = table["part"].to_numpy()
    names, sizes, parts = table["class"].to_numpy(), table["n"].to_numpy(), table["component"].to_numpy()
    raw = table["bitmap"].to_pylist()
    widths = np.array([len(b) // 8 for b in raw])
    one, two = table["i"][0].as_py(), table["j"][0].as_py()
    found = [np.empty((3, 0), np.int64)]
    for width in np.unique(widths):
        for other in (width, 2 * width):
            mine, theirs = np.flatnonzero(widths == width), np.flatnonzero(widths == other)
            if not len(theirs):
                continue
            sides = [(mine[chunk[mine] == one], theirs[chunk[theirs] == two])]
            if one != two and other != width:
                sides.append((mine[chunk[mine] == two], theirs[chunk[theirs] == one]))
            for left, right in sides:
                if not len(left) or not len(right):
                    continue
                trees = [SignatureTree(sizes[rows], _fold(np.stack([np.frombuffer(raw[r], np.uint64) for r in rows]), width)) for rows in (left, right)]
                for a, b, bound in traverse(*trees):
                    a, b = left[a], right[b]
                    keep = parts[a] != parts[b]
                    if one == two and other == width:
                        keep &= a < b
                    found.append(np.stack([a[keep], b[keep], bound[keep]]))
    a, b, bound = np.concatenate(found, axis=1)
    if first and len(a):
        # Each class's likeliest partner, and its link with the most connected class.
        degree = np.bincount(np.concatenate([a, b]), minlength=len(names))
        score = bound / (sizes[a] + sizes[b] - bound)
        ends, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
        best = pair[np.lexsort((-degree[np.concatenate([b, a])], -score[pair], ends))]
        ends = np.sort(ends)
        hub = np.argmax(degree)
        take = np.unique(np.concatenate([best[np.append(True, ends[1:] != ends[:-1])], np.flatnonzero((a == hub) | (b == hub))]))
        a, b = a[take], b[take]
    low, high = np.minimum(names[a], names[b]), np.maximum(names[a], names[b])
    return pa.table({"a": low, "b": high})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for row, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                linked.append(row)
        yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))


def class_links(docs: DataFrame, width: int = 5, chunk: int = 2048, filter_bits: int = 23) -> DataFrame:
    """Verified links (a, b) between classes of ``docs`` (doc_id, text) that hold all linked classes together."""
    spark = docs.sparkSession
    shared = staged(shared_entries(docs.select("text"), _prefixes(width)).toDF("token", "class", "n").distinct(), "ngram-shared")
    least = 1 + F.floor(F.ceil(F.col("n") * PERCENT / 100) / 16)
    able = shared.groupBy("class", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    alive = shared.join(able.select("class"), "class")
    # Tokens held by the same classes are one block; a block's name comes from its members.
    held = alive.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("class")).alias("x")).where("k > 1")
    named = held.select("token", "k", F.xxhash64("k", "s", "x").alias("block"))
    members = staged(alive.join(named, "token").select("block", "class", "k").distinct(), "ngram-blocks")
    found = blocks.folded(members.select("class").distinct().mapInArrow(_filter_parts(filter_bits), blocks.SCHEMA), np.bitwise_or, np.uint8)
    # A filter of fixed size; what passes it beside the wanted classes is never joined.
    wanted = spark.sparkContext.broadcast(bytes(1 << filter_bits - 3) if found is None else found.tobytes())
    tokens = staged(docs.select("text").mapInArrow(_whole_sets(wanted, filter_bits, width), "class long, tokens binary").dropDuplicates(["class"]), "ngram-sets")
    bitmaps = staged(tokens.mapInArrow(_bitmaps, "class long, n long, bitmap binary"), "ngram-bitmaps")

    def verified(parts: DataFrame | None) -> DataFrame:
        rows = members.join(bitmaps, "class")
        if parts is None:
            rows = rows.withColumn("component", F.col("class"))
        else:
            rows = rows.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        chunks = F.ceil(F.col("k") / chunk).cast("int")
        rows = rows.withColumn("chunks", chunks).withColumn("part", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        met = rows.select("block", "class", "n", "bitmap", "component", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")
        first = parts is None
        pairs = met.groupBy("block", "i", "j").applyInArrow(lambda table: _candidates(table, first), "a long, b long").distinct()
        # Written, so that the two joins with whole sets see how few pairs there are.
        pairs = staged(pairs, "ngram-pairs")
        left = tokens.select(F.col("class").alias("a"), F.col("tokens").alias("x"))
        right = tokens.select(F.col("class").alias("b"), F.col("tokens").alias("y"))
        return staged(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "ngram-links")

    first = verified(None)
    return first.unionByName(verified(components(first)))


def link_documents(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    described = staged(hashed.mapInArrow(_describe(width), "doc_id long, text_hash long, n_shingles long, class long"), "ngram-documents")
    classes = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    joined = components(class_links(docs.where(F.col("doc_id").isNotNull()), width))
    heads = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = staged(heads.groupBy("component").agg(F.min("smallest").alias("component_id")), "ngram-components")
    names = staged(heads.join(smallest, "component").select("class", "component_id"), "ngram-classes")
    # An empty set has no class and keeps its own id.
    return described.join(names, "class", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_heads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked documents the one with the smallest id, all columns as they are; rows without an id stay.

    Of rows that repeat id and text the first stays, in the order of the row as JSON.
    """
    owner, owner_hash, text_hash, whole, place = fresh(docs, "id", "hash", "text_hash", "row", "place")
    linked = link_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    heads = linked.where("doc_id = component_id").select(F.col("doc_id").alias(owner), F.col("text_hash").alias(owner_hash)).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    same = (F.col(id_col) == F.col(owner)) & F.xxhash64(text_col).eqNullSafe(F.col(owner_hash))
    rest = [F.col(c) for c in docs.columns if c != text_col]
    kept = named.join(heads, same, "left_semi").withColumns({text_hash: F.xxhash64(text_col), whole: F.to_json(F.struct(*rest))})
    once = kept.withColumn(place, F.row_number().over(Window.partitionBy(id_col, text_hash).orderBy(whole))).where(F.col(place) == 1)
    return once.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
