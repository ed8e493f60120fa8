"""WARC archives of pages, read back and ordered into capture histories.

`write_archives` writes one record a page with Spark's text writer: the separator
of its rows is the end of a record, so every file is a plain WARC file, written
and committed like any other output. Of equal payloads of at least ``min_bytes``
bytes the largest id is a response and all others revisit it.

`read_archives` reads files of any size, also gzipped ones, with Spark's text
reader cut at record starts, so a plain file is read in splits and a task holds one
record. ``Content-Length`` decides where a record ends. A payload that holds
a record start itself is written in chunks that cut it, so a split never
starts inside a payload of these archives; an archive of other origin that has such
a payload at the edge of a split is refused, not misread (gzip it: then it is one split).

`capture_index` merges externally: tasks sort their captures into runs and write
them; cut points from the written runs divide the keys (URL key, time, record) into
ranges; a range's part of every run is merged by a loser tree. Ranges are cut on
the whole key, so a URL that holds a third of all captures spans many of them.
What is broadcast is one key for every ``range_rows`` captures.

Cases: a null payload is an empty one; a null URL has no target and the key ''; a
row without an id is never referred to, but may revisit; rows that repeat the largest
id of a payload are all responses; empty tables give archives without
captures. Other columns are not read.
"""

from __future__ import annotations

import bisect
import calendar
import hashlib
import re
import time
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.session import staged

# ---- fixed values: the archive format ---------------------------------------
END = "\r\n\r\n"
START = "WARC/1."
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# -----------------------------------------------------------------------------
SEPARATOR = (END + START).encode()
FIRST_DATE = calendar.timegm((2024, 1, 1, 0, 0, 0))
CAPTURE = (
    "file string, offset long, length long, record_type string, record_id string, url string, url_key string, seconds long, "
    "payload_bytes long, payload_digest string, refers_to string, intact boolean"
)
KEY = ["url_key", "seconds", "record_id", "file", "offset"]


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query: ``com,example)/path?q``; scheme, user, port, www and fragment go."""
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "", re.IGNORECASE | re.DOTALL)
    if not found:
        return (url or "").partition("#")[0]
    host = re.sub(r"^www\d*\.", "", found[1].lower())
    return ",".join(reversed(host.split("."))) + ")" + (found[2] or "/")


def _date(seconds: int) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))


def _headers(lines: list[tuple[str, str | int | None]], first: str) -> bytes:
    return (first + "".join(f"\r\n{k}: {v}" for k, v in lines if v is not None) + END).encode()


def _name(key: object) -> str:
    return "<urn:page:" + ("" if key is None else quote(str(key), safe="")) + ">"


def _chunks(payload: bytes) -> bytes:
    """A payload as HTTP chunks, cut inside every record start it holds."""
    start = START.encode()
    parts = payload.split(start)
    for i in range(len(parts) - 1):
        parts[i] += start[:1]
        parts[i + 1] = start[1:] + parts[i + 1]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _unchunked(block: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = block.index(b"\r\n", at)
        size = int(block[at:stop].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(block[stop + 2 : stop + 2 + size])
        at = stop + 4 + size


def _record(key: object, url: str | None, payload: bytes, digest: str, seconds: int, head: object) -> bytes:
    """A record without the line ends that close it."""
    chunked = START.encode() in payload and head is None
    http = [("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", "chunked") if chunked else ("Content-Length", len(payload))]
    block = _headers(http, "HTTP/1.1 200 OK")
    if head is None:
        block += _chunks(payload) if chunked else payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url) if url else None
    fields = [
        ("WARC-Type", "response" if head is None else "revisit"),
        ("WARC-Record-ID", _name(key)),
        ("WARC-Date", _date(seconds)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", None if head is None else _name(head)),
        ("WARC-Profile", None if head is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _headers(fields, VERSION) + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun = False
    for batch in batches:
        out = []
        if not begun and batch.num_rows:
            begun = True
            text = b"format: WARC File Format 1.1\r\n"
            part = TaskContext.get().partitionId()
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{part}>"), ("WARC-Date", _date(FIRST_DATE))]
            info += [("Content-Type", "application/warc-fields"), ("Content-Length", len(text))]
            out.append(_headers(info, VERSION) + text)
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "seconds", "head"))):
            out.append(_record(*row))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", seconds_col: str | None = None, compression: str = "none") -> None:
    """Write ``pages`` as WARC files into the folder ``path``.

    ``seconds_col`` is the time of capture since 1970; without one, page i is taken i seconds (below 1e9) into 2024.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    clock = F.col(seconds_col).cast("long") if seconds_col else F.lit(FIRST_DATE) + F.pmod(F.coalesce(F.col(id_col).try_cast("long"), F.lit(0)), F.lit(10**9))
    rows = pages.select(
        F.col(id_col).alias("key"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
        F.coalesce(clock, F.lit(FIRST_DATE)).alias("seconds"),
    )
    # Only payloads that occur again have a row here; adaptive execution splits the join at a payload of many copies.
    heads = staged(
        rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("key").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 AND largest IS NOT NULL").drop("n"),
        "warc-heads",
    )
    head = F.when(F.col("key").isNull() | (F.col("key") < F.col("largest")), F.col("largest"))
    named = rows.join(heads, ["digest", "size"], "left").select("key", "url", "payload", "digest", "seconds", head.alias("head"))
    records = named.mapInArrow(_records, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END).option("compression", compression).text(path)


def _capture(raw: bytes) -> tuple | None:
    """Length, type, id, url, key, seconds, payload bytes, digest, referred id and whether the digest holds; None if the record goes on."""
    top, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in top.decode("utf-8", "replace").split("\r\n")[1:])}
    size = int(fields["content-length"])
    if len(block) < size:
        return None
    if block[size:].strip():
        raise ValueError(f"record {fields.get('warc-record-id')} is longer than it says")
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
    total = intact = None
    if kind in ("response", "revisit"):
        http, _, body = block[:size].partition(b"\r\n\r\n")
        said = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
        if kind == "response":
            body = _unchunked(body) if said.get("transfer-encoding", "").lower() == "chunked" else body
            found = hashlib.sha1(body).hexdigest()
            total, intact, digest = len(body), digest in (None, found), found
        elif "content-length" in said:
            total = int(said["content-length"])
    stamp = fields.get("warc-date", "")[:19]
    seconds = calendar.timegm(time.strptime(stamp, "%Y-%m-%dT%H:%M:%S")) if stamp else 0
    url = fields.get("warc-target-uri")
    return len(top) + 4 + size, kind, fields.get("warc-record-id", ""), url, url_key(url), seconds, total, digest, fields.get("warc-refers-to"), intact


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures; offsets count from the first record of a split, whose ``total`` bytes come with its last row."""
    split, at, held, begin = None, 0, b"", 0
    for batch in batches:
        out = []
        for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
            if (file, block) != split:
                if held:
                    raise ValueError(f"a record of {split[0]} goes on beyond its split; gzip the file to read it in one")
                split, at, held = (file, block), 0, b""
            # All but a file's first piece lack the start that the reader cut at.
            whole = value if value.startswith(START.encode()) and not at and not block else SEPARATOR[4:] + value
            begin = begin if held else at
            at += len(value) + len(SEPARATOR)
            if not value.strip():
                continue
            raw = held + SEPARATOR[:4] + whole if held else whole
            found = _capture(raw)
            held = b"" if found else raw
            if found:
                out.append((file, block, begin, found[0], at, *found[1:]))
        columns = list(zip(*out)) if out else [()] * len(_PARSED)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARSED.values())], list(_PARSED))
    if held:
        raise ValueError(f"a record of {split[0]} goes on beyond its split; gzip the file to read it in one")


_TEXT, _LONG = pa.string(), pa.int64()
_PARSED = {
    **{"file": _TEXT, "block": _LONG, "begin": _LONG, "length": _LONG, "total": _LONG, "record_type": _TEXT, "record_id": _TEXT},
    **{"url": _TEXT, "url_key": _TEXT, "seconds": _LONG, "payload_bytes": _LONG, "payload_digest": _TEXT, "refers_to": _TEXT, "intact": pa.bool_()},
}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives in ``path``: file, offset, length, record_type, record_id, url, url_key, seconds, payload_bytes, payload_digest, refers_to, intact."""
    raw = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    raw = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parsed = staged(
        raw.mapInArrow(_parse, "file string, block long, begin long, length long, total long, record_type string, record_id string, url string, url_key string, seconds long, payload_bytes long, payload_digest string, refers_to string, intact boolean"),
        "warc-captures",
    )
    # A split starts where the splits before it end; one row a split.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = parsed.groupBy("file", "block").agg(F.max("total").alias("total")).select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    start = F.col("base") + F.col("begin")
    offset = F.when(start > 0, start - (len(SEPARATOR) - 4)).otherwise(0)
    return parsed.join(splits, ["file", "block"]).withColumn("offset", offset).select([c.split()[0] for c in CAPTURE.split(", ")])


def loser_tree(runs: list[list]) -> Iterator[tuple[int, int]]:
    """Run and place of every entry of sorted runs, in order; equal entries by run."""
    k, at = len(runs), [0] * len(runs)
    losers = [-1] * k

    def beats(a: int, b: int) -> bool:
        if at[b] >= len(runs[b]):
            return True
        if at[a] >= len(runs[a]):
            return False
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or x == y and a < b

    def play(run: int) -> int:
        node = (run + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = run
                return -1
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        return run

    winner = -1
    for run in range(k):
        winner = max(winner, play(run))
    while k and at[winner] < len(runs[winner]):
        yield winner, at[winner]
        at[winner] += 1
        winner = play(winner)


def _runs(run_rows: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def run() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in KEY])
            places = pa.array(np.arange(len(table)))
            yield from table.append_column("run", pa.array(np.full(len(table), number))).append_column("at", places).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= run_rows:
                yield from run()
                held, number = [], number + 1
        if sum(b.num_rows for b in held):
            yield from run()

    return sort


def _cut(splitters: list[tuple]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, places = batch.column("run").to_numpy(), batch.column("at").to_numpy()
            entries = pa.StructArray.from_arrays([batch.column(c) for c in batch.schema.names[:-2]], batch.schema.names[:-2])
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
            out: list[tuple[int, int, int, int]] = []
            edges = np.append(np.flatnonzero(np.append(True, runs[1:] != runs[:-1])), len(runs)) if len(runs) else [0]
            for low, high in zip(edges[:-1], edges[1:]):
                while low < high:
                    part = bisect.bisect_right(splitters, keys[low])
                    stop = bisect.bisect_left(keys, splitters[part], low, high) if part < len(splitters) else high
                    out.append((part, runs[low], places[low], stop))
                    low = stop
            bounds = pa.array([0, *(o[3] for o in out)], pa.int32())
            columns = [pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(bounds, entries)], ["range", "run", "at", "entries"])

    return cut


def _merge(table: pa.Table) -> pa.Table:
    """A range's captures in order, with their places and numbers in their URL's part of the range."""
    table = table.combine_chunks().sort_by([("run", "ascending"), ("at", "ascending")])
    lists = table.column("entries").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    entries = pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.flatten())])
    sizes = lists.value_lengths().to_numpy()
    run = np.repeat(table.column("run").to_numpy(), sizes)
    first = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)).tolist()
    keys = list(zip(*(entries.column(c).to_pylist() for c in KEY)))
    order = np.fromiter((first[r] + p for r, p in loser_tree([keys[a:b] for a, b in zip(first[:-1], first[1:])])), np.int64, len(keys))
    merged = entries.take(pa.array(order))
    urls = np.array([keys[i][0] for i in order], object)
    begin = np.flatnonzero(np.append(True, urls[1:] != urls[:-1]))
    number = np.arange(len(urls)) - np.repeat(begin, np.diff(np.append(begin, len(urls)))) + 1
    edge = (urls == urls[0]) | (urls == urls[-1])
    for name, values in (("range", np.full(len(urls), table.column("range")[0].as_py(), np.int32)), ("place", np.arange(len(urls))), ("number", number), ("edge", edge)):
        merged = merged.append_column(name, pa.array(values))
    return merged


def capture_index(captures: DataFrame, run_rows: int = 100_000, range_rows: int = 200_000) -> DataFrame:
    """The captures in order of (range, place), with capture_no, the number of each in its URL's history."""
    runs = staged(captures.select([c.split()[0] for c in CAPTURE.split(", ")]).mapInArrow(_runs(run_rows), f"{CAPTURE}, run long, at long"), "warc-runs")
    step = max(1, min(range_rows, run_rows) // 100)
    sample = runs.where(F.col("at") % step == 0).select(KEY)
    ranges = -(-sample.count() * step // range_rows)
    splitters = []
    if ranges > 1:
        lows = sample.repartitionByRange(ranges, *KEY).groupBy(F.spark_partition_id()).agg(F.min(F.struct(KEY)).alias("low"))
        splitters = sorted(tuple(r.low) for r in lows.collect())[1:]
    dealt = runs.mapInArrow(_cut(splitters), f"range int, run long, at long, entries array<struct<{', '.join(c.replace(' ', ': ', 1) for c in CAPTURE.split(', '))}>>")
    merged = staged(dealt.groupBy("range").applyInArrow(_merge, f"{CAPTURE}, range int, place long, number long, edge boolean"), "warc-index")
    # A history that goes on from earlier ranges is counted on; only the first and last URL of a range can be one.
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = merged.where("edge").groupBy("url_key", "range").agg(F.count(F.lit(1)).alias("n"))
    carried = edges.select("url_key", "range", F.sum("n").over(before).alias("carried")).where("carried > 0")
    return merged.join(carried, ["url_key", "range"], "left").withColumn("capture_no", F.col("number") + F.coalesce("carried", F.lit(0))).drop("number", "edge", "carried")


def page_of(record_id):
    """The id inside a record's name as `write_archives` gives it; null for other names."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:page:(.+)>$", 1), F.lit("")))

