"""Entries whose 64-bit key at least two owners hold, found in one shuffle of packed arrays.

A map task packs the (key, owner, payload) entries of a slice by bucket of the
key, some ten bytes an entry. A key that two owners of the same slice hold is
known to be shared at once: its entries go on by a hash of their owner, and one
entry marks the key in its bucket. So a key that a third of all owners hold sends
one entry a slice to its bucket, whatever the number of its owners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalens.llm import words

SCHEMA = "key long, owner long, payload long"
_MARK, _PASS, _OPEN = 0, 1, 2
#: Arrays of keys, places of owners in the owner table, payloads; and the owner table.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _two_owners(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in order: where each run of a key starts, and whether its owners differ."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    if not len(starts):
        return starts, np.empty(0, bool)
    return starts, np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)


def _packed(entries: Entries, buckets: int) -> pa.RecordBatch:
    keys, places, payloads, owners = entries
    order = np.argsort(keys, kind="stable")
    keys, places, payloads = keys[order], places[order], payloads[order]
    starts, several = _two_owners(keys, owners[places])
    known = np.repeat(several, np.diff(np.append(starts, len(keys))))
    by_key = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    by_owner = (words.mix(owners.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[places]
    mark = starts[several]
    kind = np.concatenate([np.where(known, _PASS, _OPEN), np.full(len(mark), _MARK)]).astype(np.uint8)
    bucket = np.concatenate([np.where(known, by_owner, by_key), by_key[mark]])
    take = np.concatenate([np.arange(len(keys)), mark])
    order = np.argsort(bucket, kind="stable")
    bucket, take, kind = bucket[order], take[order], kind[order]
    bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    columns: dict[str, list] = {name: [] for name in ("bucket", "kinds", "keys", "owners", "places", "payloads")}
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = take[a:b]
        used, place = np.unique(places[rows], return_inverse=True)
        columns["bucket"].append(int(bucket[a]))
        columns["kinds"].append(kind[a:b].tobytes())
        columns["keys"].append(keys[rows].tobytes())
        columns["owners"].append(owners[used].tobytes())
        columns["places"].append(place.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes())
        columns["payloads"].append(payloads[rows].astype(np.int64).tobytes())
    types = [pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), types)], list(columns))


def _unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for kinds, keys, owners, places, payloads in zip(*(table.column(c).to_pylist() for c in ("kinds", "keys", "owners", "places", "payloads"))):
        keys = np.frombuffer(keys, np.uint64)
        places = np.frombuffer(places, np.uint16 if len(places) == 2 * len(keys) else np.uint32)
        yield np.frombuffer(kinds, np.uint8), keys, np.frombuffer(owners, np.int64)[places], np.frombuffer(payloads, np.int64)


def _meet(table: pa.Table) -> pa.Table:
    parts = list(_unpacked(table))
    kinds, keys, owners, payloads = (np.concatenate(x) for x in zip(*parts))
    at = np.flatnonzero(kinds != _PASS)
    at = at[np.argsort(keys[at], kind="stable")]
    starts, several = _two_owners(keys[at], owners[at])
    if len(starts):
        several |= np.minimum.reduceat(kinds[at], starts) == _MARK
    shared = np.repeat(several, np.diff(np.append(starts, len(at))))
    out = np.concatenate([at[shared & (kinds[at] == _OPEN)], np.flatnonzero(kinds == _PASS)])
    return pa.table({"key": keys[out].view(np.int64), "owner": owners[out], "payload": payloads[out]})


def shared_entries(docs: DataFrame, entries: Callable[[pa.RecordBatch], Entries], slice_bytes: int = 8_000_000, text_col: str = "text") -> DataFrame:
    """key, owner, payload of all entries of ``docs`` whose key has two owners or more.

    ``entries`` gives a slice's entries. One entry for each (key, owner) is enough.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        size = 0
        for batch in words.slices(batches, text_col):
            held.append(entries(batch))
            size += batch.nbytes
            if size >= slice_bytes:
                yield _packed(_joined(held), buckets)
                held, size = [], 0
        if held:
            yield _packed(_joined(held), buckets)

    packed = docs.mapInArrow(run, "bucket int, kinds binary, keys binary, owners binary, places binary, payloads binary")
    return packed.groupBy("bucket").applyInArrow(_meet, SCHEMA)


def _joined(held: list[Entries]) -> Entries:
    shift = np.cumsum([0, *(len(e[3]) for e in held)])
    places = [e[1] + s for e, s in zip(held, shift)]
    return (np.concatenate([e[0] for e in held]), np.concatenate(places), np.concatenate([e[2] for e in held]), np.concatenate([e[3] for e in held]))
