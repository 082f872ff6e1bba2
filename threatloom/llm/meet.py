"""Where do equal keys meet: an exchange of (key, holder) entries as packed arrays.

Keys are 64-bit hashes, or pairs of them, of parts of texts; a holder is a document or class id. A task first
settles what it can among the texts of one batch: of a key with several holders there, only the least goes on.
So a key that a third of all texts hold costs one entry per batch, not one per text. Entries travel as
byte strings, one per batch and bucket; a bucket is a range of key values, so its size follows from the number of
entries, and the number of buckets from the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "bucket long, keys binary, holders binary, known binary"
#: Entries that a bucket should hold, about.
BUCKET_ENTRIES = 1 << 20

Entries = tuple[np.ndarray, np.ndarray]  # keys (n,) or (n, 2), holders (n,)


def bucket_count(entries: int) -> int:
    return max(8, -(-entries // BUCKET_ENTRIES))


def packed(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary column: the bytes of values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * (values.shape[1] if values.ndim == 2 else 1)
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(kind or pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type = np.uint64, width: int = 1) -> np.ndarray:
    """All values of a binary column, one row after the other."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found = [np.frombuffer(x.as_buffer(), dtype=kind) for part in parts for x in part if x.is_valid]
    values = np.concatenate(found) if found else np.zeros(0, dtype=kind)
    return values.reshape(-1, width) if width > 1 else values


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the number of rows."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for column in columns:
        differs = column[1:] != column[:-1]
        new[1:] |= differs.any(axis=1) if differs.ndim == 2 else differs
    return np.append(np.flatnonzero(new), n)


def _sorted(keys: np.ndarray, holders: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    by = (holders, *keys.T[::-1]) if keys.ndim == 2 else (holders, keys)
    order = np.lexsort(by)
    return tuple(x[order] for x in (keys, holders, *more))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    high = (keys[:, 0] if keys.ndim == 2 else keys) >> np.uint64(32)
    return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _rows(numbers: np.ndarray, keys: np.ndarray, holders: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    bounds = runs(numbers)
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers[bounds[:-1]]), packed(keys, bounds), packed(holders, bounds), packed(known.astype(np.uint8), bounds)],
        names=["bucket", "keys", "holders", "known"],
    )


def settled(keys: np.ndarray, holders: np.ndarray, buckets: int, everyone: bool) -> Iterator[pa.RecordBatch]:
    """Entry rows of one batch; rows with a negative bucket hold what is decided already."""
    if not len(keys):
        return
    keys, holders = _sorted(keys, holders)
    first = runs(keys, holders)[:-1]
    keys, holders = keys[first], holders[first]
    bounds = runs(keys)
    least = np.zeros(len(keys), dtype=bool)
    least[bounds[:-1]] = True
    several = np.diff(bounds) > 1
    decided = np.repeat(several, np.diff(bounds)) if everyone else ~least
    if decided.any():
        ids = holders[decided]
        number = -1 - (ids % buckets)
        order = np.lexsort((ids, number))
        yield _rows(number[order], keys[decided][order], ids[order], np.ones(len(ids)))
    keys, holders = keys[least], holders[least]
    number = _bucket_of(keys, buckets)  # keys are in order, so the buckets are; within one, holders are put together
    order = np.lexsort((holders, number))
    yield _rows(number[order], keys[order], holders[order], (several & everyone)[order])


def _dealt(keys: np.ndarray, holders: np.ndarray, parts: int, *more: np.ndarray) -> list[pa.Array]:
    """Columns of one row for each part of the holders; so rows don't multiply with the buckets a holder occurs in."""
    part = holders % parts
    order = np.lexsort((holders, part))
    bounds = runs(part[order])
    columns = [packed(x[order], bounds) for x in (keys, holders, *more)]
    return [pa.array(part[order][bounds[:-1]], pa.int64()), *columns]


def shared(df: DataFrame, entries: Callable[[pa.RecordBatch], Entries], buckets: int, everyone: bool, width: int = 1) -> DataFrame:
    """(holder, keys binary), one row a holder: its distinct keys that others hold too.

    everyone: all holders of such keys; otherwise all but the least holder of each. A holder's list is at most as long as its text.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from settled(*entries(batch), buckets, everyone)

    def resolve(table: pa.Table) -> pa.Table:
        keys, holders = unpacked(table["keys"], width=width), unpacked(table["holders"], np.int64)
        if table["bucket"][0].as_py() >= 0:
            keys, holders, known = _sorted(keys, holders, unpacked(table["known"], np.uint8))
            bounds = runs(keys)
            lengths = np.diff(bounds)
            # Batches of one holder's repeated rows may both send it: it is one holder still.
            apart = holders[bounds[:-1]] != holders[bounds[1:] - 1]
            if everyone:
                keep = np.repeat(apart | np.logical_or.reduceat(known > 0, bounds[:-1]), lengths) & (known == 0)
            else:
                keep = holders != np.repeat(holders[bounds[:-1]], lengths)
            keys, holders = keys[keep], holders[keep]
        return pa.Table.from_arrays(_dealt(keys, holders, buckets), names=["part", "keys", "holders"])

    def collect(table: pa.Table) -> pa.Table:
        holders, keys = unpacked(table["holders"], np.int64), unpacked(table["keys"], width=width)
        order = np.lexsort((*(keys.T[::-1] if width > 1 else (keys,)), holders))
        holders, keys = holders[order], keys[order]
        new = runs(holders, keys)[:-1]
        holders, keys = holders[new], keys[new]
        bounds = runs(holders)
        return pa.Table.from_arrays([pa.array(holders[bounds[:-1]], pa.int64()), packed(keys, bounds)], names=["holder", "keys"])

    met = df.mapInArrow(make, ENTRIES).groupBy("bucket").applyInArrow(resolve, "part long, keys binary, holders binary")
    return met.groupBy("part").applyInArrow(collect, "holder long, keys binary")


def tallies(df: DataFrame, entries: Callable[[pa.RecordBatch], Entries], buckets: int, most: int) -> DataFrame:
    """(a, b, n): n keys of at most ``most`` holders that a < b have in common; (a, a, n): n keys of a that have more holders.

    Holders of a key must be distinct over all batches. A key with more than ``most`` holders in a batch is
    counted there, and only most + 1 of them go on to tell the other batches.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, holders = entries(batch)
            if not len(keys):
                continue
            keys, holders = _sorted(keys, holders)
            bounds = runs(keys)
            lengths = np.diff(bounds)
            many = np.repeat(lengths > most, lengths)
            if many.any():
                names, counts = np.unique(holders[many], return_counts=True)
                part = names % buckets
                order = np.argsort(part, kind="stable")
                number = -1 - part[order]
                edges = runs(number)
                columns = [packed(x, edges) for x in (names[order].astype(np.uint64), names[order], counts[order].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(number[edges[:-1]]), *columns], names=["bucket", "keys", "holders", "known"])
            sent = np.arange(len(keys)) - np.repeat(bounds[:-1], lengths) <= most
            number = _bucket_of(keys[sent], buckets)
            edges = runs(number)
            columns = [packed(x, edges) for x in (keys[sent], holders[sent], many[sent].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(number[edges[:-1]]), *columns], names=["bucket", "keys", "holders", "known"])

    def resolve(table: pa.Table) -> pa.Table:
        keys, holders, known = unpacked(table["keys"]), unpacked(table["holders"], np.int64), unpacked(table["known"], np.int64)
        if table["bucket"][0].as_py() < 0:
            a, b, n = holders, keys.astype(np.int64), known
        else:
            keys, holders, known = _sorted(keys, holders, known)
            bounds = runs(keys)
            lengths = np.diff(bounds)
            many = np.repeat(lengths > most, lengths) & (known == 0)
            first, second = [holders[many]], [holders[many]]
            for size in range(2, most + 1):
                group = holders[bounds[:-1][lengths == size][:, None] + np.arange(size)]
                x, y = np.triu_indices(size, 1)
                first.append(group[:, x].ravel())
                second.append(group[:, y].ravel())
            a, b = np.concatenate(first), np.concatenate(second)
            a, b, n = _summed(a, b, np.ones(len(a), dtype=np.int64))
        return pa.Table.from_arrays(_dealt(b, a, buckets, n), names=["part", "b", "a", "n"])

    def add(table: pa.Table) -> pa.Table:
        a, b, n = _summed(*(unpacked(table[name], np.int64) for name in ("a", "b", "n")))
        return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    met = df.mapInArrow(make, ENTRIES).groupBy("bucket").applyInArrow(resolve, "part long, b binary, a binary, n binary")
    return met.groupBy("part").applyInArrow(add, "a long, b long, n long")


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    bounds = runs(a, b)
    return a[bounds[:-1]], b[bounds[:-1]], np.add.reduceat(n, bounds[:-1]) if len(n) else n


def links(df: DataFrame, entries: Callable[[pa.RecordBatch], Entries], buckets: int) -> DataFrame:
    """Edges (a, b) that join all holders of each key; far fewer than all pairs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, holders = entries(batch)
            if not len(keys):
                continue
            keys, holders = _sorted(keys, holders)
            yield from _stars(keys, holders, -1)
            least = runs(keys)[:-1]
            number = _bucket_of(keys[least], buckets)
            yield _rows(number, keys[least], holders[least], np.zeros(len(least)))

    def _stars(keys: np.ndarray, holders: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        pairs = star_pairs(keys, holders)
        if len(pairs):  # the pair travels as key and holder
            numbers = number - (pairs[:, 0] % buckets)
            order = np.argsort(numbers, kind="stable")
            yield _rows(numbers[order], pairs[order, 1].astype(np.uint64), pairs[order, 0], np.ones(len(pairs)))

    def resolve(table: pa.Table) -> pa.Table:
        keys, holders = unpacked(table["keys"]), unpacked(table["holders"], np.int64)
        if table["bucket"][0].as_py() >= 0:
            pairs = star_pairs(*_sorted(keys, holders))
        else:
            pairs = np.unique(np.stack([holders, keys.astype(np.int64)], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return df.mapInArrow(make, ENTRIES).groupBy("bucket").applyInArrow(resolve, "a long, b long").distinct()


def star_pairs(keys: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Distinct (holder, least holder of a key in common), for entries in order."""
    bounds = runs(keys)
    least = np.repeat(holders[bounds[:-1]], np.diff(bounds))
    apart = least != holders
    pairs = np.stack([holders[apart], least[apart]], axis=1).astype(np.int64)
    return np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2)
