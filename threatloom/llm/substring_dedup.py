"""Repeated passages: seed and extend over whole texts.

Seeds are winnowed anchors: of the word 10-grams inside each window of ``window`` words the one with the least hash. Any
two equal windows choose the same anchor, so documents joined on anchors include all that share a window.
A seed is then extended to both sides: every placement of the window around a shared anchor is hashed (two
64-bit hashes) and looked for in other documents. Placements next to each other that are found earlier add up to the
maximal repeat, whatever its length over the threshold.

Defined results: null or empty text has no words. Rows that repeat a doc_id count as copies of one document: each is
judged against smaller ids and within itself. A row without doc_id is judged within itself alone and precedes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm import meet
from threatloom.llm.common import documents, maybe_in
from threatloom.llm.words import SPACED, Chunk, chunks, covered, inside, windows

WINDOW = 20
ANCHOR = 10
_SECOND = 0xD1342543DE82EF95

RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string"


def _window_places(chunk: Chunk, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows within one text, the place of each one's anchor, and all anchors' hashes."""
    n = len(chunk.hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    grams = windows(chunk.hashes, anchor)
    span = window - anchor + 1
    best, value = np.arange(n), grams[:n].copy()
    for step in range(1, span):
        other = grams[step : step + n]
        less = other <= value  # the last of equal ones, in any document alike
        value[less] = other[less]
        best[less] = np.flatnonzero(less) + step
    places = np.flatnonzero(inside(chunk.bounds, window, n))
    return places, best[places], grams


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _both(hashes: np.ndarray, window: int, places: np.ndarray) -> np.ndarray:
    return np.stack([windows(hashes, window)[places], windows(hashes, window, _SECOND)[places]], axis=1)


def _joined(parts: list[np.ndarray], width: int = 1) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros((0, width) if width > 1 else 0, dtype=np.uint64)


def _seeds(window: int, anchor: int):
    def entries(batch: pa.RecordBatch) -> meet.Entries:
        ids, keys, holders = _ids(batch), [], []
        for chunk in chunks(batch.column("text"), SPACED):
            places, best, grams = _window_places(chunk, window, anchor)
            new = meet.runs(best)[:-1] if len(best) else best
            keys.append(grams[best[new]])
            holders.append(ids[chunk.first + chunk.row_of_word()[places[new]]])
        return _joined(keys), _joined(holders).astype(np.int64)

    return entries


def _placements(window: int, anchor: int):
    def entries(batch: pa.RecordBatch) -> meet.Entries:
        ids, keys, holders = _ids(batch), [], []
        lists = batch.column("keys")
        for chunk in chunks(batch.column("text"), SPACED):
            places, best, grams = _window_places(chunk, window, anchor)
            rows = chunk.row_of_word()[places] if len(places) else places
            seeds = grams[best] if len(places) else grams
            both = _both(chunk.hashes, window, places) if len(places) else np.zeros((0, 2), dtype=np.uint64)
            bounds = np.searchsorted(rows, np.arange(chunk.rows + 1))
            for row in range(chunk.rows):
                lo, hi = bounds[row], bounds[row + 1]
                if hi > lo and lists[chunk.first + row].is_valid:
                    hot = np.isin(seeds[lo:hi], np.frombuffer(lists[chunk.first + row].as_buffer(), dtype=np.uint64))
                    keys.append(both[lo:hi][hot])
                    holders.append(np.full(len(keys[-1]), ids[chunk.first + row]))
        return _joined(keys, 2), _joined(holders).astype(np.int64)

    return entries


def _found(mine: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which of the hash pairs are among ``earlier``, which is in ascending order."""
    place = np.searchsorted(earlier[:, 0], mine[:, 0])
    found = np.zeros(len(mine), dtype=bool)
    open_ = np.arange(len(mine))
    while len(open_):  # more than once only for equal first hashes
        open_ = open_[place[open_] < len(earlier)]
        open_ = open_[earlier[place[open_], 0] == mine[open_, 0]]
        same = earlier[place[open_], 1] == mine[open_, 1]
        found[open_[same]] = True
        open_ = open_[~same]
        place[open_] += 1
    return found


def _finish(window: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "removed", "kept")}
            for chunk in chunks(batch.column("text"), SPACED):
                n = len(chunk.hashes) - window + 1
                places = np.flatnonzero(inside(chunk.bounds, window, n)) if n > 0 else np.zeros(0, dtype=np.int64)
                both = _both(chunk.hashes, window, places) if n > 0 else np.zeros((0, 2), dtype=np.uint64)
                rows = chunk.row_of_word()[places] if len(places) else places
                order = np.lexsort((both[:, 1], both[:, 0], rows))
                repeated = np.ones(len(places), dtype=bool)
                repeated[order[meet.runs(rows[order], both[order])[:-1]]] = False
                bounds = np.searchsorted(rows, np.arange(chunk.rows + 1))
                for row in range(chunk.rows):
                    mine = slice(bounds[row], bounds[row + 1])
                    if mine.stop > mine.start and lists[chunk.first + row].is_valid:
                        earlier = np.frombuffer(lists[chunk.first + row].as_buffer(), dtype=np.uint64).reshape(-1, 2)
                        repeated[mine] |= _found(both[mine], earlier)
                gone = covered(len(chunk.hashes), places[repeated], window)
                raw = chunk.data.tobytes()
                text_bounds, at = chunk.offsets.tolist(), chunk.bounds.tolist()
                removed_before = np.concatenate([[0], np.cumsum(gone)])
                for row in range(chunk.rows):
                    begin, end = at[row], at[row + 1]
                    many = int(removed_before[end] - removed_before[begin])
                    spans: list[dict[str, int]] = []
                    if many:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[begin:end].astype(np.int8), [0]])))
                        spans = [{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()]
                        left = np.flatnonzero(~gone[begin:end]) + begin
                        words = zip(chunk.starts[left].tolist(), chunk.ends[left].tolist(), strict=True)
                        kept = b" ".join([raw[a:b] for a, b in words])
                    else:  # bytes.split knows the same white space
                        kept = b" ".join(raw[text_bounds[row] : text_bounds[row + 1]].split())
                    out["n_words"].append(end - begin)
                    out["n_removed"].append(many)
                    out["removed"].append(spans)
                    out["kept"].append(kept.decode())
            spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "removed": spans_type, "kept": pa.string()}
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")} | {name: pa.array(values, kinds[name]) for name, values in out.items()}
            )

    return finish


def remove_repeats(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: its words without those in any ``window`` words that occur earlier too, and the removed runs.

    Earlier: in a document of smaller doc_id, or further ahead in the same one.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor must fit into the window")
    docs = documents(df)
    named = docs.where("doc_id is not null")
    # A text of n bytes has about n / 6.5 words and a sixth of them are anchors.
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = meet.bucket_count(size // 30)
    seeds = meet.shared(named, _seeds(window, anchor), buckets, everyone=True)
    seeds = seeds.withColumnRenamed("holder", "doc_id")
    seeded = maybe_in(named, "doc_id", seeds.select("doc_id")).where("maybe").drop("maybe").join(seeds, "doc_id")
    marks = meet.shared(seeded, _placements(window, anchor), buckets, everyone=False, width=2)
    marks = marks.withColumnRenamed("holder", "doc_id")
    told = maybe_in(docs, "doc_id", marks.select("doc_id"))
    alone = told.where("not maybe").select("doc_id", "text", F.lit(None).cast("binary").alias("keys"))
    marked = told.where("maybe").select("doc_id", "text").join(marks, "doc_id", "left")
    return alone.unionByName(marked).mapInArrow(_finish(window), RESULT)
