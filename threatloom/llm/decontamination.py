"""Benchmark decontamination: an FM-index per shard of training texts, searched for all test phrases.

A shard is some whole texts of a task, up to SHARD_BYTES bytes. Its alphabet is the words of the test phrases; all other words are
separators, and stretches too short to hold any phrase are left out of the index, which changes no result. Phrases are
found by backward search through wavelet-tree ranks, located by sampled suffix positions, and their places
merged to removal spans.

The benchmark is sent to the executors in blocks of at most BLOCK_CHARS characters; a larger benchmark takes several
rounds over the documents, cut by checkpoints.

Defined results: null or empty text and items have no words. Every row is judged by itself, so repeated rows and rows
without doc_id get the results of their texts; items without item_id mark words but have no id to report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import documents
from threatloom.llm.fm_index import FMIndex
from threatloom.llm.words import ALNUM_LOWER, CHUNK_BYTES, Chunk, chunks, covered, inside
from threatloom.session import checkpointed

WINDOW = 10
SHARD_BYTES = 4 * CHUNK_BYTES
BLOCK_CHARS = 16_000_000
_SPANS = "array<struct<first:int,last:int>>"


@dataclass
class Phrases:
    """Distinct test phrases by length, as symbols, and the items that hold each."""

    vocabulary: np.ndarray  # ascending word hashes; symbol = place + 1
    near: np.ndarray  # which leading 16 bits occur in the vocabulary
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, hashes[maybe])
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == hashes[maybe]
        found[maybe[same]] = place[same] + 1
        return found


def phrases(items: list[tuple[int | None, str | None]], window: int) -> Phrases:
    column = pa.array([text for _, text in items], pa.string())
    found = list(chunks(column, ALNUM_LOWER))
    vocabulary = np.unique(np.concatenate([c.hashes for c in found])) if found else np.zeros(0, dtype=np.uint64)
    near = np.zeros(1 << 16, dtype=bool)
    near[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    result = Phrases(vocabulary, near, {}, {})
    rows: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for chunk in found:
        symbols = result.symbols(chunk.hashes).tolist() if len(vocabulary) else []
        for row in range(chunk.rows):
            words = symbols[chunk.bounds[row] : chunk.bounds[row + 1]]
            item, length = items[chunk.first + row][0], min(window, len(words))
            for start in range(len(words) - length + 1) if length else ():
                holders = rows.setdefault(length, {}).setdefault(tuple(words[start : start + length]), set())
                if item is not None:
                    holders.add(item)
    for length, held in rows.items():
        result.by_length[length] = np.array(list(held), dtype=np.int64)
        result.items[length] = [sorted(x) for x in held.values()]
    return result


def _stretches(chunk: Chunk, symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The indexed text, a separator before each stretch of known words, and the word each symbol stands for."""
    known = symbols > 0
    opens, closes = known.copy(), known.copy()
    opens[1:] &= ~known[:-1]
    closes[:-1] &= ~known[1:]
    edges = np.unique(chunk.bounds)
    edges = edges[(edges > 0) & (edges < len(symbols))]
    opens[edges] = known[edges]
    closes[edges - 1] = known[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    lengths = ends - starts + 1
    at = np.cumsum(lengths) - lengths
    words = np.arange(lengths.sum()) - np.repeat(at, lengths) + np.repeat(starts, lengths) - 1
    text = symbols[np.maximum(words, 0)]
    text[at] = 0
    return text, words


def hits(chunk: Chunk, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Starts and lengths of all occurrences, in words of the chunk, and distinct (row, item) pairs."""
    starts, lengths, pairs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], set()
    if len(wanted.vocabulary) and len(chunk.hashes):
        text, words = _stretches(chunk, wanted.symbols(chunk.hashes), wanted.shortest)
        if len(text):
            index, rows = FMIndex(text, len(wanted.vocabulary)), chunk.row_of_word()
            for length, patterns in wanted.by_length.items():
                number, low, high = index.search(patterns)
                many = high - low
                each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                place = words[index.locate(each)]
                starts.append(place)
                lengths.append(np.full(len(place), length))
                held = wanted.items[length]
                both = np.unique(np.stack([rows[place], np.repeat(number, many)], axis=1), axis=0)
                for row, phrase in both.tolist():
                    pairs.update((row, item) for item in held[phrase])
    return np.concatenate(starts), np.concatenate(lengths), sorted(pairs)


def _spans(gone: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()]


def _scan(wanted, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = wanted.value
        for batch in batches:
            spans, items, words, texts = [], [], [], []
            before, named = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for chunk in chunks(batch.column("text"), ALNUM_LOWER, SHARD_BYTES):
                starts, lengths, pairs = hits(chunk, block)
                gone = covered(len(chunk.hashes), starts, lengths)
                found: dict[int, list[int]] = {}
                for row, item in pairs:
                    found.setdefault(row, []).append(item)
                touched = np.add.reduceat(np.append(gone, False), chunk.bounds[:-1]) > 0 if chunk.rows else gone
                raw = chunk.data.tobytes() if last else b""
                for row in range(chunk.rows):
                    begin, end = int(chunk.bounds[row]), int(chunk.bounds[row + 1])
                    mine, at = [], chunk.first + row
                    if end > begin and (touched[row] or before[at]):
                        own = gone[begin:end]
                        for span in before[at] or []:
                            own[span["first"] : span["last"] + 1] = True
                        mine = _spans(own)
                    spans.append(mine)
                    items.append(sorted({*(named[at] or []), *found.get(row, [])}))
                    words.append(end - begin)
                    if last:
                        texts.append(_without(raw, chunk, row, mine).decode() if mine else batch.column("text")[at].as_py())
            yield _result(batch, spans, items, words, texts, last)

    return scan


def _without(raw: bytes, chunk: Chunk, row: int, spans: list[dict[str, int]]) -> bytes:
    """The row's text without the spans: each is cut from its first word's first byte to its last word's last."""
    at, end, first = int(chunk.offsets[row]), int(chunk.offsets[row + 1]), int(chunk.bounds[row])
    parts = []
    for span in spans:
        parts.append(raw[at : int(chunk.starts[first + span["first"]])])
        at = int(chunk.ends[first + span["last"]])
    return b"".join([*parts, raw[at:end]])


_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _result(batch: pa.RecordBatch, spans: list, items: list, words: list, texts: list, last: bool) -> pa.RecordBatch:
    columns = {name: batch.column(name) for name in batch.schema.names if name not in ("spans", "items")}
    columns["spans"] = pa.array(spans, _SPAN_TYPE)
    columns["items"] = pa.array(items, pa.list_(pa.int64()))
    if last:
        columns["n_words"] = pa.array(words, pa.int64())
        columns["n_hit"] = pa.array([sum(s["last"] - s["first"] + 1 for s in mine) for mine in spans], pa.int64())
        joined = [",".join(sorted(map(str, x))) for x in items]
        columns["items_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string())
        columns["clean_text"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if block and chars + len(row[1] or "") > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(tuple(row))
        chars += len(row[1] or "")
    yield block


def scan_benchmark(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: words, removal spans (in words, merged), the items with occurring phrases, and the text without the spans.

    keep: further columns of ``df`` to carry along.
    """
    context = df.sparkSession.sparkContext
    docs = documents(df, *keep).withColumn("spans", F.lit(None).cast(_SPANS)).withColumn("items", F.lit(None).cast("array<long>"))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    blocks = _blocks(benchmark)
    block, last = next(blocks), False
    while not last:
        after = next(blocks, None)
        last = after is None
        schema = plain + (", n_words long, n_hit long, items_sha256 string, clean_text string" if last else "")
        docs = docs.mapInArrow(_scan(context.broadcast(phrases(block, window)), last), schema)
        if not last:
            docs = checkpointed(docs)
            block = after
    return docs
