"""Ranked lexical search: documents as impact vectors in buckets of falling length, searched exactly.

The score of a document for an item is the product of two vectors over terms: how often the item holds a term, and the
document's impact, weight times saturated frequency, all in integers. A first pass over the documents counts what weights and length
norms need. A second one makes the impact vectors of some whole texts at a time, over the terms of the items, orders
them by length (Euclidean) and cuts them into buckets. With an item's 10th best score so far as its threshold,

- a bucket is skipped if its longest vector times the item's length is below the threshold (Cauchy-Schwarz);
- in a bucket, coordinates are taken in LEVELS from the heaviest terms down; a document is skipped as soon as its score on the levels
  taken, plus the products of both lengths on each of the levels left, is below the threshold;
- whoever passes all levels has its exact score by then, in 64-bit integers.

Bounds are widened by 1e-9 of themselves against rounding and prune only what lies strictly below, so ties are kept
and settled by doc_id. Each task gives its best TOP of each item, which meet by groups of partitions first and by items then. Items
are sent to the executors in blocks of at most BLOCK_CHARS characters (and at least one item); further blocks take further passes.

Defined results: every row of the documents is a document and every row of the items an item, repeated or not; null or empty
texts have no terms, such items get no rows, and such documents none either. Among equal scores, rows without doc_id come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import documents
from threatloom.llm.meet import runs
from threatloom.llm.words import ALNUM_LOWER, CHUNK_BYTES, Chunk, chunks
from threatloom.session import checkpointed

TOP = 10
BUCKET_ROWS = 256
#: Levels of term weights; each holds about the same number of the items' terms.
LEVELS = 4
BLOCK_CHARS = 4_000_000
SHARD_BYTES = 4 * CHUNK_BYTES
#: Groups of partitions whose best rows meet before the items' do.
MEETINGS = 64
_NO_ID = (1 << 63) - 1
_SLACK = 1e-9


@dataclass
class Items:
    """A block of items: their terms as numbers, with repeats counted."""

    vocabulary: np.ndarray  # ascending term hashes
    near: np.ndarray  # which leading 16 bits occur in the vocabulary
    terms: list[np.ndarray]  # per item: distinct term numbers
    counts: list[np.ndarray]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their numbers."""
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, hashes[maybe])
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == hashes[maybe]
        return maybe[same], place[same]


def read_items(texts: list[str | None]) -> Items:
    found = list(chunks(pa.array(texts, pa.string()), ALNUM_LOWER))
    vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(c.hashes for c in found)]))
    near = np.zeros(1 << 16, dtype=bool)
    near[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    terms, counts = [], []
    for chunk in found:
        places = np.searchsorted(vocabulary, chunk.hashes)
        for a, b in zip(chunk.bounds, chunk.bounds[1:]):
            names, n = np.unique(places[a:b], return_counts=True)
            terms.append(names)
            counts.append(n)
    return Items(vocabulary, near, terms, counts)


def _occurrences(chunk: Chunk, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs in order, and how often each occurs."""
    places, numbers = items.numbers(chunk.hashes)
    keys = np.sort(chunk.row_of_word()[places] * len(items.vocabulary) + numbers)
    bounds = runs(keys)
    keys = keys[bounds[:-1]]
    return keys // max(1, len(items.vocabulary)), keys % max(1, len(items.vocabulary)), np.diff(bounds)


@dataclass
class Corpus:
    """What all documents together hold: documents with terms, terms with repeats, and a weight per term of the items."""

    documents: int
    length: int
    weights: np.ndarray


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _counting(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        n, length, holding = 0, 0, np.zeros(len(items.vocabulary), dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column("text"), ALNUM_LOWER):
                sizes = np.diff(chunk.bounds)
                n, length = n + int((sizes > 0).sum()), length + int(sizes.sum())
                holding += np.bincount(_occurrences(chunk, items)[1], minlength=len(holding))
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(np.concatenate([[-2, -1], held]), pa.int64()), "n": pa.array(np.concatenate([[n, length], holding[held]]), pa.int64())}
        )

    return count


def survey(docs: DataFrame, items: Items) -> Corpus:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    found = docs.select("text").mapInArrow(_counting(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {row.term: row.n for row in found.collect()}  # one row a term of the block
    n = counts.get(-2, 0)
    return Corpus(n, counts.get(-1, 0), np.array([weight(n, counts.get(k, 0)) for k in range(len(items.vocabulary))], dtype=np.int64))


def impacts(chunk: Chunk, items: Items, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and impacts, row by row; zero impacts are left out."""
    rows, terms, often = _occurrences(chunk, items)
    norms = 25 + (75 * np.diff(chunk.bounds).astype(np.int64) * corpus.documents) // max(1, corpus.length)
    values = corpus.weights[terms] * ((1_000_000_000 * often) // (1000 * often + 8 * norms[rows]))
    return rows[values > 0], terms[values > 0], values[values > 0]


class Search:
    """The best documents of each item so far, over all buckets that a task has seen."""

    def __init__(self, items: Items, corpus: Corpus, top: int = TOP) -> None:
        self.items, self.top = items, top
        self.best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in items.terms]  # scores, ids
        self.thresholds = np.ones(len(items.terms))  # scores are above 0
        spread = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *(corpus.weights[terms] for terms in items.terms)]))
        cuts = spread[[len(spread) * k // LEVELS for k in range(LEVELS - 1, 0, -1)]] if len(spread) else np.zeros(LEVELS - 1)
        self.level = (corpus.weights[:, None] < cuts).sum(axis=1)  # by term; 0 is the heaviest
        self.held = [[(terms[at == k], counts[at == k]) for k in range(LEVELS)] for terms, counts, at in ((t, c, self.level[t]) for t, c in zip(items.terms, items.counts))]
        squares = np.array([[float((counts.astype(float) ** 2).sum()) for _, counts in levels] for levels in self.held]).reshape(-1, LEVELS)
        self.lengths = np.sqrt(squares.sum(axis=1)) * (1 + _SLACK)
        self.by_level = np.sqrt(squares) * (1 + _SLACK)
        self.column = np.zeros(len(items.vocabulary), dtype=np.int64)
        self.buckets = self.skipped_buckets = self.scored = 0

    def add(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray) -> None:
        """Impact vectors of some documents, as entries in the order of rows; ids by row."""
        squares = np.bincount(rows * LEVELS + self.level[terms], weights=values.astype(float) ** 2, minlength=len(ids) * LEVELS)
        squares = squares.reshape(-1, LEVELS)
        lengths, by_level = np.sqrt(squares.sum(axis=1)), np.sqrt(squares)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        begins = np.searchsorted(rows, np.arange(len(ids) + 1))
        for first in range(0, len(order), BUCKET_ROWS):
            bucket = order[first : first + BUCKET_ROWS]
            live = np.flatnonzero(self.lengths * lengths[bucket[0]] >= self.thresholds)
            self.buckets += len(self.thresholds)
            self.skipped_buckets += len(self.thresholds) - len(live)
            if len(live):
                self._bucket(bucket, live, terms, values, begins, by_level[bucket], ids[bucket])

    def _bucket(self, bucket, live, terms, values, begins, by_level, ids) -> None:
        sizes = begins[bucket + 1] - begins[bucket]
        entries = np.repeat(begins[bucket] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        held = np.unique(terms[entries])
        self.column[held] = np.arange(1, len(held) + 1)  # 0: a term that no document of the bucket holds
        table = np.zeros((len(held) + 1, len(bucket)), dtype=np.int64)
        table[self.column[terms[entries]], np.repeat(np.arange(len(bucket)), sizes)] = values[entries]
        bounds = by_level @ self.by_level[live].T
        for item, bound in zip(live, bounds.T):
            threshold = self.thresholds[item]
            may, scores = np.flatnonzero(bound >= threshold), None
            if not len(may):
                continue
            left = bound[may]
            for level, (names, counts) in enumerate(self.held[item]):
                columns = self.column[names]
                here = columns > 0
                if not here.any():
                    left = left - self.by_level[item, level] * by_level[may, level]
                    continue
                part = counts[here] @ table[columns[here]][:, may]
                scores = part if scores is None else scores + part
                left = left - self.by_level[item, level] * by_level[may, level]
                good = scores + left + _SLACK * bound[may] >= threshold
                if not good.all():
                    may, scores, left = may[good], scores[good], left[good]
                    if not len(may):
                        break
            if len(may) and scores is not None:
                self.scored += len(may)
                self._offer(item, scores, ids[may])
        self.column[held] = 0

    def _offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.thresholds[item]
        if not good.any():
            return
        scores, ids = np.concatenate([self.best[item][0], scores[good]]), np.concatenate([self.best[item][1], ids[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.best[item] = scores[order], ids[order]
        if len(order) == self.top:
            self.thresholds[item] = scores[order[-1]]


def _searching(sent, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus = sent.value
        found = Search(items, corpus, top)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            for chunk in chunks(batch.column("text"), ALNUM_LOWER, SHARD_BYTES):
                found.add(*impacts(chunk, items, corpus), ids[chunk.first : chunk.first + chunk.rows])
        sizes = [len(scores) for scores, _ in found.best]
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()),
             "doc_id": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(ids for _, ids in found.best)])),
             "score": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(scores for scores, _ in found.best)]))}
        )

    return search


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks, read through the driver one partition at a time."""
    held, chars = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        if held and chars + len(row.text) > block_chars:
            yield held
            held, chars = [], 0
        held.append(tuple(row))
        chars += len(row.text)
    if held:
        yield held


def search(df: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank from 1, doc_id and score of the best ``top`` documents of each item."""
    docs, spark = documents(df), df.sparkSession
    result = None
    for block in _blocks(items, block_chars):
        read = read_items([text for _, text in block])
        corpus = survey(docs, read)
        sent = spark.sparkContext.broadcast((read, corpus))
        found = docs.mapInArrow(_searching(sent, top), "item long, doc_id long, score long")
        order = F.desc("score"), F.asc("doc_id")
        place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        met = found.withColumn("meeting", F.spark_partition_id() % MEETINGS).withColumn("rank", place("item", "meeting")).where(F.col("rank") <= top)
        best = met.drop("meeting").withColumn("rank", place("item")).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], "item long, item_id long")
        doc_id = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id")
        # The block's ids: one row an item.
        best = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
        result = best if result is None else checkpointed(result).unionByName(best)
    return result if result is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
