"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 low quality, 1 good but toxic, 2 good. One weight vector over hashed text features is shared by all
thresholds: P(grade > k) = logistic(w x - theta_k) with ordered thetas. The expected grade is the sum of these, and the tail
probability P(grade = 2) selects documents.

Features are what a text holds, not how often: its words, the first PREFIXES bytes of longer words, and classes of some ratios
(capitals, signs, repeated words), hashed to 2 ** FEATURE_BITS places. Training uses at most TRAIN_ROWS labelled
documents, those with the least hashes of their ids, and the MOST_FEATURES features that tell the grades apart best. Features are
counted by grade and chosen in the cluster; the one training task gets only the chosen ones of each document, at most MOST_FEATURES
two-byte numbers a row, so neither it nor the weights sent to the executors grow with the texts. Every document is scored whole.

Defined results: a null text is an empty one. Labels without doc_id, quality or toxicity are left out; of several labels of a document
the least grade counts. Without any usable label nothing can be rejected: scores are null and all rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import documents
from threatloom.llm.meet import runs
from threatloom.llm.words import _BYTE_VALUES, _POWERS, ALNUM_LOWER, Chunk, chunks, mix
from threatloom.session import checkpointed

FEATURE_BITS = 22
PREFIXES = (4, 5)
TRAIN_ROWS = 20_000
MOST_FEATURES = 8_192
LEAST_DOCUMENTS = 4
#: Standard errors by which a feature's documents must differ from all in some P(grade >= k).
LEAST_SCORE = 4.0
GRADES = 3
RIDGE = 0.05
#: Pairs of row and feature that a training step expands at once.
PAIRS = 1 << 19
KEEP = 0.75
_MASK = np.uint64((1 << FEATURE_BITS) - 1)
_SHAPES = np.uint64(0x5851F42D4C957F2D)
_UPPER, _SIGNS, _MARKS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SIGNS[[ord(c) for c in "#*$%&|<>@_=~^{}[]\\"]] = True
_MARKS[[ord(c) for c in "!?"]] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a chunk; words and prefixes may occur more than once."""
    rows = chunk.row_of_word()
    sums = np.zeros(len(chunk.data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[ALNUM_LOWER.read_as][chunk.data] * _POWERS.up[: len(chunk.data)], out=sums[1:])
    owners, prefixes = [], []
    for length in PREFIXES:
        longer = np.flatnonzero(chunk.ends - chunk.starts > length)
        begin = chunk.starts[longer]
        owners.append(rows[longer])
        prefixes.append(mix((sums[begin + length] - sums[begin]) * _POWERS.down[begin] + np.uint64(length)))
    words = np.diff(chunk.bounds)
    size = np.maximum(1, np.diff(chunk.offsets))
    again = np.zeros(len(chunk.hashes), dtype=bool)
    again[1:] = (chunk.hashes[1:] == chunk.hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((chunk.hashes, rows))
    distinct = np.bincount(rows[order][runs(rows[order], chunk.hashes[order])[:-1]], minlength=chunk.rows)
    ratios = [
        _per_row(_UPPER[chunk.data], chunk.offsets) / size, _per_row(_SIGNS[chunk.data], chunk.offsets) / size,
        _per_row(_MARKS[chunk.data], chunk.offsets) / size, _per_row(again, chunk.bounds) / np.maximum(1, words),
    ]
    shapes = [np.minimum(15, np.round(ratio * 40)).astype(np.uint64) for ratio in ratios]
    shapes.append(np.minimum(15, 16 * distinct / np.maximum(1, words)).astype(np.uint64))
    shapes.append(np.minimum(15, np.log2(words + 1)).astype(np.uint64))
    shaped = [mix(value + np.uint64(16 * number) + _SHAPES) for number, value in enumerate(shapes)]
    each = np.arange(chunk.rows)
    found = np.concatenate([chunk.hashes, *prefixes, *shaped]) & _MASK
    return np.concatenate([rows, *owners, *[each] * len(shaped)]), found.astype(np.int64)


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _grades(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).cast("int").alias("grade"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each grade that hold a feature, one row for each feature of a chunk; the feature -1 is held by all."""
    for batch in batches:
        grades = batch.column("grade").to_numpy()
        for chunk in chunks(batch.column("text"), ALNUM_LOWER):
            rows, found = features(chunk)
            pairs = np.unique(rows << FEATURE_BITS | found)
            own = grades[chunk.first : chunk.first + chunk.rows]
            column = np.concatenate([pairs & int(_MASK), np.full(chunk.rows, -1)])
            grade = np.concatenate([own[pairs >> FEATURE_BITS], own])
            names, number = np.unique(column, return_inverse=True)
            counts = np.bincount(number * GRADES + grade, minlength=len(names) * GRADES).reshape(-1, GRADES)
            yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(n) for n in counts.T)], names=["feature", "n0", "n1", "n2"])


def choose(rows: DataFrame, most: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` features whose documents differ most from all in some P(grade >= cut), ascending; and documents by grade."""
    counts = rows.mapInArrow(_counted, "feature long, n0 long, n1 long, n2 long").groupBy("feature")
    counts = checkpointed(counts.agg(*(F.sum(name).alias(name) for name in ("n0", "n1", "n2"))))
    everyone = counts.where("feature = -1").first()
    if everyone is None:
        return np.zeros(0, dtype=np.int64), np.zeros(GRADES, dtype=np.int64)
    of_grade = np.array(everyone[1:])
    n = int(of_grade.sum())
    total, score = F.col("n0") + F.col("n1") + F.col("n2"), F.lit(0.0)
    for cut in range(1, GRADES):
        share = float(of_grade[cut:].sum()) / n
        hits = sum((F.col(f"n{k}") for k in range(cut, GRADES)), F.lit(0))
        score = F.greatest(score, F.abs(hits - total * share) / F.sqrt(total * max(share * (1 - share), 1 / n)))
    good = counts.withColumn("score", score).where((total >= min(LEAST_DOCUMENTS, max(1, n // 50))) & (F.col("score") >= LEAST_SCORE))
    best = good.where("feature >= 0").orderBy(F.desc("score"), "feature").limit(most).select("feature").collect()
    return np.sort(np.array([r.feature for r in best], dtype=np.int64)), of_grade


def _reduced(names: np.ndarray):
    """Of each document its chosen features, as places among them."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << FEATURE_BITS, -1, dtype=np.int16)
        number[names] = np.arange(len(names))
        for batch in batches:
            for chunk in chunks(batch.column("text"), ALNUM_LOWER):
                rows, found = features(chunk)
                place = number[found].astype(np.int64)
                pairs = np.unique((rows << FEATURE_BITS | place)[place >= 0])
                bounds = np.searchsorted(pairs >> FEATURE_BITS, np.arange(chunk.rows + 1))
                held = (pairs & int(_MASK)).astype(np.int16)
                yield pa.RecordBatch.from_pydict(
                    {"grade": batch.column("grade").slice(chunk.first, chunk.rows),
                     "held": pa.array([held[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())}
                )

    return reduce


def fit(held: list[np.ndarray], grades: np.ndarray, features: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``features`` features and thresholds: maximum likelihood with a small ridge, by full-batch steps scaled per weight.

    Pairs of row and feature are expanded some rows at a time; besides two bytes a pair, memory follows rows and features.
    """
    n, lengths = len(held), np.array([len(x) for x in held])
    column = np.concatenate(held)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    cuts = [0]
    while cuts[-1] < n:  # rows of about PAIRS pairs
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + PAIRS, side="right")) - 1))
    blocks = [(a, b, column[bounds[a] : bounds[b]], lengths[a:b]) for a, b in zip(cuts, cuts[1:])]
    weights, squares = np.zeros(features), np.full(features, 1e-6)
    share = [np.clip((grades >= cut).mean(), 0.5 / n, 1 - 0.5 / n) for cut in range(1, GRADES)]
    thresholds = np.maximum.accumulate([-np.log(s / (1 - s)) for s in share] + np.arange(GRADES - 1) * 1e-3)
    z = np.zeros(n)
    for _ in range(rounds):
        for a, b, places, sizes in blocks:
            z[a:b] = np.bincount(np.repeat(np.arange(b - a), sizes), weights=weights[places], minlength=b - a)
        low, high, probability = cumulative(z, thresholds, grades)
        slope = 1 - low - high
        gradient = -RIDGE * weights
        for a, b, places, sizes in blocks:
            gradient += np.bincount(places, weights=np.repeat(slope[a:b], sizes), minlength=features)
        squares += gradient**2
        weights = np.minimum(0, weights + 0.5 * gradient / np.sqrt(squares))
        for k in range(GRADES - 1):
            step = np.sum((high * (1 - high) / probability)[grades == k]) - np.sum((low * (1 - low) / probability)[grades == k + 1])
            at = _logistic(z - thresholds[k])
            thresholds[k] += np.clip(0.5 * step / (np.sum(at * (1 - at)) + 1), -1, 1)  # a damped Newton step
        thresholds = np.maximum.accumulate(thresholds + np.arange(GRADES - 1) * 1e-9)
    return weights, thresholds


def cumulative(z: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(grade >= own), P(grade > own) and P(grade = own) of every row."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    low, high = _logistic(z - edges[grades]), _logistic(z - edges[grades + 1])
    return low, high, np.maximum(low - high, 1e-9)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of at most ``train_rows`` labelled documents: features chosen in the cluster, weights fitted by one task."""
    chosen = _grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # The sample is bounded by train_rows, so it may be sent to all. Its texts are read three times, hence the checkpoint.
    rows = checkpointed(documents(docs).join(F.broadcast(chosen), "doc_id").select("text", "grade"))
    names, of_grade = choose(rows)
    if not of_grade.sum():
        return None

    def one(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(x.as_buffer(), dtype=np.int16) for part in table["held"].chunks for x in part]
        grades = table["grade"].to_numpy().astype(np.int64)
        order = sorted(range(len(held)), key=lambda i: (grades[i], held[i].tobytes()))  # the same model from any order of rows
        weights, thresholds = fit([held[i] for i in order], grades[order], len(names))
        places = np.concatenate([np.arange(len(names)), -1 - np.arange(GRADES - 1)])
        return pa.table({"place": pa.array(places, pa.int64()), "value": pa.array(np.concatenate([weights, thresholds]))})

    reduced = rows.mapInArrow(_reduced(names), "grade int, held binary").withColumn("all", F.lit(0))
    fitted = {r.place: r.value for r in reduced.groupBy("all").applyInArrow(one, "place long, value double").collect()}
    weights = np.array([fitted[k] for k in range(len(names))])
    return Model(names, weights, np.array([fitted[-1 - k] for k in range(GRADES - 1)]))


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        table = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
        table[fitted.places] = fitted.weights
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for chunk in chunks(batch.column("text"), ALNUM_LOWER):
                rows, found = features(chunk)
                counts = table[found] != 0
                pairs = np.unique(rows[counts] << FEATURE_BITS | found[counts])
                z[chunk.first : chunk.first + chunk.rows] = np.bincount(
                    pairs >> FEATURE_BITS, weights=table[pairs & int(_MASK)], minlength=chunk.rows
                )
            above = _logistic(z[:, None] - fitted.thresholds)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["expected_grade"] = pa.array(above.sum(axis=1))
            columns["tail_probability"] = pa.array(above[:, -1])
            yield pa.RecordBatch.from_pydict(columns)

    return score


def classify(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, keep_from: float = KEEP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: expected grade, P(grade = 2), and whether it is kept."""
    model = train(df, labels, train_rows)
    docs = documents(df, *keep)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.withColumns({"expected_grade": nothing, "tail_probability": nothing, "kept": F.lit(True)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += ", expected_grade double, tail_probability double"
    scored = docs.mapInArrow(_score(df.sparkSession.sparkContext.broadcast(model)), schema)
    return scored.withColumn("kept", F.col("tail_probability") >= keep_from)
