"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Only the histogram of piece lengths, one count per length up to the limit, comes to the driver, so planning costs the same for any
input. Patterns are few-document combinations of length bins that fill a sequence; non-negative least squares says how often to
repeat each, the counts are rounded down, and what is left is placed best-fit, longest first, into the
room the patterns leave and into new sequences. The plan is a list of ranges over the pieces numbered by length.

Defined results: a null or empty text is one piece with the end id alone. Every row is a document of its own, so repeated rows are
packed as often as they occur, and rows without doc_id too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import documents
from threatloom.llm.token_ids import Encoder
from threatloom.llm.words import CHUNK_BYTES, buffers
from threatloom.operators.numbering import number_rows
from threatloom.session import checkpointed

LIMIT = 4096
END_ID = 1
#: Numbers of length bins and of documents in a pattern to plan with; the plan with the fewest sequences is taken.
SHAPES = ((256, 2), (128, 3))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, limit: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        closing = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw, offsets = buffers(batch.column("text"))
            first, n = 0, len(offsets) - 1
            while first < n:
                last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
                last = min(max(last, first + 1), n)
                data = raw[offsets[first] : offsets[last]]
                tokens, bounds = encoder.encode(data, offsets[first : last + 1] - offsets[first])
                tokens = np.ascontiguousarray(tokens, dtype="<u4")
                rows: list[tuple] = []
                for i in range(last - first):
                    begin, total = int(bounds[i]), int(bounds[i + 1] - bounds[i]) + 1
                    for piece, start in enumerate(range(0, total, limit)):
                        stop = min(start + limit, total)
                        body = tokens[begin + start : begin + min(stop, total - 1)].tobytes()
                        body += closing if stop == total else b""
                        rows.append((ids[first + i], piece, start, stop - start, zlib.crc32(body), body))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k, _ in zip(zip(*rows), kinds, names)], names=names)
                first = last

    return pieces


def token_pieces(df: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` tokens; with_ids adds them as little-endian 32-bit numbers."""
    return documents(df).mapInArrow(_pieces(tokenizer, limit, with_ids), PIECES + ", ids binary" * with_ids)


def patterns(bins: int, documents_: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``documents_`` bin numbers that add up to ``bins``."""
    found: list[tuple[int, ...]] = []

    def extend(taken: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(taken)
        elif len(taken) < documents_:
            for size in range(min(left, most), 0, -1):
                if size * (documents_ - len(taken)) < left:
                    break
                extend((*taken, size), left - size, size)

    extend((), bins, bins)
    return found


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least ||a x - b||, by the active-set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = np.where(active, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * scale:
            break
        active[best] = True
        while True:
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (trial <= 0)
            if not bad.any():
                break
            gap = x[bad] - trial[bad]
            step = float(np.min(np.where(gap > 0, x[bad] / np.where(gap > 0, gap, 1), 0)))
            x = x + step * (trial - x)
            dropped = active & (x <= 1e-12)
            if not dropped.any():
                dropped = bad
            active &= ~dropped
            x[~active] = 0
        x = trial
    return x


@dataclass
class _Group:
    """Sequences filled alike: ``count`` of them, each with slots (length, first rank, offset)."""

    count: int
    used: int = 0
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, length: int, rank: int) -> None:
        self.slots.append((length, rank, self.used))
        self.used += length

    def split(self, count: int) -> _Group:
        """Take ``count`` sequences off."""
        part = _Group(count, self.used, list(self.slots))
        self.count -= count
        self.slots = [(length, rank + count, offset) for length, rank, offset in self.slots]
        return part


def _from_patterns(counts: np.ndarray, limit: int, bins: int, most: int) -> tuple[list[_Group], np.ndarray]:
    """Groups from rounded pattern counts, and how many pieces of each length they use (the first ranks)."""
    width = -(-limit // bins)
    bin_of = -(-np.arange(limit + 1) // width)
    histogram = np.bincount(bin_of, weights=counts, minlength=bins + 1)[1:]
    choices = patterns(bins, most)
    matrix = np.zeros((bins, len(choices)))
    for j, choice in enumerate(choices):
        np.add.at(matrix[:, j], np.array(choice) - 1, 1)
    weight = np.sqrt(np.arange(1, bins + 1) / bins)  # short pieces find room anywhere
    repeats = np.floor(non_negative_least_squares(matrix * weight[:, None], histogram * weight) + 1e-6).astype(np.int64)
    taken = np.zeros(limit + 1, dtype=np.int64)
    free = histogram.astype(np.int64)
    groups: list[_Group] = []
    for j in np.argsort(-repeats, kind="stable"):
        column = matrix[:, j].astype(np.int64)
        need = column > 0
        times = int(min(repeats[j], (free[need] // column[need]).min()))
        if times <= 0:
            continue
        free -= times * column
        open_ = [_Group(times)]
        for size in choices[j]:
            filled, lengths = [], iter(range(min(limit, size * width), (size - 1) * width, -1))
            length = next(lengths)
            while open_:
                group = open_.pop()
                while not (left := int(counts[length] - taken[length])):
                    length = next(lengths)
                if left < group.count:
                    open_.append(group)
                    group = group.split(left)
                group.add(length, int(taken[length]))
                taken[length] += group.count
                filled.append(group)
            open_ = filled[::-1]
        groups.extend(open_)
    return groups, taken


def plan(counts: np.ndarray, limit: int = LIMIT, shapes: tuple[tuple[int, int], ...] = SHAPES) -> list[_Group]:
    """Groups of sequences that hold counts[n] pieces of each length n."""
    plans = [_plan(counts, limit, min(bins, limit), most) for bins, most in shapes]
    return min(plans, key=lambda groups: sum(group.count for group in groups))


def _plan(counts: np.ndarray, limit: int, bins: int, most: int) -> list[_Group]:
    full = _Group(int(counts[limit]))
    full.add(limit, 0)
    rest = counts.copy()
    rest[limit] = 0
    groups, taken = _from_patterns(rest, limit, bins, most)
    by_room: list[list[_Group]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit n: there are groups with room n
    for group in groups:
        by_room[limit - group.used].append(group)
        rooms |= 1 << (limit - group.used)

    def put(group: _Group) -> None:
        nonlocal rooms
        by_room[limit - group.used].append(group)
        rooms |= 1 << (limit - group.used)

    for length in range(limit - 1, 0, -1):
        left = int(rest[length] - taken[length])
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                group = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                if group.count > left:
                    part = group.split(left)
                    put(group)
                    group = part
                each = 1
            else:
                each = min(limit // length, left)
                group = _Group(left // each)
            for _ in range(each):
                group.add(length, int(taken[length]))
                taken[length] += group.count
                left -= group.count
            put(group)
    return [g for g in ([full] if full.count else []) + [g for room in by_room for g in room] if g.count]


def _slots(groups: list[_Group], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over pieces numbered by length: where each slot's range begins, its first sequence, and its offset."""
    base = np.concatenate([[0], np.cumsum(counts)])
    rows, sequence = [], 0
    for group in groups:
        rows.extend((int(base[length]) + rank, sequence, offset) for length, rank, offset in group.slots)
        sequence += group.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _place(slots):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, sequences, offsets = slots.value
        for batch in batches:
            position = batch.column("position").to_numpy()
            slot = np.searchsorted(begins, position, side="right") - 1
            columns = {name: batch.column(name) for name in batch.schema.names if name != "position"}
            columns["sequence_id"] = pa.array(sequences[slot] + position - begins[slot] if len(position) else position)
            columns["offset"] = pa.array(offsets[slot] if len(position) else position)
            yield pa.RecordBatch.from_pydict(columns)

    return place


def pack(df: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their sequence and the place in it."""
    pieces = checkpointed(token_pieces(df, tokenizer, limit, with_ids))
    counts = np.zeros(limit + 1, dtype=np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # at most ``limit`` rows
        counts[length] = count
    slots = _slots(plan(counts, limit), counts)
    numbered = number_rows(pieces, ["length", "doc_id", "piece", "start", "ids_crc32"], "position")
    schema = PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long"
    context = df.sparkSession.sparkContext
    return numbered.select(*pieces.columns, F.col("position").cast("long")).mapInArrow(_place(context.broadcast(slots)), schema)
