"""Chat formatting: minimum-cost repair of role sequences, then rendering.

Legal conversations are an optional system turn, then user and assistant turns in alternation, ending with the assistant. Dynamic programming
over the automaton's states (start, system, user, assistant) picks for every turn whether it is kept or relabelled, opens a turn or
is merged into the one before, and where empty turns are inserted, at the least total cost.

Turns are sorted by (conv_id, turn) over range partitions, so even a conversation with a third of all rows is spread. Of a conversation
that reaches over partitions, each partition's part is summed up as a 4 x 4 matrix of least costs; the driver joins
at most two matrices per partition, and each part is then solved between its entry and exit states.

Output is one row per source or inserted turn, in the order (turn, step); its rendered pieces put together give the repaired
conversation, so no row grows with a merged run.

A text cannot forge a turn: ``<|`` in it is rendered as ``<\\|`` (and ``<\\|`` with one more backslash, so ``unescaped`` gives the text
back), and every ``<|`` of a rendered conversation is a marker of its own.

Defined results: null conv_id is one conversation of its own; null or unknown roles have to be relabelled; null text is empty; ties of
turn are ordered by role, then by a hash of the text. Repeated rows are turns like others. Of equal costs the least state wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.session import checkpointed, ship_package

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
MERGE, INSERT, RELABEL = 1, 2, 3
_NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
_FAR = 1 << 40
#: Empty turns needed to open a turn of the label from the state; absent: not legal.
_OPEN: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
_CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = "turn long, step int, role string, action string, rendered string"


def known_role(role: str | None) -> int:
    return _NAMES.get((role or "").strip().lower(), START)


def escaped(text: str) -> str:
    """The text without ``<|``."""
    return _MARK.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def step_cost(state: int, role: int, label: int) -> tuple[int, bool]:
    """Least cost of taking a turn of ``role`` as ``label`` from ``state``, and whether it is merged."""
    cost = 0 if role == label else RELABEL
    merged = MERGE if state == label else _FAR
    opened = INSERT * len(_OPEN[state, label]) if (state, label) in _OPEN else _FAR
    return cost + min(merged, opened), merged <= opened


_STEPS = np.full((4, 4, 4), _FAR, dtype=np.int64)  # role, state before, state after
for _role in range(4):
    for _state in range(4):
        for _label in (SYSTEM, USER, ASSISTANT):
            _STEPS[_role, _state, _label] = min(_FAR, step_cost(_state, _role, _label)[0])


def matrix(roles: list[int]) -> np.ndarray:
    """Least cost from every entry state to every exit state."""
    result = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for role in roles:
        result = np.minimum(_FAR, (result[:, :, None] + _STEPS[role][None]).min(axis=1))
    return result


def labels(roles: list[int], entry: int, leave: int | None) -> list[int]:
    """The least-cost labels from ``entry``, to ``leave`` or to any state at its closing cost."""
    cost, back = np.full(4, _FAR, dtype=np.int64), []
    cost[entry] = 0
    for role in roles:
        table = cost[:, None] + _STEPS[role]
        back.append(table.argmin(axis=0))
        cost = np.minimum(_FAR, table.min(axis=0))
    if leave is None:
        leave = int(np.argmin(cost + INSERT * np.array([len(_CLOSE[s]) for s in range(4)])))
    found = []
    for choice in reversed(back):
        found.append(leave)
        leave = int(choice[leave])
    return found[::-1]


def repaired(turns: list[tuple[int | None, int, str]], entry: int = START, leave: int | None = None, ends: bool = True) -> list[tuple]:
    """(turn, step, role, action, rendered) rows for turns (turn, role, text) of one conversation or a part of it."""
    rows, state = [], entry
    turns = [(turn, role, escaped(text)) for turn, role, text in turns]
    for (turn, role, text), label in zip(turns, labels([t[1] for t in turns], entry, leave), strict=True):
        merged = step_cost(state, role, label)[1]
        if merged:
            rows.append((turn, 9, ROLES[label], "merge" if role == label else "relabel+merge", "\n" + text))
        else:
            empty = _OPEN[state, label]
            before = "<|end|>\n" if state != START else ""
            for step, extra in enumerate(empty):
                rows.append((turn, step, ROLES[extra], "insert", f"{before}<|{ROLES[extra]}|>\n"))
                before = "<|end|>\n"
            rows.append((turn, 9, ROLES[label], "keep" if role == label else "relabel", f"{before}<|{ROLES[label]}|>\n{text}"))
        state = label
    if ends and turns:
        for step, extra in enumerate(_CLOSE[state]):
            rows.append((turns[-1][0], 10 + step, ROLES[extra], "insert", f"<|end|>\n<|{ROLES[extra]}|>\n"))
        rows.append((turns[-1][0], 20, "", "end", "<|end|>\n"))
    return rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Turns of a partition, conversation by conversation."""
    from itertools import groupby

    def turns() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text")), strict=True)

    return groupby(turns(), key=lambda row: row[0])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of the first and the last conversation of this partition; only these may reach over its borders."""
    number, first, last = TaskContext.get().partitionId(), None, None
    for conv, rows in _parts(batches):
        last = (conv, bytes(known_role(row[2]) for row in rows))
        first = first or last
    found = [x for x in (first, last) if x is not None][: 1 if first is last else 2]
    costs = [matrix(list(roles)).ravel().tolist() for _, roles in found]
    yield pa.RecordBatch.from_pydict(
        {"part": pa.array([number] * len(found), pa.int32()), "conv_id": pa.array([x[0] for x in found], pa.int64()),
         "costs": pa.array(costs, pa.list_(pa.int64()))}
    )


def _borders(rows: list) -> dict[tuple[int, int | None], tuple[int, int | None, bool]]:
    """Entry state, exit state and whether it is the end, for the parts of conversations over several partitions."""
    parts: dict[int | None, list] = {}
    for row in sorted(rows, key=lambda r: r.part):
        parts.setdefault(row.conv_id, []).append((row.part, np.array(row.costs).reshape(4, 4)))
    found = {}
    for conv, held in parts.items():
        if len(held) < 2:
            continue
        cost, back = np.array([0, _FAR, _FAR, _FAR]), []
        for _, costs in held:
            table = cost[:, None] + costs
            back.append(table.argmin(axis=0))
            cost = np.minimum(_FAR, table.min(axis=0))
        state = int(np.argmin(cost + INSERT * np.array([len(_CLOSE[s]) for s in range(4)])))
        for place in range(len(held) - 1, -1, -1):
            entry = int(back[place][state])
            found[held[place][0], conv] = (entry, state, place == len(held) - 1)
            state = entry
    return found


def _repair(borders):
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId(), borders.value
        rows: list[tuple] = []
        for conv, turns in _parts(batches):
            own = [(turn, known_role(role), text or "") for _, turn, role, text in turns]
            rows.extend((conv, *row) for row in repaired(own, *known.get((number, conv), (START, None, True))))
            if len(rows) > 5_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return repair


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("step", pa.int32()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def repair_roles(df: DataFrame) -> DataFrame:
    """One row per turn of the repaired conversations, in the order (conv_id, turn, step)."""
    ship_package(df.sparkSession)
    turns = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # Bounds are drawn from hashes, not texts, and the row's number parts equal rows.
    turns = turns.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "_hash", "_row"]
    placed = checkpointed(turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_row"))  # so that parts stay where they are
    rows = placed.mapInArrow(_summaries, "part int, conv_id long, costs array<long>").collect()  # at most two per partition
    borders = df.sparkSession.sparkContext.broadcast(_borders(rows))
    return placed.mapInArrow(_repair(borders), "conv_id long, " + _TURN)
