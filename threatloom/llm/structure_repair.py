"""Conversation structure repair: survivor-coalescence Viterbi over a conversation's rows.

Rows are taken in the order of turn (nulls first; rows of one turn by the MD5 of role and text). Every row is kept, rerolled to user or
assistant, or deleted, and empty turns are inserted, so that role initials read ``(s?(ua)+)?`` at the least cost; of equal costs the
ASCII-least string of edit initials wins. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated.

The trellis has four states: nothing yet, after a system turn, after a user turn, after an assistant turn. A step is the inserts before a row and
the row's own edit. Each state's survivor is a leaf of a tree of backpointers whose nodes count their references. When a
survivor dies, its branch is freed; when all survivors share an ancestor, the edits up to it are final and go out at once. So
only unresolved edits, and the rows that they stand for, are held. A survivor also dies when another one can imitate all its
futures and stay cheaper (or equal and ASCII-less), otherwise "delete everything so far" would never meet the others. Two tied
survivors are compared by their whole unresolved suffixes: that order is kept as a rank with each survivor, which a step updates, since
suffixes of different survivors differ before either ends.

Rows are spread over range partitions of (conv_id, turn, MD5), so a conversation with a third of all rows lies in many. Only for
conversations that cross a border: 4 x 4 matrices of least costs and a few border values, one row a part, give the driver the costs to
the end from every border; these make a part's choice a local one, so each part tells its exit state for every entry
state, and all parts are then repaired independently, with the very edits of one long run. The SHA-256 of a repaired conversation
is sequential by nature: conversations within one partition are hashed there; the lines of the others go
through one task a conversation, in order and some at a time.

Defined results: null role and text are one space; a null conv_id is one conversation; without turns there are no gaps. Rows marked
``dropped`` count for nothing, but their conversation is reported. Exactly equal rows are repeats, wherever they come from; an empty
table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.session import checkpointed, ship_package

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: Characters of repaired lines that travel in one row.
PIECE_CHARS = 1 << 18
_ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Which state a turn of an initial leads to.
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What a reroled or an inserted turn becomes, as the state after it.
_OTHER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Empty turns that make a legal end of a state.
CLOSING = (0, 2, 1, 0)
_LEGAL = {"su", "ua", "au"}


def _inserts() -> dict[tuple[int, int], int]:
    """Empty turns that lead from one state to another; more than two never help."""
    found = {}
    for state in range(4):
        now = state
        for n in range(3):
            found.setdefault((state, now), n)
            now = _OTHER[now]
    return found


INSERTS = _inserts()


def _steps(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, edits) of a row: for each pair of states the cheapest, then ASCII-least way."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for (state, now), n in INSERTS.items():
        ways = [(now, DELETE, "D")]
        if not must_go:
            extra = TRUNCATED if truncated else 0
            ways.append((_OTHER[now], REROLE + extra, "R"))
            if (now, initial) in _NEXT:
                ways.append((_NEXT[now, initial], KEEP + extra, "K"))
        for after, cost, edit in ways:
            way = (cost + INSERT * n, "I" * n + edit)
            best[state, after] = min(best.get((state, after), way), way)
    return [(state, after, cost, edits) for (state, after), (cost, edits) in best.items()]


STEPS = {(i, g, t): _steps(i, g, t) for i in "sua-" for g in (False, True) for t in (False, True)}


def _imitation() -> np.ndarray:
    """[p, q]: how much dearer p's way to any end can be than q's: both take the same edits, p with inserts or a deletion more.

    The least values that satisfy every step: whatever q does next, some step of p's with the same row leaves a pair of states within
    its own bound. Deleting stands for a step that p may not take; it costs DELETE at most where q pays nothing.
    """
    bound = np.array([[INSERT * (CLOSING[p] - CLOSING[q]) for q in range(4)] for p in range(4)])
    while True:
        wider = bound.copy()
        for p in range(4):
            for q in range(4):
                for kind in STEPS:
                    for state, after, cost, _ in STEPS[kind]:
                        if state == q:
                            answer = min(c + bound[a, after] for s, a, c, _ in STEPS[kind] if s == p)
                            wider[p, q] = max(wider[p, q], answer - cost)
        if (wider == bound).all():
            return bound
        bound = wider


IMITATION = _imitation().tolist()


class _Node:
    """Edits of one step, below those of its parent; freed when nothing refers to it."""

    __slots__ = ("parent", "edits", "references")

    def __init__(self, parent: _Node | None, edits: str) -> None:
        self.parent, self.edits, self.references = parent, edits, 0
        if parent is not None:
            parent.references += 1


class Decoder:
    """Edits of a run of rows from one entry state, given out as soon as all survivors agree on them."""

    def __init__(self, entry: int = START) -> None:
        self.root = _Node(None, "")
        #: state -> (cost, rank among the survivors' unresolved suffixes, leaf)
        self.survivors: dict[int, tuple[int, int, _Node]] = {entry: (0, 0, self.root)}
        self.root.references = 1
        self.held = self.most_held = 0

    def step(self, kind: tuple[str, bool, bool]) -> list[str]:
        """Take a row; returns the edits of earlier rows, or of this one, that are final now, one string a row."""
        best: dict[int, tuple] = {}
        for state, after, cost, edits in STEPS[kind]:
            if state in self.survivors:
                so_far, rank, leaf = self.survivors[state]
                way = (so_far + cost, rank, edits)
                if after not in best or way < best[after][0]:
                    best[after] = (way, leaf)
        order = sorted(best, key=lambda s: best[s][0][1:])
        found = {s: (best[s][0][0], rank) for rank, s in enumerate(order)}
        alive = {
            q for q, (cost, rank) in found.items()
            if not any(p != q and (c + IMITATION[p][q], r) < (cost, rank) for p, (c, r) in found.items())
        }
        before = [leaf for _, _, leaf in self.survivors.values()]
        after = {}
        for state in alive:
            node = _Node(best[state][1], best[state][0][2])
            node.references += 1
            after[state] = (*found[state], node)
        self.survivors = after
        self.held += len(after)
        for leaf in before:
            self._release(leaf)
        self.most_held = max(self.most_held, self.held)
        return self._resolved()

    def _release(self, node: _Node) -> None:
        node.references -= 1
        while node.references == 0 and node is not self.root:
            self.held -= 1
            node = node.parent
            node.references -= 1

    def _resolved(self) -> list[str]:
        """Walk down while the root has one child and is no survivor's leaf."""
        leaves = [leaf for _, _, leaf in self.survivors.values()]
        ends = lambda: self.root.references != 1 or any(leaf is self.root for leaf in leaves)
        if ends():
            return []
        below, node = [], leaves[0]
        while node is not self.root:
            below.append(node)
            node = node.parent
        path = []
        while below and not ends():
            self.root = below.pop()
            self.root.parent = None
            self.held -= 1
            path.append(self.root.edits)
        return path

    def best(self, to_go: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """(cost, state) of the least survivor, with the costs from each state to the end."""
        cost, _, state = min((cost + to_go[s], rank, s) for s, (cost, rank, _) in self.survivors.items())
        return cost, state

    def rest(self, state: int) -> list[str]:
        """The unresolved edits of a state's survivor."""
        path, node = [], self.survivors[state][2]
        while node is not self.root:
            path.append(node.edits)
            node = node.parent
        return path[::-1]


def matrix(kinds: Iterable[tuple[str, bool, bool]]) -> np.ndarray:
    """Least costs of a run of rows from every entry state to every exit state."""
    now = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for kind in kinds:
        then = [[FAR] * 4 for _ in range(4)]
        for state, after, cost, _ in STEPS[kind]:
            for entry in range(4):
                then[entry][after] = min(then[entry][after], now[entry][state] + cost)
        now = then
    return np.array(now)


def damaged(df: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32(conv_id:turn) % 20; a dropped row stays, marked."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") < 2, F.lit("")).when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") == 0).alias("dropped"), "what")
    return rows.withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("what", "copy")


def in_order(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault, sorted over range partitions, in the shared folder.

    Faults: dropped, blank, duplicate, truncated or empty.
    """
    ship_package(df.sparkSession)
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in df.columns else F.lit(False)
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role"), space("text"), dropped.alias("dropped"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    # Equal rows may be split anywhere; their own number in the input makes that possible.
    rows = rows.withColumns({"digest": digest, "number": F.monotonically_increasing_id()})
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest", "dropped").orderBy("turn", "number")) > 1
    ends = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(F.col("dropped"), "dropped").when(ends == "", "blank").when(seen, "duplicate")
        .when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    )
    order = ["conv_id", "turn", "digest", "number"]
    rows = rows.withColumn("fault", fault).drop("dropped")
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("digest", "number"))


@dataclass
class Part:
    """How a part of a conversation over several partitions begins and goes on."""

    entry: int = START
    to_go: tuple[int, ...] = tuple(INSERT * n for n in CLOSING)
    last: bool = True
    initial: str | None = None
    turn: int | None = None


def _kind(role: str, fault: str) -> tuple[str, bool, bool]:
    return role[:1] if role[:1] in ("s", "u", "a") else "-", fault in ("blank", "duplicate"), fault == "truncated"


def _conversations(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", *columns)), strict=True)

    return groupby(rows(), key=lambda row: row[0])


def _crossing(rows: DataFrame) -> list[int | None]:
    """Conversations in more than one partition: at most one a border."""
    key = F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("id"))
    ends = rows.groupBy(F.spark_partition_id()).agg(F.min(key).alias("first"), F.max(key).alias("last")).select("first", "last").collect()
    seen, twice = set(), set()
    for row in ends:
        for conv in {row.first.id, row.last.id}:
            (twice if conv in seen else seen).add(conv)
    return list(twice)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, rows in _conversations(batches, "turn", "initial", "fault"):
        initials, turns = [], []

        def kinds():
            for _, turn, initial, fault in rows:
                if fault != "dropped":
                    initials[:] = [initial]
                    turns[:] = [turn] if turn is not None else turns
                    yield _kind(initial, fault)

        costs = matrix(kinds()).ravel().tolist()
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "conv_id": pa.array([conv], pa.int64()),
             "costs": pa.array([costs], pa.list_(pa.int64())), "initial": pa.array(initials or [None], pa.string()),
             "turn": pa.array(turns or [None], pa.int64())}
        )


def _exits(parts):
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for conv, rows in _conversations(batches, "initial", "fault"):
            decoders = [Decoder(entry) for entry in range(4)]
            for _, initial, fault in rows:
                if fault != "dropped":
                    for decoder in decoders:
                        decoder.step(_kind(initial, fault))
            to_go = parts.value[number, conv].to_go
            leave = [decoder.best(to_go)[1] for decoder in decoders]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([number], pa.int32()), "conv_id": pa.array([conv], pa.int64()), "leave": pa.array([leave], pa.list_(pa.int64()))}
            )

    return exits


def _parts(rows: DataFrame) -> dict[tuple[int, int | None], Part]:
    """By (partition, conversation), for conversations that cross a border."""
    crossing = _crossing(rows)
    if not crossing:
        return {}
    known = F.col("conv_id").isin([conv for conv in crossing if conv is not None])
    inner = rows.where(known | F.col("conv_id").isNull() if None in crossing else known)
    narrow = inner.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    schema = "part int, conv_id long, costs array<long>, initial string, turn long"
    by_conversation: dict[int | None, list] = {}
    for row in sorted(narrow.mapInArrow(_summaries, schema).collect(), key=lambda r: r.part):
        by_conversation.setdefault(row.conv_id, []).append(row)
    parts = {}
    for conv, held in by_conversation.items():
        to_go = Part().to_go
        for row in reversed(held):
            parts[row.part, conv] = Part(to_go=to_go, last=row is held[-1])
            costs = np.array(row.costs).reshape(4, 4)
            to_go = tuple(int(x) for x in (costs + np.array(to_go)).min(axis=1))
        initial = turn = None
        for row in held:
            parts[row.part, conv].initial, parts[row.part, conv].turn = initial, turn
            initial = row.initial if row.initial is not None else initial
            turn = row.turn if row.turn is not None else turn
    sent = rows.sparkSession.sparkContext.broadcast(parts)
    found = narrow.mapInArrow(_exits(sent), "part int, conv_id long, leave array<long>").collect()
    leave = {(row.part, row.conv_id): row.leave for row in found}
    for conv, held in by_conversation.items():
        entry = START
        for row in held:
            parts[row.part, conv].entry = entry
            entry = leave[row.part, conv][entry]
    return parts


def edits(rows: Iterable[tuple], part: Part) -> Iterator[tuple]:
    """(edit, turn, role, text, cost so far) of (turn, role, text, fault) rows; text is None where a row goes.

    The costs are known at the end: all rows but the last one carry 0.
    """
    decoder, waiting, state = Decoder(part.entry), deque(), part.entry

    def out(steps: list[str]) -> Iterator[tuple]:
        nonlocal state
        for step in steps:
            for edit in step:
                if edit == "I":
                    state = _OTHER[state]
                    yield "I", None, _ROLE_OF[state], "", 0
                    continue
                turn, role, text = waiting.popleft()
                if edit == "D":
                    yield "D", turn, role, None, 0
                elif edit == "K":
                    state = _NEXT[state, role[:1]]
                    yield "K", turn, role, text, 0
                else:
                    state = _OTHER[state]
                    yield "R", turn, _ROLE_OF[state], text, 0

    for turn, role, text, fault in rows:
        kind = _kind(role, fault)
        waiting.append((turn, role, None if kind[1] else text))
        yield from out(decoder.step(kind))
    cost, leave = decoder.best(part.to_go)
    yield from out(decoder.rest(leave))
    if part.last:
        yield from out(["I" * CLOSING[leave]])
    yield "", None, "", None, cost - (0 if part.last else part.to_go[leave])


_EDITS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("least", pa.int64()), ("most", pa.int64())]
    + [(name, pa.int64()) for name in ("turns", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("lines", pa.string()), ("repaired_sha256", pa.string())]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{field.name} {names[field.type]}" for field in schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``size`` rows, or earlier of some pieces' characters."""
    from itertools import islice

    rows = iter(rows)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)


def repair(df: DataFrame) -> DataFrame:
    """One row per edit: conv_id, part and place that order a conversation's edits, the edit, and the repaired turn's role and text.

    ``turn`` is the source's, null for an inserted row; ``text`` is null for a deleted one.
    """
    rows = in_order(df)
    parts = df.sparkSession.sparkContext.broadcast(_parts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            place = 0
            for conv, held in _conversations(batches, "turn", "role", "text", "fault"):
                for edit, turn, role, text, _ in edits((row[1:] for row in held if row[4] != "dropped"), parts.value.get((number, conv), Part())):
                    if edit:
                        yield conv, number, place, edit, turn, role, text
                        place += 1

        yield from _batches(made(), _EDITS)

    return rows.mapInArrow(run, _ddl(_EDITS))


def _figures(conv: int | None, rows: Iterator[tuple], number: int, part: Part | None) -> Iterator[tuple]:
    """Rows of _DIGEST for a conversation: one with its hash, or the pieces of a part of one, figures in the last."""
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    turns = [None, None, 0]  # least, most, distinct ones that the part before doesn't end with
    before, illegal, last_turn = (part.initial, 0, part.turn) if part else (None, 0, None)

    def judged() -> Iterator[tuple]:
        nonlocal before, illegal, last_turn
        for _, turn, role, text, fault in rows:
            if fault == "dropped":
                continue
            if fault:
                counts[fault] += 1
            illegal += before is not None and before + role[:1] not in _LEGAL
            before = role[:1]
            if turn is not None:
                turns[0] = turn if turns[0] is None else turns[0]
                turns[1] = turn
                turns[2] += turn != last_turn
                last_turn = turn
            yield turn, role, text, fault

    sha, audit, lines, chars, piece, any_line = hashlib.sha256(), [], [], 0, 0, False
    for edit, _, role, text, cost in edits(judged(), part or Part()):
        audit.append(edit)
        if text is not None:
            line = f"{role}:{text}"
            if part is None:
                sha.update(("\n" + line if any_line else line).encode())
            else:
                lines.append("\n" + line)
                chars += len(line)
            any_line = True
        if part is not None and chars >= PIECE_CHARS:
            yield conv, number, piece, None, None, 0, 0, 0, 0, 0, 0, "".join(audit), "".join(lines), None
            audit, lines, chars, piece = [], [], 0, piece + 1
    figures = (turns[0], turns[1], turns[2], counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost)
    yield conv, number, piece, *figures, "".join(audit), "".join(lines), None if part else sha.hexdigest()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, summed up and hashed one after the other."""

    def made() -> Iterator[tuple]:
        for conv, pieces in _conversations(batches, *_DIGEST.names[1:13]):
            sha, audit, sums, least, most, begun = hashlib.sha256(), [], [0] * 6, None, None, False
            for _, _, _, low, high, *figures, edit, lines in pieces:
                least = low if least is None else least
                most = high if high is not None else most
                sums = [a + b for a, b in zip(sums, figures, strict=True)]
                audit.append(edit)
                if lines:
                    sha.update((lines if begun else lines[1:]).encode())
                    begun = True
            yield conv, 0, 0, least, most, *sums, "".join(audit), "", sha.hexdigest()

    yield from _batches(made(), _DIGEST, 16)


def repaired_conversations(df: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults by kind, illegal neighbours, the least cost, its edits and the hash of the repaired text."""
    rows = in_order(df)
    parts = _parts(rows)
    sent = df.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            for conv, held in _conversations(batches, "turn", "role", "text", "fault"):
                yield from _figures(conv, held, number, sent.value.get((number, conv)))

        yield from _batches(made(), _DIGEST, 64)

    found = rows.mapInArrow(run, _ddl(_DIGEST))
    if parts:
        found = checkpointed(found)
        pieces = found.where("repaired_sha256 is null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
        found = found.where("repaired_sha256 is not null").unionByName(pieces.mapInArrow(_joined, _ddl(_DIGEST)))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
