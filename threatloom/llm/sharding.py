"""Minimax contiguous partition of documents into shards, with DataFrame operations only.

Equal texts are an atomic group; groups stand in the order of their texts' 64-bit hashes (texts whose hashes collide
share a group, which keeps them together as well). The smallest feasible capacity is binary-searched and checked greedily over that
order, and the cuts are made there. The driver never sees the groups: it holds byte sums of hash ranges, at first
2 ** FIRST_BITS of them, and splits only the ranges in which a cut would fall, again and again, until every cut lies at a border
of ranges or at a range of a single group. While a range is not split yet the check may cut it anywhere, so the capacity it
finds never exceeds the true minimum; once no cut lies inside a range it is that minimum.

Groups larger than an even share of the rest get a shard of their own first, the largest ahead, so that one huge group does not set
the capacity of all shards.

Defined results: a null text is treated as an empty one. Repeated rows stay rows of their own, in one group. Rows without doc_id are
numbered like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import documents
from threatloom.session import checkpointed

SHARDS = 40
ROW_BYTES = 16
#: A range is all hashes with the same leading bits: so many at first, and so many more when it is split.
FIRST_BITS = 14
MORE_BITS = 8
_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these


@dataclass
class _Range:
    """Groups whose hashes agree but for the last ``shift`` bits: the least hash, their bytes and their number."""

    shift: int
    prefix: int
    low: int
    bytes: int
    groups: int


def greedy(ranges: list[_Range], capacity: int, shards: int) -> tuple[bool, list[int], list[int]]:
    """Whether the ranges fit, the first hash of every shard but the first, and the ranges that would be cut inside."""
    cuts, inside, room = [], [], capacity
    for number, part in enumerate(ranges):
        if part.bytes <= room:
            room -= part.bytes
            continue
        if part.groups == 1:
            cuts.append(part.low)
            room = capacity - part.bytes
            if room < 0:
                return False, [], []
        else:
            left = part.bytes - room
            inside.append(number)
            cuts.append(part.low)
            more = (left - 1) // capacity
            cuts.extend([part.low] * more)
            room = capacity - (left - more * capacity)
        if len(cuts) >= shards:
            return False, [], []
    return True, cuts, inside


def smallest_capacity(ranges: list[_Range], shards: int) -> int:
    total = sum(part.bytes for part in ranges)
    low, high = max([-(-total // shards), *(part.bytes for part in ranges if part.groups == 1)], default=0), total
    while low < high:
        middle = (low + high) // 2
        if greedy(ranges, middle, shards)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def _sums(groups: DataFrame, parts: list[tuple[int, list[int] | None]]) -> list[_Range]:
    """Sums of finer ranges; parts: (bits to split after, leading bits of the ranges to split, or None for all)."""
    shift, prefix = F.lit(None).cast("int"), F.lit(None).cast("long")
    for bits, prefixes in parts:
        here = F.shiftright("hash", bits).isin(prefixes) if prefixes is not None else F.lit(True)
        finer = max(0, bits - (MORE_BITS if prefixes is not None else 0))
        shift = F.when(here, finer).otherwise(shift)
        prefix = F.when(here, F.shiftright("hash", finer)).otherwise(prefix)
    found = groups.select(shift.alias("shift"), prefix.alias("prefix"), "hash", "bytes").where("shift is not null")
    sums = found.groupBy("shift", "prefix").agg(
        F.min("hash").alias("low"), F.sum("bytes").alias("bytes"), F.count("*").alias("groups")
    )
    return [_Range(**row.asDict()) for row in sums.collect()]


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """First hashes of all shards but the first; groups: hash, bytes."""
    ranges = sorted(_sums(groups, [(64 - FIRST_BITS, None)]), key=lambda part: part.low)
    while True:
        _, cuts, inside = greedy(ranges, smallest_capacity(ranges, shards), shards)
        if not inside:
            return cuts
        # Neighbours too: the next capacity moves the cuts a little.
        wanted = {n for i in inside for n in range(max(0, i - 3), min(len(ranges), i + 4)) if ranges[n].groups > 1}
        by_shift: dict[int, list[int]] = {}
        for n in wanted:
            by_shift.setdefault(ranges[n].shift, []).append(ranges[n].prefix)
        kept = [part for n, part in enumerate(ranges) if n not in wanted]
        ranges = sorted(kept + _sums(groups, list(by_shift.items())), key=lambda part: part.low)


def shard(df: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots run gapless from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(df).select(
        "doc_id", (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("hash").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    alone: list[int] = []
    for row in groups.orderBy(F.desc("bytes"), "hash").limit(shards - 1).collect():
        if row.bytes * (shards - len(alone)) <= total:
            break
        alone.append(row.hash)
        total -= row.bytes
    rest = groups.where(~F.col("hash").isin(alone)) if alone else groups
    cuts = cut_points(rest, shards - len(alone))
    number = F.lit(len(alone)) + sum((F.when(F.col("hash") >= F.lit(cut), 1).otherwise(0) for cut in cuts), F.lit(0))
    for at, name in enumerate(alone):
        number = F.when(F.col("hash") == F.lit(name), F.lit(at)).otherwise(number)
    return _slots(rows.withColumn("shard", number.cast("int")))


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard without gathering it: places in sorted partitions, and one sum per partition and shard."""
    order = ["shard", "hash", "doc_id", "text_crc32", "size"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("_part", F.shiftright("_at", _POSITION_BITS))
    counts = placed.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    # At most one row for each partition and shard that meet in it: partitions + shards.
    slot = (F.col("_before") + F.col("_at") - F.col("_first")).cast("long")
    return placed.join(F.broadcast(counts), ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
