"""Dense numbering of a whole table in a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.session import checkpointed, freeing_shuffles

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition number above these


def number_rows(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: start, start + 1, ... in the given order.

    Rows are range-partitioned and sorted, each notes its place, and the result is checkpointed so that
    the places stay the same when they are counted and joined. Only one row per partition is then summed up.
    """
    with freeing_shuffles(df.sparkSession):
        placed = checkpointed(
            df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
        )
    part = F.shiftright("_place", _POSITION_BITS)
    position = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(position) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    # One row per partition: small enough to send everywhere whatever the size of the table.
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + position + F.lit(start)).drop("_place", "_part", "_offset")
