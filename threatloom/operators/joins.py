"""Size-checked broadcasts, pruning by a sketch and input spreading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a table for broadcasting if it is counted to be small; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_side(df: DataFrame) -> DataFrame:
    """Mark the side whose partitions hold little: they are kept in memory, and the rows of the other side pass without being sorted.

    Spark guesses the size of rows exploded from arrays by that of the files below, and so would send all of them to the driver; marked, no
    side is broadcast. What a task holds follows the rows of a shuffle's partition (``at_least_partitions``), not the input.
    """
    return df.hint("shuffle_hash")


#: Bits of a sketch per key, the most bits of one (32 MB), and those of one row of it, as Spark's bitmap functions have it.
SKETCH_BITS, MOST_SKETCH_BITS, _ROW_BITS = 32, 1 << 28, 1 << 15


def may_be_among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be one of ``wanted`` (one column), without a shuffle of ``df``.

    The hashes of the wanted keys are set in a bitmap that is broadcast: SKETCH_BITS per key let about one other key in SKETCH_BITS
    pass, and its size is bounded, so that beyond 2^23 keys more pass. A join on the key has to follow.
    """
    count = wanted.count()
    bits = _ROW_BITS
    while bits < min(count * SKETCH_BITS, MOST_SKETCH_BITS):
        bits *= 2
    spot = lambda column: F.pmod(F.xxhash64(column.cast("string")), F.lit(bits))
    own = wanted.select(spot(F.col(wanted.columns[0])).alias("_spot"))
    rows = own.groupBy(F.expr(f"_spot div {_ROW_BITS}").alias("_row")).agg(F.bitmap_construct_agg(F.col("_spot") % _ROW_BITS).alias("_bits"))
    placed = df.withColumn("_spot", spot(F.col(key))).withColumn("_row", F.expr(f"_spot div {_ROW_BITS}"))
    return placed.join(F.broadcast(rows), "_row").filter(_bit("_bits", F.col("_spot") % _ROW_BITS)).drop("_row", "_spot", "_bits")


def _bit(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1


#: Rows of a task before costly work per row.
TASK_ROWS = 25_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows over all cores, and at most about ``task_rows`` in a task, before costly work per row.

    The splits of a file follow its bytes, of which a row that means much work may have few; so tasks would grow with the input, in
    time and in what they hold, up to millions of rows. An input with enough splits is left as it is, without a shuffle. Later shuffles
    start from as many partitions.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    at_least_partitions(df.sparkSession, tasks)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def at_least_partitions(spark: SparkSession, partitions: int) -> None:
    """Let later shuffles of the session start from so many partitions, which adaptive execution joins where they are small.

    With a fixed number, what a task sorts or holds in a hash aggregation grows with the input. Never lowered, as plans made
    before may not have run yet.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = int(spark.conf.get(_FIRST_PARTITIONS, None) or 0)
    if partitions > usual or now:
        spark.conf.set(_FIRST_PARTITIONS, str(max(partitions, usual, now)))
