"""Helpers shared by the operators on documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.session import checkpointed, ship_package

#: Bits of the fixed-size filter on ids; it is sent to every executor as 64-bit words.
FILTER_BITS = 1 << 22
_WORD = 6


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only what an operator reads, so that no other column can clash with one of its own."""
    ship_package(df.sparkSession)
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def _bit(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(FILTER_BITS - 1))


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Add ``maybe``: false only where ``key`` is not in the one column of ``keys``.

    At most FILTER_BITS / 64 = 65,536 rows are broadcast, however many keys there are. With many millions of
    keys the filter lets everything through, and the exact join behind it does the work alone.
    """
    (name,) = keys.columns
    bit = _bit(F.col(name))
    words = keys.groupBy(F.shiftright(bit, _WORD).alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64({name}) & 63 as int))")).alias("_bits")
    )
    joined = df.withColumn("_word", F.shiftright(_bit(F.col(key)), _WORD)).join(F.broadcast(words), "_word", "left")
    here = F.expr(f"(_bits & shiftleft(1L, cast(xxhash64({key}) & 63 as int))) != 0")
    return joined.withColumn("maybe", F.col(key).isNotNull() & F.coalesce(here, F.lit(False))).drop("_word", "_bits")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its least node.

    Large-star and small-star steps in turn: every step hangs neighbours on the least one they can see, so paths
    halve. Edges stay in the cluster; only a count and a checksum of them come to the driver.
    """
    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
