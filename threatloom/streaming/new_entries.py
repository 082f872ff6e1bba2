"""New entries from a stream of index snapshots, repaired when snapshots come late.

State is a log of tables by batch, in the shared folder; a batch reads those of earlier batches and overwrites its own, so it may run
again after a crash. It writes what it brought and what it changed, never a source's whole state:

- ``landed``: the batch's entries that had not landed before;
- ``kept``: snapshots whose decision (kept or dropped) the batch made or changed;
- ``changes``: entries that became new (+1) or stopped being new (-1).

A batch re-opens its sources at the earliest snapshot it holds: history from the last kept snapshot before that is
replayed, with the batch's snapshots in their places, by the distributed replay of stored histories. On a source in time order that is
its baseline alone; a late snapshot takes in all that came after it, and whatever its absence had made look new is withdrawn.
So whatever the order of arrival, the sum of the changes is the result of one replay of everything.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.operators.incremental import replay_history
from threatloom.session import checkpointed

_SNAPSHOT = ["source_name", "collected_at"]
_ENTRY = [*_SNAPSHOT, "publication_url"]
_SCHEMAS = {
    "landed": "source_name string, collected_at timestamp, publication_url string, batch long",
    "kept": "source_name string, collected_at timestamp, kept boolean, batch long",
    "changes": "source_name string, collected_at timestamp, publication_url string, change int, batch long",
}


def _log(spark: SparkSession, folder: str, table: str, before: int | None = None) -> DataFrame:
    """A table of the state, of all batches or of those before one."""
    schema = _SCHEMAS[table]
    try:
        rows = spark.read.schema(schema).parquet(f"{folder}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("batch") < before)


def decisions(kept: DataFrame) -> DataFrame:
    """The last decision on each snapshot."""
    return kept.groupBy(*_SNAPSHOT).agg(F.max_by("kept", "batch").alias("kept"))


def in_effect(changes: DataFrame) -> DataFrame:
    """Entries that are new by all changes so far."""
    return changes.groupBy(*_ENTRY).agg(F.sum("change").alias("times")).where("times > 0").select(_ENTRY)


def replay_batch(batch: DataFrame, landed: DataFrame, kept: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(landed, kept, changes) rows that a batch of index entries adds to those of earlier batches.

    Rows without source, time or URL tell nothing and are left out.
    """
    entries = batch.select(_ENTRY).dropna().distinct()
    opened = checkpointed(entries.groupBy("source_name").agg(F.min("collected_at").alias("opened_at")))
    was = decisions(kept).join(opened, "source_name")
    baseline = was.where(F.col("kept") & (F.col("collected_at") < F.col("opened_at"))).groupBy("source_name").agg(F.max("collected_at").alias("baseline_at"))
    since = opened.join(baseline, "source_name", "left").select("source_name", "opened_at", F.coalesce("baseline_at", "opened_at").alias("since"))
    # What lies before the baselines can't change anything. Dropped snapshots before the opening stay dropped.
    past = landed.join(since, "source_name").where((F.col("collected_at") >= F.col("opened_at")) | (F.col("collected_at") == F.col("since"))).select(_ENTRY)
    fresh = checkpointed(entries.join(past, _ENTRY, "left_anti"))
    snapshots, judged = replay_history(past.unionByName(fresh))
    judged = checkpointed(judged.join(opened, "source_name").where("collected_at >= opened_at"))

    found = judged.groupBy(*_SNAPSHOT).agg(F.bool_or("kept").alias("kept"))
    before = was.where("collected_at >= opened_at").select(*_SNAPSHOT, F.col("kept").alias("was"))
    changed = found.join(before, _SNAPSHOT, "left").where("not (kept <=> was)").select(*_SNAPSHOT, "kept")

    now = judged.where("is_new").select(*_ENTRY, F.lit(1).alias("change"))
    then = in_effect(changes).join(opened, "source_name").where("collected_at >= opened_at").select(*_ENTRY, F.lit(-1).alias("change"))
    differing = now.unionByName(then).groupBy(*_ENTRY).agg(F.sum("change").cast("int").alias("change")).where("change <> 0")
    return fresh, changed, differing


def stream_new_entries(entries: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start following a stream of (source_name, collected_at, publication_url); a snapshot may even arrive in parts."""

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = replay_batch(batch, *(_log(spark, folder, table, number) for table in _SCHEMAS))
        for table, rows in zip(_SCHEMAS, made, strict=True):
            rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")

    writer = entries.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_new_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that are new by all batches so far."""
    return in_effect(_log(spark, folder, "changes"))


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What each batch added (+1) and withdrew (-1)."""
    return _log(spark, folder, "changes")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Each snapshot's last decision."""
    return decisions(_log(spark, folder, "kept"))
