"""Session settings and checkpoint folder handling."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Pages are large rows, so Arrow batches are kept small.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def local_session(cores: str = "8", app: str = "threatloom") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """All feed timestamps are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a scratch one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="threatloom-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    usual = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if usual is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, usual)


def freeing_shuffles(spark: SparkSession):
    """Let actions on tables planned in here delete their shuffle files when they end.

    For results that are stored whole: otherwise the files stay until the driver happens to collect its garbage.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def writing_folders(spark: SparkSession):
    """Let a write in here use all cores however few its bytes are.

    Adaptive execution joins partitions below a megabyte, but with a folder per source, day or bundle the work is the files, not the bytes.
    """
    return _setting(spark, "spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
