"""A training corpus out of ``documents``: stages of the operators in threatloom.llm, each written before the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.llm import decontamination, ngram_join, packing, pii, quality_classifier
from threatloom.llm.queries import tokenizer_path
from threatloom.session import checkpoint_folder, checkpointed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels, keep=OTHERS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row: that of the least id, then of the least class (set hash).

    Rows are told apart by doc_id and class, so a text that is linked with nothing stays, whatever other texts have its id. Of
    rows equal in both, the least by text, lang, source and n_chars stays. So does, for each id, one of its rows without
    words. Rows without doc_id stand in no group and stay.
    """
    rows = checkpointed(ngram_join.row_components(docs).where("doc_id is not null").select("doc_id", "class", "component"))
    least = rows.where("class is not null").groupBy("component").agg(F.min(F.struct("doc_id", "class")).alias("row")).select("row.*")
    least = least.unionByName(rows.where("class is null").select("doc_id", "class").distinct())
    least = least.withColumnsRenamed({"doc_id": "id", "class": "own"})
    docs = docs.select(*COLUMNS)
    named = ngram_join.with_classes(docs.where("doc_id is not null"), keep=OTHERS)
    kept = named.join(least, (F.col("doc_id") == F.col("id")) & F.col("class").eqNullSafe(F.col("own")), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "class").orderBy("text", *OTHERS))
    kept = kept.withColumn("place", place).where("place = 1").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that was nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.scan_benchmark(docs, benchmark, keep=OTHERS).where("n_hit = 0 or n_hit < n_words")
    return _with_text(found, "clean_text", F.col("n_hit") > 0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds."""
    return _with_text(pii.find_personal_data(docs, keep=OTHERS), "masked", F.col("spans") != "")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


def _with_text(found: DataFrame, text: str, changed) -> DataFrame:
    chars = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": chars, "text": F.when(changed, F.col(text)).otherwise(F.col("text"))}).select(*COLUMNS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]
#: SQL can express neither the trained models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4()}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
