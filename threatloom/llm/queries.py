"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import (
    chat_repair,
    credentials,
    decontamination,
    html_content,
    ngram_join,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    ranked_search,
    sharding,
    structure_repair,
    substring_dedup,
)
from threatloom.llm.document_twins import BENCHMARK_SQL, JOIN_SQL, REPEATS_SQL, RULES_SQL
from threatloom.llm.twins import CREDENTIALS_SQL, REPAIR_SQL, SEARCH_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        if sql is not None:
            SQL[name] = sql
        return make

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op1_ordinal_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "expected_grade", "tail_probability", "kept")


@_query("op2_pattern_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op3_minimax_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"))
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@_query("op4_substring_dedup", REPEATS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op5_weakly_supervised_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents")).drop("text", "masked")


@_query("op6_role_repair")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_roles(_table(spark, sf_dir, "conversations"))


@_query("op7_rule_cascade", RULES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents"))
    # Which rule rejects first follows from the measured order, so it is no part of the result.
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op8_fm_decontamination", BENCHMARK_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


@_query("op9_tree_model_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract_content(_table(spark, sf_dir, "pages"))


@_query("op10_prefix_tree_join", JOIN_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op11_credential_linking", CREDENTIALS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in credentials.KINDS[: credentials.BASE]]
    base = F.sha2(credentials.written(F.filter("spans", credentials.is_base)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), credentials.written(F.col("spans")).alias("spans"))


@_query("op12_coalescing_viterbi_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repaired_conversations(structure_repair.damaged(_table(spark, sf_dir, "conversations")))


@_query("op13_norm_bucket_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
