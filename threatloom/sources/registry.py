"""Feed registry: JSON documents that list the feeds to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom import schemas
from threatloom.functions.text import strip_space
from threatloom.functions.url import is_http_url
from threatloom.operators.joins import broadcast_if_small

PROFILES = (V.S1, V.SL, V.PP)


def parse_registry(documents: DataFrame, value: str = "value") -> DataFrame:
    """Feeds of registry documents: a JSON list, or an object with a ``sources`` list.

    ``row_no`` counts from 1 within a document; a document that is neither keeps one row with ``load_error``. An empty
    list has no feeds, which is no error.
    """
    as_list = F.from_json(value, f"array<{schemas.SOURCE}>")
    as_object = F.from_json(value, f"struct<sources:array<{schemas.SOURCE}>>")["sources"]
    is_list = F.ltrim(F.regexp_replace(F.col(value), r"\A\s+", "")).startswith("[")
    kept = [c for c in documents.columns if c != value]
    rows = documents.select(*kept, F.when(is_list, as_list).otherwise(as_object).alias("_sources"))
    rows = rows.where(F.col("_sources").isNull() | (F.size("_sources") > 0))
    exploded = rows.select(*kept, F.posexplode_outer("_sources").alias("_pos", "s"))
    return exploded.select(
        *kept,
        (F.col("_pos") + 1).alias("row_no"),
        "s.name",
        "s.index_url",
        F.coalesce("s.profile", F.lit("")).alias("profile"),
        F.coalesce("s.enabled", F.lit(True)).alias("enabled"),
        F.when(F.col("_pos").isNull(), F.lit("no list of sources")).alias("load_error"),
    )


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Registry files, one document each."""
    return parse_registry(spark.read.text(path, wholetext=True))


def source_issues(profiles: tuple[str, ...] = PROFILES) -> Column:
    """Problems of a feed row, as an array of texts."""
    blank = lambda c: strip_space(F.coalesce(F.col(c), F.lit(""))) == ""
    issues = [
        F.when(F.col("load_error").isNotNull(), F.col("load_error")),
        F.when(F.col("load_error").isNull() & blank("name"), F.lit("name must not be empty")),
        F.when(F.col("load_error").isNull() & blank("profile"), F.lit("profile must not be empty")),
        F.when(
            F.col("load_error").isNull() & ~F.coalesce(is_http_url(F.col("index_url")), F.lit(False)),
            F.lit("index_url must be a valid HTTP/HTTPS URL"),
        ),
        F.when(~blank("profile") & ~F.col("profile").isin(*profiles), F.concat(F.lit("unknown profile "), F.col("profile"))),
    ]
    return F.array_compact(F.array(*issues))


def validate_sources(sources: DataFrame, profiles: tuple[str, ...] = PROFILES) -> DataFrame:
    return sources.withColumn("issues", source_issues(profiles))


def registry_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count_if(F.col("load_error").isNull()).alias("total_sources"),
        F.count_if(F.col("load_error").isNull() & F.col("enabled")).alias("enabled_sources"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issue_count"),
    )


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled")


def route_enabled(landed: DataFrame, sources: DataFrame) -> DataFrame:
    """Landed pages of enabled feeds; the registry is broadcast when it is small."""
    names = enabled_sources(sources).select(F.col("name").alias("source_name"))
    return landed.join(broadcast_if_small(names), "source_name", "left_semi")


def with_feed(landed: DataFrame, sources: DataFrame) -> DataFrame:
    """Landed pages of enabled feeds with their feed's profile."""
    feeds = enabled_sources(sources).select(F.col("name").alias("source_name"), "profile")
    return landed.join(broadcast_if_small(feeds), "source_name")
