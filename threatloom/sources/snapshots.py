"""Page snapshots: landing, validation, storage and listing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from threatloom import fixed_values as V
from threatloom import schemas
from threatloom.functions.text import strip_space
from threatloom.functions.url import is_http_url
from threatloom.session import checkpointed, ship_package, writing_folders

_UTF8_NAMES = ("", "utf-8", "utf8", "utf_8")
_LATIN1_NAMES = ("latin-1", "latin1", "iso-8859-1", "iso8859-1", "l1")


def source_key(name: Column) -> Column:
    """Folder name of a source."""
    return F.replace(strip_space(name), F.lit(" "), F.lit("_"))


def to_utf8(pages: DataFrame) -> DataFrame:
    """Decode ``content`` with its declared ``encoding`` (UTF-8 by default) into UTF-8 ``data``.

    Undecodable bytes become replacement characters. An unknown encoding gives null data and a
    ``decode_error``. One pass: only bytes of pages in rarer encodings are handed to Python, nulls for all others.
    """
    encoding = F.lower(F.coalesce("encoding", F.lit("")))
    native = encoding.isin(*_UTF8_NAMES, *_LATIN1_NAMES)
    text = F.when(encoding.isin(*_LATIN1_NAMES), F.decode("content", "ISO-8859-1")).otherwise(
        F.make_valid_utf8(F.col("content").cast("string"))
    )

    @F.pandas_udf("data binary, error string")
    def decode(contents: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for content, name in zip(contents, names):
            try:
                rows.append((None if content is None else bytes(content).decode(name, errors="replace").encode("utf-8"), None))
            except (LookupError, UnicodeError) as error:
                rows.append((None, str(error)))
        return pd.DataFrame(rows, columns=["data", "error"])

    ship_package(pages.sparkSession)
    rare = pages.withColumn("_rare", decode(F.when(~native, F.col("content")), F.when(~native, F.col("encoding"))))
    return rare.withColumns(
        {"data": F.when(native, F.encode(text, "UTF-8")).otherwise(F.col("_rare.data")), "decode_error": F.col("_rare.error")}
    ).drop("_rare")


def with_sha256(df: DataFrame, data: str = "data") -> DataFrame:
    return df.withColumn("sha256_hex", F.sha2(F.col(data), 256))


def _is_blank(data: Column) -> Column:
    """Nothing but ASCII white space."""
    return F.btrim(F.decode(data, "ISO-8859-1"), F.lit(" \t\n\r\x0b\x0c")) == ""


def land_pages(pages: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Turn fetched pages (source_name, url, content, encoding, collected_at) into snapshots.

    Returns (snapshots, rejects); the snapshot's URL is the final one of the response.
    """
    judged = to_utf8(pages).withColumn("error", body_error())
    carried = [c for c in pages.columns if c not in ("source_name", "url", "content", "encoding", "collected_at")]
    snapshots = with_sha256(judged.filter("error is null")).select(
        "collected_at",
        F.col("url").alias("source_url"),
        "source_name",
        F.lit(kind).alias("snapshot_kind"),
        "data",
        "sha256_hex",
        *carried,
    )
    return snapshots, judged.filter("error is not null").select("source_name", "url", "collected_at", "error")


EMPTY_BODY = "empty response body"


def body_error() -> Column:
    """Why a decoded page cannot become a snapshot, null when it can."""
    blank = F.coalesce(_is_blank(F.col("data")), F.lit(True))
    return F.coalesce(F.col("decode_error"), F.when(blank, F.lit(EMPTY_BODY)))


def snapshot_issues() -> Column:
    """Problems of a snapshot row, as an array of texts."""
    return F.array_compact(
        F.array(
            F.when(F.col("collected_at").isNull(), F.lit("collected_at must be set")),
            F.when(strip_space(F.coalesce("source_name", F.lit(""))) == "", F.lit("source_name must not be empty")),
            F.when(
                ~F.coalesce(is_http_url(F.col("source_url")), F.lit(False)),
                F.lit("source_url must be a valid HTTP/HTTPS URL"),
            ),
            F.when(
                ~F.coalesce(F.col("snapshot_kind").isin(*V.SNAPSHOT_KINDS), F.lit(False)),
                F.lit("snapshot_kind must be index or entry"),
            ),
            F.when(F.col("data").isNull(), F.lit("data must be bytes")),
        )
    )


def validate_snapshots(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with ``issues``)."""
    judged = snapshots.withColumn("issues", snapshot_issues())
    return judged.filter(F.size("issues") == 0).drop("issues"), judged.filter(F.size("issues") > 0)


def snapshot_name(collected_at: Column, sha256_hex: Column) -> Column:
    """Time and digest; names sort like (time, digest)."""
    return F.concat(F.date_format(collected_at, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("+0000_"), sha256_hex)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append snapshots as Parquet under source and kind; those stored before are not stored again.

    The rebalance hint gathers a folder's rows into full files and splits a folder that is too large.
    """
    keyed = snapshots.withColumn("source_key", source_key(F.col("source_name")))
    identity = ["source_key", "snapshot_kind", "collected_at", "sha256_hex"]
    try:
        stored = load_snapshots(snapshots.sparkSession, path).select(identity)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        keyed = keyed.join(stored, identity, "left_anti")
    balanced = keyed.hint("rebalance", "source_key", "snapshot_kind")
    with writing_folders(snapshots.sparkSession):
        balanced.write.mode("append").partitionBy("source_key", "snapshot_kind").parquet(path)


def delete_snapshots(redundant: DataFrame, path: str) -> None:
    """Take snapshots (source_name, snapshot_kind, collected_at) out of the store; what is not there is no error.

    Only folders that hold some of them are written anew; their new files replace the old ones when the write commits. A folder
    that is left empty goes. A repeated call finds nothing to do.
    """
    spark, folder = redundant.sparkSession, ["source_key", "snapshot_kind"]
    stored = load_snapshots(spark, path)
    gone = redundant.select(source_key(F.col("source_name")).alias("source_key"), "snapshot_kind", "collected_at").distinct()
    identity = [*folder, "collected_at"]
    # One narrow row per folder: is it touched, does anything stay, and where is it?
    where = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("place")
    judged = stored.select(*identity, where).join(gone.withColumn("gone", F.lit(True)), identity, "left")
    folders = judged.groupBy(*folder, "place").agg(F.bool_or(F.col("gone").isNotNull()).alias("touched"), F.bool_or(F.col("gone").isNull()).alias("stays"))
    touched = checkpointed(folders.where("touched"))
    if touched.isEmpty():
        return
    rest = stored.join(touched.where("stays").select(folder), folder, "left_semi").join(gone, identity, "left_anti")
    rest.hint("rebalance", *folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folder).parquet(path)
    for row in touched.where("not stays").select("place").toLocalIterator():
        place = spark._jvm.org.apache.hadoop.fs.Path(row.place)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _iso_time(ts: Column) -> Column:
    """ISO-8601 in UTC; the fraction is left out when it is zero."""
    fraction = F.date_format(ts, "SSSSSS")
    shown = F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), shown, F.lit("+00:00"))


def encode_snapshots(snapshots: DataFrame) -> DataFrame:
    """One JSON document (schema version 2) per snapshot, with its folder and name."""
    document = F.to_json(
        F.struct(
            _iso_time(F.col("collected_at")).alias("collected_at"),
            F.base64("data").alias("data_base64"),
            F.lit(V.SNAPSHOT_SCHEMA_VERSION).alias("schema_version"),
            F.col("sha256_hex"),
            F.col("snapshot_kind"),
            F.col("source_name"),
            F.col("source_url"),
        )
    )
    return snapshots.select(
        source_key(F.col("source_name")).alias("source_key"),
        "snapshot_kind",
        snapshot_name(F.col("collected_at"), F.col("sha256_hex")).alias("name"),
        F.regexp_replace(document, r"\\r\\n", "").alias("value"),
    )


def export_snapshots(snapshots: DataFrame, path: str) -> None:
    """JSON export, one document per line under source and kind."""
    documents = encode_snapshots(snapshots).drop("name")
    documents.hint("rebalance", "source_key", "snapshot_kind").write.mode("append").partitionBy(
        "source_key", "snapshot_kind"
    ).text(path)


def decode_snapshots(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, quarantined) from JSON documents in ``value``.

    A missing kind means index. The digest is computed anew; ``sha_mismatch`` flags a stored one that differs.
    """
    fields = F.from_json("value", schemas.SNAPSHOT_JSON)
    read = documents.select("*", fields.alias("s"))
    data = F.try_to_binary(F.col("s.data_base64"), F.lit("base64"))
    decoded = read.select(
        *documents.columns,
        F.try_to_timestamp(F.col("s.collected_at")).alias("collected_at"),
        F.col("s.source_url").alias("source_url"),
        F.col("s.source_name").alias("source_name"),
        F.coalesce("s.snapshot_kind", F.lit("index")).alias("snapshot_kind"),
        data.alias("data"),
        F.col("s.sha256_hex").alias("stored_sha256"),
    )
    valid, bad = validate_snapshots(decoded)
    checked = with_sha256(valid.drop(*documents.columns))
    snapshots = checked.withColumn("sha_mismatch", F.col("stored_sha256") != F.col("sha256_hex")).drop("stored_sha256")
    return snapshots, bad.select(*documents.columns, "issues")


def read_snapshots(spark: SparkSession, path: str, one_per_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Exported snapshots; ``one_per_file`` for stores that keep one pretty-printed document per file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return decode_snapshots(reader.text(path, wholetext=one_per_file))


def list_snapshots(snapshots: DataFrame, source: str | None = None, kind: str = "index") -> DataFrame:
    """Snapshots of one source and kind, oldest first."""
    found = snapshots.filter(F.col("snapshot_kind") == kind)
    if source is not None:
        found = found.filter(F.col("source_name") == source)
    return found.orderBy("source_name", "collected_at", "sha256_hex")


def preprocess(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots with ``text``, failures): the payload must be UTF-8."""
    raw = F.col("data").cast("string")
    judged = snapshots.withColumn("_ok", F.is_valid_utf8(raw))
    good = judged.filter("_ok").withColumn("text", raw).drop("_ok", "data")
    bad = judged.filter("not _ok").select(
        "source_name", "source_url", "snapshot_kind", "collected_at", F.lit("payload is not UTF-8").alias("error")
    )
    return good, bad


def only_kind(snapshots: DataFrame, kind: str) -> DataFrame:
    return snapshots.filter(F.col("snapshot_kind") == kind)


def retain(snapshots: DataFrame, as_of: Column, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Snapshots not older than ``days`` before ``as_of``."""
    return snapshots.filter(F.col("collected_at") >= as_of - F.make_dt_interval(F.lit(days)))
