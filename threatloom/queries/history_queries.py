"""INC-01..06, SRC-10, SRC-12, SRC-13: snapshot histories made from events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators import incremental as I
from threatloom.queries import corpora as C
from threatloom.queries.catalog import query
from threatloom.session import checkpoint_folder
from threatloom.sources import snapshots as S
from threatloom.streaming import new_entries as N

DAILY, DAILY_SQL = (24, None), C.event_snapshots_sql(24, None)
DENSE, DENSE_SQL = (8, 12), C.event_snapshots_sql(8, 12)


def shown(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm").alias(column)


def shown_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M') AS {column}"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct daily snapshots with a kind and a digest of their URL count."""
    entries = C.event_snapshots(spark, sf_dir, *DAILY)
    listed = entries.groupBy("source_name", "collected_at").agg(F.count(F.lit(1)).alias("urls"))
    return listed.withColumn("snapshot_kind", F.lit("index")).withColumn("sha256_hex", F.sha2(F.col("urls").cast("string"), 256))


_SNAPSHOTS_SQL = (
    "SELECT source_name, collected_at, 'index' AS snapshot_kind, sha256(CAST(count(*) AS STRING)) AS sha256_hex "
    f"FROM ({DAILY_SQL}) AS e GROUP BY source_name, collected_at"
)
_PREVIOUS_SQL = (
    "SELECT source_name, collected_at, lag(collected_at) OVER (PARTITION BY source_name ORDER BY collected_at) AS previous_at "
    f"FROM ({_SNAPSHOTS_SQL}) AS s"
)


@query(
    "inc_01_previous_snapshot",
    f"SELECT source_name, {shown_sql('collected_at')}, {shown_sql('previous_at')} FROM ({_PREVIOUS_SQL}) AS p",
)
def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_previous(_snapshots(spark, sf_dir)).select("source_name", shown("collected_at"), shown("previous_at"))


_TIED_SQL = (
    "SELECT source_name, collected_at, sha256(CAST(user_id % 2 AS STRING)) AS sha256_hex, publication_url "
    f"FROM (SELECT *, CAST(split_part(publication_url, '/', 5) AS BIGINT) AS user_id FROM ({DAILY_SQL}) AS d) AS u"
)


@query(
    "inc_01_tied_snapshots",
    f"WITH e AS ({_TIED_SQL}), s AS (SELECT DISTINCT source_name, collected_at, sha256_hex FROM e), p AS (SELECT *, "
    "lag(collected_at) OVER before AS previous_at, lag(sha256_hex) OVER before AS previous_sha256_hex FROM s "
    "WINDOW before AS (PARTITION BY source_name ORDER BY collected_at, sha256_hex)) "
    f"SELECT source_name, {shown_sql('collected_at')}, sha256_hex, {shown_sql('previous_at')}, previous_sha256_hex, publication_url "
    "FROM e JOIN p USING (source_name, collected_at, sha256_hex) WHERE NOT EXISTS (SELECT 1 FROM e AS b WHERE b.source_name = e.source_name "
    "AND b.collected_at = p.previous_at AND b.sha256_hex = p.previous_sha256_hex AND b.publication_url = e.publication_url)",
)
def tied_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries where each source has two snapshots of one time: users with even and with odd ids."""
    entries = C.event_snapshots(spark, sf_dir, *DAILY)
    user = F.split("publication_url", "/")[4].cast("long")
    entries = entries.withColumn("sha256_hex", F.sha2((user % 2).cast("string"), 256))
    key = ["source_name", "collected_at", "sha256_hex"]
    previous = I.with_previous(entries.select(*key).distinct().withColumn("snapshot_kind", F.lit("index"))).drop("snapshot_kind")
    found = I.diff_entries(entries.join(previous, key), entries, digests=True)
    return found.select(
        "source_name", shown("collected_at"), "sha256_hex", shown("previous_at"), "previous_sha256_hex", "publication_url"
    )


_NEW_SQL = (
    f"SELECT e.source_name, e.collected_at, e.publication_url FROM ({DAILY_SQL}) AS e "
    f"JOIN ({_PREVIOUS_SQL}) AS p USING (source_name, collected_at) WHERE NOT EXISTS (SELECT 1 FROM ({DAILY_SQL}) AS b "
    "WHERE b.source_name = e.source_name AND b.collected_at = p.previous_at AND b.publication_url = e.publication_url)"
)


def _new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = C.event_snapshots(spark, sf_dir, *DAILY)
    previous = I.with_previous(_snapshots(spark, sf_dir)).select("source_name", "collected_at", "previous_at")
    current = entries.join(previous, ["source_name", "collected_at"])
    return I.diff_entries(current, entries).select("source_name", "collected_at", "publication_url")


@query(
    "inc_02_new_entries",
    f"SELECT source_name, {shown_sql('collected_at')}, publication_url FROM ({_NEW_SQL}) AS n",
)
def new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_entries(spark, sf_dir).select("source_name", shown("collected_at"), "publication_url")


def replay_sql(entries_sql: str) -> str:
    """CTEs ending in ``replayed``: a recursive replay, snapshot after snapshot, with whole URL lists."""
    return (
        f"RECURSIVE entries AS ({entries_sql}), snaps AS (SELECT source_name, collected_at, list(publication_url) AS urls, "
        "row_number() OVER (PARTITION BY source_name ORDER BY collected_at) AS n FROM entries GROUP BY source_name, collected_at), "
        "replayed AS (SELECT source_name, collected_at, n, urls AS baseline, collected_at AS baseline_now, "
        "CAST(NULL AS TIMESTAMP) AS baseline_at, true AS kept, urls AS fresh FROM snaps WHERE n = 1 UNION ALL "
        "SELECT source_name, collected_at, n, CASE WHEN len(fresh) > 0 THEN urls ELSE before END, "
        "CASE WHEN len(fresh) > 0 THEN collected_at ELSE before_at END, before_at, len(fresh) > 0, fresh FROM ("
        "SELECT s.source_name, s.collected_at, s.n, s.urls, r.baseline AS before, r.baseline_now AS before_at, "
        "list_filter(s.urls, lambda u: NOT list_contains(r.baseline, u)) AS fresh "
        "FROM replayed AS r JOIN snaps AS s ON s.source_name = r.source_name AND s.n = r.n + 1) AS step)"
    )


@query(
    "inc_03_replay_snapshots",
    f"WITH {replay_sql(DENSE_SQL)} SELECT source_name, {shown_sql('collected_at')}, {shown_sql('baseline_at')}, kept FROM replayed",
)
def replay_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed, _ = I.replay_history(C.event_snapshots(spark, sf_dir, *DENSE))
    return replayed.select("source_name", shown("collected_at"), shown("baseline_at"), "kept")


HOURLY, HOURLY_SQL = (1, None), C.event_snapshots_sql(1, None)


@query(
    "inc_03_replay_all_urls",
    f"WITH {replay_sql(HOURLY_SQL)} SELECT source_name, {shown_sql('collected_at')}, {shown_sql('baseline_at')}, kept, len(fresh) AS fresh FROM replayed",
)
def replay_all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly snapshots with the events' own URLs."""
    replayed, judged = I.replay_history(C.event_snapshots(spark, sf_dir, *HOURLY))
    fresh = judged.groupBy("source_name", "collected_at").agg(F.count_if("is_new").alias("fresh"))
    joined = replayed.join(fresh, ["source_name", "collected_at"])
    return joined.select("source_name", shown("collected_at"), shown("baseline_at"), "kept", "fresh")


_REPLAY_NEW_SQL = (
    f"WITH {replay_sql(DENSE_SQL)} SELECT source_name, {shown_sql('collected_at')}, unnest(fresh) AS publication_url FROM replayed"
)


@query("inc_03_replay_new_entries", _REPLAY_NEW_SQL)
def replay_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, judged = I.replay_history(C.event_snapshots(spark, sf_dir, *DENSE))
    return judged.filter("is_new").select("source_name", shown("collected_at"), "publication_url")


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that landed: one per user, some users missing."""
    users = C.table(spark, sf_dir, "events").filter(F.col("user_id") % 5 != 0).select("user_id").distinct()
    url = F.concat(F.lit("https://example.org/post/"), F.col("user_id").cast("string"))
    return users.select(url.alias("url"), F.md5(url).alias("content"))


_LANDED_SQL = (
    "SELECT url, md5(url) AS content FROM (SELECT DISTINCT 'https://example.org/post/' || CAST(user_id AS STRING) AS url "
    "FROM events WHERE user_id % 5 <> 0)"
)


@query(
    "inc_04_match_entries",
    f"SELECT source_name, {shown_sql('collected_at')}, publication_url, content FROM ({_NEW_SQL}) AS n "
    f"JOIN ({_LANDED_SQL}) AS l ON l.url = n.publication_url",
)
def match_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = I.match_entries(_new_entries(spark, sf_dir), _landed(spark, sf_dir))
    return matched.select("source_name", shown("collected_at"), "publication_url", "content")


@query(
    "inc_04_latest_page",
    f"SELECT source_name, {shown_sql('collected_at')}, publication_url, content FROM ({_NEW_SQL}) AS n "
    f"JOIN ({_LANDED_SQL}) AS l ON l.url = n.publication_url",
)
def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that landed three times, the first time with another content, the last two times alike."""
    landed = _landed(spark, sf_dir).withColumn("landed_at", F.explode(F.array(F.lit(1), F.lit(2), F.lit(2))))
    landed = landed.withColumn("content", F.when(F.col("landed_at") == 1, F.lit("old")).otherwise(F.col("content")))
    matched = I.match_entries(_new_entries(spark, sf_dir), landed)
    return matched.select("source_name", shown("collected_at"), "publication_url", "content")


@query(
    "inc_05_missing_entries",
    f"SELECT source_name, {shown_sql('collected_at')}, publication_url FROM ({_NEW_SQL}) AS n "
    f"WHERE publication_url NOT IN (SELECT url FROM ({_LANDED_SQL}) AS l)",
)
def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = I.missing_entries(_new_entries(spark, sf_dir), _landed(spark, sf_dir))
    return missing.select("source_name", shown("collected_at"), "publication_url")


CHUNKS = 3


def _streamed(spark: SparkSession, sf_dir: str, hours: int, users: int | None) -> str:
    """Folder of a stream that got whole snapshots in CHUNKS deliveries, out of order, and was stopped after each."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"
    chunk = F.pmod(F.xxhash64("source_name", "collected_at"), F.lit(CHUNKS))
    entries = C.event_snapshots(spark, sf_dir, hours, users).withColumn("chunk", chunk)
    for n in range(CHUNKS):
        entries.where(F.col("chunk") == n).drop("chunk").write.parquet(f"{folder}/arrived/{n}")
        arriving = spark.readStream.schema("source_name string, collected_at timestamp, publication_url string")
        N.stream_new_entries(arriving.parquet(f"{folder}/arrived/*"), folder).awaitTermination()
    return folder


@query("inc_06_stream_new_entries", _REPLAY_NEW_SQL)
def stream_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.read_new_entries(spark, _streamed(spark, sf_dir, *DENSE))
    return found.select("source_name", shown("collected_at"), "publication_url")


@query(
    "inc_06_stream_all_urls",
    f"WITH {replay_sql(HOURLY_SQL)} SELECT source_name, {shown_sql('collected_at')}, kept, len(fresh) AS fresh FROM replayed",
)
def stream_all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and numbers of new entries after late deliveries, with the events' own URLs."""
    folder = _streamed(spark, sf_dir, *HOURLY)
    fresh = N.read_new_entries(spark, folder).groupBy("source_name", "collected_at").agg(F.count(F.lit(1)).alias("fresh"))
    joined = N.read_snapshots(spark, folder).join(fresh, ["source_name", "collected_at"], "left")
    return joined.select("source_name", shown("collected_at"), "kept", F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query(
    "src_10_list_snapshots",
    f"SELECT source_name, {shown_sql('collected_at')}, sha256_hex FROM ({_SNAPSHOTS_SQL}) AS s WHERE source_name = 'click'",
)
def list_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = S.list_snapshots(_snapshots(spark, sf_dir), "click", "index")
    return listed.select("source_name", shown("collected_at"), "sha256_hex")


@query(
    "src_12_compact_snapshots",
    f"WITH {replay_sql(DENSE_SQL)} SELECT source_name, {shown_sql('collected_at')}, len(urls) AS urls FROM snaps "
    "WHERE (source_name, collected_at) IN (SELECT (source_name, collected_at) FROM replayed WHERE kept)",
)
def compact_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = C.event_snapshots(spark, sf_dir, *DENSE)
    snapshots = entries.groupBy("source_name", "collected_at").agg(F.count(F.lit(1)).alias("urls"))
    replayed, _ = I.replay_history(entries)
    return I.compact_snapshots(snapshots, replayed).select("source_name", shown("collected_at"), "urls")


@query(
    "src_12_delete_redundant",
    f"WITH {replay_sql(DENSE_SQL)} SELECT source_name, {shown_sql('collected_at')}, CAST(len(urls) AS STRING) AS urls FROM snaps "
    "WHERE (source_name, collected_at) IN (SELECT (source_name, collected_at) FROM replayed WHERE kept)",
)
def delete_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots stored, replayed, and what the replay found redundant deleted from the store, twice."""
    entries = C.event_snapshots(spark, sf_dir, *DENSE)
    listed = entries.groupBy("source_name", "collected_at").agg(F.count(F.lit(1)).cast("string").alias("urls"))
    folder = f"{checkpoint_folder(spark)}/snapshots-{uuid.uuid4()}"
    S.write_snapshots(listed.select("*", F.lit("index").alias("snapshot_kind"), F.sha2("urls", 256).alias("sha256_hex")), folder)
    redundant = I.replay_history(entries)[0].where("not kept").withColumn("snapshot_kind", F.lit("index"))
    for _ in range(2):
        S.delete_snapshots(redundant, folder)
    return S.load_snapshots(spark, folder).select("source_name", shown("collected_at"), "urls")


@query(
    "src_13_retain",
    f"SELECT source_name, {shown_sql('collected_at')} FROM ({_SNAPSHOTS_SQL}) AS s "
    "WHERE collected_at >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY",
)
def retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.retain(_snapshots(spark, sf_dir), F.lit("2024-02-10 00:00:00").cast("timestamp"))
    return kept.select("source_name", shown("collected_at"))
