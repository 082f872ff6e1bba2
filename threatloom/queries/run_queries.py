"""RUN-01..08: whole runs, results, health and failure statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.operators import runs as R
from threatloom.plans import full_run, run_store
from threatloom.queries import corpora as C
from threatloom.queries import sql as Q
from threatloom.queries.catalog import query
from threatloom.queries.history_queries import replay_sql, shown, shown_sql
from threatloom.queries.stix_queries import OBJECT_COUNTS_SQL, stix_entries, with_objects
from threatloom.operators import stix as X
from threatloom.session import checkpoint_folder
from threatloom.sources import run_history

# ---------------------------------------------------------------- a whole run over landed pages

_PROFILE = "CASE {} % 3 WHEN 0 THEN 's1' WHEN 1 THEN 'sl' ELSE 'pp' END"


def _feed_name(column: str):
    return F.concat(F.lit("feed "), F.col(column).cast("string"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per customer; every 13th is switched off."""
    customers = C.table(spark, sf_dir, "customer")
    return customers.select(
        _feed_name("c_custkey").alias("name"),
        F.lit("https://example.org/").alias("index_url"),
        F.expr(_PROFILE.format("c_custkey")).alias("profile"),
        (F.col("c_custkey") % 13 != 0).alias("enabled"),
    )


_BASES = {
    V.S1: "https://b{c}.example.org/ioc/",
    V.SL: "https://r{c}.example.com/all/",
    V.PP: f"https://{V.PP_HOST}/us/blog/threat-insight",
}
_LINKS = {
    V.S1: ("https://b{c}.example.org/post/{k}", "https://b{c}.example.org/again/{r}"),
    V.SL: ("https://r{c}.example.com/post/{k}", "https://r{c}.example.com/again/{r}"),
    V.PP: (
        f"https://{V.PP_HOST}/us/blog/threat-insight/c{{c}}-post-{{k}}",
        f"https://{V.PP_HOST}/us/blog/threat-insight/c{{c}}-again-{{r}}",
    ),
}


def _by_customer(make) -> object:
    profile = F.expr(_PROFILE.format("c"))
    return F.when(profile == V.S1, make(V.S1)).when(profile == V.SL, make(V.SL)).otherwise(make(V.PP))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("dated").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("k") % 86400).cast("double"))
    return C.indicators(spark, sf_dir).withColumn("r", F.col("k") % 3).withColumn("collected_at", at)


_NO_ENCODING = "no-such-code"


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetched listing page per order; some blank, undecodable or empty, some without their own post."""

    def html(profile: str):
        post, again = _LINKS[profile]
        anchor = '<article><h2><a href="{}">{}</a></h2></article>'
        both = C.fill("<main>" + anchor.format(post, "Post {k}") + anchor.format(again, "Again {r}") + "</main>")
        old = C.fill("<main>" + anchor.format(again, "Again {r}") + "</main>")
        n = F.col("k") % 50
        return (
            F.when(n == 7, F.lit(" \n"))
            .when(n == 9, C.fill("<main><p>{k}</p></main>"))
            .when(F.col("k") % 4 == 3, old)
            .otherwise(both)
        )

    return _orders(spark, sf_dir).select(
        _feed_name("c").alias("source_name"),
        _by_customer(lambda p: C.fill(_BASES[p])).alias("url"),
        F.encode(_by_customer(html), "UTF-8").alias("content"),
        F.when(F.col("k") % 50 == 11, F.lit(_NO_ENCODING)).otherwise(F.lit("utf-8")).alias("encoding"),
        "collected_at",
    )


def entry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched entry pages: one per order's post, some missing, blank or without content, and the feeds' recurring posts."""
    bulletins, orders = None, _orders(spark, sf_dir)
    for profile in (V.S1, V.SL, V.PP):
        rows = orders.filter(F.expr(_PROFILE.format("c")) == profile)
        part = rows.select("k", C.fill(_LINKS[profile][0]).alias("url"), C.entry_html(profile).alias("html"))
        bulletins = part if bulletins is None else bulletins.unionByName(part)
    posts = bulletins.filter("k % 17 <> 0").select(
        "url", F.when(F.col("k") % 19 == 0, F.lit("")).when(F.col("k") % 29 == 0, F.lit("<p>Moved.</p>")).otherwise(F.col("html")).alias("html")
    )
    customers = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.explode(F.array(*map(F.lit, range(3)))).alias("r"))
    again = customers.select(
        _by_customer(lambda p: C.fill(_LINKS[p][1].replace("{k}", ""))).alias("url"),
        F.lit("<main><article><h1>Again</h1><p>Nothing found.</p></article></main>").alias("html"),
    )
    return posts.unionByName(again).select(
        "url", F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("string").alias("encoding")
    )


def _run(spark: SparkSession, sf_dir: str) -> full_run.FullRun:
    return full_run.run_feeds(feeds(spark, sf_dir), index_pages(spark, sf_dir), entry_pages(spark, sf_dir))


def _bulletin_rows() -> str:
    parts = []
    for n, expected in enumerate((C.S1_EXPECTED, C.SL_EXPECTED, C.PP_EXPECTED)):
        parts.append(f"SELECT k, kind, value FROM ({C.expected_rows_sql(expected)}) AS b{n} WHERE k IN (SELECT k FROM indicators WHERE c % 3 = {n})")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS b WHERE {Q.keep('kind', 'value')}"


_RUN_CTES = (
    # Runs of enabled feeds; post and again name the two links of a listing page.
    f"indicators AS ({C.INDICATORS_SQL}), "
    "runs AS (SELECT k, c, 'feed ' || CAST(c AS STRING) AS source_name, dated + to_seconds(k % 86400) AS collected_at, "
    "CASE k % 50 WHEN 7 THEN 'empty response body' WHEN 9 THEN 'no index entries' "
    f"WHEN 11 THEN 'unknown encoding: {_NO_ENCODING}' END AS error, k % 4 <> 3 AS has_post, "
    "'p' || CAST(k AS STRING) AS post, 'a' || CAST(k % 3 AS STRING) AS again FROM indicators "
    "WHERE c % 13 <> 0 AND c IN (SELECT c_custkey FROM customer)), "
    f"iocs AS ({_bulletin_rows()}), "
    "observed AS (SELECT k, kind, CASE WHEN kind = 'ipv4_port' AND contains(value, ':') THEN 'ipv4' ELSE kind END AS kind2, "
    "CASE WHEN kind = 'ipv4_port' THEN split_part(value, ':', 1) ELSE value END AS value2, value FROM iocs "
    "WHERE NOT (kind = 'ipv4_port' AND NOT contains(value, ':'))), "
    "objects AS (SELECT DISTINCT k, kind2 AS kind, value2 AS value FROM observed UNION "
    "SELECT DISTINCT k, 'traffic', value FROM observed WHERE kind = 'ipv4_port')"
)
_LISTED_SQL = (
    "SELECT source_name, collected_at, again AS publication_url FROM runs WHERE error IS NULL UNION ALL "
    "SELECT source_name, collected_at, post FROM runs WHERE error IS NULL AND has_post"
)
_JUDGED_CTES = (
    f"{replay_sql(_LISTED_SQL)}, fresh AS (SELECT source_name, collected_at, unnest(fresh) AS link FROM replayed), "
    # A post's page is there unless it is missing, blank or hollow; a recurring post's page always is.
    "outcome AS (SELECT f.source_name, f.collected_at, f.link, r.k, f.link[1] = 'p' AND r.k % 17 = 0 AS missing, "
    "f.link[1] = 'p' AND r.k % 17 <> 0 AND r.k % 19 = 0 AS blank, "
    "f.link[1] = 'p' AND r.k % 17 <> 0 AND r.k % 19 <> 0 AND r.k % 29 = 0 AS hollow FROM fresh AS f JOIN runs AS r USING (source_name, collected_at)), "
    "per_run AS (SELECT source_name, collected_at, count(*) AS new, count(*) FILTER (NOT missing AND NOT blank) AS good, "
    "count(*) FILTER (NOT missing AND NOT blank AND NOT hollow) AS parsed, "
    "max(CASE WHEN link[1] = 'p' AND NOT missing AND NOT blank AND NOT hollow THEN (SELECT count(*) FROM objects AS o WHERE o.k = outcome.k) ELSE 0 END) AS observed "
    "FROM outcome GROUP BY source_name, collected_at)"
)
_RESULTS_SQL = (
    f"WITH {_JUDGED_CTES.replace('RECURSIVE ', f'RECURSIVE {_RUN_CTES}, ', 1)}, results AS (SELECT r.source_name, r.collected_at, "
    "r.error IS NULL AND NOT coalesce(p.kept, false) AS snapshot_deleted, "
    "CASE WHEN r.error IS NOT NULL THEN 0 WHEN has_post THEN 2 ELSE 1 END AS total_index_entries, "
    "coalesce(n.new, 0) AS new_index_entries, coalesce(n.good, 0) AS fetched_entries, coalesce(n.parsed, 0) AS parsed_entries, "
    "CASE WHEN n.observed > 0 THEN n.observed + 2 ELSE 0 END AS stix_object_count, r.error IS NULL AS succeeded, "
    "r.error AS error_message FROM runs AS r LEFT JOIN replayed AS p USING (source_name, collected_at) "
    "LEFT JOIN per_run AS n USING (source_name, collected_at)) "
)


_RUN_01_SQL = (
    f"{_RESULTS_SQL} SELECT source_name, {shown_sql('collected_at')}, snapshot_deleted, total_index_entries, new_index_entries, "
    "fetched_entries, parsed_entries, stix_object_count, succeeded, error_message FROM results"
)


@query("run_01_full_batch", _RUN_01_SQL)
def full_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_results(_run(spark, sf_dir).results)


class _Stopped(Exception):
    """A run's end in the middle."""


class _StoppingStore(run_store.RunStore):
    def commit(self, run: str, stage: str, schema: str = "") -> None:
        super().commit(run, stage, schema)
        if stage == "parsed":
            raise _Stopped


@query("run_01_two_stored_runs", _RUN_01_SQL)
def two_stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages in two runs; the first one stops after a stage and is started again, the second begins at stored baselines."""
    folder = f"{checkpoint_folder(spark)}/runs-{uuid.uuid4()}"
    pages, entries = index_pages(spark, sf_dir), entry_pages(spark, sf_dir)
    early = F.col("collected_at") < F.lit("1995-07-01").cast("timestamp")
    store = run_store.RunStore(spark, folder)
    try:
        run_store.run_and_store(_StoppingStore(spark, folder), "1", feeds(spark, sf_dir), pages.where(early), entries)
    except _Stopped:
        run_store.run_and_store(store, "1", feeds(spark, sf_dir), pages.where(early), entries)
    run_store.run_and_store(store, "2", feeds(spark, sf_dir), pages.where(~early), entries)
    return _shown_results(run_history.load_runs(spark, f"{folder}/history"))


_SOURCE_STATUS_SQL = (
    "SELECT 'feed ' || CAST(c_custkey AS STRING) AS source_name, 'https://example.org/' || CAST(c_custkey AS STRING) AS source_url, "
    "c_custkey % 23 <> 0 AS succeeded, CASE WHEN c_custkey % 23 = 0 THEN 'no \"quotes\", no end' END AS error_message, "
    "CASE WHEN c_custkey % 23 <> 0 AND c_custkey % 5 <> 0 THEN 'snapshot ' || CAST(c_custkey AS STRING) END AS snapshot_locator, "
    "c_custkey % 23 <> 0 AND c_custkey % 5 = 0 AS snapshot_deleted, CAST(c_custkey % 9 AS INT) AS total_index_entries, "
    "CAST(c_custkey % 4 AS INT) AS new_index_entries, CAST(c_custkey % 3 AS INT) AS fetched_entries, CAST(c_custkey % 2 AS INT) AS parsed_entries, "
    "CASE WHEN c_custkey % 2 = 1 THEN 'bundle--' || CAST(c_custkey AS STRING) END AS stix_bundle_locator, "
    "CAST(c_custkey % 2 * 3 AS INT) AS stix_object_count FROM customer"
)


@query(
    "run_status",
    f"SELECT s.*, '2024-05-06T07:08:09.000000Z' AS generated_at, count(*) OVER () AS total_sources, count(*) FILTER (succeeded) OVER () AS succeeded_sources, "
    f"count(*) FILTER (NOT succeeded) OVER () AS failed_sources FROM ({_SOURCE_STATUS_SQL}) AS s",
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status document of a run, written and read back: its sources, each with the document's totals."""
    C.table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    results = spark.sql(_SOURCE_STATUS_SQL).withColumn("generated_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    folder = f"{checkpoint_folder(spark)}/status-{uuid.uuid4()}"
    run_history.write_status(results, folder, config_path="feeds.json")
    totals, sources = run_history.read_status(spark, folder)
    # The document has one row of totals.
    return sources.withColumn("one", F.lit(1)).join(F.broadcast(totals.withColumn("one", F.lit(1))), "one").drop("one")


def _shown_results(results: DataFrame) -> DataFrame:
    return results.withColumnRenamed("generated_at", "collected_at").select(
        "source_name",
        shown("collected_at"),
        "snapshot_deleted",
        "total_index_entries",
        "new_index_entries",
        "fetched_entries",
        "parsed_entries",
        "stix_object_count",
        "succeeded",
        "error_message",
    )


@query(
    "run_02_failures",
    f"{_RESULTS_SQL} SELECT source_name, stage, count(*) AS failures FROM ("
    "SELECT source_name, CASE error WHEN 'empty response body' THEN 'fetch_index' WHEN 'no index entries' THEN 'parse_index' "
    "ELSE 'decode_index' END AS stage FROM runs WHERE error IS NOT NULL "
    "UNION ALL SELECT source_name, 'fetch_entry' FROM outcome WHERE missing OR blank "
    "UNION ALL SELECT source_name, 'parse_entry' FROM outcome WHERE hollow UNION ALL "
    "SELECT o.source_name, 'build_bundle' FROM outcome AS o JOIN iocs AS i ON i.k = o.k WHERE o.link[1] = 'p' AND NOT missing "
    "AND NOT blank AND NOT hollow AND i.kind = 'ipv4_port' AND NOT contains(i.value, ':')) GROUP BY source_name, stage",
)
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir).failures
    return found.groupBy("source_name", "stage").agg(F.count(F.lit(1)).alias("failures"))


@query(
    "run_03_results_per_source",
    f"{_RESULTS_SQL} SELECT source_name, count(*) AS runs, CAST(sum(new_index_entries) AS BIGINT) AS new_index_entries, "
    "CAST(sum(fetched_entries) AS BIGINT) AS fetched_entries, CAST(sum(stix_object_count) AS BIGINT) AS stix_objects, "
    "count(*) FILTER (snapshot_deleted) AS dropped FROM results GROUP BY source_name",
)
def results_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _run(spark, sf_dir).results
    return results.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("new_index_entries").alias("new_index_entries"),
        F.sum("fetched_entries").alias("fetched_entries"),
        F.sum("stix_object_count").alias("stix_objects"),
        F.count_if("snapshot_deleted").alias("dropped"),
    )


def _filled_sql(template: str) -> str:
    for name, value in (("{c}", "c"), ("{k}", "k"), ("{r}", "(k % 3)")):
        template = template.replace(name, f"' || CAST({value} AS STRING) || '")
    return f"'{template}'"


def _link_sql(which: int) -> str:
    s1, sl, pp = (_filled_sql(_LINKS[profile][which]) for profile in (V.S1, V.SL, V.PP))
    return f"CASE c % 3 WHEN 0 THEN {s1} WHEN 1 THEN {sl} ELSE {pp} END"


_LISTING_SQL = (
    f"'<main>' || CASE WHEN has_post THEN '<article><h2><a href=\"' || {_link_sql(0)} || '\">Post ' || CAST(k AS STRING) || '</a></h2></article>' ELSE '' END "
    f"|| '<article><h2><a href=\"' || {_link_sql(1)} || '\">Again ' || CAST(k % 3 AS STRING) || '</a></h2></article></main>'"
)
_BUNDLE_NAME_SQL = "'{\"run_at\":\"' || strftime(collected_at, '%Y-%m-%d %H:%M:%S') || '\",\"source_name\":\"' || source_name || '\"}'"


@query(
    "run_03_locators",
    f"{_RESULTS_SQL} SELECT source_name, {shown_sql('collected_at')}, CASE WHEN succeeded AND NOT snapshot_deleted THEN "
    f"strftime(collected_at, '%Y%m%dT%H%M%S') || '000000+0000_' || sha256({_LISTING_SQL}) END AS snapshot_locator, "
    f"CASE WHEN stix_object_count > 0 THEN {Q.stix_id('bundle', _BUNDLE_NAME_SQL)} END AS stix_bundle_locator "
    "FROM results JOIN (SELECT source_name, collected_at, k, c, has_post FROM runs) AS r USING (source_name, collected_at)",
)
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run's snapshot and bundle are."""
    results = _run(spark, sf_dir).results.withColumnRenamed("generated_at", "collected_at")
    return results.select("source_name", shown("collected_at"), "snapshot_locator", "stix_bundle_locator")


# ---------------------------------------------------------------- reports over run results


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run result per order: its source is the customer, its day the order date."""
    k = F.col("o_orderkey")
    ok = k % 23 != 0
    new = F.when(ok, k % 4).otherwise(F.lit(0))
    return C.table(spark, sf_dir, "orders").select(
        _feed_name("o_custkey").alias("source_name"),
        F.to_date("o_orderdate").alias("day"),
        ok.alias("succeeded"),
        new.cast("int").alias("new_index_entries"),
        F.when(ok & (k % 4 > 0) & (k % 31 != 0), F.concat(F.lit("bundle--"), k.cast("string"))).alias("stix_bundle_locator"),
    )


_RESULT_ROWS_SQL = (
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 23 <> 0 AS succeeded, "
    "CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 4 ELSE 0 END AS new_entries, "
    "o_orderkey % 23 <> 0 AND o_orderkey % 4 > 0 AND o_orderkey % 31 <> 0 AS bundled FROM orders"
)


@query(
    "run_04_summary",
    "SELECT day, count(*) AS total_sources, count(*) FILTER (succeeded) AS succeeded_sources, "
    f"count(*) FILTER (NOT succeeded) AS failed_sources FROM ({_RESULT_ROWS_SQL}) AS r GROUP BY day",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_summary(_results(spark, sf_dir), ["day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_COUNTED = OBJECT_COUNTS_SQL.rsplit("SELECT source_name, type, count(*) AS n FROM", 1)


@query(
    "run_05_totals",
    _COUNTED[0]
    + f"SELECT (SELECT count(*) * {len(C.KIND_VALUES)} FROM entries WHERE has_iocs) AS total_iocs, "
    + "(SELECT count(*) FROM"
    + _COUNTED[1].removesuffix(" GROUP BY source_name, type")
    + ") AS total_stix_objects",
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stix_entries(spark, sf_dir)
    iocs = entries.select("source_name", F.inline("iocs"))
    return R.run_totals(iocs, X.bundle_objects(entries))


@query(
    "run_06_health",
    "SELECT day, round(count(*) FILTER (succeeded) * 100.0 / count(*), 4) AS success_rate, "
    "count(*) FILTER (NOT succeeded) AS failed_sources, count(*) FILTER (bundled) AS bundle_count, "
    "count(*) FILTER (succeeded AND new_entries > 0) AS sources_with_new, "
    f"round(count(*) FILTER (succeeded) * 100.0 / count(*), 4) >= {V.SUCCESS_RATE_TARGET} AS rate_ok, "
    "count(*) FILTER (NOT succeeded) > 0 AS alarm, "
    "count(*) FILTER (bundled) = count(*) FILTER (succeeded AND new_entries > 0) AS bundles_ok "
    f"FROM ({_RESULT_ROWS_SQL}) AS r GROUP BY day",
)
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = R.health(_results(spark, sf_dir), ["day"])
    return checked.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn(
        "success_rate", F.col("success_rate").cast("double")
    )


_STAGES = ("fetch_index", "parse_index", "fetch_entry", "parse_entry")


@query(
    "run_07_failure_stats",
    "SELECT event_type AS source_name, CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STAGES))
    + " END AS stage, strftime(ts, '%Y-%m-%d') AS day, count(*) AS failures FROM events GROUP BY ALL",
)
def failure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (F.col("user_id") % 4 + 1).cast("int"))
    rows = C.table(spark, sf_dir, "events").select(F.col("event_type").alias("source_name"), stage.alias("stage"), "ts")
    return R.failure_stats(rows).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "run_08_preview",
    with_objects(
        "SELECT e.source_url, CASE WHEN has_iocs THEN "
        + " || ' ' || ".join(f"'{kind}=' || i.{name}" for kind, name in C.KIND_VALUES[: V.PREVIEW_SIZE])
        + f" ELSE '' END AS preview, CASE WHEN has_iocs THEN {len(C.KIND_VALUES) - V.PREVIEW_SIZE} ELSE 0 END AS more, "
        f"CASE WHEN has_iocs THEN {len(C.KIND_VALUES)} ELSE 0 END AS ioc_count FROM entries AS e "
        "JOIN indicators AS i ON i.k = e.entry_ord"
    ),
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown_iocs = F.array_join(F.transform("preview", lambda x: F.concat(x["kind"], F.lit("="), x["value"])), " ")
    return R.preview(C.entries(spark, sf_dir)).select("source_url", shown_iocs.alias("preview"), "more", "ioc_count")
