"""STX-01..09 and SUR-01..06: objects and rules from entries made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.operators import stix as X
from threatloom.operators import suricata as R
from threatloom.operators.numbering import number_rows
from threatloom.queries import corpora as C
from threatloom.queries import sql as Q
from threatloom.queries.catalog import query

KEYS = ["source_name"]


def stix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their observables, built in their row wherever they are read: storing them takes more than a shuffle of them."""
    return X.with_observables(C.entries(spark, sf_dir))


# (type, value column, canonical name of the id) of an entry's observables, in order; and their JSON behind the id.
_ADDRESS = [("ipv4-addr", v, Q.one_value(v)) for v in ("ipv4", "ipv4_b", "ipv4_b")]
_TRAFFIC_NAME = (
    f"('{{\"dst_port\":' || port || ',\"dst_ref\":\"' || {Q.stix_id('ipv4-addr', Q.one_value('ipv4_b'))} || "
    "'\",\"protocols\":[\"ipv4\"]}')"
)


def _hash(kind: str) -> tuple[str, str, str]:
    return "file", kind, f"('{{\"hashes\":{{\"{V.HASH_NAMES[kind]}\":\"' || {kind} || '\"}}}}')"


_GENERIC = "('{\"observable_type\":\"campaign\",\"value\":\"' || priority || '\"}')"
OBSERVABLES = [
    *_ADDRESS,
    ("network-traffic", "NULL", _TRAFFIC_NAME),
    ("domain-name", "domain", Q.one_value("domain")),
    ("domain-name", "domain_b", Q.one_value("domain_b")),
    ("url", "url", Q.one_value("url")),
    ("url", "url_b", Q.one_value("url_b")),
    _hash("md5"),
    _hash("sha1"),
    _hash("sha256"),
    ("x-ti-tox-id", "file", Q.one_value("file")),
    ("domain-name", "domain", Q.one_value("domain")),
    ("x-ti-observable", "priority", _GENERIC),
]
_TAILS = {
    "network-traffic": f"',\"dst_ref\":\"' || {Q.stix_id('ipv4-addr', Q.one_value('ipv4_b'))} || '\",\"dst_port\":' || port || ',\"protocols\":[\"ipv4\"]'",
    "x-ti-observable": "',\"observable_type\":\"campaign\",\"value\":\"' || priority || '\"'",
}


def _tail(kind: str, value: str) -> str:
    if kind == "file":
        return f"',\"hashes\":{{\"{V.HASH_NAMES[value]}\":\"' || {value} || '\"}}'"
    return _TAILS.get(kind, f"',\"value\":' || CAST(to_json({value}) AS VARCHAR)")


_OBS_SQL = " UNION ALL ".join(
    f"SELECT k, priority, {place} AS place, '{kind}' AS type, {Q.stix_id(kind, name)} AS id, {value} AS value, {_tail(kind, value)} AS tail FROM indicators "
    "WHERE priority <> '5-LOW' AND k % 11 <> 0"
    for place, (kind, value, name) in enumerate(OBSERVABLES)
)
_FIRST_SQL = (
    "SELECT 'Feed ' || priority AS source_name, id, type, min((k, place)) AS first, any_value(value) AS value, any_value(tail) AS tail FROM obs "
    "GROUP BY priority, id, type"
)


def with_objects(query_text: str) -> str:
    """DuckDB query over ``indicators``, ``entries``, ``obs`` and ``first_seen``."""
    return (
        f"WITH indicators AS ({C.INDICATORS_SQL}), entries AS ({C.ENTRIES_SQL}), obs AS ({_OBS_SQL}), "
        f"first_seen AS ({_FIRST_SQL}) {query_text}"
    )


@query(
    "stx_01_observables",
    with_objects(
        "SELECT k, place, type, CASE WHEN type IN ('file', 'network-traffic') THEN NULL ELSE value END AS value, "
        "CASE WHEN type = 'file' THEN value END AS digest FROM obs"
    ),
)
def observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = stix_entries(spark, sf_dir).select(F.col("entry_ord").alias("k"), F.posexplode("observables").alias("place", "o"))
    digest = F.coalesce("o.hashes.MD5", "o.hashes.SHA-1", "o.hashes.SHA-256")
    return exploded.select("k", "place", "o.type", "o.value", digest.alias("digest"))


_PORT_VALUE = "CASE k % 6 WHEN 0 THEN ipv4_b || ':port' WHEN 1 THEN ipv4_b ELSE ipv4_port END"


@query(
    "stx_02_ipv4_port",
    with_objects(
        f"SELECT k, 'ipv4-addr' AS type, {Q.stix_id('ipv4-addr', Q.one_value('ipv4_b'))} AS id, ipv4_b AS value, "
        "CAST(NULL AS INT) AS dst_port, CAST(NULL AS STRING) AS dst_ref FROM indicators WHERE k % 6 > 1 UNION ALL "
        f"SELECT k, 'network-traffic', {Q.stix_id('network-traffic', _TRAFFIC_NAME)}, NULL, CAST(port AS INT), "
        f"{Q.stix_id('ipv4-addr', Q.one_value('ipv4_b'))} FROM indicators WHERE k % 6 > 1 UNION ALL "
        f"SELECT k, 'bad', NULL, {_PORT_VALUE}, NULL, NULL FROM indicators WHERE k % 6 <= 1"
    ),
)
def ipv4_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.indicators(spark, sf_dir).select("k", F.lit("ipv4_port").alias("kind"), F.expr(_PORT_VALUE).alias("value"))
    built = rows.select("k", F.inline(X.observables(F.col("kind"), F.col("value")))).select(
        "k", "type", "id", "value", "dst_port", "dst_ref"
    )
    nothing = F.lit(None)
    bad = X.bad_ipv4_ports(rows).select(
        "k",
        F.lit("bad").alias("type"),
        nothing.cast("string").alias("id"),
        "value",
        nothing.cast("int").alias("dst_port"),
        nothing.cast("string").alias("dst_ref"),
    )
    return built.unionByName(bad)


@query("stx_03_observable_ids", with_objects("SELECT DISTINCT type, id FROM obs"))
def observable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = stix_entries(spark, sf_dir).select(F.explode("observables").alias("o"))
    return exploded.select("o.type", "o.id").distinct()


@query(
    "stx_04_dedup_objects",
    with_objects("SELECT source_name, id, type, first[1] AS entry_ord, first[2] AS place FROM first_seen"),
)
def dedup_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_places(stix_entries(spark, sf_dir)).select("source_name", "id", "type", "entry_ord", "place")


_REFS_SQL = (
    "SELECT k, list(id ORDER BY place) AS refs FROM (SELECT k, id, min(place) AS place FROM obs GROUP BY k, id) GROUP BY k"
)


@query(
    "stx_05_object_refs",
    with_objects(f"SELECT k, len(refs) AS n, md5(array_to_string(refs, ' ')) AS digest FROM ({_REFS_SQL}) AS r"),
)
def object_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stix_entries(spark, sf_dir).filter(F.size("object_refs") > 0)
    digest = F.md5(F.array_join("object_refs", " "))
    return entries.select(F.col("entry_ord").alias("k"), F.size("object_refs").alias("n"), digest.alias("digest"))


_IDENTITY_ID = Q.stix_id(
    "identity", f"('{{\"identity_class\":\"{V.IDENTITY_CLASS}\",\"name\":\"' || source_name || '\"}}')"
)
_DAY = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_CREATED = f"({_DAY.format('collected_at')} || '.000Z')"
_IDENTITIES_SQL = (
    f"SELECT source_name, {_IDENTITY_ID} AS id, min_by({_CREATED}, entry_ord) AS created FROM entries "
    "GROUP BY source_name HAVING bool_or(has_iocs)"
)


@query("stx_06_identities", with_objects(_IDENTITIES_SQL))
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.identities(stix_entries(spark, sf_dir)).select("source_name", "id", "created")


_REPORT_ID = Q.stix_id(
    "report",
    f"('{{\"collected_at\":\"' || {_CREATED} || '\",\"source_name\":\"' || source_name || '\",\"source_url\":\"' || "
    "source_url || '\"}')",
)
_DESCRIPTION = (
    f"CASE WHEN length(content) > {V.DESCRIPTION_LIMIT} THEN left(content, {V.DESCRIPTION_CUT}) || '{V.DESCRIPTION_TAIL}' "
    "ELSE content END"
)


@query(
    "stx_07_reports",
    with_objects(
        f"SELECT source_name, entry_ord, {_REPORT_ID} AS id, {_IDENTITY_ID} AS created_by_ref, {_CREATED} AS created, "
        f"{_DAY.format('collected_at')} || 'Z' AS published, title AS name, md5({_DESCRIPTION}) AS description, "
        "source_url AS url FROM entries WHERE has_iocs"
    ),
)
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reports(stix_entries(spark, sf_dir)).select(
        "source_name",
        "entry_ord",
        "id",
        "created_by_ref",
        "created",
        "published",
        "name",
        F.md5("description").alias("description"),
        F.col("external_references")[0]["url"].alias("url"),
    )


def _head(kind: str, stix_id: str) -> str:
    return f"'{{\"type\":\"' || {kind} || '\",\"spec_version\":\"2.1\",\"id\":\"' || {stix_id} || '\"'"


def _members(**values: str) -> str:
    return " || ".join(f"',\"{name}\":' || CAST(to_json({value}) AS VARCHAR)" for name, value in values.items()) + " || '}'"


_IDENTITY_JSON = _head("'identity'", "id") + " || " + _members(created="created", modified="created", name="source_name", identity_class=f"'{V.IDENTITY_CLASS}'")
_REPORT_JSON = _head("'report'", _REPORT_ID) + " || " + _members(
    created_by_ref=_IDENTITY_ID, created=_CREATED, modified=_CREATED, name="title", description=_DESCRIPTION, report_types=f"['{V.REPORT_TYPE}']",
    published=f"({_DAY.format('collected_at')} || 'Z')", object_refs="refs",
    external_references=f"[{{'source_name': source_name, 'description': '{V.REFERENCE_DESCRIPTION}', 'url': source_url}}]",
)
_OBJECTS_SQL = (
    f"SELECT source_name, 0 AS section, 0 AS entry_ord, 0 AS place, id, 'identity' AS type, md5({_IDENTITY_JSON}) AS json_md5 "
    f"FROM ({_IDENTITIES_SQL}) AS i UNION ALL "
    f"SELECT source_name, 1, first[1], first[2], id, type, md5({_head('type', 'id')} || tail || '}}') FROM first_seen UNION ALL "
    f"SELECT source_name, 2, entry_ord, 0, {_REPORT_ID}, 'report', md5({_REPORT_JSON}) FROM entries JOIN ({_REFS_SQL}) AS r ON r.k = entry_ord "
    "WHERE has_iocs"
)
OBJECT_COUNTS_SQL = with_objects(f"SELECT source_name, type, count(*) AS n FROM ({_OBJECTS_SQL}) AS o GROUP BY source_name, type")


@query("stx_08_bundle_objects", with_objects(_OBJECTS_SQL))
def bundle_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = X.bundle_objects(stix_entries(spark, sf_dir))
    return objects.withColumn("json_md5", F.md5("json")).drop("json")


@query("stx_09_bundle_stats", OBJECT_COUNTS_SQL)
def bundle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.bundle_stats(X.object_kinds(stix_entries(spark, sf_dir)))


# ---------------------------------------------------------------- rules


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle objects as a reader of stored bundles sees them; every fifth report without a usable URL."""
    fields = R.object_fields(X.bundle_objects(stix_entries(spark, sf_dir)))
    blank = F.array(F.struct(F.lit("  ").alias("url"), ), F.struct(F.lit(None).cast("string").alias("url")))
    no_url = (F.col("type") == "report") & (F.col("entry_ord") % 5 == 0)
    return fields.withColumn("external_references", F.when(no_url, blank).otherwise(F.col("external_references")))


_REF_ROWS = (
    f"SELECT e.source_name, {_REPORT_ID.replace('source_name', 'e.source_name')} AS report_id, r.id, "
    "CASE WHEN e.entry_ord % 5 <> 0 THEN e.source_url END AS url FROM entries AS e JOIN (SELECT DISTINCT k, id FROM obs) AS r "
    "ON r.k = e.entry_ord"
).replace('"e.source_name', '"source_name')


@query("sur_01_reports_by_ref", with_objects(f"SELECT source_name, report_id, id FROM ({_REF_ROWS}) AS r"))
def reports_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reports_by_ref(_objects(spark, sf_dir), KEYS).select("source_name", "report_id", "id")


@query(
    "sur_02_reference_urls",
    with_objects(f"SELECT DISTINCT report_id, url FROM ({_REF_ROWS}) AS r WHERE url IS NOT NULL"),
)
def reference_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _objects(spark, sf_dir).filter("type = 'report'")
    urls = R.reference_urls(F.col("external_references"))
    return reports.select(F.col("id").alias("report_id"), F.explode(urls).alias("url"))


_ROWS_SQL = (
    "SELECT DISTINCT CASE f.type WHEN 'ipv4-addr' THEN 'ipv4' ELSE 'domain' END AS ioc_type, f.value AS indicator, "
    f"coalesce(r.url, '{V.NO_REFERENCE_URL}') AS reference_url FROM first_seen AS f LEFT JOIN "
    f"(SELECT * FROM ({_REF_ROWS}) AS q WHERE url IS NOT NULL) AS r ON r.source_name = f.source_name AND r.id = f.id "
    "WHERE f.type IN ('ipv4-addr', 'domain-name')"
)
_ENTRY_ROWS_SQL = (
    "SELECT DISTINCT CASE o.type WHEN 'ipv4-addr' THEN 'ipv4' ELSE 'domain' END AS ioc_type, o.value AS indicator, "
    "e.source_url AS reference_url FROM obs AS o JOIN entries AS e ON e.entry_ord = o.k "
    "WHERE o.type IN ('ipv4-addr', 'domain-name')"
)
_ORDERED = "row_number() OVER (ORDER BY ioc_type, indicator, reference_url)"
_SIDS_SQL = f"SELECT ioc_type, indicator, reference_url, {V.START_SID - 1} + {_ORDERED} AS sid FROM ({_ROWS_SQL}) AS x"


@query("sur_03_rule_rows", with_objects(_ROWS_SQL))
def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rule_rows(_objects(spark, sf_dir), KEYS)


@query("sur_03_rule_rows_of_entries", with_objects(_ENTRY_ROWS_SQL))
def rule_rows_of_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rule_rows_of_entries(stix_entries(spark, sf_dir))


@query(
    "sur_04_distinct_sorted",
    with_objects(f"SELECT ioc_type, indicator, reference_url, {_ORDERED} - 1 AS position FROM ({_ROWS_SQL}) AS x"),
)
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct row with its position in the sorted whole."""
    return number_rows(R.rule_rows(_objects(spark, sf_dir), KEYS), ["ioc_type", "indicator", "reference_url"], "position")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assign_sids(R.rule_rows(_objects(spark, sf_dir), KEYS))


@query("sur_05_assign_sids", with_objects(_SIDS_SQL))
def assign_sids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir)


def _rule_sql(template: str) -> str:
    text = Q.lit(template)
    for name, value in (("indicator", "indicator"), ("reference_url", "reference_url"), ("sid", "CAST(sid AS STRING)")):
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


RULES_SQL = (
    f"SELECT sid, CASE ioc_type WHEN 'ipv4' THEN {_rule_sql(V.IPV4_RULE)} ELSE {_rule_sql(V.DOMAIN_RULE)} END AS rule "
    f"FROM ({_SIDS_SQL}) AS s"
)


@query("sur_06_render_rules", with_objects(RULES_SQL))
def render_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.render_rules(rules(spark, sf_dir)).select("sid", "rule")
