"""FLT-01..08: indicator quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions import rules
from threatloom.queries import corpora as C
from threatloom.queries import sql as Q
from threatloom.queries.catalog import query

# Some addresses written loosely, so that the strict reading has something to refuse.
_LOOSE = "CASE k % 5 WHEN 0 THEN '0' || ipv4 WHEN 1 THEN ipv4_port WHEN 2 THEN ipv4 || '.' ELSE ipv4 END"


@query(
    "flt_01_ipv4_to_long",
    C.with_indicators(
        f"SELECT k, address, {Q.ipv4_to_long('address')} AS number FROM (SELECT k, {_LOOSE} AS address FROM indicators)"
    ),
)
def ipv4_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.indicators(spark, sf_dir).select("k", F.expr(_LOOSE).alias("address"))
    return rows.withColumn("number", rules.ipv4_to_long(F.col("address")))


@query(
    "flt_02_special_ipv4",
    C.with_indicators(
        f"SELECT value, {Q.is_special('n')} AS special, count(*) AS n FROM (SELECT value, "
        f"{Q.ipv4_to_long('value')} AS n FROM iocs WHERE kind = 'ipv4') GROUP BY value, special"
    ),
)
def special_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    addresses = C.iocs(spark, sf_dir).filter("kind = 'ipv4'")
    judged = addresses.withColumn("special", rules.is_special_ipv4(rules.ipv4_to_long(F.col("value"))))
    return judged.groupBy("value", "special").agg(F.count(F.lit(1)).alias("n"))


def _rule_query(key: str, rule: rules.Rule, keep) -> None:
    @query(key, C.with_indicators(f"SELECT k, ord, kind, value FROM iocs WHERE {keep('kind', 'value')}"))
    def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.iocs(spark, sf_dir).filter(rule(F.col("kind"), F.col("value")))


_rule_query("flt_03_special_ip_rule", rules.rule_special_ip, Q.keep_ip)
_rule_query("flt_04_domain_rule", rules.rule_domain, Q.keep_domain)
_rule_query("flt_05_url_rule", rules.rule_url, Q.keep_url)


@query("flt_06_rule_chain", C.with_indicators(f"SELECT k, ord, kind, value FROM iocs WHERE {Q.keep('kind', 'value')}"))
def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filter_iocs(C.iocs(spark, sf_dir))


@query(
    "flt_07_drop_reasons",
    C.with_indicators(
        f"SELECT rule, kind, count(*) AS dropped FROM (SELECT kind, CASE WHEN NOT {Q.keep_ip('kind', 'value')} "
        f"THEN 'special_purpose_ipv4' WHEN NOT {Q.keep_domain('kind', 'value')} THEN 'invalid_domain' "
        f"WHEN NOT {Q.keep_url('kind', 'value')} THEN 'internal_url' END AS rule FROM iocs) "
        "WHERE rule IS NOT NULL GROUP BY rule, kind"
    ),
)
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = rules.explain_drops(C.iocs(spark, sf_dir))
    return dropped.groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("dropped"))


@query(
    "flt_08_filter_entries",
    C.with_indicators(
        "SELECT e.source_name, e.source_url, e.title, md5(e.content) AS content_digest, "
        "coalesce(string_agg(i.kind || '=' || i.value, ' ' ORDER BY i.ord), '') AS iocs "
        f"FROM ({C.ENTRIES_SQL}) AS e LEFT JOIN (SELECT * FROM iocs WHERE {Q.keep('kind', 'value')}) AS i "
        "ON i.k = e.entry_ord AND e.has_iocs GROUP BY ALL"
    ),
)
def filter_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("iocs", lambda x: F.concat(x["kind"], F.lit("="), x["value"])), " ")
    filtered = rules.filter_entry_iocs(C.entries(spark, sf_dir))
    return filtered.select(
        "source_name", "source_url", "title", F.md5("content").alias("content_digest"), shown.alias("iocs")
    )
