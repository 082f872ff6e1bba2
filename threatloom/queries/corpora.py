"""Corpora derived from the given tables, row by row.

The tables hold few indicators, so orders are turned into indicator values and into bulletins and index
pages of each profile. ``VALUES`` are SQL expressions both Spark and DuckDB evaluate alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.operators.joins import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table each row of which means much work."""
    return spread(table(spark, sf_dir, name))


_K, _C = "o_orderkey", "o_custkey"
_SUFFIX = (
    f"CASE {_K} % 8 WHEN 0 THEN 'com' WHEN 1 THEN 'net' WHEN 2 THEN 'example' WHEN 3 THEN 'local' "
    "WHEN 4 THEN 'corp' WHEN 5 THEN 'lan' WHEN 6 THEN 'home' ELSE 'internal' END"
)
_S = "CAST({} AS STRING)"


def _text(expression: str) -> str:
    return _S.format(expression)


_IPV4 = f"concat_ws('.', {_text(f'{_K} % 256')}, {_text(f'{_C} % 256')}, {_text(f'({_K} + {_C}) % 256')}, {_text(f'1 + {_C} % 254')})"
_IPV4_B = f"concat_ws('.', {_text(f'({_K} * 7) % 223 + 1')}, '20', {_text(f'{_C} % 256')}, '5')"
_DOMAIN = f"'host' || {_text(_C)} || '.' || {_SUFFIX}"
_DOMAIN_B = f"'c' || {_text(_C)} || '.evil' || {_text(f'{_K} % 10')} || '.org'"
VALUES = {
    "k": _K,
    "c": _C,
    "s": f"{_C} % 10",
    "k1": f"{_K} + 1",
    "ipv4": _IPV4,
    "ipv4_b": _IPV4_B,
    "port": _text(f"({_K} * 7) % 65536"),
    "ipv4_port": f"{_IPV4_B} || ':' || {_text(f'({_K} * 7) % 65536')}",
    "md5": f"md5({_text(_K)})",
    "md5_b": f"md5('b' || {_text(_K)})",
    "md5_c": f"md5('c' || {_text(_K)})",
    "sha1": f"sha1({_text(_K)})",
    "sha256": f"sha256({_text(_K)})",
    "domain": _DOMAIN,
    "domain_b": _DOMAIN_B,
    "url": (
        f"CASE {_K} % 3 WHEN 0 THEN 'http' ELSE 'https' END || '://' || CASE {_K} % 7 WHEN 0 THEN {_DOMAIN} "
        f"WHEN 1 THEN {_IPV4} WHEN 2 THEN 'localhost:8080' WHEN 3 THEN 'user:pw@' || {_DOMAIN_B} "
        f"WHEN 4 THEN 'intranet' WHEN 5 THEN upper({_DOMAIN_B}) || ':8443' ELSE {_DOMAIN_B} || '.' END "
        f"|| '/p/' || {_text(_K)}"
    ),
    "url_b": f"'https://' || {_DOMAIN_B} || '/drop/' || {_text(_K)}",
    "file": f"'invoice' || {_text(_K)} || '.exe'",
}
_SELECTED = ",\n  ".join(f"{expression} AS {name}" for name, expression in VALUES.items())
# The indicator table for DuckDB, and the same for Spark, which names one function differently.
INDICATORS_SQL = (
    f"SELECT {_SELECTED},\n  o_orderpriority AS priority, o_orderdate AS dated, o_totalprice AS price FROM orders"
)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of indicator values per order."""
    chosen = [
        F.expr(re.sub(r"sha256\((.*)\)\Z", r"sha2(\1, 256)", expression)).alias(name)
        for name, expression in VALUES.items()
    ]
    orders = wide_table(spark, sf_dir, "orders")
    return orders.select(
        *chosen, F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("dated"), F.col("o_totalprice").alias("price")
    )


# Kinds of the exploded indicator table, with the value each takes.
KIND_VALUES = [
    ("ipv4", "ipv4"),
    ("ipv4", "ipv4_b"),
    ("ipv4_port", "ipv4_port"),
    ("domain", "domain"),
    ("domain", "domain_b"),
    ("url", "url"),
    ("url", "url_b"),
    ("md5", "md5"),
    ("sha1", "sha1"),
    ("sha256", "sha256"),
    ("tox id", "file"),
    ("host names", "domain"),
    ("campaign", "priority"),
]


def ioc_array(pairs: list[tuple[str, str]] = KIND_VALUES) -> Column:
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.col(name).alias("value"))
        for i, (kind, name) in enumerate(pairs, 1)
    ]
    return F.array(*rows)


def iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded indicator table: k, ord, kind, value."""
    return indicators(spark, sf_dir).select("k", F.inline(ioc_array()))


IOCS_SQL = "\nUNION ALL\n".join(
    f"SELECT k, {i} AS ord, '{kind}' AS kind, {name} AS value FROM indicators"
    for i, (kind, name) in enumerate(KIND_VALUES, 1)
)


def with_indicators(query: str) -> str:
    """DuckDB query over ``indicators`` and ``iocs``."""
    return f"WITH indicators AS ({INDICATORS_SQL}),\niocs AS ({IOCS_SQL})\n{query}"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parsed entry per order; five sources, one of them without any indicator."""
    silent = F.col("priority") == "5-LOW"
    return indicators(spark, sf_dir).select(
        F.concat(F.lit("Feed "), F.col("priority")).alias("source_name"),
        F.concat(F.lit("https://feeds.example.org/post/"), F.col("k").cast("string")).alias("source_url"),
        F.concat(F.lit("Post "), F.col("k").cast("string")).alias("title"),
        F.when(F.col("k") % 16 == 0, F.repeat(F.lit("lorem ipsum "), 1700 + (F.col("k") % 7).cast("int")))
        .otherwise(F.concat(F.lit("About "), F.col("domain")))
        .alias("content"),
        F.col("dated").cast("timestamp").alias("collected_at"),
        F.col("k").alias("entry_ord"),
        F.when(silent | (F.col("k") % 11 == 0), F.array().cast("array<struct<ord:int,kind:string,value:string>>"))
        .otherwise(ioc_array())
        .alias("iocs"),
    )


ENTRIES_SQL = (
    "SELECT 'Feed ' || priority AS source_name, 'https://feeds.example.org/post/' || CAST(k AS STRING) AS source_url, "
    "'Post ' || CAST(k AS STRING) AS title, CASE WHEN k % 16 = 0 THEN repeat('lorem ipsum ', 1700 + CAST(k % 7 AS INT)) "
    "ELSE 'About ' || domain END AS content, dated AS collected_at, k AS entry_ord, "
    "(priority <> '5-LOW' AND k % 11 <> 0) AS has_iocs FROM indicators"
)


def fill(template: str) -> Column:
    """Template text with ``{name}`` replaced by indicator columns; ``{name~}`` writes dots as [.]."""
    pieces = re.split(r"\{(\w+~?)\}", template)
    columns = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            columns.append(F.lit(piece))
        elif piece.endswith("~"):
            columns.append(F.replace(F.col(piece[:-1]).cast("string"), F.lit("."), F.lit("[.]")))
        else:
            columns.append(F.col(piece).cast("string"))
    return F.concat(*columns)


def _choose(modulus: int, templates: list[str]) -> Column:
    chain = fill(templates[-1])
    for i in range(modulus - 1):
        chain = F.when(F.col("k") % modulus == i, fill(templates[i])).otherwise(chain)
    return chain


_S1_MD5 = [
    "<ul><li>Доступно только авторизованным  пользователям</li></ul>",
    "<pre>{md5}\nnot a hash</pre>",
    "<p>{md5}, {md5_b}</p>",
]
_S1_ENTRY = (
    "<html><body><main><article><h1> Группа\n{k}</h1><div class=\"entry-content\"><p>Текст {c}</p>"
    "<h2>Индикаторы  Компрометации</h2>OPEN<p>Пояснение 9.9.9.9</p>"
    "<h3>IPv4</h3><ul><li>{ipv4}</li><li>Адрес <b>{ipv4_b}</b></li><li>{ipv4}</li></ul>"
    "<h3>IPv4 Port Combinations</h3><ol><li>{ipv4_port} C2</li><li>нет данных</li></ol>"
    "<h3>Onion Domains</h3><ul><li>{domain}</li><li>evil[.]com</li></ul>"
    "<h4>Tox ID</h4><p>TOX{c}</p>"
    "<h3>MD5</h3>MD5"
    "<h3>URLs</h3><div><p>{url_b} and {url}</p></div>"
    "CLOSE<h2>Комментарии</h2><p>8.8.8.8</p><ul><li>{ipv4}</li></ul></div></article></main></body></html>"
)
_SL_ENTRY = (
    "<html><body><main><article><h1>Report {k}</h1><div class=\"post-content wide\"><p>Intro {c}.</p>"
    "<h2>Appendix I – Indicators of Compromise</h2>"
    "<h3>File Hashes</h3><ul><li>{md5}</li><li>{sha256} and {sha1}</li></ul>"
    "<h3>Domains and IPs</h3><ul><li>{domain_b~}</li><li>{ipv4~}</li></ul>"
    "<h3>URLs</h3><ul><li>hxxps://{domain_b~}/drop/{k}</li></ul>"
    "<h3>Samples</h3><p>MD5 list: {md5} {md5_b}</p><p>seen {ipv4_b}:{port} at {domain}</p>"
    "<table><tr><th>Domain</th><th>MD5</th><th>Note</th></tr>"
    "<tr><td>{domain}</td><td>{md5_c}</td><td>{sha1}</td></tr></table>"
    "<table><tr><td>{ipv4_b}</td><td>none</td></tr></table>"
    "<h2>Appendix II</h2><p>{ipv4} 8.8.8.8</p></div></article></main></body></html>"
)
_PP_ENTRIES = [
    "<html><body><main><article><h1>Brief {k}</h1><p>Intro.</p><h3>Indicators of compromise</h3>"
    "<table><tr><th>Indicator</th><th>Type</th><th>Context</th></tr>"
    "<tr><td>{domain_b~}</td><td>Domain</td><td>C2 {ipv4_b}</td></tr>"
    "<tr><td>{ipv4~}</td><td>IP</td><td>Delivery</td></tr>"
    "<tr><td>{sha256}</td><td>SHA256</td><td>{file}</td></tr>"
    "<tr><td>{file}</td><td>Filename</td><td>Lure</td></tr>"
    "<tr><td>{md5}</td><td>Hash</td><td>Loader</td></tr>"
    "<tr><td>only {url_b}</td></tr></table><h2>Rules</h2><p>{ipv4_b}</p></article></main></body></html>",
    "<html><body><article class=\"node\"><div class=\"blog-content__body\"><h3>Campaign {k}</h3><p>Reported by customer {c}</p>"
    "<table><tr><td><b>Indicator</b></td><td>Description</td></tr>"
    "<tr><td>{ipv4_b~}:{port}</td><td>Backdoor server</td></tr>"
    "<tr><td>{domain}</td><td>Domain of the kit</td></tr>"
    "<tr><td>box{c}@{domain_b~}</td><td>Mailbox</td></tr></table>"
    "<table><tr><td>elsewhere</td></tr><tr><td>{md5}</td></tr></table></div></article></body></html>",
    "<html><body><main><article><h1>Note {k}</h1><div><h3>Example indicators of compromise</h3>"
    "<p>{sha256} SHA256 of the archive</p><p>{domain_b~} panel</p><p>{ipv4~} IP of a relay</p>"
    "<h4>URLs</h4><p>hxxps://{domain_b~}/drop/{k} second stage</p><h4>Other</h4><ul><li>{sha1} {file}</li></ul>"
    "<h2>Earlier notes</h2><p>{ipv4_b}</p></div></article></main></body></html>",
]
_INDEX = {
    V.S1: (
        "https://bulletins{s}.example.org/ioc/",
        "<html><body><main><article><h2><a href=\"/post/{k}\">Post {k}</a></h2>"
        "<h2><a href=\"https://bulletins{s}.example.org/post/{k1}?x=1\">Post <b>next</b></a></h2>"
        "<h2><a href=\"/tag/{c}\">Tag</a></h2><h2><a href=\"/popular\">Популярное</a></h2>"
        "<h2><a href=\"/post/{k}\">again</a></h2></article>"
        "<div class=\"box entry-title\"><a href=\"../deep/./{c}/\">Deep  {c}</a></div>"
        "<h2><a href=\"https://other.example.net/post/1\">foreign</a></h2>"
        "<h2><a href=\"//bulletins{s}.example.org/side/{k}#top\"></a></h2><h2><a href=\"#only\">Frag</a></h2>"
        "<h2><a>no link</a></h2></main></body></html>",
    ),
    V.SL: (
        "https://research.example.com/all/",
        "<html><body><main><h3><a href=\"https://research.example.com/report-{c}/{k}/\"> Report\n {c}</a></h3>"
        "<h3><a href=\" /second/{k} \">Second</a></h3><h3><a href=\"/all/\">Archive</a></h3>"
        "<h3><a href=\"/a/b/{k}/\">Nested</a></h3></main>"
        "<article><h2><a href=\"/third/{c}/?p=1\">Third</a></h2><h3><a href=\"/second/{k}\">Dup</a></h3></article>"
        "</body></html>",
    ),
    V.PP: (
        f"https://{V.PP_HOST}/us/blog/threat-insight",
        "<html><body><main><article><h2><a href=\"/us/blog/threat-insight/brief-{k}\">Brief {k}</a></h2></article>"
        "<article><h3>Nearby {c}</h3><p><a href=\"/us/blog/threat-insight/near-{c}/\"><img src=\"x\"></a></p></article>"
        "<div><span><a href=\"/us/blog/threat-insight/short-{k}\"></a> Short text {k}</span></div>"
        "<a href=\"/us/blog/threat-insight\">Threat Insight</a><a href=\"/us/blog/threat-insight/preview\">Preview</a>"
        "<a href=\"/us/blog/Threat-Insight/UP-{c}\">Up</a></main></body></html>",
    ),
}


def _s1_entry() -> Column:
    def whole(opening: str, closing: str) -> Column:
        framed = _S1_ENTRY.replace("OPEN", opening).replace("CLOSE", closing)
        return _choose(3, [framed.replace(">MD5<h3>", f">{block}<h3>", 1) for block in _S1_MD5])

    return F.when(F.col("k") % 2 == 0, whole('<div class="wide TabContent">', "</div>")).otherwise(whole("", ""))


def entry_html(profile: str) -> Column:
    """The bulletin page of a row of indicators."""
    return {V.S1: _s1_entry, V.SL: lambda: fill(_SL_ENTRY), V.PP: lambda: _choose(3, _PP_ENTRIES)}[profile]()


def entry_pages(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """One bulletin page per order: k, index_title, html."""
    return indicators(spark, sf_dir).select("k", fill("Index title {k}").alias("index_title"), entry_html(profile).alias("html"))


def index_pages(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """One listing page per order: k, source_url, html."""
    url, html = _INDEX[profile]
    return indicators(spark, sf_dir).select("k", fill(url).alias("source_url"), fill(html).alias("html"))


# Indicators each bulletin holds, as (condition on k, kind, value) in page order.
S1_EXPECTED = [
    ("true", "ipv4", "ipv4"),
    ("true", "ipv4", "ipv4_b"),
    ("true", "ipv4_port", "ipv4_port"),
    ("true", "ipv4_port", "'нет данных'"),
    ("true", "domain", "domain"),
    ("true", "domain", "'evil[.]com'"),
    ("true", "tox id", "'TOX' || CAST(c AS STRING)"),
    ("k % 3 <> 0", "md5", "md5"),
    ("k % 3 = 1", "md5", "'not a hash'"),
    ("k % 3 = 2", "md5", "md5_b"),
    ("true", "url", "url_b"),
    ("true", "url", "url"),
]
SL_EXPECTED = [
    ("true", "md5", "md5"),
    ("true", "sha256", "sha256"),
    ("true", "sha1", "sha1"),
    ("true", "domain", "domain_b"),
    ("true", "ipv4", "ipv4"),
    ("true", "url", "url_b"),
    ("true", "md5", "md5_b"),
    ("true", "ipv4", "ipv4_b"),
    ("true", "domain", "domain"),
    ("true", "md5", "md5_c"),
]
PP_EXPECTED = [
    ("k % 3 = 0", "domain", "domain_b"),
    ("k % 3 = 0", "ipv4", "ipv4"),
    ("k % 3 = 0", "sha256", "sha256"),
    ("k % 3 = 0", "filename", "file"),
    ("k % 3 = 0", "md5", "md5"),
    ("k % 3 = 0", "url", "url_b"),
    ("k % 3 = 1", "ipv4", "ipv4_b"),
    ("k % 3 = 1", "domain", "domain"),
    ("k % 3 = 2", "sha256", "sha256"),
    ("k % 3 = 2", "domain", "domain_b"),
    ("k % 3 = 2", "ipv4", "ipv4"),
    ("k % 3 = 2", "url", "url_b"),
    ("k % 3 = 2", "sha1", "sha1"),
    ("k % 3 = 2", "filename", "sha1 || ' ' || file"),
]


def expected_rows_sql(expected: list[tuple[str, str, str]]) -> str:
    """DuckDB subquery (k, ord, kind, value) of what the bulletins hold, repeats dropped and renumbered."""
    raw = "\nUNION ALL\n".join(
        f"SELECT k, {i} AS place, '{kind}' AS kind, {value} AS value FROM indicators WHERE {condition}"
        for i, (condition, kind, value) in enumerate(expected, 1)
    )
    first = f"SELECT k, kind, value, min(place) AS place FROM ({raw}) AS raw GROUP BY k, kind, value"
    return f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY place) AS ord, kind, value FROM ({first}) AS f"


def snapshot_entries(events: DataFrame, hours: int, users: int | None) -> DataFrame:
    """Index entries from events: source is the event type, a snapshot covers some hours."""
    user = F.col("user_id") if users is None else F.col("user_id") % users
    seconds = hours * 3600
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds)
    return events.select(
        F.col("event_type").alias("source_name"),
        bucket.alias("collected_at"),
        F.concat(F.lit("https://example.org/post/"), user.cast("string")).alias("publication_url"),
    )


def event_snapshots(spark: SparkSession, sf_dir: str, hours: int, users: int | None) -> DataFrame:
    return snapshot_entries(table(spark, sf_dir, "events"), hours, users).distinct()


def event_snapshots_sql(hours: int, users: int | None) -> str:
    user = "user_id" if users is None else f"user_id % {users}"
    return (
        "SELECT DISTINCT event_type AS source_name, "
        f"time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01') AS collected_at, "
        f"'https://example.org/post/' || CAST({user} AS STRING) AS publication_url FROM events"
    )
