"""H-01..H-18: HTML pages, index links and entry text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions import url as U
from threatloom.operators import entry as E
from threatloom.operators import html as H
from threatloom.operators import index as X
from threatloom.queries import corpora as C
from threatloom.queries import sql as Q
from threatloom.queries.catalog import query
from threatloom.sources import snapshots as S

def _elements() -> Column:
    return F.col("elements")


def _texts() -> Column:
    return F.col("texts")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.parse_html(C.wide_table(spark, sf_dir, "pages"), "html")


def _with(ctes: str, select: str) -> str:
    return f"WITH indicators AS ({C.INDICATORS_SQL}){ctes} {select}"


@query(
    "h_01_html_nodes",
    "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, "
    "'<script>.*?</script>', '<script>', 'g'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY page_id, tag",
)
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = H.html_nodes(C.wide_table(spark, sf_dir, "pages"), "page_id", "html")
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h_02_select",
    "SELECT page_id, generate_subscripts(hrefs, 1) AS ord, unnest(hrefs) AS href FROM (SELECT page_id, "
    "regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages)",
)
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.posexplode(F.transform(H.select(_elements(), "nav ul a[href]"), lambda e: e["href"])).alias("pos", "href")
    return _pages(spark, sf_dir).select("page_id", hits).select("page_id", (F.col("pos") + 1).alias("ord"), "href")


def _page_text_sql(inner: str) -> str:
    """Text of markup as the page reader sees it: strings between tags, trimmed, joined by one blank."""
    text = f"regexp_replace({inner}, '<[^>]*>', chr(1), 'g')"
    for entity, character in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    pieces = f"list_transform(string_split({text}, chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))"
    return f"array_to_string(list_filter({pieces}, lambda x: x <> ''), ' ')"


@query(
    "h_03_node_text",
    "SELECT page_id, md5(text) AS digest, length(text) AS chars FROM (SELECT page_id, "
    + _page_text_sql("regexp_extract(html, '<article>(.*)</article>', 1, 's')")
    + " AS text FROM pages)",
)
def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = H.node_text(_texts(), H.first_or_null(H.select(_elements(), "article")), " ")
    return _pages(spark, sf_dir).select("page_id", text.alias("text")).select(
        "page_id", F.md5("text").alias("digest"), F.length("text").alias("chars")
    )


def _index_query(key: str, profile: str, expected: list[tuple[str, str, str]]) -> None:
    rows = " UNION ALL ".join(
        f"SELECT k, {i} AS ord, {title} AS title, {link} AS publication_url FROM indicators"
        for i, (title, link) in enumerate(expected, 1)
    )

    @query(key, _with("", rows))
    def links(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.index_entries(C.index_pages(spark, sf_dir, profile), profile).select("k", "ord", "title", "publication_url")


_SITE = "'https://bulletins' || CAST(s AS STRING) || '.example.org"
_index_query(
    "h_06_index_links_s1",
    V.S1,
    [
        ("'Post ' || CAST(k AS STRING)", f"{_SITE}/post/' || CAST(k AS STRING)"),
        ("'Post next'", f"{_SITE}/post/' || CAST(k1 AS STRING) || '?x=1'"),
        ("'Deep  ' || CAST(c AS STRING)", f"{_SITE}/deep/' || CAST(c AS STRING) || '/'"),
        ("'Frag'", f"{_SITE}/ioc/#only'"),
    ],
)
_index_query(
    "h_07_index_links_sl",
    V.SL,
    [
        (
            "'Report ' || CAST(c AS STRING)",
            "'https://research.example.com/report-' || CAST(c AS STRING) || '/' || CAST(k AS STRING) || '/'",
        ),
        ("'Second'", "'https://research.example.com/second/' || CAST(k AS STRING)"),
        ("'Third'", "'https://research.example.com/third/' || CAST(c AS STRING) || '/?p=1'"),
    ],
)
_BLOG = f"'https://{V.PP_HOST}/us/blog/"
_index_query(
    "h_08_index_links_pp",
    V.PP,
    [
        ("'Brief ' || CAST(k AS STRING)", f"{_BLOG}threat-insight/brief-' || CAST(k AS STRING)"),
        ("'Nearby ' || CAST(c AS STRING)", f"{_BLOG}threat-insight/near-' || CAST(c AS STRING) || '/'"),
        ("'Short text ' || CAST(k AS STRING)", f"{_BLOG}threat-insight/short-' || CAST(k AS STRING)"),
        ("'Up'", f"{_BLOG}Threat-Insight/UP-' || CAST(c AS STRING)"),
    ],
)


@query(
    "h_09_resolve_url",
    "SELECT page_id, ord, regexp_extract(url, '^https?://[^/]+') || href AS link FROM (SELECT page_id, url, "
    "generate_subscripts(hrefs, 1) AS ord, unnest(hrefs) AS href FROM (SELECT page_id, url, "
    "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages))",
)
def resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.posexplode(F.transform(H.select(_elements(), "a[href]"), lambda e: e["href"])).alias("pos", "href")
    hrefs = _pages(spark, sf_dir).select("page_id", "url", links)
    return hrefs.select("page_id", (F.col("pos") + 1).alias("ord"), U.resolve_url(F.col("url"), F.col("href")).alias("link"))


# Links of every page against its own site, the way the three feeds judge theirs.
_LINKS = (
    "SELECT DISTINCT 'https://x' || CAST(s AS STRING) || '.example.org/ioc/' AS base, unnest(["
    "'https://x' || CAST(s AS STRING) || '.example.org/post/' || CAST(k AS STRING), "
    "'https://x' || CAST(s AS STRING) || '.example.org/page/' || CAST(k AS STRING), "
    "'https://x' || CAST(s AS STRING) || '.example.org/', 'https://x' || CAST(s AS STRING) || '.example.org', "
    "'http://other.example.org/post/' || CAST(k AS STRING), 'ftp://x' || CAST(s AS STRING) || '.example.org/a/1', "
    "'https://x' || CAST(s AS STRING) || '.example.org/slug-' || CAST(c AS STRING) || '/' || CAST(k AS STRING) || '/', "
    "'https://x' || CAST(s AS STRING) || '.example.org/slug/' || CAST(k AS STRING) || '?q=/x/1', "
    "'https://x' || CAST(s AS STRING) || '.example.org/tags/', "
    f"'https://{V.PP_HOST}/us/blog/threat-insight/a-' || CAST(k AS STRING) || '//', "
    f"'http://{V.PP_HOST}/US/blog/threat-insight/B' || CAST(c AS STRING) || '?page=2', "
    f"'https://{V.PP_HOST}/us/blog/threat-insight', 'https://{V.PP_HOST}/us/blog/threat-insight/preview/', "
    f"'https://{V.PP_HOST}/us/blog/other/' || CAST(k AS STRING), "
    f"'https://{V.PP_HOST}:443/us/blog/threat-insight/c-' || CAST(k AS STRING)"
    "]) AS link FROM indicators"
)
_PATH = "regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_SAME_SITE = (
    "regexp_extract(link, '^([a-z]+)://', 1) IN ('http', 'https') AND "
    "regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(base, '^[a-z]+://([^/?#]*)', 1)"
)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    expression = _LINKS.removeprefix("SELECT DISTINCT ").removesuffix(" FROM indicators")
    base, links = expression.split(" AS base, unnest([")
    listed = F.expr(f"array({links.removesuffix(']) AS link')})")
    rows = C.indicators(spark, sf_dir).select(F.expr(base).alias("base"), F.explode(listed).alias("link"))
    return rows.distinct()


def _publication_query(key: str, profile: str, condition: str) -> None:
    @query(key, _with("", f"SELECT base, link FROM ({_LINKS}) AS l WHERE {condition}"))
    def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _links(spark, sf_dir).filter(X.is_publication(F.col("link"), F.col("base"), profile))


_publication_query(
    "h_10a_publication_s1",
    V.S1,
    f"{_SAME_SITE} AND {_PATH} NOT IN ('', '/') AND NOT ("
    + " OR ".join(f"starts_with({_PATH}, '{prefix}')" for prefix in V.S1_SKIP_PREFIXES)
    + ")",
)
_publication_query(
    "h_10b_publication_sl",
    V.SL,
    f"{_SAME_SITE} AND {_PATH} NOT IN ({', '.join(Q.lit(p) for p in V.SL_SKIP_PATHS)}) "
    f"AND regexp_matches({_PATH}, {Q.lit(V.SL_ARTICLE_PATH)})",
)
_publication_query(
    "h_10c_publication_pp",
    V.PP,
    f"regexp_extract(link, '^([a-z]+)://', 1) IN ('http', 'https') AND "
    f"regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) = '{V.PP_HOST}' "
    f"AND regexp_matches(rtrim({_PATH}, '/'), {Q.lit('(?i)' + V.PP_ARTICLE_PATH)}) AND NOT ("
    + " OR ".join(f"ends_with(rtrim({_PATH}, '/'), {Q.lit(e)})" for e in V.PP_SKIP_ENDINGS)
    + ")",
)


@query(
    "h_11_title_nearby",
    _with(
        "",
        "SELECT k, 1 AS ord, 'Brief ' || CAST(k AS STRING) AS title FROM indicators UNION ALL "
        "SELECT k, 2, 'Nearby ' || CAST(c AS STRING) FROM indicators UNION ALL "
        "SELECT k, 3, 'Short text ' || CAST(k AS STRING) FROM indicators UNION ALL "
        "SELECT k, 6, 'Brief ' || CAST(k AS STRING) FROM indicators UNION ALL "
        "SELECT k, 4, 'Brief ' || CAST(k AS STRING) FROM indicators UNION ALL "
        "SELECT k, 5, 'Brief ' || CAST(k AS STRING) FROM indicators",
    ),
)
def title_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title each link of a listing page would get from its surroundings alone."""
    pages = H.parse_html(C.index_pages(spark, sf_dir, V.PP), "html")
    titles = F.transform(H.select(_elements(), "a[href]"), lambda a: X.title_nearby(_elements(), _texts(), a))
    found = pages.select("k", F.posexplode(titles).alias("pos", "title"))
    return found.select("k", (F.col("pos") + 1).alias("ord"), "title")


@query(
    "h_12_dedup_first",
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS ord, href FROM (SELECT page_id, href, "
    "min(place) AS place FROM (SELECT page_id, generate_subscripts(hrefs, 1) AS place, unnest(hrefs) AS href "
    "FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages)) GROUP BY page_id, href)",
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page, each listed twice."""
    links = H.select(_elements(), "a[href]")
    rows = F.transform(F.concat(links, links), lambda e: F.struct(e["href"].alias("href")))
    found = _pages(spark, sf_dir).select("page_id", F.posexplode(X.dedup_first(rows, "href")).alias("pos", "r"))
    return found.select("page_id", (F.col("pos") + 1).alias("ord"), "r.href")


@query(
    "h_13_index_quality",
    "SELECT page_id, 'no index entries' AS error FROM pages WHERE NOT regexp_matches(html, '<a href=\"/[^\"]*[ßéèü]')",
)
def index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that list nothing, counting only links with certain letters."""
    pages = _pages(spark, sf_dir)
    links = F.filter(H.select(_elements(), "a[href]"), lambda a: a["href"].rlike("^/.*[ßéèü]"))
    return X.index_failures(pages.withColumn("links", links)).select("page_id", "error")


def _container_query(key: str, profile: str, sql: str) -> None:
    @query(key, sql)
    def container(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = H.parse_html(C.entry_pages(spark, sf_dir, profile), "html")
        found = pages.select("k", E.entry_container(_elements(), _texts(), profile).alias("e"))
        return found.select("k", "e.tag", F.btrim("e.classes").alias("classes"))


_container_query("h_14_container_s1", V.S1, _with("", "SELECT k, 'div' AS tag, 'entry-content' AS classes FROM indicators"))
_container_query(
    "h_15_container_sl", V.SL, _with("", "SELECT k, 'div' AS tag, 'post-content wide' AS classes FROM indicators")
)
_container_query(
    "h_15_container_pp",
    V.PP,
    _with("", "SELECT k, 'article' AS tag, CASE WHEN k % 3 = 1 THEN 'node' END AS classes FROM indicators"),
)


@query(
    "h_16_entry_title",
    "SELECT page_id, coalesce(nullif(" + Q.normalize(_page_text_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))
    + ", ''), 'Index title') AS title FROM pages",
)
def entry_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    container = E.entry_container(_elements(), _texts(), V.SL)
    pages = _pages(spark, sf_dir).withColumn("container", container)
    return pages.select(
        "page_id", E.entry_title(_elements(), _texts(), F.col("container"), F.lit("Index title")).alias("title")
    )


_CONTENT = (
    "array_to_string(list_filter(list_transform(string_split(replace(replace("
    + _page_text_sql("regexp_extract(html, '<article>(.*)</article>', 1, 's')").removesuffix(", ' ')")
    + ", chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), "
    f"lambda x: {Q.normalize('x')}), lambda x: x <> ''), chr(10))"
)


@query(
    "h_17_entry_content",
    f"SELECT page_id, md5(content) AS digest, length(content) AS chars FROM (SELECT page_id, {_CONTENT} AS content FROM pages)",
)
def entry_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    container = E.entry_container(_elements(), _texts(), V.SL)
    content = _pages(spark, sf_dir).withColumn("container", container).select(
        "page_id", E.entry_content(_texts(), F.col("container")).alias("content")
    )
    return content.select("page_id", F.md5("content").alias("digest"), F.length("content").alias("chars"))


@query(
    "h_18_entry_kind",
    "SELECT page_id, url FROM pages WHERE page_id % 3 <> 0",
)
def entry_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "index").otherwise("entry")
    pages = C.table(spark, sf_dir, "pages").withColumn("snapshot_kind", kind)
    return S.only_kind(pages, "entry").select("page_id", "url")
