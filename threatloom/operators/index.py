"""Index pages: publication links of a feed's listing page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.expressions import any_of, compute_once, let
from threatloom.functions.patterns import java_regex
from threatloom.functions.text import normalize_text, strip_space
from threatloom.functions.url import resolve_from, split_url
from threatloom.operators import html as H

INDEX_ENTRY = "struct<ord:int,title:string,publication_url:string>"

_SL_ARTICLE_PATH = java_regex(V.SL_ARTICLE_PATH)
_PP_ARTICLE_PATH = java_regex(V.PP_ARTICLE_PATH, ignore_case=True)


def is_publication_of(url: Column, base: Column, profile: str) -> Column:
    """``is_publication`` with the page's URL already split."""

    def same_site(u: Column, b: Column) -> Column:
        return u["scheme"].isin("http", "https") & (u["netloc"] == b["netloc"])

    def s1(u: Column, b: Column) -> Column:
        skipped = any_of([u["path"].startswith(prefix) for prefix in V.S1_SKIP_PREFIXES])
        return same_site(u, b) & ~u["path"].isin("", "/") & ~skipped

    def sl(u: Column, b: Column) -> Column:
        return same_site(u, b) & ~u["path"].isin(*V.SL_SKIP_PATHS) & u["path"].rlike(_SL_ARTICLE_PATH)

    def pp(u: Column, b: Column) -> Column:
        path = F.rtrim(u["path"], F.lit("/"))
        skipped = any_of([path.endswith(ending) for ending in V.PP_SKIP_ENDINGS])
        return u["scheme"].isin("http", "https") & (u["netloc"] == V.PP_HOST) & path.rlike(_PP_ARTICLE_PATH) & ~skipped

    test = {V.S1: s1, V.SL: sl, V.PP: pp}[profile]
    return F.coalesce(let(split_url(url), lambda u: test(u, base)), F.lit(False))


def is_publication(url: Column, base: Column, profile: str) -> Column:
    """Whether a resolved link of a page at ``base`` is a publication of the feed."""
    return let(split_url(base), lambda b: is_publication_of(url, b, profile))


def title_nearby(elements: Column, texts: Column, anchor: Column) -> Column:
    """Title of a link without text, from its parent, then its nearest article, div or section."""

    def usable(text: Column) -> Column:
        return (text != "") & ~F.lower(text).isin(*V.PP_TITLE_REJECTS)

    def from_element(e: Column) -> Column:
        def first_heading(tag: str) -> Column:
            heading = H.first_or_null(H.descendants(elements, e, (tag,)))
            return let(H.heading_text(texts, heading), lambda t: F.when(usable(t), t))

        own = let(H.heading_text(texts, e), lambda t: F.when(usable(t) & (F.length(t) < V.PP_TITLE_LIMIT), t))
        return F.when(e.isNotNull(), F.coalesce(*[first_heading(tag) for tag in V.PP_TITLE_TAGS], own))

    parent = F.get(elements, anchor["parent"] - 1)
    around = F.filter(
        elements, lambda e: e["tag"].isin("article", "div", "section") & (e["id"] < anchor["id"]) & (e["last"] >= anchor["id"])
    )
    nearest = F.when(F.size(around) > 0, F.element_at(around, -1))
    return F.coalesce(let(parent, from_element), let(nearest, from_element), F.lit(""))


def dedup_first(rows: Column, field: str) -> Column:
    """Rows of an array whose ``field`` was not seen before, order kept."""
    return let(
        F.transform(rows, lambda r: r[field]),
        lambda values: F.filter(rows, lambda r, i: F.array_position(values, r[field]) == i + 1),
    )


def index_links(elements: Column, texts: Column, base: Column, profile: str) -> Column:
    """array<struct<ord,title,publication_url>> of the publications an index page lists, in order."""
    anchors = F.array_distinct(F.concat(*[H.select(elements, s) for s in V.INDEX_SELECTORS[profile]]))

    def title_of(a: Column) -> Column:
        if profile == V.S1:
            return H.node_text(texts, a, " ")
        own = H.heading_text(texts, a)
        if profile == V.SL:
            return own
        return let(own, lambda t: F.when(t != "", t).otherwise(title_nearby(elements, texts, a)))

    def link(a: Column, page: Column) -> Column:
        href = a["href"] if profile == V.S1 else strip_space(a["href"])
        return F.struct(resolve_from(base, page, href).alias("publication_url"), a.alias("anchor"))

    def listed(page: Column) -> Column:
        linked = F.filter(anchors, lambda a: strip_space(a["href"]) != "" if profile != V.S1 else a["href"] != "")
        publications = F.filter(
            F.transform(linked, lambda a: link(a, page)), lambda x: is_publication_of(x["publication_url"], page, profile)
        )
        titled = F.transform(
            publications,
            lambda x: F.struct(title_of(x["anchor"]).alias("title"), x["publication_url"].alias("publication_url")),
        )
        wanted = lambda x: normalize_text(x["title"]) != ""
        if profile == V.S1:
            wanted = lambda x: (normalize_text(x["title"]) != "") & ~x["title"].isin(*V.S1_IGNORED_TITLES)
        unique = let(F.filter(titled, wanted), lambda rows: dedup_first(rows, "publication_url"))
        return F.transform(
            unique,
            lambda x, i: F.struct(
                (i + 1).cast("int").alias("ord"), x["title"].alias("title"), x["publication_url"].alias("publication_url")
            ),
        )

    return let(split_url(base), listed)


def by_profile(make, profile: Column, profiles: tuple[str, ...] = (V.S1, V.SL, V.PP)) -> Column:
    """Choose between the profiles' expressions row by row."""
    chain = None
    for name in profiles:
        chain = F.when(profile == name, make(name)) if chain is None else chain.when(profile == name, make(name))
    return chain


def read_index_pages(pages: DataFrame, profile: str | None = None) -> DataFrame:
    """Add ``links`` to pages with ``source_url`` and ``html``; the profile is fixed or read from ``profile``."""
    parsed = H.parse_html(pages, "html")
    elements, texts, base = F.col("elements"), F.col("texts"), F.col("source_url")
    if profile is not None:
        links = index_links(elements, texts, base, profile)
    else:
        links = by_profile(lambda name: index_links(elements, texts, base, name), F.col("profile"))
    return compute_once(parsed, links=links).drop("elements", "texts")


def index_entries(pages: DataFrame, profile: str | None = None) -> DataFrame:
    """One row per listed publication, page columns kept."""
    read = read_index_pages(pages, profile)
    kept = [c for c in read.columns if c not in ("links", "html_error")]
    return read.select(*kept, F.inline("links"))


def index_failures(read: DataFrame) -> DataFrame:
    """Index pages without a single publication are errors of their source."""
    return read.filter(F.size("links") == 0).withColumn("error", F.coalesce("html_error", F.lit("no index entries")))
