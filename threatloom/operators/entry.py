"""Entry pages: title, content and indicator sections of one publication.

Every step works on the element array of the page's own row, so a page is read without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.expressions import any_of, compute_once, empty_array, let
from threatloom.functions.ioc import dedup_iocs, extract_by_hint, is_protected, kind_hint, number_iocs, typed_values
from threatloom.functions.patterns import java_regex
from threatloom.functions.text import clean_lines, fold_case, normalize_heading, normalize_text, value_lines
from threatloom.operators import html as H
from threatloom.operators.index import by_profile

_IOC = "struct<kind:string,value:string>"


# ---------------------------------------------------------------- container, title, content


def is_section_title(text: Column, profile: str) -> Column:
    if profile == V.S1:
        return fold_case(normalize_text(text)) == V.S1_SECTION_TITLE
    return normalize_heading(text).rlike(java_regex(V.SECTION_PATTERNS[profile], ignore_case=True))


def ioc_heading(elements: Column, texts: Column, container: Column, profile: str) -> Column:
    """First heading inside the container that opens the indicator section."""
    headings = H.descendants(elements, container, V.SECTION_HEADING_TAGS[profile])
    return H.first_or_null(F.filter(headings, lambda e: is_section_title(H.node_text(texts, e, " "), profile)))


def _first_with_text(texts: Column, candidates: list[Column]) -> Column:
    return F.coalesce(
        *[let(c, lambda e: F.when(H.heading_text(texts, e) != "", e)) for c in candidates]
    )


def entry_article(elements: Column) -> Column:
    """Profile S1 needs an article; one inside main is preferred."""
    return F.coalesce(*[H.first_or_null(H.select(elements, s)) for s in V.S1_ARTICLE_SELECTORS])


def entry_container(elements: Column, texts: Column, profile: str) -> Column:
    """Element holding the publication's content, null when there is none."""
    selectors = V.CONTAINER_SELECTORS[profile]
    if profile != V.S1:
        return _first_with_text(texts, [H.first_or_null(H.select(elements, s)) for s in selectors])

    def inside_article(article: Column) -> Column:
        candidates = [H.first_or_null(H.select_within(elements, article, s)) for s in selectors]

        # Tried one after the other, and the search for a section only where the article holds one.
        sectioned = F.coalesce(
            *[let(c, lambda e: F.when(ioc_heading(elements, texts, e, V.S1).isNotNull(), e)) for c in candidates]
        )
        has_section = ioc_heading(elements, texts, article, V.S1).isNotNull()
        found = F.coalesce(F.when(has_section, sectioned), _first_with_text(texts, candidates), article)
        return F.when(article.isNotNull(), found)

    return let(entry_article(elements), inside_article)


def entry_title(elements: Column, texts: Column, scope: Column, index_title: Column) -> Column:
    """First h1 of the container (S1: of the article), or else the title on the index page."""
    heading = H.first_or_null(H.descendants(elements, scope, ("h1",)))
    return let(H.heading_text(texts, heading), lambda t: F.when(t != "", t).otherwise(index_title))


def entry_content(texts: Column, container: Column) -> Column:
    """Cleaned lines of the container's text."""
    return clean_lines(H.node_text(texts, container, "\n"))


# ---------------------------------------------------------------- section blocks


def section_blocks(elements: Column, texts: Column, heading: Column, profile: str) -> Column:
    """Elements of the indicator section, in order."""
    siblings = H.following_siblings(elements, heading)
    if profile != V.S1:

        def until_stop(found: Column) -> Column:
            stop = H.first_or_null(F.filter(found, lambda e: e["tag"].isin(*V.SECTION_STOP_TAGS)))
            return let(stop["id"], lambda end: F.filter(found, lambda e: end.isNull() | (e["id"] < end)))

        return let(siblings, until_stop)

    def blocks(found: Column) -> Column:
        def choose(first: Column) -> Column:
            is_tab = (
                (first["tag"] == "div")
                & ~first["text_before"]
                & F.contains(fold_case(first["classes"]), F.lit(f" {V.S1_TAB_CLASS} "))
            )
            return F.when(F.coalesce(is_tab, F.lit(False)), H.children(elements, first)).otherwise(found)

        def until_stop(section: Column) -> Column:
            # A repeated section title at the same level neither ends the section nor names a kind.
            outer = F.filter(
                section,
                lambda e: e["tag"].isin(*V.BLOCK_HEADING_TAGS[V.S1]) & (heading_level(e) <= heading_level(heading)),
            )
            stop = H.first_or_null(
                F.filter(outer, lambda e: ~is_section_title(H.node_text(texts, e, " "), V.S1))
            )
            return let(
                F.struct(outer.alias("outer"), stop["id"].alias("end")),
                lambda x: F.filter(
                    section,
                    lambda e: (x["end"].isNull() | (e["id"] < x["end"]))
                    & ~F.exists(x["outer"], lambda o: o["id"] == e["id"]),
                ),
            )

        return let(let(H.first_or_null(found), choose), until_stop)

    return let(siblings, blocks)


def heading_level(e: Column) -> Column:
    return F.substring(e["tag"], 2, 1).cast("int")


def carry_hint(blocks: Column, texts: Column, profile: str) -> Column:
    """Pair each block that is not a heading with the kind set by the last heading before it.

    array<struct<block,hint>>; a heading that names no kind resets the hint to null.
    """
    heading_tags = V.BLOCK_HEADING_TAGS[profile]

    def paired(headings: Column) -> Column:
        def hint_of(b: Column) -> Column:
            before = F.filter(headings, lambda h: h["id"] < b["id"])
            return F.get(before, F.size(before) - 1)["kind"]

        return F.transform(
            F.filter(blocks, lambda b: ~b["tag"].isin(*heading_tags)),
            lambda b: F.struct(b.alias("block"), hint_of(b).alias("hint")),
        )

    headings = F.transform(
        F.filter(blocks, lambda b: b["tag"].isin(*heading_tags)),
        lambda h: F.struct(h["id"].alias("id"), kind_hint(H.node_text(texts, h, " "), profile).alias("kind")),
    )
    return let(headings, paired)


# ---------------------------------------------------------------- candidate texts

_TEXT = "struct<text:string,hint:string>"


def _texts_of(texts: Column, found: Column, hint: Column, separator: str = " ") -> Column:
    return F.transform(
        found, lambda e: F.struct(H.node_text(texts, e, separator).alias("text"), hint.alias("hint"))
    )


def candidate_texts_s1(elements: Column, texts: Column, block: Column) -> Column:
    """Texts of one S1 block that may hold values, protected ones left out."""

    def nested(tags: tuple[str, ...]) -> Column:
        chain = None
        for tag in tags:
            found = H.descendants(elements, block, (tag,))
            values = F.transform(found, lambda e: H.heading_text(texts, e))
            chain = F.when(F.size(found) > 0, values) if chain is None else chain.when(F.size(found) > 0, values)
        # Normalising removes line breaks, so what is left is a single line.
        return chain.otherwise(value_lines(normalize_text(H.node_text(texts, block, "\n"))))

    values = (
        F.when(
            block["tag"].isin("ul", "ol"),
            F.transform(H.children(elements, block, ("li",)), lambda e: H.heading_text(texts, e)),
        )
        .when(block["tag"].isin("pre", "code"), value_lines(H.node_text(texts, block, "\n")))
        .otherwise(nested(V.S1_NESTED_TEXT_TAGS))
    )
    shown = F.filter(values, lambda t: (t != "") & ~is_protected(t))
    return F.when(is_protected(H.node_text(texts, block, " ")), empty_array("string")).otherwise(shown)


def candidate_texts(elements: Column, texts: Column, block: Column, hint: Column, profile: str) -> Column:
    """Texts of one SL or PP block with the hint that applies to each, array<struct<text,hint>>."""

    def prose_hint() -> Column:
        own = kind_hint(H.node_text(texts, block, " "), profile)
        return F.coalesce(own, hint) if profile == V.SL else F.coalesce(hint, own)

    whole = F.array(block)
    return (
        F.when(block["tag"] == "table", table_texts(elements, texts, block, profile))
        .when(block["tag"].isin("ul", "ol"), _texts_of(texts, H.descendants(elements, block, ("li",)), hint))
        .when(block["tag"].isin("pre", "code"), _texts_of(texts, whole, hint, "\n"))
        .when(block["tag"].isin(*V.PROSE_TAGS), _texts_of(texts, whole, prose_hint(), "\n"))
        .otherwise(empty_array(_TEXT))
    )


def table_texts(elements: Column, texts: Column, table: Column, profile: str) -> Column:
    """Cell texts of a table with their hints: by header column (SL) or by row (PP)."""
    rows = F.transform(
        H.descendants(elements, table, ("tr",)),
        lambda row: F.transform(H.descendants(elements, row, ("th", "td")), lambda c: H.node_text(texts, c, " ")),
    )

    def cell(text: Column, hint: Column) -> Column:
        return F.struct(text.alias("text"), hint.cast("string").alias("hint"))

    def by_column(all_rows: Column) -> Column:
        def typed(kinds: Column) -> Column:
            body = F.slice(all_rows, 2, F.greatest(F.size(all_rows) - 1, F.lit(0)))
            hinted = F.transform(body, lambda row: F.transform(row, lambda t, i: cell(t, F.get(kinds, i))))
            plain = F.transform(all_rows, lambda row: F.transform(row, lambda t: cell(t, F.lit(None))))
            return F.flatten(F.when(F.exists(kinds, lambda k: k.isNotNull()), hinted).otherwise(plain))

        header = F.get(all_rows, F.lit(0))
        kinds = F.transform(F.coalesce(header, empty_array("string")), lambda t: kind_hint(t, profile))
        return let(kinds, typed)

    def by_row(all_rows: Column) -> Column:
        def typed(row: Column) -> Column:
            kinds = F.array_compact(F.transform(row, lambda t: kind_hint(t, profile)))
            return let(
                H.first_or_null(kinds),
                lambda hint: F.transform(
                    F.when(hint.isNotNull() & (F.size(row) >= 2), F.slice(row, 1, 1)).otherwise(row),
                    lambda t: cell(t, hint),
                ),
            )

        return F.flatten(F.transform(all_rows, typed))

    return let(rows, by_column if profile == V.SL else by_row)


def looks_like_ioc_table(elements: Column, texts: Column, table: Column) -> Column:
    """A table whose first cells name an indicator column and a context column."""
    cells = F.slice(H.descendants(elements, table, ("th", "td")), 1, V.PP_TABLE_HEADER_CELLS)
    named = F.filter(F.transform(cells, lambda c: normalize_heading(H.node_text(texts, c, " "))), lambda t: t != "")
    return let(
        F.array_join(named, " | "),
        lambda blob: F.contains(blob, F.lit(V.PP_TABLE_INDICATOR))
        & any_of([F.contains(blob, F.lit(word)) for word in V.PP_TABLE_CONTEXT]),
    )


def ioc_tables(elements: Column, texts: Column, container: Column) -> Column:
    return F.filter(
        H.descendants(elements, container, ("table",)), lambda t: looks_like_ioc_table(elements, texts, t)
    )


# ---------------------------------------------------------------- indicators


def _block_iocs_s1(elements: Column, texts: Column, block: Column, kind: Column) -> Column:
    def from_text(text: Column) -> Column:
        def or_raw(values: Column) -> Column:
            keep_raw = (F.size(values) == 0) & block["tag"].isin("ul", "ol", "pre", "code")
            return F.when(keep_raw, F.array(text)).otherwise(values)

        return let(typed_values(text, kind), or_raw)

    values = F.flatten(F.transform(candidate_texts_s1(elements, texts, block), from_text))
    return F.transform(values, lambda v: F.struct(kind.alias("kind"), v.alias("value")))


def _hinted_blocks(elements: Column, texts: Column, container: Column, profile: str) -> Column:
    def of_heading(heading: Column) -> Column:
        in_section = section_blocks(elements, texts, heading, profile)
        if profile == V.PP:
            blocks = F.when(heading.isNotNull(), in_section).otherwise(ioc_tables(elements, texts, container))
        else:
            blocks = F.when(heading.isNotNull(), in_section).otherwise(empty_array(H.ELEMENT))
        return let(blocks, lambda found: carry_hint(found, texts, profile))

    return let(ioc_heading(elements, texts, container, profile), of_heading)


def entry_iocs(elements: Column, texts: Column, container: Column, profile: str) -> Column:
    """Distinct indicators of the section, array<struct<ord,kind,value>> in page order."""
    paired = _hinted_blocks(elements, texts, container, profile)
    if profile == V.S1:
        known = F.filter(paired, lambda p: p["hint"] != "")
        found = F.transform(known, lambda p: _block_iocs_s1(elements, texts, p["block"], p["hint"]))
    else:
        candidates = F.flatten(
            F.transform(paired, lambda p: candidate_texts(elements, texts, p["block"], p["hint"], profile))
        )
        found = F.transform(candidates, lambda t: extract_by_hint(t["text"], t["hint"], profile))
    return number_iocs(dedup_iocs(F.coalesce(F.flatten(found), empty_array(_IOC))))


def entry_fields(elements: Column, texts: Column, index_title: Column, profile: str) -> Column:
    """struct<title,content,iocs>, null when the page has no container or no content."""

    def of_container(container: Column) -> Column:
        scope = entry_article(elements) if profile == V.S1 else container
        fields = F.struct(
            entry_title(elements, texts, scope, index_title).alias("title"),
            entry_content(texts, container).alias("content"),
            entry_iocs(elements, texts, container, profile).alias("iocs"),
        )
        return F.when(container.isNotNull(), let(fields, lambda f: F.when(f["content"] != "", f)))

    return let(entry_container(elements, texts, profile), of_container)


def parse_entries(pages: DataFrame, profile: str | None = None) -> DataFrame:
    """Read entry pages (``html``, ``index_title``): adds title, content, iocs and error.

    A page that cannot be read keeps its row with an error instead of failing the job.
    """
    parsed = H.parse_html(pages, "html")
    elements, texts, title = F.col("elements"), F.col("texts"), F.col("index_title")
    if profile is not None:
        fields = entry_fields(elements, texts, title, profile)
    else:
        fields = by_profile(lambda name: entry_fields(elements, texts, title, name), F.col("profile"))
    kept = [c for c in pages.columns if c not in ("html", "index_title")]
    read = compute_once(parsed, entry=fields)
    error = F.coalesce("html_error", F.when(F.col("entry").isNull(), F.lit("no content found")))
    return read.select(*kept, "entry.title", "entry.content", "entry.iocs", error.alias("error"))
