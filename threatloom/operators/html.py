"""HTML pages as element arrays, CSS selection and element text.

A page becomes one row with two arrays: ``elements`` in document order and the visible ``texts``.
An element knows the last element of its subtree and its slice of ``texts``, so selecting, nesting
tests and text collection are array expressions inside the row. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.expressions import let
from threatloom.functions.text import normalize_text
from threatloom.session import ship_package

# id and last: preorder number of the element and of the last element inside it; parent 0 is the page.
# first_text and text_count: its slice of ``texts`` (1-based). text_before: visible or hidden text stands
# between it and the element before it under the same parent. classes: names padded with blanks.
ELEMENT = (
    "struct<id:int,last:int,parent:int,tag:string,classes:string,href:string,"
    "first_text:int,text_count:int,text_before:boolean>"
)
NODE_COLUMNS = f"elements array<{ELEMENT}>, texts array<string>, html_error string"

_ELEMENT_TYPE = pa.struct(
    [
        ("id", pa.int32()),
        ("last", pa.int32()),
        ("parent", pa.int32()),
        ("tag", pa.string()),
        ("classes", pa.string()),
        ("href", pa.string()),
        ("first_text", pa.int32()),
        ("text_count", pa.int32()),
        ("text_before", pa.bool_()),
    ]
)
_ROWS_PER_BATCH = 64
# Markup HTMLParser can read in one way only: text, complete tags with quoted attributes, complete references, a document type.
_PLAIN = re.compile(
    r'([^<&]+)|<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>&]*")*)>|</([a-z][a-z0-9]*)>|&([a-zA-Z][a-zA-Z0-9]*);'
    r"|&#([0-9]+|[xX][0-9a-fA-F]+);|<!((?i:doctype)[^<>]*)>"
)
_PLAIN_ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
_NOT_PLAIN = {*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"}


class _TreeReader(HTMLParser):
    """Feeds on one page and fills flat element columns.

    An end tag closes up to the nearest open element of its name and is ignored when there is none;
    nothing else closes an element, except that void elements close at once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows: list[list] = []
        self.texts: list[str] = []
        self.open: list[int] = []  # row numbers of open elements
        self.open_count: dict[str, int] = {}
        self.hidden = 0
        self.pending: list[str] = []
        self.text_since: set[int] = set()  # parents (row number, -1 for the page) with text after their last child
        self.just_voided: list[str] = []

    def _flush(self) -> None:
        if self.pending:
            text = "".join(self.pending).strip()
            self.pending = []
            if text:
                self._note_text()
                if not self.hidden:
                    self.texts.append(text)

    def _note_text(self) -> None:
        self.text_since.add(self.open[-1] if self.open else -1)

    def _close_top(self) -> None:
        row = self.rows[self.open.pop()]
        row[1] = len(self.rows)
        row[7] = len(self.texts) - row[6] + 1
        self.open_count[row[3]] -= 1
        if row[3] in V.HIDDEN_TEXT_TAGS:
            self.hidden -= 1

    def _open(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        values = {name: value or "" for name, value in attrs}
        classes = values.get("class")
        parent = self.open[-1] if self.open else -1
        self.open.append(len(self.rows))
        self.rows.append(
            [
                len(self.rows) + 1,
                0,
                parent + 1,
                tag,
                None if classes is None else f" {' '.join(classes.split())} ",
                values.get("href"),
                len(self.texts) + 1,
                0,
                parent in self.text_since,
            ]
        )
        self.text_since.discard(parent)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in V.HIDDEN_TEXT_TAGS:
            self.hidden += 1

    def _close(self, tag: str) -> None:
        self._flush()
        if self.open_count.get(tag):
            while self.rows[self.open[-1]][3] != tag:
                self._close_top()
            self._close_top()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open(tag, attrs)
        if tag in V.VOID_TAGS:
            self._close(tag)
            self.just_voided.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open(tag, attrs)
        self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.just_voided:
            self.just_voided.remove(tag)
        else:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_entityref(self, name: str) -> None:
        self.pending.append(html5.get(f"{name};", f"&{name}"))

    def handle_charref(self, name: str) -> None:
        try:
            number = int(name[1:], 16) if name[:1] in "xX" else int(name)
            if number < 256:
                self.pending.append(bytes([number]).decode("windows-1252"))
            else:
                self.pending.append(chr(number))
        except (UnicodeDecodeError, ValueError, OverflowError):
            self.pending.append("\N{REPLACEMENT CHARACTER}")

    def _hidden_string(self, data: str) -> None:
        self._flush()
        if data.strip():
            self._note_text()

    handle_comment = handle_decl = handle_pi = _hidden_string

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()
        else:
            self._hidden_string(data)

    def read_plain(self, page: str) -> int:
        """Read plain markup from the start of a page; the place of the first other markup, from which ``feed`` goes on."""
        at = 0
        for token in _PLAIN.finditer(page):
            if token.start() != at:
                break
            kind = token.lastindex
            if kind == 1:
                self.pending.append(token[1])
            elif kind == 3:
                tag, attributes = token[2], token[3]
                if tag in _NOT_PLAIN:
                    break
                self.handle_starttag(tag, _PLAIN_ATTRIBUTE.findall(attributes) if attributes else [])
            elif kind == 4:
                self.handle_endtag(token[4])
            elif kind == 5:
                self.handle_entityref(token[5])
            elif kind == 6:
                self.handle_charref(token[6])
            else:
                self.handle_decl(token[7])
            at = token.end()
        return at

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._close_top()


def _read_page(html: str | None) -> tuple[list[list], list[str], str | None]:
    reader = _TreeReader()
    try:
        page = html or ""
        reader.feed(page[reader.read_plain(page) :])
        reader.finish()
    except Exception as error:  # a broken page must not fail the task
        return [], [], f"{type(error).__name__}: {error}"
    return reader.rows, reader.texts, None


def _list_array(lengths: list[int], values: pa.Array) -> pa.Array:
    offsets = [0]
    for length in lengths:
        offsets.append(offsets[-1] + length)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _page_columns(pages: list[str | None]) -> list[pa.Array]:
    read = [_read_page(page) for page in pages]
    rows = [row for page_rows, _, _ in read for row in page_rows]
    columns = list(zip(*rows)) if rows else [()] * len(_ELEMENT_TYPE)
    fields = [pa.array(column, field.type) for column, field in zip(columns, _ELEMENT_TYPE)]
    elements = _list_array(
        [len(page_rows) for page_rows, _, _ in read], pa.StructArray.from_arrays(fields, fields=list(_ELEMENT_TYPE))
    )
    texts = _list_array(
        [len(texts) for _, texts, _ in read], pa.array([t for _, texts, _ in read for t in texts], pa.string())
    )
    return [elements, texts, pa.array([error for _, _, error in read], pa.string())]


def parse_html(df: DataFrame, html: str, drop_html: bool = True) -> DataFrame:
    """Add ``elements``, ``texts`` and ``html_error``; the page text itself is dropped by default."""
    carried = [c for c in df.columns if c != html or not drop_html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in carried)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS_PER_BATCH):
                part = batch.slice(start, _ROWS_PER_BATCH)
                kept = [part.column(name) for name in carried]
                yield pa.RecordBatch.from_arrays(
                    kept + _page_columns(part.column(html).to_pylist()), [*carried, "elements", "texts", "html_error"]
                )

    ship_package(df.sparkSession)
    return df.mapInArrow(parse, f"{schema}, {NODE_COLUMNS}")


# ---------------------------------------------------------------- selection


def _matches(compound: str, e: Column) -> Column:
    """One step of a selector: tag, ``.class``, ``[attr]``, ``[class*='x']``."""
    tag = re.match(r"[a-z0-9]*", compound).group()
    conditions = [e["tag"] == tag] if tag else []
    conditions += [F.contains(e["classes"], F.lit(f" {name} ")) for name in re.findall(r"\.([\w-]+)", compound)]
    conditions += [e[name].isNotNull() for name in re.findall(r"\[(\w+)\]", compound)]
    conditions += [
        F.contains(F.btrim(e["classes"]), F.lit(piece)) for piece in re.findall(r"\[class\*='([^']*)'\]", compound)
    ]
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return F.coalesce(result, F.lit(False))


def inside(e: Column, outer: Column) -> Column:
    """``e`` is a descendant of ``outer``."""
    return (e["id"] > outer["id"]) & (e["id"] <= outer["last"])


def select(elements: Column, selector: str) -> Column:
    """Elements matching a descendant selector, in document order."""

    def step(outers: Column, compound: str) -> Column:
        return let(
            outers,
            lambda found: F.filter(elements, lambda e: _matches(compound, e) & F.exists(found, lambda o: inside(e, o))),
        )

    first, *rest = selector.split(" ")
    hits = F.filter(elements, lambda e: _matches(first, e))
    for compound in rest:
        hits = step(hits, compound)
    return hits


def select_within(elements: Column, scope: Column, selector: str) -> Column:
    """Matches inside one element; the selector's ancestors may lie outside it."""
    return F.filter(select(elements, selector), lambda e: inside(e, scope))


def first_or_null(found: Column) -> Column:
    return F.get(found, F.lit(0))


def subtree(elements: Column, e: Column) -> Column:
    """Descendants of an element."""
    return F.slice(elements, e["id"] + 1, e["last"] - e["id"])


def descendants(elements: Column, e: Column, tags: tuple[str, ...]) -> Column:
    return F.filter(subtree(elements, e), lambda d: d["tag"].isin(*tags))


def children(elements: Column, e: Column, tags: tuple[str, ...] | None = None) -> Column:
    found = F.filter(subtree(elements, e), lambda d: d["parent"] == e["id"])
    return found if tags is None else F.filter(found, lambda d: d["tag"].isin(*tags))


def following_siblings(elements: Column, e: Column) -> Column:
    return F.filter(elements, lambda d: (d["id"] > e["last"]) & (d["parent"] == e["parent"]))


def node_text(texts: Column, e: Column, separator: str) -> Column:
    """Visible strings of an element's subtree, each trimmed, joined."""
    return F.array_join(F.slice(texts, e["first_text"], e["text_count"]), separator)


def heading_text(texts: Column, e: Column) -> Column:
    return normalize_text(node_text(texts, e, " "))


def html_nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per element: key, position, nesting, tag, classes, href and text."""
    parsed = parse_html(df.select(key, html), html)
    rows = parsed.select(key, "texts", F.explode("elements").alias("e"))
    return rows.select(
        key,
        "e.id",
        "e.last",
        "e.parent",
        "e.tag",
        F.btrim("e.classes").alias("classes"),
        "e.href",
        node_text(F.col("texts"), F.col("e"), " ").alias("text"),
    )
