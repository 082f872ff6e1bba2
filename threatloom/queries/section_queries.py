"""H-19..H-28: indicator sections of entry pages, on bulletins made from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.expressions import let
from threatloom.operators import entry as E
from threatloom.operators import html as H
from threatloom.queries import corpora as C
from threatloom.queries.catalog import query

def _elements() -> Column:
    return F.col("elements")


def _texts() -> Column:
    return F.col("texts")


def _with(select: str) -> str:
    return f"WITH indicators AS ({C.INDICATORS_SQL}) {select}"


def _rows(parts: list[tuple[str, ...]], names: list[str]) -> str:
    """Union of rows (condition, column expressions...), numbered by position and renumbered per k."""
    raw = " UNION ALL ".join(
        f"SELECT k, {i} AS place, {', '.join(f'{v} AS {n}' for v, n in zip(values, names))} FROM indicators WHERE {condition}"
        for i, (condition, *values) in enumerate(parts)
    )
    return _with(f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY place) AS ord, {', '.join(names)} FROM ({raw}) AS r")


def _read(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    pages = H.parse_html(C.entry_pages(spark, sf_dir, profile), "html")
    return pages.withColumn("container", E.entry_container(_elements(), _texts(), profile))


def _numbered(df: DataFrame, rows: Column, *fields: str) -> DataFrame:
    found = df.select("k", F.posexplode(rows).alias("pos", "r"))
    return found.select("k", (F.col("pos") + 1).alias("ord"), *[F.col(f"r.{f}").alias(f) for f in fields])


def _heading(profile: str) -> Column:
    return E.ioc_heading(_elements(), _texts(), F.col("container"), profile)


def _heading_query(key: str, profile: str, text: str) -> None:
    @query(key, _with(f"SELECT k, {text} AS heading FROM indicators"))
    def heading(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _read(spark, sf_dir, profile).select("k", "texts", _heading(profile).alias("h"))
        return found.select("k", H.heading_text(F.col("texts"), F.col("h")).alias("heading"))


_heading_query("h_19_ioc_heading_s1", V.S1, "'Индикаторы Компрометации'")
_heading_query("h_19_ioc_heading_sl", V.SL, "'Appendix I – Indicators of Compromise'")
_heading_query(
    "h_19_ioc_heading_pp",
    V.PP,
    "CASE k % 3 WHEN 0 THEN 'Indicators of compromise' WHEN 2 THEN 'Example indicators of compromise' END",
)


def _blocks(profile: str) -> Column:
    return let(_heading(profile), lambda h: E.section_blocks(_elements(), _texts(), h, profile))


def _block_query(key: str, profile: str, parts: list[tuple[str, ...]]) -> None:
    @query(key, _rows(parts, ["tag"]))
    def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _numbered(_read(spark, sf_dir, profile), _blocks(profile), "tag")


def _all(*tags: str) -> list[tuple[str, str]]:
    return [("true", f"'{tag}'") for tag in tags]


_block_query("h_20_section_blocks_sl", V.SL, _all("h3", "ul", "h3", "ul", "h3", "ul", "h3", "p", "p", "table", "table"))
_block_query(
    "h_20_section_blocks_pp",
    V.PP,
    [("k % 3 = 0", "'table'")] + [("k % 3 = 2", f"'{tag}'") for tag in ("p", "p", "p", "h4", "p", "h4", "ul")],
)
_S1_MD5_TAG = ("true", "CASE k % 3 WHEN 0 THEN 'ul' WHEN 1 THEN 'pre' ELSE 'p' END")
_block_query(
    "h_21_section_blocks_s1",
    V.S1,
    [*_all("p", "h3", "ul", "h3", "ol", "h3", "ul", "h4", "p", "h3"), _S1_MD5_TAG, *_all("h3", "div")],
)


def _hint_query(key: str, profile: str, parts: list[tuple[str, ...]]) -> None:
    @query(key, _rows(parts, ["tag", "hint"]))
    def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
        paired = let(_blocks(profile), lambda blocks: E.carry_hint(blocks, _texts(), profile))
        shown = F.transform(paired, lambda p: F.struct(p["block"]["tag"].alias("tag"), p["hint"].alias("hint")))
        return _numbered(_read(spark, sf_dir, profile), shown, "tag", "hint")


_hint_query(
    "h_22_carry_hint_s1",
    V.S1,
    [
        ("true", "'p'", "NULL"),
        ("true", "'ul'", "'ipv4'"),
        ("true", "'ol'", "'ipv4_port'"),
        ("true", "'ul'", "'domain'"),
        ("true", "'p'", "'tox id'"),
        (*_S1_MD5_TAG, "'md5'"),
        ("true", "'div'", "'url'"),
    ],
)
_hint_query(
    "h_22_carry_hint_sl",
    V.SL,
    [
        ("true", "'ul'", "'mixed_hash'"),
        ("true", "'ul'", "'mixed_network'"),
        ("true", "'ul'", "'url'"),
        *[("true", f"'{tag}'", "NULL") for tag in ("p", "p", "table", "table")],
    ],
)
_hint_query(
    "h_22_carry_hint_pp",
    V.PP,
    [
        ("k % 3 = 0", "'table'", "NULL"),
        *[("k % 3 = 2", "'p'", "NULL")] * 3,
        ("k % 3 = 2", "'p'", "'url'"),
        ("k % 3 = 2", "'ul'", "NULL"),
    ],
)


@query(
    "h_24_candidate_texts_s1",
    _rows(
        [
            ("true", "'Пояснение 9.9.9.9'"),
            ("true", "ipv4"),
            ("true", "'Адрес ' || ipv4_b"),
            ("true", "ipv4"),
            ("true", "ipv4_port || ' C2'"),
            ("true", "'нет данных'"),
            ("true", "domain"),
            ("true", "'evil[.]com'"),
            ("true", "'TOX' || CAST(c AS STRING)"),
            ("k % 3 = 1", "md5"),
            ("k % 3 = 1", "'not a hash'"),
            ("k % 3 = 2", "md5 || ', ' || md5_b"),
            ("true", "url_b || ' and ' || url"),
        ],
        ["text"],
    ),
)
def candidate_texts_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = let(_blocks(V.S1), lambda blocks: E.carry_hint(blocks, _texts(), V.S1))
    texts = F.flatten(F.transform(paired, lambda p: E.candidate_texts_s1(_elements(), _texts(), p["block"])))
    shown = F.transform(texts, lambda t: F.struct(t.alias("text")))
    return _numbered(_read(spark, sf_dir, V.S1), shown, "text")


def _candidates(profile: str) -> Column:
    paired = let(_blocks(profile), lambda blocks: E.carry_hint(blocks, _texts(), profile))
    kept = F.filter(paired, lambda p: p["block"]["tag"] != "table")
    return F.flatten(F.transform(kept, lambda p: E.candidate_texts(_elements(), _texts(), p["block"], p["hint"], profile)))


def _dots(name: str) -> str:
    return f"replace({name}, '.', '[.]')"


def _candidate_query(key: str, profile: str, parts: list[tuple[str, ...]]) -> None:
    @query(key, _rows(parts, ["text", "hint"]))
    def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _numbered(_read(spark, sf_dir, profile), _candidates(profile), "text", "hint")


_DROP = f"'hxxps://' || {_dots('domain_b')} || '/drop/' || CAST(k AS STRING)"
_candidate_query(
    "h_25_candidate_texts_sl",
    V.SL,
    [
        ("true", "md5", "'mixed_hash'"),
        ("true", "sha256 || ' and ' || sha1", "'mixed_hash'"),
        ("true", _dots("domain_b"), "'mixed_network'"),
        ("true", _dots("ipv4"), "'mixed_network'"),
        ("true", _DROP, "'url'"),
        ("true", "'MD5 list: ' || md5 || ' ' || md5_b", "'md5'"),
        ("true", "'seen ' || ipv4_b || ':' || port || ' at ' || domain", "NULL"),
    ],
)
_candidate_query(
    "h_25_candidate_texts_pp",
    V.PP,
    [
        ("k % 3 = 2", "sha256 || ' SHA256 of the archive'", "'sha256'"),
        ("k % 3 = 2", f"{_dots('domain_b')} || ' panel'", "NULL"),
        ("k % 3 = 2", f"{_dots('ipv4')} || ' IP of a relay'", "'ipv4'"),
        ("k % 3 = 2", f"{_DROP} || ' second stage'", "'url'"),
        ("k % 3 = 2", "sha1 || ' ' || file", "NULL"),
    ],
)


def _tables(profile: str) -> Column:
    tables = H.descendants(_elements(), F.col("container"), ("table",))
    return F.flatten(F.transform(tables, lambda t: E.table_texts(_elements(), _texts(), t, profile)))


@query(
    "h_26_header_typed_table",
    _rows(
        [
            ("true", "domain", "'domain'"),
            ("true", "md5_c", "'md5'"),
            ("true", "sha1", "NULL"),
            ("true", "ipv4_b", "NULL"),
            ("true", "'none'", "NULL"),
        ],
        ["text", "hint"],
    ),
)
def header_typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_read(spark, sf_dir, V.SL), _tables(V.SL), "text", "hint")


@query(
    "h_27_row_typed_table",
    _rows(
        [
            ("k % 3 = 0", "'Indicator'", "NULL"),
            ("k % 3 = 0", "'Type'", "NULL"),
            ("k % 3 = 0", "'Context'", "NULL"),
            ("k % 3 = 0", _dots("domain_b"), "'domain'"),
            ("k % 3 = 0", _dots("ipv4"), "'ipv4'"),
            ("k % 3 = 0", "sha256", "'sha256'"),
            ("k % 3 = 0", "file", "'filename'"),
            ("k % 3 = 0", "md5", "'hash'"),
            ("k % 3 = 0", "'only ' || url_b", "NULL"),
            ("k % 3 = 1", "'Indicator'", "'ipv4'"),
            ("k % 3 = 1", f"{_dots('ipv4_b')} || ':' || port", "NULL"),
            ("k % 3 = 1", "'Backdoor server'", "NULL"),
            ("k % 3 = 1", "domain", "'domain'"),
            ("k % 3 = 1", f"'box' || CAST(c AS STRING) || '@' || {_dots('domain_b')}", "NULL"),
            ("k % 3 = 1", "'Mailbox'", "NULL"),
            ("k % 3 = 1", "'elsewhere'", "NULL"),
            ("k % 3 = 1", "md5", "NULL"),
        ],
        ["text", "hint"],
    ),
)
def row_typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_read(spark, sf_dir, V.PP), _tables(V.PP), "text", "hint")


@query(
    "h_28_ioc_tables",
    _with("SELECT k, CASE k % 3 WHEN 2 THEN 0 ELSE 1 END AS tables, CASE k % 3 WHEN 0 THEN 7 WHEN 1 THEN 4 ELSE 0 END AS lines FROM indicators"),
)
def ioc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.ioc_tables(_elements(), _texts(), F.col("container"))
    tables = _read(spark, sf_dir, V.PP).select("k", "elements", found.alias("t"))
    lines = F.transform("t", lambda t: F.size(H.descendants(_elements(), t, ("tr",))))
    return tables.select("k", F.size("t").alias("tables"), F.aggregate(lines, F.lit(0), lambda a, n: a + n).alias("lines"))


def _entry_query(key: str, profile: str, expected: list[tuple[str, str, str]]) -> None:
    @query(key, f"WITH indicators AS ({C.INDICATORS_SQL}) {C.expected_rows_sql(expected)}")
    def iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = E.parse_entries(C.entry_pages(spark, sf_dir, profile), profile)
        return parsed.select("k", F.inline("iocs"))


_entry_query("h_19_30_entry_iocs_s1", V.S1, C.S1_EXPECTED)
_entry_query("h_19_30_entry_iocs_sl", V.SL, C.SL_EXPECTED)
_entry_query("h_19_30_entry_iocs_pp", V.PP, C.PP_EXPECTED)
