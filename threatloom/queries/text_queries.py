"""IOC-01..17, H-04, H-05, H-23, H-29, H-30: text functions and indicator extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions import ioc, rules, text
from threatloom.queries import corpora as C
from threatloom.queries import sql as Q
from threatloom.queries.catalog import query


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and one note per order: id, text."""
    documents = C.wide_table(spark, sf_dir, "documents")
    notes = C.indicators(spark, sf_dir)
    return documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionAll(
        notes.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("id"), F.expr(Q.NOTE).alias("text"))
    )


def _digest(column: str) -> str:
    return f"id, md5({column}) AS digest, length({column}) AS chars"


def _digest_columns(df: DataFrame, value) -> DataFrame:
    return df.select("id", value.alias("v")).select("id", F.md5("v").alias("digest"), F.length("v").alias("chars"))


@query(
    "h_04_normalize_text",
    f"WITH {Q.TEXTS} SELECT {_digest('v')} FROM (SELECT id, {Q.normalize('text')} AS v FROM texts)",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(texts(spark, sf_dir), text.normalize_text(F.col("text")))


@query(
    "h_05_normalize_heading",
    f"WITH {Q.TEXTS} SELECT {_digest('v')} FROM (SELECT id, translate(lower({Q.normalize('text')}), '—–', '--') AS v FROM texts)",
)
def normalize_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(texts(spark, sf_dir), text.normalize_heading(F.col("text")))


@query(
    "ioc_01_refang",
    f"WITH {Q.TEXTS} SELECT {_digest('v')} FROM (SELECT id, {Q.refang('text')} AS v FROM texts)",
)
def refang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(texts(spark, sf_dir), text.refang(F.col("text")))


def _found_sql(name: str) -> str:
    return (
        f"WITH {Q.TEXTS} SELECT id, generate_subscripts(hits, 1) AS ord, unnest(hits) AS value FROM "
        f"(SELECT id, {Q.found(Q.mask('text'), name)} AS hits FROM texts)"
    )


def _found_query(key: str, name: str) -> None:
    @query(key, _found_sql(name))
    def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = F.posexplode(ioc.find_in_text(F.col("text"), name)).alias("pos", "value")
        return texts(spark, sf_dir).select("id", hits).select("id", (F.col("pos") + 1).alias("ord"), "value")


_found_query("ioc_02_ipv4", "ipv4")
_found_query("ioc_03_ipv4_port", "ipv4_port")
_found_query("ioc_04_sha256", "sha256")
_found_query("ioc_05_sha1", "sha1")
_found_query("ioc_06_md5", "md5")
_found_query("ioc_07_url", "url")
_found_query("ioc_07_url_s1", "url_s1")
_found_query("ioc_08_domain", "domain")


# File names may hold any letters, so the masked twin cannot show their value beyond ASCII.
@query(
    "ioc_09_filename",
    f"WITH {Q.TEXTS} SELECT id, generate_subscripts(hits, 1) AS ord, unnest(hits) AS value FROM "
    f"(SELECT id, {Q.found(Q.mask(Q.normalize('text')), 'filename')} AS hits FROM texts)",
)
def filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = text.normalize_text(F.col("text"))
    masked = F.regexp_replace("v", r"[^\x00-\x7F\p{Z}\p{P}\p{S}\p{M}\p{C}]", "_")
    hits = F.posexplode(ioc.find_in_text(F.col("m"), "filename")).alias("pos", "value")
    masked_texts = texts(spark, sf_dir).select("id", normal.alias("v")).select("id", masked.alias("m"))
    return masked_texts.select("id", hits).select("id", (F.col("pos") + 1).alias("ord"), "value")


@query(
    "ioc_10_mask_email",
    f"WITH {Q.TEXTS} SELECT {_digest('v')} FROM (SELECT id, {Q.blank_out('m', Q.found('m', 'email'))} AS v "
    f"FROM (SELECT id, {Q.mask('text')} AS m FROM texts))",
)
def mask_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.regexp_replace("text", r"[^\x00-\x7F\p{Z}\p{P}\p{S}\p{M}\p{C}]", "_")
    return _digest_columns(texts(spark, sf_dir).select("id", masked.alias("m")), ioc.mask_email(F.col("m")))


def _hinted_sql(profile: str) -> str:
    rows = Q.extracted("notes", profile, hinted=True)
    return (
        f"WITH indicators AS ({Q.INDICATORS_SQL}), notes AS (SELECT k AS id, {Q.NOTE} AS text, {Q.HINT_OF_K} AS hint "
        f"FROM indicators) SELECT id AS k, row_number() OVER (PARTITION BY id ORDER BY place) AS ord, kind, value "
        f"FROM ({rows}) AS x"
    )


def _hinted_query(profile: str) -> None:
    @query(f"ioc_11_kind_dispatch_{profile}", _hinted_sql(profile))
    def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
        notes = C.indicators(spark, sf_dir).select("k", F.expr(Q.NOTE).alias("text"), F.expr(Q.HINT_OF_K).alias("hint"))
        found = ioc.number_iocs(ioc.extract_by_hint(F.col("text"), F.col("hint"), profile))
        return notes.select("k", F.inline(found))


_hinted_query(V.SL)
_hinted_query(V.PP)


def _residual_query(profile: str) -> None:
    sql = (
        f"WITH {Q.TEXTS}, masked AS (SELECT id, {Q.mask(Q.refang('text'))} AS m FROM texts) "
        f"SELECT {_digest('v')} FROM (SELECT id, {Q.residual('m', profile)} AS v FROM masked)"
    )

    @query(f"ioc_12_residual_{profile}", sql)
    def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
        masked = F.regexp_replace(text.refang(F.col("text")), r"[^\x00-\x7F\p{Z}\p{P}\p{S}\p{M}\p{C}]", "_")
        found = texts(spark, sf_dir).select("id", masked.alias("m"))
        with_urls = found.select("id", "m", ioc.find_all(F.col("m"), "url").alias("urls"))
        return _digest_columns(with_urls, ioc.residual(F.col("m"), F.col("urls"), profile))


_residual_query(V.SL)
_residual_query(V.PP)

_WORDS = "unnest(string_split(text, ' ')) AS word"


@query(
    "ioc_13_strip_punctuation",
    f"WITH {Q.TEXTS} SELECT value, count(*) AS n FROM (SELECT {Q.strip_punctuation('word')} AS value FROM "
    f"(SELECT {_WORDS} FROM texts)) WHERE value <> '' GROUP BY value",
)
def strip_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word"))
    stripped = words.select(text.strip_punctuation(F.col("word")).alias("value")).filter("value <> ''")
    return stripped.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ioc_14_is_hash",
    f"WITH {Q.TEXTS} SELECT word, count(*) AS n FROM (SELECT {_WORDS} FROM texts) WHERE {Q.IS_HASH.format('word')} GROUP BY word",
)
def is_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter(ioc.is_hash(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ioc_15_is_filename",
    f"WITH {Q.TEXTS} SELECT word, count(*) AS n FROM (SELECT {_WORDS} FROM texts) "
    f"WHERE regexp_full_match(word, {Q.lit('(?i)' + V.FILENAME)}) GROUP BY word",
)
def is_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter(ioc.is_filename(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ioc_16_dedup_iocs",
    "WITH indicators AS (" + Q.INDICATORS_SQL + "), raw AS ("
    + " UNION ALL ".join(
        f"SELECT k AS id, {i} AS place, '{kind}' AS kind, {name} AS value FROM indicators"
        for i, (kind, name) in enumerate([*C.KIND_VALUES, *C.KIND_VALUES[::2], ("ipv4", "ipv4_b")])
    )
    + f") SELECT id AS k, ord, kind, value FROM ({Q.deduplicated('SELECT * FROM raw')}) AS d",
)
def dedup_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [*C.KIND_VALUES, *C.KIND_VALUES[::2], ("ipv4", "ipv4_b")]
    listed = F.transform(C.ioc_array(pairs), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    return C.indicators(spark, sf_dir).select("k", F.inline(ioc.number_iocs(ioc.dedup_iocs(listed))))


def _extract_query(profile: str) -> None:
    sql = f"WITH {Q.TEXTS} {Q.deduplicated(Q.extracted('texts', profile))}"

    @query(f"ioc_17_extract_{profile}", sql)
    def extract(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ioc.extract_iocs(texts(spark, sf_dir), "id", "text", profile)


_extract_query(V.SL)
_extract_query(V.PP)


@query(
    "ioc_17_feed_summary",
    f"WITH {Q.TEXTS}, found AS ({Q.deduplicated(Q.extracted('texts', V.SL))}) "
    f"SELECT kind, count(*) AS mentions, count(DISTINCT value) AS indicators FROM found "
    f"WHERE {Q.keep('kind', 'value')} GROUP BY kind",
)
def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: texts to indicators, through the rules, distinct values per kind."""
    found = ioc.extract_iocs(texts(spark, sf_dir), "id", "text", V.SL).transform(rules.filter_iocs)
    # Per value first: combined on the map side, and no kind is gathered in one task.
    per_value = found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("kind").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("indicators"))


# ---------------------------------------------------------------- headings and protected texts

_HEADINGS = [
    "IPv4", "IPv4 Port  Combinations", "URLs of drops", "SHA256", "SHA-256 list", "SHA1", "sha-1", "MD5", "Onion Domains",
    "Domains and IPs", "Domains & IPs", "DOMAIN", "IP addresses", "Description", "File Hashes", "Hashes", "File names",
    "Tox ID", "Hosts", "Host names", "ÜBER — Campaign",
]
_HEADING = "CASE k % {n} ".format(n=len(_HEADINGS)) + " ".join(
    f"WHEN {i} THEN {Q.lit(h)}" for i, h in enumerate(_HEADINGS)
) + " END || ' ' || priority"


def _kind_sql(profile: str) -> str:
    heading = f"lower({Q.normalize('heading')})"
    if profile != V.S1:
        heading = f"translate({heading}, '—–', '--')"
    whens = " ".join(f"WHEN contains(h, {Q.lit(n)}) THEN {Q.lit(kind)}" for n, kind in V.KIND_NEEDLES[profile])
    other = "h" if profile == V.S1 else "NULL"
    return (
        f"WITH indicators AS ({Q.INDICATORS_SQL}), heads AS (SELECT k, {_HEADING} AS heading FROM indicators) "
        f"SELECT k, heading, CASE {whens} ELSE {other} END AS kind FROM (SELECT k, heading, {heading} AS h FROM heads)"
    )


def _kind_query(key: str, profile: str) -> None:
    @query(key, _kind_sql(profile))
    def kind(spark: SparkSession, sf_dir: str) -> DataFrame:
        heads = C.indicators(spark, sf_dir).select("k", F.expr(_HEADING).alias("heading"))
        return heads.withColumn("kind", ioc.kind_hint(F.col("heading"), profile))


_kind_query("h_23a_kind_dictionary_s1", V.S1)
_kind_query("h_23b_kind_dictionary_sl", V.SL)
_kind_query("h_23c_kind_dictionary_pp", V.PP)

_NOTICE = (
    "CASE k % 4 WHEN 0 THEN 'Список  Доступно только  авторизованным пользователям ' || md5 "
    "WHEN 1 THEN 'ПРИСОЕДИНИТЬСЯ к ' || domain WHEN 2 THEN 'доступно только ' || domain ELSE md5 END"
)
_PROTECTED = " OR ".join(f"contains(lower({Q.normalize('notice')}), {Q.lit(m)})" for m in V.S1_PROTECTED_MARKERS)


@query(
    "h_29_drop_protected",
    f"WITH indicators AS ({Q.INDICATORS_SQL}) SELECT k, notice FROM (SELECT k, {_NOTICE} AS notice FROM indicators) "
    f"WHERE NOT ({_PROTECTED})",
)
def drop_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = C.indicators(spark, sf_dir).select("k", F.expr(_NOTICE).alias("notice"))
    return ioc.drop_protected(notices, "notice")


_TYPED_KIND = "CASE k % 9 " + " ".join(
    f"WHEN {i} THEN '{kind}'" for i, kind in enumerate([*V.S1_PATTERN_KINDS, "tox id"])
) + " ELSE 'campaign' END"
_TYPED_LISTS = " ".join(
    f"WHEN '{kind}' THEN {Q.found('m', 'url_s1' if kind == 'url' else kind)}" for kind in V.S1_PATTERN_KINDS
)
_LINES = f"list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: {Q.normalize('x')}), lambda x: x <> '')"


@query(
    "h_30_typed_values",
    f"WITH indicators AS ({Q.INDICATORS_SQL}), notes AS (SELECT k, {Q.NOTE} AS text, {_TYPED_KIND} AS kind FROM indicators), "
    f"typed AS (SELECT k, kind, CASE kind {_TYPED_LISTS} ELSE {_LINES} END AS hits "
    f"FROM (SELECT k, kind, text, {Q.mask('text')} AS m FROM notes)) "
    "SELECT k, kind, generate_subscripts(hits, 1) AS ord, unnest(hits) AS value FROM typed",
)
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = C.indicators(spark, sf_dir).select("k", F.expr(_TYPED_KIND).alias("kind"), F.expr(Q.NOTE).alias("text"))
    hits = F.posexplode(ioc.typed_values(F.col("text"), F.col("kind"))).alias("pos", "value")
    return notes.select("k", "kind", hits).select("k", "kind", (F.col("pos") + 1).alias("ord"), "value")
