"""DuckDB fragments the checking statements share."""

from __future__ import annotations

from ipaddress import IPv4Address, IPv4Network

from threatloom import fixed_values as V
from threatloom.queries.corpora import INDICATORS_SQL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def normalize(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(_SPACE)}, ' ', 'g'))"


def refang(x: str) -> str:
    out = normalize(x)
    for search, replacement in V.REFANG_STEPS:
        out = f"replace({out}, {lit(search)}, {lit(replacement)})"
    return out


def mask(x: str) -> str:
    """Letters and digits beyond ASCII as underscores: DuckDB's word boundary knows ASCII only."""
    return f"regexp_replace({x}, {lit(r'[^\x00-\x7F\p{Z}\p{P}\p{S}\p{M}\p{C}]')}, '_', 'g')"


def find_all(x: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_extract_all({x}, {lit(('(?i)' if ignore_case else '') + pattern)})"


PATTERNS = {
    "ipv4": V.IPV4,
    "ipv4_port": V.IPV4_PORT,
    "sha256": V.SHA256,
    "sha1": V.SHA1,
    "md5": V.MD5,
    "url": V.URL,
    "url_s1": V.URL_S1,
    "domain": V.DOMAIN,
    "filename": V.FILENAME,
    "email": V.EMAIL,
}


def found(x: str, name: str) -> str:
    return find_all(x, PATTERNS[name], name == "filename")


def strip_punctuation(x: str) -> str:
    return f"trim({x}, {lit(V.STRIP_CHARS)})"


def blank_out(x: str, values: str) -> str:
    return f"list_reduce([{x}] || {values}, lambda acc, hit: replace(acc, hit, ' '))"


def residual(x: str, profile: str) -> str:
    rest = blank_out(x, found(x, "url"))
    if profile == V.PP:
        rest = blank_out(rest, found(x, "email"))
    else:
        rest = f"regexp_replace({rest}, {lit(V.IPV4_PORT)}, ' ', 'g')"
    return f"regexp_replace({rest}, {lit(V.IPV4)}, ' ', 'g')"


IS_HASH = "regexp_full_match({0}, '[a-fA-F0-9]{{32}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{64}}')"

# A sentence holding every kind, glued to the marks that trouble the patterns.
NOTE = (
    "'Seen ' || ipv4 || ',' || ipv4_port || ' and ' || url || '), (' || url_b || ']. Hash ' || md5 || '/' || sha1 "
    "|| ';' || sha256 || 'x ' || sha256 || chr(10) || ' host  ' || domain || '. mail ops.' || CAST(c AS STRING) || '+x@' "
    "|| domain_b || ' file ' || file || ', a_' || md5 || ' v1.2.3.4.5 999.1.1.1 1.1.1.1.com ' "
    "|| replace(domain_b, '.', '[.]') || ' hxxp://' || domain || '(.)x hxxps[:]//' || domain_b || ' ü' || md5 "
    "|| '; bare ' || sha1 || ' ; (copy of ' || file || ') setup.DLL readme.txt -' || domain || '-'"
)
TEXTS = (
    f"indicators AS ({INDICATORS_SQL}),\n"
    "texts AS (SELECT 'd' || CAST(doc_id AS STRING) AS id, text FROM documents "
    f"UNION ALL SELECT 'o' || CAST(k AS STRING) AS id, {NOTE} AS text FROM indicators)"
)
HINTS = ("md5", "sha1", "sha256", "ipv4", "url", "domain", "filename", "mixed_hash", "mixed_network", "hash", None)
HINT_OF_K = "CASE k % 11 " + " ".join(
    f"WHEN {i} THEN {lit(hint)}" for i, hint in enumerate(HINTS) if hint
) + " END"


def extracted(texts: str, profile: str, hinted: bool = False) -> str:
    """Subquery (id, place, kind, value) of the indicators of ``texts`` (id, text[, hint]), repeats kept.

    ``place`` orders them; the list of kinds a hint allows follows the fixed table.
    """
    parts = []
    for rank, kind in enumerate(V.KINDS[profile]):
        source = residual("m", profile) if kind == "domain" else "m"
        where = "true"
        if hinted:
            narrow = [*V.KINDS[profile], *V.GROUP_HINTS[profile]]
            own = [kind, *[g for g, members in V.GROUP_HINTS[profile].items() if kind in members]]
            listed = lambda names: ", ".join(lit(n) for n in names)
            where = f"(hint IS NULL OR hint NOT IN ({listed(narrow)}) OR hint IN ({listed(own)}))"
        parts.append(
            f"SELECT id, {rank} AS rank, generate_subscripts(hits, 1) AS pos, '{kind}' AS kind, unnest(hits) AS raw "
            f"FROM (SELECT id, {found(source, kind)} AS hits FROM masked WHERE {where}) AS h{rank}"
        )
    rows = "\nUNION ALL\n".join(parts)
    keep = "value <> ''"
    if "filename" in V.KINDS[profile]:
        keep += f" AND NOT (kind = 'domain' AND regexp_full_match(value, {lit('(?i)' + V.FILENAME)}))"
    hint = ", hint" if hinted else ""
    return (
        f"SELECT id, rank * 1000000 + pos AS place, kind, value FROM ("
        f"WITH masked AS (SELECT id, {mask(refang('text'))} AS m{hint} FROM {texts}) "
        f"SELECT id, rank, pos, kind, {strip_punctuation('raw')} AS value FROM ({rows}) AS r) AS s WHERE {keep}"
    )


def deduplicated(rows: str) -> str:
    """Subquery (id, ord, kind, value): first occurrences, numbered per id."""
    first = f"SELECT id, kind, value, min(place) AS place FROM ({rows}) AS rr GROUP BY id, kind, value"
    return f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) AS ord, kind, value FROM ({first}) AS ff"


# ---------------------------------------------------------------- quality rules

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
STRICT_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def ipv4_to_long(x: str) -> str:
    octets = [f"CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    total = f"(({octets[0]} * 256 + {octets[1]}) * 256 + {octets[2]}) * 256 + {octets[3]}"
    return f"CASE WHEN regexp_full_match({x}, {lit(STRICT_IPV4)}) THEN {total} END"


def is_special(n: str) -> str:
    blocks = [IPv4Network(b) for b in V.SPECIAL_IPV4_BLOCKS]
    inside = " OR ".join(f"{n} BETWEEN {int(b.network_address)} AND {int(b.broadcast_address)}" for b in blocks)
    allowed = ", ".join(str(int(IPv4Address(a))) for a in V.ALLOWED_IPV4)
    return f"({n} NOT IN ({allowed}) AND ({inside}))"


def is_internal(host: str) -> str:
    ends = " OR ".join(f"ends_with({host}, '{s}')" for s in V.INTERNAL_SUFFIXES)
    return f"({host} IN ('localhost', 'localdomain') OR {ends})"


def keep_ip(kind: str, value: str) -> str:
    address = f"CASE WHEN {kind} = 'ipv4_port' THEN split_part({value}, ':', 1) ELSE {value} END"
    number = ipv4_to_long(f"({address})")
    return f"({kind} NOT IN ('ipv4', 'ipv4_port') OR coalesce(NOT {is_special(f'({number})')}, true))"


def public_domain(value: str) -> str:
    v = f"lower(rtrim({value}, '.'))"
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return (
        f"(regexp_full_match({v}, {lit(label + '(?:[.]' + label + ')+')}) AND length({v}) <= {V.DOMAIN_MAX_LENGTH} "
        f"AND NOT {is_internal(v)} AND NOT regexp_full_match({v}, {lit(STRICT_IPV4)}))"
    )


def keep_domain(kind: str, value: str) -> str:
    return f"({kind} <> 'domain' OR {public_domain(value)})"


def host(value: str) -> str:
    return f"lower(regexp_extract({value}, {lit('^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)')}, 1))"


def public_url(value: str) -> str:
    h = f"rtrim({host(value)}, '.')"
    return (
        f"(NOT {is_internal(h)} AND contains({h}, '.') AND CASE WHEN {ipv4_to_long(h)} IS NOT NULL "
        f"THEN NOT {is_special(f'({ipv4_to_long(h)})')} ELSE {public_domain(h)} END)"
    )


def keep_url(kind: str, value: str) -> str:
    return f"({kind} <> 'url' OR {public_url(value)})"


def keep(kind: str, value: str) -> str:
    return f"({keep_ip(kind, value)} AND {keep_domain(kind, value)} AND {keep_url(kind, value)})"


# ---------------------------------------------------------------- identifiers

_NAMESPACE = V.STIX_NAMESPACE.replace("-", "")


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{_NAMESPACE}') || encode({name}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || "
        f"substr({h}, 21, 12))"
    )


def stix_id(stix_type: str, name: str) -> str:
    return f"('{stix_type}--' || {uuid5(name)})"


def one_value(value: str) -> str:
    return f"('{{\"value\":\"' || {value} || '\"}}')"
