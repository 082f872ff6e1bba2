"""Spark expressions against Python's re, ipaddress, urllib and uuid on generated texts."""

import json
import re
import uuid
from ipaddress import IPv4Address, ip_address
from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions import identifiers, ioc, rules, text, url

FEW = settings(max_examples=4, derandomize=True, deadline=None, suppress_health_check=list(HealthCheck))
PIECES = [
    "1.2.3.4", "255.1.1.1", "256.1.1.1", "01.2.3.4", "1.2.3.4:80", "10.0.0.1:65535", "٣.1.1.1", "evil.example", "-bad.example",
    "a.b", "a..b", "x" * 64 + ".org", "hxxp://", "hxxps://", "https://", "http://evil.example/a?b=c", "[.]", "(.)", "[:]//", "［.］",
    "d41d8cd98f00b204e9800998ecf8427e", "a" * 40, "F" * 64, "b" * 33, "user+tag@mail.example.org", "invoice (1).exe", "x.DLL", ".pdf",
    "é", "ß", "ı", "ſ", "²", "_", "-", ".", ",", ";", ":", "(", ")", "'", '"', "<", ">", "/", "@", " ", "  ", "\n", "\t", " ",
    " ", "\x1c", "\x85", "word", "Слово", "中文", "é", "a-b", "0",
]
TEXTS = st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=40, max_size=120)


def evaluate(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    found = {r.i: r.v for r in rows.select("i", make(F.col("t")).alias("v")).collect()}
    return [found[i] for i in range(len(texts))]


def space(value):
    return re.sub(r"\s+", " ", value).strip()


def refang(value):
    value = space(value)
    for search, replacement in V.REFANG_STEPS:
        value = value.replace(search, replacement)
    return value


PATTERNS = {
    "ipv4": V.IPV4, "ipv4_port": V.IPV4_PORT, "sha256": V.SHA256, "sha1": V.SHA1, "md5": V.MD5, "url": V.URL, "url_s1": V.URL_S1,
    "domain": V.DOMAIN, "filename": V.FILENAME, "email": V.EMAIL,
}
COMPILED = {name: re.compile(p, re.I if name == "filename" else 0) for name, p in PATTERNS.items()}


def all_matches(name, value):
    return [m.group(0) for m in COMPILED[name].finditer(value)]


def expected_iocs(value, hint, profile):
    value = refang(value)
    kinds, groups = V.KINDS[profile], V.GROUP_HINTS[profile]
    allowed = [hint] if hint in kinds else groups.get(hint, kinds)
    rest = value
    for hit in all_matches("url", value):
        rest = rest.replace(hit, " ")
    if profile == V.PP:
        for hit in all_matches("email", value):
            rest = rest.replace(hit, " ")
    else:
        rest = COMPILED["ipv4_port"].sub(" ", rest)
    rest = COMPILED["ipv4"].sub(" ", rest)
    found = []
    for kind in kinds:
        if kind in allowed:
            for hit in all_matches(kind, rest if kind == "domain" else value):
                hit = hit.strip(V.STRIP_CHARS)
                named = kind == "domain" and profile == V.PP and COMPILED["filename"].fullmatch(hit)
                if hit and not named and (kind, hit) not in found:
                    found.append((kind, hit))
    return found


@FEW
@given(TEXTS)
def test_text_clean_up(spark, texts):
    assert evaluate(spark, texts, text.normalize_text) == [space(t) for t in texts]
    assert evaluate(spark, texts, text.strip_space) == [t.strip() for t in texts]
    assert evaluate(spark, texts, text.refang) == [refang(t) for t in texts]
    lines = ["\n".join(s for s in map(space, t.splitlines()) if s) for t in texts]
    assert evaluate(spark, texts, text.clean_lines) == lines


@FEW
@given(TEXTS)
def test_patterns(spark, texts):
    names = list(PATTERNS)
    got = evaluate(spark, texts, lambda c: F.array(*[ioc.find_in_text(c, name) for name in names]))
    assert got == [[all_matches(name, t) for name in names] for t in texts]


@FEW
@given(TEXTS)
def test_extraction(spark, texts):
    for profile in (V.SL, V.PP):
        for hint in (None, "domain", "mixed_network", "filename", "hash"):
            column = None if hint is None else F.lit(hint)
            got = evaluate(spark, texts, lambda c: ioc.dedup_iocs(ioc.extract_by_hint(c, column, profile)))
            assert [[tuple(x) for x in row] for row in got] == [expected_iocs(t, hint, profile) for t in texts], (profile, hint)


def strict_ipv4(value):
    try:
        address = ip_address(value.strip())
    except ValueError:
        return None
    return address if isinstance(address, IPv4Address) else None


def keep_domain(value):
    value = value.strip().rstrip(".").lower()
    label = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", re.I)
    return (
        bool(value)
        and not any(c.isspace() or c in "/:@" for c in value)
        and value not in V.INTERNAL_HOSTS
        and not value.endswith(V.INTERNAL_SUFFIXES)
        and strict_ipv4(value) is None
        and "." in value
        and len(value) <= V.DOMAIN_MAX_LENGTH
        and all(label.fullmatch(part) for part in value.split("."))
    )


def is_special(address):
    from ipaddress import IPv4Network

    return str(address) not in V.ALLOWED_IPV4 and any(address in IPv4Network(b) for b in V.SPECIAL_IPV4_BLOCKS)


def keep_url(value):
    try:
        parsed = urlparse(value.strip())
        host = (parsed.hostname or "").strip().rstrip(".").lower()
    except ValueError:
        return False
    if not parsed.scheme or not host or host in V.INTERNAL_HOSTS or host.endswith(V.INTERNAL_SUFFIXES) or "." not in host:
        return False
    address = strict_ipv4(host)
    return not is_special(address) if address is not None else keep_domain(host)


HOSTS = st.lists(
    st.sampled_from(
        ["a", "evil", ".", ".", "-", "example", "com", "local", "corp", "LAN", "localhost", "10", "0", "192", "168", "8", "255", "01",
         "xn--a", "ı", "ſ", "K", "é", "_", " ", "x" * 63, "y" * 64, "\t", "."]
    ),
    min_size=1,
    max_size=9,
).map("".join)
NAMES = st.lists(HOSTS, min_size=60, max_size=150)
URLS = st.lists(
    st.tuples(
        st.sampled_from(["http://", "https://", "ftp://", "HTTP://", "", "//", "http:", "1http://", " https://"]),
        st.sampled_from(["", "user@", "u:p@", "a@b@"]),
        HOSTS,
        st.sampled_from(["", ":80", ":", ":x"]),
        st.sampled_from(["", "/", "/p?q#f", "?q", "#f", "/a b", "/@x:1"]),
    ).map("".join),
    min_size=60,
    max_size=150,
)


@FEW
@given(NAMES)
def test_domain_rule(spark, names):
    assert evaluate(spark, names, rules.is_public_domain) == [keep_domain(n) for n in names]


BLANKS = [
    "http:// evil.example/", "http://u@evil.example :80/", "http://u@ 8.8.8.8 /", "http:// 10.0.0.8 ?q", "http://evil.example ./p", "http://evil.example. /p",
    "http://a .b/", "http:// /x", "http://printer.local .", "http:// printer.LAN :8080/", "http://\u00a0evil.example\u2003/x", "http://8.8.8.8 .", "http://[::1]/", "http:// .",
]


@FEW
@example(BLANKS)
@given(URLS)
def test_url_rule(spark, urls):
    assert evaluate(spark, urls, rules.is_public_url) == [keep_url(u) for u in urls]


@FEW
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1).map(lambda n: str(IPv4Address(n))), HOSTS), min_size=60, max_size=150))
def test_ipv4_rule(spark, values):
    addresses = [strict_ipv4(v) for v in values]
    assert evaluate(spark, values, rules.ipv4_to_long) == [None if a is None else int(a) for a in addresses]
    kept = [a is None or not is_special(a) for a in addresses]
    assert evaluate(spark, values, lambda c: rules.rule_special_ip(F.lit("ipv4"), c)) == kept
    by_number = evaluate(spark, values, lambda c: rules.is_special_ipv4(rules.ipv4_to_long(c)))
    assert by_number == [None if a is None else is_special(a) for a in addresses]


PATHS = st.lists(
    st.sampled_from(["a", "b", "/", "/", ".", "..", "./", "../", "?q=1", "#f", ";p", "//h.example", "http://h/x", "https:", "mailto:x", " ", "%20"]),
    max_size=7,
).map("".join)


@FEW
@given(st.lists(PATHS, min_size=60, max_size=150), st.sampled_from(["https://x.org/a/b/c?z=1", "https://x.org", "http://x.org/d/"]))
def test_resolve_url(spark, hrefs, base):
    got = evaluate(spark, hrefs, lambda c: url.resolve_url(F.lit(base), c))
    assert got == [urljoin(base, h) for h in hrefs]


@FEW
@given(st.lists(PATHS.map(lambda p: "https://u:p@Host.Example:8080" + p), min_size=60, max_size=120))
def test_split_url(spark, urls):
    got = evaluate(spark, urls, url.split_url)
    wanted = [urlparse(u) for u in urls]
    assert [tuple(g) for g in got] == [(w.scheme, w.netloc, w.path, w.params, w.query, w.fragment) for w in wanted]


@FEW
@given(st.lists(st.text(st.characters(min_codepoint=32, exclude_categories=["Cs"]), max_size=20), min_size=20, max_size=60))
def test_uuid5(spark, values):
    got = evaluate(spark, values, lambda c: identifiers.named_id("url", value=c))
    namespace = uuid.UUID(V.STIX_NAMESPACE)
    names = [json.dumps({"value": v}, ensure_ascii=False, separators=(",", ":")) for v in values]
    assert got == [f"url--{uuid.uuid5(namespace, name)}" for name in names]
