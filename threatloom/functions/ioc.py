"""Indicator extraction as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.expressions import empty_array, let
from threatloom.functions.patterns import java_regex
from threatloom.functions.text import normalize_text, refang, strip_punctuation, value_lines

# The run before the dot cannot hold a dot itself, so a possessive match is the same and never backtracks.
_FILENAME = java_regex(V.FILENAME, ignore_case=True).replace("+\\.(?:exe", "++\\.(?:exe")
_PATTERNS = {
    "ipv4": java_regex(V.IPV4, word_edges=True),
    "ipv4_port": java_regex(V.IPV4_PORT, word_edges=True),
    "sha256": java_regex(V.SHA256, word_edges=True),
    "sha1": java_regex(V.SHA1, word_edges=True),
    "md5": java_regex(V.MD5, word_edges=True),
    "url": java_regex(V.URL, word_edges=True),
    "url_s1": java_regex(V.URL_S1, word_edges=True),
    "domain": java_regex(V.DOMAIN, word_edges=True),
    "filename": _FILENAME,
    "email": java_regex(V.EMAIL),
}
# A text without this piece cannot hold the kind; a plain search is far cheaper than the pattern.
_REQUIRED_PIECE = {"url": "://", "url_s1": "://", "email": "@", "ipv4": ".", "ipv4_port": ":", "domain": "."}
_EXTENSION = "(?iu)" + V.FILENAME[V.FILENAME.index(r"\.(?:exe") : -len(r"\b")]
# All three hash lengths are bounded by non-word characters: one pass finds them, the length tells them apart.
_ANY_HASH = java_regex(r"\b[a-fA-F0-9]{32}(?:[a-fA-F0-9]{8}(?:[a-fA-F0-9]{24})?)?\b", word_edges=True)
_HASH_LENGTHS = {"sha256": 64, "sha1": 40, "md5": 32}
_IOC = "struct<kind:string,value:string>"


def candidate_words(c: Column) -> Column:
    """The words of a text that can hold a match of any pattern but the file name.

    No other pattern crosses a blank, and each needs a dot, a colon or 32 characters in one word. Most
    words of prose fall out here, long before the costly patterns run.
    """
    possible = lambda w: F.contains(w, F.lit(".")) | F.contains(w, F.lit(":")) | (F.length(w) >= 32)
    return F.array_join(F.filter(F.split(c, " "), possible), " ")


def find_all(c: Column, name: str) -> Column:
    """Array of all matches of a named pattern."""
    found = F.regexp_extract_all(c, F.lit(_PATTERNS[name]), F.lit(0))
    if name == "filename":
        possible = c.rlike(_EXTENSION)
    elif name in _REQUIRED_PIECE:
        possible = F.contains(c, F.lit(_REQUIRED_PIECE[name]))
    else:
        return found
    return F.when(possible, found).otherwise(empty_array("string"))


def find_in_text(c: Column, name: str) -> Column:
    """``find_all`` for long texts."""
    if name == "filename":
        return find_all(c, name)
    return let(candidate_words(c), lambda words: find_all(words, name))


def is_hash(c: Column) -> Column:
    return c.rlike(r"\A(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})\z")


def is_filename(c: Column) -> Column:
    return c.rlike(r"\A(?:" + _FILENAME + r")\z")


def _blank_out(text: Column, found: Column) -> Column:
    """Replace each found string, in order, wherever it occurs."""
    return F.aggregate(found, text, lambda rest, hit: F.replace(rest, hit, F.lit(" ")))


def residual(text: Column, urls: Column, profile: str) -> Column:
    """What is left of a text for the domain search."""
    rest = _blank_out(text, urls)
    if profile == V.PP:
        rest = _blank_out(rest, find_all(text, "email"))
    else:
        rest = F.regexp_replace(rest, _PATTERNS["ipv4_port"], " ")
    return F.regexp_replace(rest, _PATTERNS["ipv4"], " ")


def mask_email(c: Column) -> Column:
    return _blank_out(c, find_all(c, "email"))


def _typed(kind: str, values: Column) -> Column:
    """Clean matches and tag them with their kind."""
    cleaned = F.filter(F.transform(values, strip_punctuation), lambda v: v != "")
    return F.transform(cleaned, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _hashes(text: Column, kinds: tuple[str, ...], allowed: Callable[[str], Column]) -> Column:
    def of_kind(found: Column, kind: str) -> Column:
        length = _HASH_LENGTHS[kind]
        hits = F.filter(found, lambda v: (F.length(v) == length) & allowed(kind))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.regexp_extract_all(text, F.lit(_ANY_HASH), F.lit(0))
    return let(found, lambda f: F.concat(*[of_kind(f, kind) for kind in kinds]))


def extract_by_hint(c: Column, hint: Column | None, profile: str) -> Column:
    """Refang a text and extract what its hint allows, array<struct<kind,value>> in kind order.

    No hint or an unknown one means every kind.
    """
    kinds, groups = V.KINDS[profile], V.GROUP_HINTS[profile]
    narrowing = [*kinds, *groups]
    any_kind = F.lit(True) if hint is None else hint.isNull() | ~hint.isin(narrowing)

    def allowed(kind: str) -> Column:
        if hint is None:
            return any_kind
        return any_kind | hint.isin([kind, *[g for g, members in groups.items() if kind in members]])

    def domains(text: Column, urls: Column) -> Column:
        found = _typed("domain", find_all(residual(text, urls, profile), "domain"))
        looks_wrong = lambda x: is_hash(x["value"])
        if profile == V.PP:
            looks_wrong = lambda x: is_hash(x["value"]) | is_filename(x["value"])
        return F.filter(found, lambda x: ~looks_wrong(x))

    def pick(kind: str, values: Column) -> Column:
        return values if hint is None else F.when(allowed(kind), values).otherwise(empty_array(_IOC))

    def all_kinds(text: Column, urls: Column) -> Column:
        parts = [
            pick("url", _typed("url", urls)),
            _hashes(text, ("sha256", "sha1", "md5"), allowed),
            pick("ipv4", _typed("ipv4", find_all(text, "ipv4"))),
            F.when(F.contains(text, F.lit(".")), pick("domain", domains(text, urls))).otherwise(empty_array(_IOC)),
        ]
        if "filename" in kinds:
            # A name may run over blanks and so needs the whole text, but its extension stands in one word.
            names = F.when(text.rlike(_EXTENSION), find_all(refang(c), "filename")).otherwise(empty_array("string"))
            parts.append(pick("filename", _typed("filename", names)))
        return F.concat(*parts)

    return let(refang(candidate_words(c)), lambda text: let(find_all(text, "url"), lambda urls: all_kinds(text, urls)))


def dedup_iocs(iocs: Column) -> Column:
    """Distinct (kind, value) pairs, first occurrence kept."""
    return F.array_distinct(iocs)


def number_iocs(iocs: Column) -> Column:
    """array<struct<ord,kind,value>> with the position as order."""
    return F.transform(
        iocs, lambda x, i: F.struct((i + 1).cast("int").alias("ord"), x["kind"].alias("kind"), x["value"].alias("value"))
    )


def kind_hint(c: Column, profile: str) -> Column:
    """Kind named by a heading: first needle contained in it, else null (S1: the heading itself)."""
    from threatloom.functions.text import fold_case, normalize_heading

    heading = fold_case(normalize_text(c)) if profile == V.S1 else normalize_heading(c)

    def choose(text: Column) -> Column:
        chain = None
        for needle, kind in V.KIND_NEEDLES[profile]:
            hit = F.contains(text, F.lit(needle))
            chain = F.when(hit, F.lit(kind)) if chain is None else chain.when(hit, F.lit(kind))
        return chain.otherwise(text) if profile == V.S1 else chain

    return let(heading, choose)


def is_protected(c: Column) -> Column:
    """Text shown to visitors in place of members-only values."""
    from threatloom.functions.expressions import any_of
    from threatloom.functions.text import fold_case

    return let(
        fold_case(normalize_text(c)),
        lambda text: any_of([F.contains(text, F.lit(marker)) for marker in V.S1_PROTECTED_MARKERS]),
    )


def drop_protected(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_protected(F.col(column)))


def typed_values(text: Column, kind: Column) -> Column:
    """Profile S1: matches of the kind's own pattern, or the lines of the text for other kinds."""
    chain = None
    for name in V.S1_PATTERN_KINDS:
        found = F.transform(find_all(text, "url_s1" if name == "url" else name), normalize_text)
        chain = F.when(kind == name, found) if chain is None else chain.when(kind == name, found)
    return chain.otherwise(F.filter(value_lines(text), lambda x: ~is_protected(x)))


def extract_iocs(df: DataFrame, key: str, text: str, profile: str) -> DataFrame:
    """Exploded indicator table (key, ord, kind, value) of a text column; no shuffle, no Python."""
    iocs = number_iocs(dedup_iocs(extract_by_hint(F.col(text), None, profile)))
    return df.select(F.col(key), F.inline(iocs))
