"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom import fixed_values as V

_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def normalize_text(c: Column) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.btrim(F.regexp_replace(c, _SPACE_RUN, " "))


def strip_space(c: Column) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def normalize_heading(c: Column) -> Column:
    """Normalised, lower-cased, long dashes as plain hyphens."""
    return F.translate(F.lower(normalize_text(c)), "—–", "--")


def fold_case(c: Column) -> Column:
    """Case folding: upper then lower also expands ligatures and sharp s."""
    return F.translate(F.lower(F.replace(F.upper(c), F.lit("ẞ"), F.lit("SS"))), "ς", "σ")


def refang(c: Column) -> Column:
    """Undo the usual defanging marks, in their fixed order."""
    text = normalize_text(c)
    for search, replacement in V.REFANG_STEPS:
        text = F.replace(text, F.lit(search), F.lit(replacement))
    return text


def strip_punctuation(c: Column) -> Column:
    return F.btrim(c, F.lit(V.STRIP_CHARS))


def clean_lines(c: Column) -> Column:
    """Lines of a text, each normalised, blank ones dropped, joined by newlines."""
    lines = F.transform(F.split(c, _LINE_BREAK), normalize_text)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def value_lines(c: Column) -> Column:
    """Array of the non-blank normalised lines between CR/LF breaks."""
    lines = F.transform(F.split(c, "[\r\n]+"), normalize_text)
    return F.filter(lines, lambda x: x != "")
