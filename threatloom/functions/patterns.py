"""Python regular expressions rewritten for the JVM, where class shorthands mean less."""

from __future__ import annotations

import re

# Characters str.isspace() and \s accept.
SPACE_CHARS = r"\p{IsWhite_Space}\x1c-\x1f"
WORD_CHARS = r"\w\p{L}\p{N}"
BOUNDARY = f"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"

_IN_CLASS = {"w": WORD_CHARS, "s": SPACE_CHARS, "d": r"\p{Nd}"}
_OUTSIDE = {"w": f"[{WORD_CHARS}]", "s": f"[{SPACE_CHARS}]", "d": r"\p{Nd}", "b": BOUNDARY}


def java_regex(pattern: str, ignore_case: bool = False, word_edges: bool = False) -> str:
    """Same matches in java.util.regex as ``pattern`` has in Python's ``re`` on str.

    ``word_edges`` is for patterns whose match starts, and if bounded also ends, in a word character:
    the boundary then needs to look one way only, which is several times faster.
    """
    if word_edges:
        body = java_regex(pattern.removeprefix(r"\b").removesuffix(r"\b"))
        end = f"(?![{WORD_CHARS}])" if pattern.endswith(r"\b") else ""
        return f"(?<![{WORD_CHARS}]){body}{end}"
    out: list[str] = []
    in_class = False
    for token in re.findall(r"\\.|.", pattern, flags=re.S):
        if token.startswith("\\"):
            out.append((_IN_CLASS if in_class else _OUTSIDE).get(token[1], token))
            continue
        if token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        out.append(token)
    return ("(?iu)" if ignore_case else "") + "".join(out)
