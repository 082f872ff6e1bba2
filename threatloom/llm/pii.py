"""Personal data in whole texts by weak supervision.

Regexes propose spans. Five labelers vote on each (yes, no, or nothing): a validator of its kind, a gazetteer, cue words ahead of it,
its borders, and its shape. Expectation-maximisation over the counts of all vote patterns of the corpus estimates how far
each labeler can be relied on and how probable each proposal is; a logistic span classifier is then trained on those
probabilities with the votes and the surroundings as features. Only distinct patterns with their counts reach the driver; they are a
bounded set (kinds x votes x a few classes), whatever the corpus.

Spans of the four base kinds that pass their checks always stay. The classifier decides about all other proposals: secrets,
identity numbers, bank accounts, local phone numbers, disguised email addresses.

Defined results: a null text is an empty one and has no spans. Every row is judged by itself, repeated or without doc_id.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import documents

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "identity", "account", "local_phone", "hidden_email")
KINDS = (*BASE, *MORE)
LABELERS = 5
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does: a later start in the run could only match where that one does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PROPOSED = {
    "secret": re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=-]{8,}+)", re.I),
    "identity": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "account": re.compile(r"\b([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})\b"),
    "local_phone": re.compile(r"(?<![0-9+(])(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"),
    "hidden_email": re.compile(r"([A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,8})", re.I),
}
#: What a text must hold for a proposal to be looked for at all.
_NEEDED = {
    "secret": re.compile(r"token|secret|passw|key", re.I),
    "identity": re.compile(r"[0-9]-[0-9]"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}"),
    "local_phone": re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-]"),
    "hidden_email": re.compile(r"[\[(]at[\])]", re.I),
}
# Gazetteers.
_TOP_DOMAINS = frozenset("com org net edu gov io de fr es it uk eu ch at nl be pl ru cn jp br in info biz dev app".split())
_CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "90", "91")
_CARD_STARTS = ("4", "51", "52", "53", "54", "55", "22", "34", "37", "60", "65", "35", "36", "38")
_CUES = {
    "email": "mail email e-mail contact write", "ip": "ip host server address addr", "card": "card visa mastercard amex credit",
    "phone": "phone tel telephone call mobile fax", "secret": "token secret password passwd key", "identity": "ssn social security id",
    "account": "iban account bank konto", "local_phone": "phone tel telephone call mobile fax", "hidden_email": "mail email e-mail contact write",
}
_CUE_WORDS = {kind: frozenset(words.split()) for kind, words in _CUES.items()}
_WORD = re.compile(r"[A-Za-z-]+")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", match.end() if match else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for place, sign in enumerate(reversed(digits)):
        value = ord(sign) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _valid(kind: str, value: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in value.split("."))
    digits = _digits(value)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_matches(text: str) -> list[tuple[int, int, str, bool]]:
    """All matches of the base patterns and whether they pass, by start, then kind as listed."""
    found = [(a, b, "email", True) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found.extend((m.start(), m.end(), kind, _valid(kind, m.group())) for m in pattern.finditer(text))
    found.sort(key=lambda x: (x[0], BASE.index(x[2])))
    return found


def proposals(text: str, taken: list[Span]) -> list[Span]:
    """Further spans, none overlapping a base span or an earlier proposal."""
    found: list[Span] = []
    for kind in MORE:
        if _NEEDED[kind].search(text):
            found.extend((m.start(1), m.end(1), kind) for m in _PROPOSED[kind].finditer(text))
    found.sort()
    free, held, at = [], sorted(taken), 0
    last = 0
    for start, end, kind in found:
        while at < len(held) and held[at][1] <= start:
            at += 1
        if start >= last and not (at < len(held) and held[at][0] < end):
            free.append((start, end, kind))
            last = end
    return free


def _mod97(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str, passes: bool) -> tuple[int, ...]:
    """1, 0 or -1 from the validator, the gazetteer, the cue words, the borders and the shape."""
    value = text[start:end]
    digits = _digits(value)
    if kind in BASE:
        validator = 1 if passes else -1
    elif kind == "account":
        validator = 1 if _mod97(value) else -1
    elif kind == "identity":
        validator = 1 if value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000" else -1
    elif kind == "local_phone":
        validator = 1 if digits[0] not in "01" and len(digits) == 10 else -1
    elif kind == "secret":
        validator = 1 if len(value) >= 16 and digits and any(c.isalpha() for c in value) else -1
    else:
        validator = 0
    gazetteer = 0
    if kind in ("email", "hidden_email"):
        gazetteer = 1 if re.split(r"[^a-z0-9-]+", value.lower())[-1] in _TOP_DOMAINS else 0
    elif kind == "ip":
        gazetteer = -1 if value.startswith(("0.", "127.", "255.")) else 1
    elif kind == "card":
        gazetteer = 1 if digits.startswith(_CARD_STARTS) else -1
    elif kind == "phone":
        gazetteer = 1 if digits.startswith(_CALLING_CODES) else -1
    elif kind == "secret":
        gazetteer = 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9+/]{24,}={0,2}|(?:sk|pk|gh[a-z])[-_].{12,}", value) else 0
    ahead = _WORD.findall(text[max(0, start - 40) : start])[-3:]
    cues = 1 if any(word.lower() in _CUE_WORDS[kind] for word in ahead) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    borders = -1 if left.isalnum() or right.isalnum() else 1
    low, high = {"email": (6, 64), "ip": (7, 15), "card": (14, 23), "phone": (11, 20), "secret": (16, 128)}.get(kind, (9, 64))
    shape = 1 if low <= len(value) <= high else -1
    return validator, gazetteer, cues, borders, shape


def _class(sign: str) -> str:
    return "-" if not sign else "s" if sign.isspace() else "a" if sign.isalpha() else "d" if sign.isdigit() else "p"


Pattern = tuple[str, tuple[int, ...], str]


def pattern(text: str, start: int, end: int, kind: str, passes: bool) -> Pattern:
    size = min(6, (end - start) // 8)
    return kind, votes(text, start, end, kind, passes), f"{size}{_class(text[start - 1 : start])}{_class(text[end : end + 1])}"


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[Pattern] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                matches = base_matches(text)
                kept = [(a, b, kind) for a, b, kind, passes in matches if passes]
                counts.update(pattern(text, *match) for match in matches)
                counts.update(pattern(text, a, b, kind, True) for a, b, kind in proposals(text, kept))
    names = list(counts)
    yield pa.RecordBatch.from_pydict(
        {"kind": pa.array([n[0] for n in names], pa.string()), "votes": pa.array([list(n[1]) for n in names], pa.list_(pa.int32())),
         "around": pa.array([n[2] for n in names], pa.string()), "n": pa.array([counts[n] for n in names], pa.int64())}
    )


def estimate(patterns_: list[Pattern], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each pattern and reliabilities [labeler, truth, vote + 1], by expectation-maximisation."""
    kinds = np.array([KINDS.index(p[0]) for p in patterns_])
    cast = np.array([p[1] for p in patterns_]) + 1
    probability = 1 / (1 + np.exp(-(cast - 1).sum(axis=1).astype(float)))  # start: the majority
    tables = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - probability), counts * probability])
        for j in range(LABELERS):
            for truth in (0, 1):
                table = np.bincount(cast[:, j], weights=weight[truth], minlength=3) + 1.0
                tables[j, truth] = table / table.sum()
        each = np.bincount(kinds, weights=counts, minlength=len(KINDS))
        prior = (np.bincount(kinds, weights=weight[1], minlength=len(KINDS)) + 1) / (each + 2)
        logs = np.log(prior / (1 - prior))[kinds]
        for j in range(LABELERS):
            logs = logs + np.log(tables[j, 1, cast[:, j]] / tables[j, 0, cast[:, j]])
        probability = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
    return probability, tables


def _features(item: Pattern) -> list[str]:
    kind, cast, around = item
    return ["bias", f"kind={kind}", *(f"{j}={v}" for j, v in enumerate(cast)), f"size={around[0]}", f"left={around[1]}", f"right={around[2]}"]


def train(patterns_: list[Pattern], counts: np.ndarray, rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic span classifier on the estimated probabilities."""
    target, _ = estimate(patterns_, counts)
    names = sorted({f for p in patterns_ for f in _features(p)})
    place = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(patterns_), len(names)))
    for row, p in enumerate(patterns_):
        x[row, [place[f] for f in _features(p)]] = 1
    weight = np.sqrt(counts) / np.sqrt(counts).sum()
    w = np.zeros(len(names))
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (weight * (target - guess)) - 1e-4 * w)
    return dict(zip(names, w.tolist(), strict=True))


def span_classifier(docs: DataFrame) -> dict[str, float]:
    """Trained on all vote patterns of the corpus."""
    rows = documents(docs).select("text").mapInArrow(_patterns, "kind string, votes array<int>, around string, n long")
    found = rows.groupBy("kind", "votes", "around").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "around").collect()
    items = [(r.kind, tuple(r.votes), r.around) for r in found]
    return train(items, np.array([r.n for r in found], dtype=float)) if items else {}


def probable(weights: dict[str, float], item: Pattern) -> bool:
    score = sum(weights.get(f, 0.0) for f in _features(item))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) >= THRESHOLD


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_EMPTY = hashlib.sha256(b"").hexdigest()


def _find(model):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in (*BASE, "base_sha256", "spans", "masked")}
            for text in batch.column("text").to_pylist():
                base = [(a, b, kind) for a, b, kind, passes in base_matches(text) if passes] if text else []
                more = [s for s in proposals(text, base) if probable(weights, pattern(text, *s, True))] if text else []
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base
                for kind in BASE:
                    columns[kind].append(sum(s[2] == kind for s in base))
                columns["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest() if base else _EMPTY)
                columns["spans"].append(_listed(every))
                columns["masked"].append(masked(text, every) if every else text)
            result = {name: batch.column(name) for name in batch.schema.names}
            result |= {f"n_{kind}": pa.array(columns[kind], pa.int64()) for kind in BASE}
            result |= {name: pa.array(columns[name], pa.string()) for name in ("base_sha256", "spans", "masked")}
            yield pa.RecordBatch.from_pydict(result)

    return find


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or spans that overlap, replaced by the kind's name."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts.append(f"{text[at:start]}[{kind.upper()}]")
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_personal_data(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: counts of the base kinds, a digest of the base spans, all spans, and the masked text."""
    weights = span_classifier(df)
    docs = documents(df, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += "".join(f", n_{kind} long" for kind in BASE) + ", base_sha256 string, spans string, masked string"
    return docs.mapInArrow(_find(df.sparkSession.sparkContext.broadcast(weights)), schema)
