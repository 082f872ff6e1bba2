"""Words of whole texts as numpy arrays, read straight from Arrow string buffers.

Texts are never turned into Python strings here: word borders come from a byte table, word hashes from
prefix sums, and hashes of word windows from doubling steps, so a task's cost is a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are held at once; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


@cache
def _inverse() -> np.uint64:
    return np.uint64(pow(int(_ODD), -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def at_least(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            for name, base in (("up", _ODD), ("down", _inverse())):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS = _Powers()


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words and how a byte is read."""

    is_word: np.ndarray
    read_as: np.ndarray

    def __hash__(self) -> int:
        return id(self)


def alphabet(separators: bytes, lower: bool = False) -> Alphabet:
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    read_as = np.arange(256, dtype=np.uint8)
    if lower:
        read_as[65:91] += 32
        is_word[65:91] = is_word[97:123]
    return Alphabet(is_word, read_as)


SPACES = b" \t\n\x0b\x0c\r"
#: Runs of anything but ASCII white space, as they are or with A-Z lowered.
SPACED = alphabet(SPACES)
SPACED_LOWER = alphabet(SPACES, lower=True)
#: Runs of digits, letters a-z (A-Z lowered) and all characters beyond ASCII.
ALNUM_LOWER = alphabet(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


@dataclass
class Chunk:
    """Some whole texts: rows first..first+n, their bytes, where each begins, and their words."""

    first: int
    data: np.ndarray
    offsets: np.ndarray  # n + 1 places in data
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # n + 1 places among the words

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, places, data = column.buffers()
    if places is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def _chunk(raw: np.ndarray, offsets: np.ndarray, first: int, last: int, letters: Alphabet) -> Chunk:
    begin, end = offsets[first], offsets[last]
    data, local = raw[begin:end], offsets[first : last + 1] - begin
    n = len(data)
    is_word = letters.is_word[data]
    opens, closes = is_word.copy(), is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes[:-1] &= ~is_word[1:]
    inner = local[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    opens[inner] = is_word[inner]
    closes[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    _POWERS.at_least(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[letters.read_as][data] * _POWERS.up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _POWERS.down[starts])
    return Chunk(first, data, local, starts, ends, hashes, np.searchsorted(starts, local))


def chunks(column: pa.Array, letters: Alphabet, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of a string column, some whole texts at a time."""
    raw, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield _chunk(raw, offsets, first, last, letters)
        first = last


def windows(hashes: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C55) -> np.ndarray:
    """Hash of every k consecutive word hashes (windows that cross texts included); length n - k + 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, value, width = base, hashes, 1
    result, done, rest = None, 0, k
    while True:
        if rest & 1:  # this block of `width` words stands behind the `done` words taken so far
            part = value[done : done + n]
            result = part.copy() if result is None else result * np.uint64(power) + part
            done += width
        rest >>= 1
        if not rest:
            return mix(result)
        value = value[: len(value) - width] * np.uint64(power) + value[width:]
        power = power * power % (1 << 64)
        width *= 2


def inside(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words lie within one text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + k <= ends


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask of n words that lie in [start, start + length) for any start."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:n]) > 0
