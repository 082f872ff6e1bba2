"""Token ids of whole texts with the word-level BPE vocabulary, a distinct word encoded once.

The tokenizer splits at white space and between letters, single digits and other signs, and encodes each part by itself,
in lower case. Parts of plain Latin text are therefore cut out and hashed as arrays, and only new parts go to the tokenizer.
A word with anything else in it (other scripts, combining marks, apostrophes, control characters, ``<|``) goes to it whole.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from threatloom.llm import words
from threatloom.llm.words import SPACES, mix

#: Distinct parts, and ids of these, that a worker remembers before it starts anew.
CACHE_PARTS = 1 << 20
CACHE_IDS = 1 << 23
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    for code in range(0x21, 0x7F):
        sign = chr(code)
        kinds[code] = _LETTER if sign.isalpha() else _DIGIT if sign.isdigit() else _SIGN
    kinds[ord("'")] = _OTHER
    kinds[list(SPACES)] = 0
    return kinds


_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _byte_signs() -> dict[int, str]:
    """The sign by which the byte-level vocabulary writes each byte: its own if printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """The same values with room for ``size``, at least doubled."""
    if size <= len(values):
        return values
    larger = np.zeros(max(size, 2 * len(values)), dtype=values.dtype)
    larger[: len(values)] = values
    return larger


class Encoder:
    """Ids of texts; keeps those of the parts seen so far, in arrays only: about 40 bytes a part."""

    #: Places in the first look-up table, one per value of the hash's low bits.
    SLOTS = 1 << 19

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # ascending
        self.places = np.zeros(0, dtype=np.int32)
        self.slot_hash = np.zeros(self.SLOTS, dtype=np.uint64)
        self.slot_place = np.zeros(self.SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.begins = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int32)

    def _learn(self, hashes: np.ndarray, parts: list[bytes], odd: list[bool]) -> None:
        model, signs, found = self.tokenizer.model, _byte_signs(), []
        for part, whole in zip(parts, odd, strict=True):
            text = part.decode()
            if whole:
                found.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            text = text.lower()
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(signs)
            found.append([token.id for token in model.tokenize(text)])
        first, last = len(self.hashes), len(self.hashes) + len(parts)
        lengths = np.array([len(x) for x in found], dtype=np.int64)
        total = int(lengths.sum())
        self.begins, self.lengths = _grown(self.begins, last), _grown(self.lengths, last)
        self.ids = _grown(self.ids, self.used + total)
        self.ids[self.used : self.used + total] = [i for x in found for i in x]
        self.begins[first:last] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.used += total
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.places = np.insert(self.places, at, np.arange(first, last, dtype=np.int32))

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes stand among those seen so far, and which do."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        return at, known

    def _look_up(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray, data: np.ndarray) -> np.ndarray:
        slots = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        place = self.slot_place[slots].astype(np.int64)
        missed = np.flatnonzero(self.slot_hash[slots] != hashes)
        if len(missed):
            unique, at, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            fresh = np.flatnonzero(~self._known(unique)[1])
            if len(fresh):
                raw, where = data.tobytes(), missed[at[fresh]]
                begins, closes = starts[where].tolist(), ends[where].tolist()
                self._learn(unique[fresh], [raw[a:b] for a, b in zip(begins, closes, strict=True)], odd[where].tolist())
            found = self.places[self._known(unique)[0]]
            place[missed] = found[inverse]
            slots = (unique & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.slot_hash[slots], self.slot_place[slots] = unique, found
        return place

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 bounds."""
        starts, ends, hashes, odd = _parts(data, offsets)
        if len(self.hashes) > CACHE_PARTS or self.used > CACHE_IDS:
            self.forget()
        place = self._look_up(hashes, starts, ends, odd, data)
        lengths = self.lengths[place]
        totals = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(totals[-1]) + np.repeat(self.begins[place] - totals[:-1], lengths)
        return self.ids[take], totals[np.searchsorted(starts, offsets)]


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the parts that are encoded by themselves, and which need the whole tokenizer."""
    n = len(data)
    kinds, lowered = _KINDS[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, dtype=np.int64)
    second = data[lead + 1]
    latin = (second >= 0x80) & (second != 0x97) & (second != 0xB7)  # letters of U+00C0..U+00FF
    lead, second = lead[latin], second[latin]
    kinds[lead] = kinds[lead + 1] = _LETTER
    lowered[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
    marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if n else lead
    kinds[marks] = _OTHER
    word = np.zeros(n, dtype=bool)  # where a word begins
    filled = kinds > 0
    word[:1] = filled[:1]
    word[1:] = filled[1:] & ~filled[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    word[inner] = filled[inner]
    begins = np.flatnonzero(word)
    whole = np.logical_or.reduceat(kinds == _OTHER, begins) if len(begins) else np.zeros(0, dtype=bool)
    part = word.copy()
    part[1:] |= filled[1:] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT))
    number = np.cumsum(word) - 1
    odd = np.zeros(n, dtype=bool)
    if len(begins):
        odd = whole[np.maximum(number, 0)] & filled
    part &= ~odd | word
    starts = np.flatnonzero(part)
    # A part ends before the next one, or before white space, or with its text.
    stop = ~filled
    stop[starts] = True
    stops = np.append(np.flatnonzero(stop), n)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    read = np.where(odd, data, lowered)
    words._POWERS.at_least(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words._BYTE_VALUES[read] * words._POWERS.up[:n], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * words._POWERS.down[starts]), odd[starts]
