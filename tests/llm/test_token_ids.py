"""The encoder's memory of word parts: bounded, and in arrays."""

import tracemalloc

import numpy as np

from threatloom.llm import token_ids
from threatloom.llm.queries import tokenizer_path


def _encode(encoder: token_ids.Encoder, texts: list[str]) -> list[list[int]]:
    raw = [text.encode() for text in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, bounds = encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def _word(n: int) -> str:
    return "".join(chr(97 + n // 26**k % 26) for k in range(5))


def test_a_remembered_part_costs_few_bytes():
    encoder = token_ids.Encoder(tokenizer_path())
    _encode(encoder, ["warm up"])
    tracemalloc.start()
    try:
        for first in range(0, 100_000, 10_000):
            _encode(encoder, [" ".join(map(_word, range(first, first + 10_000)))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 80 * 100_000


def test_parts_are_forgotten_by_their_number_and_by_their_ids(monkeypatch):
    texts = [f"{_word(n)} it's-{n} Über{_word(7 * n)}" for n in range(300)]
    whole = _encode(token_ids.Encoder(tokenizer_path()), texts)
    for name, most in (("CACHE_PARTS", 100), ("CACHE_IDS", 150)):
        monkeypatch.undo()
        monkeypatch.setattr(token_ids, name, most)
        encoder = token_ids.Encoder(tokenizer_path())
        assert [_encode(encoder, [text])[0] for text in texts] == whole
        assert encoder.used < 400
    tokenizer = token_ids._tokenizer(tokenizer_path())
    assert whole == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
