"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z
lower-cased.  A polynomial over the bytes, taken from running sums, gives each
word's hash; a finaliser mixes it; five mixed words in a row make a shingle.
A text of one to four words is one shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are hashed at once (some ten times as much memory).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers of the places in a shingle, by rule.
_PLACES = [pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(WIDTH)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U), np.ones(0, _U))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            row = np.full(n + 1024, base, _U)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and each text's first place in them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < n]
    first[starts_of_texts] = word[starts_of_texts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_of_texts = offsets[1:][offsets[1:] > 0] - 1
    last[ends_of_texts] = word[ends_of_texts]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers_to(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin])
    return hashes, np.searchsorted(begin, offsets)


def shingles_of(hashes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The shingles of each text in order, repeats included."""
    n = len(hashes)
    if n >= WIDTH:
        total = np.zeros(n - WIDTH + 1, _U)
        for k in range(WIDTH):
            total += hashes[k : n - WIDTH + 1 + k] * _U(_PLACES[k])
        runs = mix(total)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            yield runs[a : b - WIDTH + 1]
        elif b > a:
            total = np.full(1, b - a, _U)
            for k in range(b - a):
                total = total * _U(_PLACES[1]) + hashes[a + k : a + k + 1] * _U(_PLACES[k])
            yield mix(total)
        else:
            yield np.zeros(0, _U)


def shingle_texts(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text of an Arrow string or binary array; null: none."""
    texts = texts.cast(pa.large_binary())
    low = 0
    while low < len(texts):
        rest = texts.slice(low)
        offsets = np.frombuffer(rest.buffers()[1], np.int64)[rest.offset : rest.offset + len(rest) + 1]
        high = max(1, int(np.searchsorted(offsets, offsets[0] + CHUNK_BYTES)) - 1)
        offsets = offsets[: high + 1]
        buffer = rest.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
        hashes, at = word_hashes(data, offsets - offsets[0])
        yield from shingles_of(hashes, at)
        low += high


def shingle_strings(texts: list[str | None]) -> list[np.ndarray]:
    return list(shingle_texts(pa.array(texts, pa.large_string())))
