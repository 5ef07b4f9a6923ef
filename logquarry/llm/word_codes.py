"""64-bit codes of words and of short word n-grams, for many texts at once in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. Codes find candidates only: what they find is compared on the words
themselves before it counts. A word's code sums its eight-byte limbs, each mixed under a key of its place; an n-gram's
code is a polynomial over its words' codes. Prefix sums give every n-gram's code in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text coded at once.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What is kept of a limb of which so many bytes belong to the word.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        grown = []
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            grown.append(np.cumprod(factors, dtype=np.uint64))
        _powers = tuple(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    powers, _ = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers[: len(codes)], dtype=np.uint64, out=sums[1:])
    return sums


def range_codes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the runs [start, end) of what ``sums`` was made of."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _LENGTH)


def word_codes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of ``texts``, one after the other, and where each text's words begin; its end last."""
    raw = b"\n".join(texts) + b"\n"
    raw = (raw.lower() if lower else raw) + bytes(8)
    space = _SPACE[np.frombuffer(raw, np.uint8, len(raw) - 8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    if not len(start):
        return np.zeros(0, np.uint64), bounds
    limbs = (end - start + 7) >> 3
    first = np.cumsum(limbs) - limbs
    word = np.repeat(np.arange(len(start)), limbs)
    nth = np.arange(len(word)) - first[word]
    at = start[word] + 8 * nth
    values = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[at] & _MASK[np.minimum(end[word] - at, 8)]
    mixed = mix(values ^ mix((nth + 1).astype(np.uint64) * _BASE))
    return mix(np.add.reduceat(mixed, first) + (end - start).astype(np.uint64) * _LENGTH), bounds


def chunks(texts: list[bytes]) -> Iterator[slice]:
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct codes of n lower-cased words; of the whole sequence where there are fewer; or none."""
    out: list[np.ndarray] = []
    for part in chunks(texts):
        codes, at = word_codes(texts[part], lower=True)
        sums = prefix_sums(codes)
        starts = np.arange(max(0, len(codes) - n + 1))
        grams = range_codes(sums, starts, starts + n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(range_codes(sums, np.array([a]), np.array([b])))
            else:
                out.append(grams[:0])
    return out


def shingles(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves of a text whose letters are lower-cased already."""
    words = text.split()
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} if words else set()
