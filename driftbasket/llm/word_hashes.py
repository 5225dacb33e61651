"""64-bit hashes of all words of many texts at once, with numpy: no loop over words.

A word's bytes b0 b1 ... hash to sum T[bi] P^i (mod 2^64), then a finalizer; T is a fixed random table and P odd.
Prefix sums over the joined texts give each word's sum times P^start, and P has an inverse mod 2^64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]  # A-Z is lower-cased
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_NEXT_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Powers that are kept, of each base; a longer word has its own.
MOST_POWERS = 1 << 22
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), doubling what is there."""
    got = _powers.get(base, np.ones(1, np.uint64))
    while len(got) < n:
        got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
    _powers[base] = got[:MOST_POWERS]
    return got[:n]


def hashed_words(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    r"""Slices of whole texts: the hashes of their words [^\x20\x09-\x0D]+, A-Z lower-cased, one text after
    another, and how many words each text has. A text of more than `size` bytes is a slice of its own, read in pieces."""
    held, length = [], 0
    for t in texts:
        held.append(t.encode("utf-8", "surrogatepass"))
        if len(held[-1]) > size:
            long = held.pop()
            if held:
                yield _hashed(held)
            words = np.concatenate([_hashed([x])[0] for x in _pieces(long, size)])
            yield words, np.array([len(words)])
            held, length = [], 0
            continue
        length += len(held[-1]) + 1
        if length >= size:
            yield _hashed(held)
            held, length = [], 0
    if held:
        yield _hashed(held)


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about `size` bytes, cut at white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        cut = _NEXT_WHITE.search(text, at + size)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, counts, _, _, _ = located_words(texts)
    return words, counts


def located_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, words per text, the texts' joined bytes, and where each word starts and ends there."""
    octets = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    white = _IS_WHITE[octets]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(octets) and not white[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(_TABLE[octets] * _power(_P, len(octets)), out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(octets) + 1)[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    return words, counts, octets, starts, ends
