"""Hashes of word shingles, many texts at a time in numpy.

Words are runs of bytes other than space and tab to carriage return (0x20, 0x09
to 0x0D), with A-Z lower-cased. A text's shingles are its windows of five words;
a text of one to four words has one shingle, the whole sequence; one without
words has none. Each shingle is a 64-bit hash of its words in order.
"""

from __future__ import annotations

import numpy as np

from observatory.llm.arrow import PASS_BYTES

WORDS = 5

_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 2**63, WORDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PASS_BYTES + 4096)
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    n = len(raw)
    texts = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = solid[edges]
    final = solid.copy()
    final[:-1] &= ~solid[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    final[edges] = solid[edges]
    start, stop = np.flatnonzero(first), np.flatnonzero(final) + 1
    power, inverse = _power(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * power, out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending, text after text; their bounds)."""
    word, count = words(raw, offsets)
    texts = len(count)
    begin = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(texts), np.maximum(count - WORDS + 1, 0))
    at = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(count - WORDS + 1, 0))[:-1]]), np.maximum(count - WORDS + 1, 0)) + begin[owner]
    full = np.zeros(len(at), dtype=np.uint64)
    for k in range(WORDS):
        full += word[at + k] * _PLACE[k]
    full = mix(full)
    few = np.flatnonzero((count > 0) & (count < WORDS))
    short = np.zeros(len(few), dtype=np.uint64)
    for k in range(WORDS - 1):
        has = count[few] > k
        short[has] += word[begin[few[has]] + k] * _PLACE[k]
    short = mix(short + _SHORT[count[few]])
    found = np.concatenate([full, short])
    owner = np.concatenate([owner, few])
    if not len(found):
        return found, np.zeros(texts + 1, np.int64)
    order = np.argsort(found)
    order = order[np.argsort(owner[order].astype(np.uint16 if texts < 65536 else np.int64), kind="stable")]
    found, owner = found[order], owner[order]
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[keep], np.searchsorted(owner[keep], np.arange(texts + 1))
