"""Hashed word shingles of many texts at once, for tasks that read batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_MULTIPLIERS = [U(x | 1) for x in _RANDOM.integers(0, 2**64, 8, dtype=np.uint64)]
#: Bytes of text that are hashed at once, if they are of several texts.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of blank-separated bytes that end with a blank."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data]] * _power(_BASE, len(data)))))
    return mix((sums[end] - sums[start]) * _power(_INVERSE, len(data))[start]), start


def shingle_hashes(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its word shingles in order; of a text with fewer words, one of the whole; none without words."""
    at = 0
    while at < len(texts):
        raw, total, first = [], 0, at
        while at < len(texts) and (not raw or total < CHUNK):
            raw.append((texts[at] or "").encode() + b" ")
            total += len(raw[-1])
            at += 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        words, starts = _word_hashes(data)
        ends = np.searchsorted(starts, np.cumsum([len(r) for r in raw]))
        joined = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            joined += words[k : k + len(joined)] * _MULTIPLIERS[k]
        joined, begin = mix(joined), 0
        for end in ends[: at - first]:
            if end - begin >= size:
                yield joined[begin : end - size + 1]
            elif end > begin:
                whole = sum(int(words[begin + k]) * int(_MULTIPLIERS[k]) for k in range(end - begin)) + int(end - begin)
                yield mix(np.array([whole % 2**64], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            begin = end
