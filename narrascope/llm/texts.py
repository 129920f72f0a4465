"""Small helpers on one text inside a task: code points, letters, hashed character and word grams.

All hashes are 64-bit and made by array arithmetic that wraps around, so a text costs a few passes over an
array instead of a Python step per character.
"""

from __future__ import annotations

import functools

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of SplitMix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@functools.cache
def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 0x20


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of the text in order, A-Z lower-cased first."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if lower:
        raw = LOWER_BYTES[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE_BYTES[raw], [True])).view(np.int8)))
    if not len(edges):
        return np.empty(0, dtype=np.uint64)
    starts, ends = edges[0::2], edges[1::2]
    # Sum of mixed (byte, place in the word) pairs, mixed again with the length.
    begin = np.zeros(len(raw), dtype=np.int64)
    begin[starts] = starts
    place = (np.arange(len(raw)) - np.maximum.accumulate(begin)).astype(np.uint64)
    values = mix(_byte_table()[raw] + place * _ODD)
    values[SPACE_BYTES[raw]] = 0
    sums = np.add.reduceat(values, starts)
    return mix(sums + (ends - starts).astype(np.uint64) * _MIX[0])


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words; none if there are fewer words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    found = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        found = mix(found * _ODD + words[i:i + count])
    return found


def char_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` code points."""
    count = len(codes) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    found = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        found *= _ODD
        found += codes[i:i + count]
        found ^= found >> np.uint64(29)
    return found * _MIX[0]
