"""Hashed words and n-grams of a text, with numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

# Units handled at once, so that a very long text needs little memory.
SLICE = 1 << 20
_FACTORS = [np.uint32(f) for f in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]


def byte_grams(data: bytes, lengths: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets, below ``2 ** bits``, of all byte n-grams of the given lengths (5 at most)."""
    return grams(np.frombuffer(data, np.uint8), lengths, bits)


def character_grams(text: str, lengths: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The same of n-grams of code points."""
    return grams(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), lengths, bits)


def grams(whole: np.ndarray, lengths: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    shift = np.uint32(32 - bits)
    for at in range(0, max(len(whole), 1), SLICE):
        part = whole[at:at + SLICE + max(lengths) - 1].astype(np.uint32) + np.uint32(1)
        taken = min(SLICE, len(whole) - at)  # starts in this slice
        mixed = np.zeros(len(part), np.uint32)
        for n in range(1, max(lengths) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            mixed = mixed[:size] * _FACTORS[4] + part[n - 1:] * _FACTORS[n - 1]
            if n in lengths:
                spread = mixed[:taken] ^ (mixed[:taken] >> np.uint32(15))
                yield (spread * _FACTORS[1]) >> shift


def word_buckets(data: bytes, bits: int) -> np.ndarray:
    """Buckets of the words between ASCII white space and of neighbouring pairs. A pair goes by
    the difference of its hashes, so a word said twice is one feature, whatever the word."""
    crc = np.array([zlib.crc32(w) for w in data.split()], np.uint32)
    both = np.concatenate((crc, np.diff(crc) ^ _FACTORS[3]))
    return (both * _FACTORS[0]) >> np.uint32(32 - bits)
