"""Hashes of the words of many texts at once, in arrays."""

from __future__ import annotations

import numpy as np

_MULTIPLIER, _WORD_MULTIPLIERS = np.uint64(0xD6E8FEB86659FD93), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64)  # a fixed random table
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _inverse(multiplier: np.uint64) -> np.uint64:
    return np.uint64(pow(int(multiplier), -1, 2**64))


def powers(multiplier: np.uint64, size: int) -> np.ndarray:
    """The first ``size`` powers of a multiplier modulo 2**64; the tables grow with the longest text seen."""
    table = _powers.get(int(multiplier))
    if table is None or len(table) < size:
        table = np.full(max(size, 4096), multiplier, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[int(multiplier)] = table
    return table[:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(multiplier, len(values)), out=out[1:])
    return out


def word_hashes(text: str, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, with A to Z lower-cased if asked for."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    space = _SPACE[raw]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = (turns[1::2], turns[::2]) if not space[0] else (turns[::2], turns[1::2])
    if not space[0]:
        starts = np.concatenate(([0], starts))
    if not space[-1]:
        ends = np.concatenate((ends, [len(raw)]))
    sums = _sums(_BYTES[_LOWER[raw] if lower else raw], _MULTIPLIER)
    unshift = powers(_inverse(_MULTIPLIER), len(raw) + 1)
    return mixed((sums[ends] - sums[starts]) * unshift[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive words; ``which`` (0 or 1) chooses one of two independent functions."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    multiplier = _WORD_MULTIPLIERS[which]
    sums = _sums(words, multiplier)
    return mixed((sums[size:] - sums[:n]) * powers(_inverse(multiplier), n) + np.uint64(size))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit values, as Spark's long has them."""
    return x.view(np.int64)
