"""Words, 64-bit word hashes and shingle hashes of one text, as numpy arrays.

All functions work on UTF-8 bytes: the separators of every contract here are ASCII, so a byte-wise
cut never splits a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACED = np.ones(256, bool)
SPACED[list(_SPACES)] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Seeds of the two independent halves of a 128-bit hash.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_PERIOD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(1, 257 + _PERIOD, dtype=np.uint64) * _U(seed)
    values = mix(steps)
    return values[:256], values[256:] | _U(1)


_TABLES = {seed: _tables(seed) for seed in SEEDS}


def spans(data: bytes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of every maximal run of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    value, power = _TABLES[seed]
    lengths = ends - starts
    first = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at = np.arange(lengths.sum())
    raw = np.frombuffer(data, np.uint8)[first + at]
    place = at - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.add.reduceat(value[raw] * power[place % _PERIOD], np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * _U(seed))


def word_hashes(data: bytes, word: np.ndarray = SPACED, seed: int = SEEDS[0]) -> np.ndarray:
    return hash_spans(data, *spans(data, word), seed)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values; a plain sort is several times faster here than a hash-based unique."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def windows(hashes: np.ndarray, width: int, seed: int = SEEDS[0]) -> np.ndarray:
    """The hash of every run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _U(seed | 1) + hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, width: int, seed: int = SEEDS[0]) -> np.ndarray:
    """Distinct window hashes in ascending order; a shorter text is one window of its own length."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return distinct(windows(hashes, min(width, len(hashes)), seed))


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes, one text copied at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (value.as_py() for value in column.cast(kind))
