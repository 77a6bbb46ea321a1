"""Content-defined anchors: a thin, exact index of all windows of a sequence.

Every window of ``width`` units has one anchor: the leftmost position with the least gram hash among its first ``reach``
positions. That depends on the window's content alone, so equal windows have anchors at the same place inside
them. Consecutive windows mostly share an anchor; such a run is a *record*. Two windows can only be equal if
the ``width - reach + 1`` units from their anchors on (the record's *prefix*) are equal too, whatever surrounds them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from filigree.llm.words import SEEDS, mix, windows

_U = np.uint64
_PLACE = 30  # bits of a position in the sort key of the sliding minimum


class Records(NamedTuple):
    low: np.ndarray  # first window start of each record
    high: np.ndarray  # last window start, inclusive
    anchor: np.ndarray


class Hasher:
    """Hashes of any ranges of one sequence in constant time each, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, seed: int) -> None:
        base = (seed * 2 + 5) & 0xFFFFFFFFFFFFFFFF | 1
        inverse = pow(base, -1, 1 << 64)
        n = len(values)
        power = np.ones(n + 1, np.uint64)
        back = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, base, np.uint64), out=power[1:])
        np.cumprod(np.full(n, inverse, np.uint64), out=back[1:])
        self.back = back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(values ^ _U(seed)) * power[:-1], out=self.sums[1:])
        self.seed = _U(seed)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * self.seed)


def records(values: np.ndarray, width: int, reach: int, gram: int) -> Records:
    """The records of a sequence of hashed units; none if it is shorter than one window. ``reach + gram - 1 <= width``."""
    n = len(values) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Records(none, none, none)
    grams = windows(values, gram)[: n + reach - 1]
    least = (grams >> _U(_PLACE)) << _U(_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least[:n] & _U((1 << _PLACE) - 1)).astype(np.int64)
    low = np.flatnonzero(np.diff(anchor, prepend=-1))
    return Records(low, np.append(low[1:], n) - 1, anchor[low])


def keys(values: np.ndarray, found: Records, width: int, reach: int, seeds: tuple[int, ...] = SEEDS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each seed, the hash of each record's prefix, and of the whole record with the anchor's place in it."""
    prefixes, wholes = [], []
    for seed in seeds:
        h = Hasher(values, seed)
        prefixes.append(h.of(found.anchor, found.anchor + (width - reach + 1)))
        wholes.append(mix(h.of(found.low, found.high + width) ^ (found.anchor - found.low).astype(np.uint64) * _U(seed)))
    return prefixes, wholes
