"""Weighted minwise signatures by dart throwing.

Every element owns a region as high as its weight; darts fall on it as a Poisson
process in time, seeded by the element alone. A dart picks one of ``k``
coordinates, and each coordinate keeps the earliest dart it got. Two weighted
sets keep the same dart in a coordinate with a probability equal to their
weighted Jaccard similarity. Only the first ``k (ln k + 3)`` darts or so of a set
are thrown, however many elements it has; a set that leaves a coordinate empty
throws for longer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


class Shingler:
    """Hashed word shingles with their counts; word hashes are cached, ``most`` of them."""

    def __init__(self, width: int = 5, most: int = 300_000):
        self.width, self._most = width, most
        self._cache: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        """One hash per window of ``width`` words; fewer words are one window."""
        cache = self._cache
        found = list(map(cache.get, words))
        if None in found:
            if len(cache) > self._most:
                cache.clear()
            for at, value in enumerate(found):
                if value is None:
                    word = words[at]
                    found[at] = cache[word] = xxhash.xxh3_64_intdigest(word)
        h = np.array(found, dtype=np.uint64)
        n = min(self.width, len(h))
        if not n:
            return h
        size = len(h) - n + 1
        total = np.full(size, n, dtype=np.uint64)
        for i in range(n):
            total = total * _GOLD + h[i : i + size]
        return mix(total)

    def weighted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(self.hashes(words), return_counts=True)
        return values, counts.astype(np.float64)


@dataclass(frozen=True)
class Darts:
    """``bands`` bands of ``rows`` coordinates."""

    bands: int = 32
    rows: int = 7
    seed: int = 1

    @property
    def k(self) -> int:
        return self.bands * self.rows

    def signatures(self, sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of ``k`` dart names per non-empty weighted set."""
        out = np.zeros((len(sets), self.k), dtype=np.uint64)
        todo, patience = np.arange(len(sets)), math.log(self.k) + 3
        while len(todo):
            rank, names = self._throw([sets[i] for i in todo], patience)
            full = np.isfinite(rank).all(axis=1)
            out[todo[full]] = names[full]
            todo, patience = todo[~full], patience * 2
        return out

    def _throw(self, sets: list[tuple[np.ndarray, np.ndarray]], patience: float) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(sets), self.k
        elements = np.concatenate([e for e, _ in sets])
        weights = np.concatenate([w for _, w in sets])
        sizes = [len(e) for e, _ in sets]
        owner = np.repeat(np.arange(n), sizes)
        until = k * patience / np.bincount(owner, weights, minlength=n)
        # One cell per unit of weight, the last one cut to the remaining height.
        cells = np.ceil(weights).astype(np.int64)
        first = np.repeat(np.cumsum(cells) - cells, cells)
        level = np.arange(cells.sum()) - first
        cell = mix(np.repeat(elements, cells) + mix((level + 1 + (self.seed << 32)).astype(np.uint64)))
        height = np.minimum(np.repeat(weights, cells) - level, 1.0)
        owner = np.repeat(owner, cells)
        time = np.zeros(len(cell))
        best, names = np.full(n * k, np.inf), np.zeros(n * k, dtype=np.uint64)
        throw = 0
        while len(cell):
            throw += 1
            dart = mix(cell + _U(throw * int(_GOLD) % 2**64))
            time = time - np.log(uniform(dart))
            flying = time <= until[owner]
            if not flying.all():
                cell, height, owner, time, dart = cell[flying], height[flying], owner[flying], time[flying], dart[flying]
            if not len(cell):
                break
            aim = mix(dart + _GOLD)
            place = owner * k + (aim % _U(k)).astype(np.int64)
            at, name = time, aim
            if (height < 1).any():
                hit = uniform(mix(aim + _GOLD)) <= height
                place, at, name = place[hit], time[hit], aim[hit]
            np.minimum.at(best, place, at)
            won = best[place] == at
            names[place[won]] = name[won]
        return best.reshape(n, k), names.reshape(n, k)

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, different for every band."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows)
        keys = np.repeat(np.arange(1, self.bands + 1, dtype=np.uint64)[None, :], len(signatures), axis=0)
        for i in range(self.rows):
            keys = mix(keys * _GOLD + parts[:, :, i])
        return keys.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted weighted sets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    common = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))
