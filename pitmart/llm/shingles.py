"""Word shingle sets as arrays of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 60, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(int(_RNG.integers(1 << 60, 1 << 62)) * 2 + 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, first word of each text and the end); A-Z count as a-z."""
    whole = b" ".join(texts).lower() + b" "
    b = np.frombuffer(whole, dtype=np.uint8)
    space = _SPACE[b]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], word[:-1])))
    power, inverse = _powers(len(b))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * power[: len(b)])))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Distinct hashes, in order, of the runs of `width` words of each text; of all its words where they are fewer."""
    hashes, bounds = word_hashes(texts)
    runs = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        runs = runs * _STEP + hashes[k : k + len(runs)]
    runs = mix(runs)
    out = []
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if z - a >= width:
            out.append(np.unique(runs[a : z - width + 1]))
        elif z > a:
            h = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:z]:
                    h = h * _STEP + x
            out.append(mix(np.array([h], dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def content_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse): (sums[z] - sums[a]) * inverse[a] depends on the bytes a to z alone, whatever stands before."""
    power, inverse = _powers(len(b) + 1)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * power[: len(b)]))), inverse
