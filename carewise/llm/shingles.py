"""Word shingles of whole texts as 64-bit hashes, with array arithmetic over the bytes.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's hash is a
polynomial in a random value per byte modulo 2^64, taken from running sums over all texts of a
batch; shingle hashes mix the hashes of adjacent words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# Batches up to this size share their tables of powers.
BATCH = 1 << 19


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    upper = np.arange(65, 91)
    values[upper] = values[upper + 32]
    return values


def geometric(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


@lru_cache(maxsize=2)
def _short_powers(base: int) -> np.ndarray:
    return geometric(base, BATCH)


def powers_of(base: int, count: int) -> np.ndarray:
    return _short_powers(base)[:count] if count <= BATCH else geometric(base, count)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _IS_SPACE[data]
    edges = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    values = byte_values(seed)[data]
    values[space] = 0
    lengths = ends - starts
    if len(lengths) and lengths.max() > 0:
        # the sum over a word, moved back to its start
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values * powers_of(_BASE, len(data)), out=sums[1:])
        down = powers_of(_INVERSE, len(data))
        hashes = (sums[ends] - sums[starts]) * down[starts]
    else:
        hashes = np.zeros(0, dtype=np.uint64)
    hashes = mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    borders = np.cumsum(sizes + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, borders))))
    return hashes, counts


def shingle_sets(texts: list[str | None], width: int, seed: int = 0) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], seed)
    stops = np.cumsum(counts)
    runs = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        own = words[k:]
        runs[: len(own)] += own * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    runs = mix(runs)
    out = []
    for stop, n in zip(stops.tolist(), counts.tolist()):
        start = stop - n
        if n >= width:
            own = np.sort(runs[start:stop - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            short = words[start:stop] * np.array([pow(0x9FB21C651E98DF25, k + 1, 1 << 64) for k in range(n)], dtype=np.uint64)
            out.append(mix(np.array([short.sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
