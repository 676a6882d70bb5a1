"""BagMinHash signatures of many multisets at once, in numpy.

For each element there is, for each weight interval [0,1), [1,2), [2,4), [4,8) ..., a Poisson process of events shared by all multisets;
an event has a time, a signature component and an integer level in its interval, all drawn from hashes of the element. A multiset that
holds an element ``w`` times sees the events whose level is under ``w``: the intervals under ``w`` entirely, the one that ``w`` cuts
thinned. A component is the earliest event seen there, so two multisets agree in a component with the probability of their weighted
Jaccard similarity. Processes are followed in rounds, and only as long as their next event can still be the earliest of a component.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` word hashes; a row of fewer words has one run of all of them, an empty one none."""
    words = words.astype(np.uint64, copy=False)
    lengths = np.diff(offsets)
    runs = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(lengths.dtype))
    rows = np.repeat(np.arange(len(lengths)), runs)
    first = np.repeat(offsets[:-1], runs) + np.arange(len(rows)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.minimum(lengths[rows], width)
    hashed = length.astype(np.uint64) * _GOLDEN
    with np.errstate(over="ignore"):
        for k in range(width):
            word = words[np.minimum(first + k, len(words) - 1)] if len(words) else words
            hashed = np.where(k < length, hashed * np.uint64(0x100000001B3) + mix(word + np.uint64(k + 1) * _GOLDEN), hashed)
        return rows, mix(hashed)


def bags(rows: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, with their counts."""
    order = np.lexsort((hashed, rows))
    rows, hashed = rows[order], hashed[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashed[at], np.diff(np.append(at, len(rows)))


def signatures(rows: np.ndarray, hashed: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Array (n, size) of unsigned 64-bit: the earliest event of each component. Rows without elements are all ones."""
    best = np.full((n, size), np.inf)
    flat = best.reshape(-1)
    r, h, w = rows, hashed, counts
    parts = [(r, mix(h), np.zeros(len(r), np.int64), np.ones(len(r), np.int64), w)]
    low = 1
    while len(w) and (more := w > low).any():
        r, h, w = r[more], h[more], w[more]
        with np.errstate(over="ignore"):
            parts.append((r, mix(h + np.uint64(low) * _GOLDEN), np.full(len(r), low), np.full(len(r), low), w))
        low *= 2
    row, seed, start, width, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, step = np.zeros(len(row)), 0
    with np.errstate(over="ignore"):
        while len(row):
            step += 1
            a = mix(seed + np.uint64(2 * step) * _GOLDEN)
            b = mix(seed + np.uint64(2 * step + 1) * _GOLDEN)
            time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * width)
            seen = start + ((b >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64) < weight
            place = row * size + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(flat, place[seen], time[seen])
            on = time < best.max(axis=1)[row]
            row, seed, start, width, weight, time = row[on], seed[on], start[on], width[on], weight[on], time[on]
    return best.view(np.uint64).copy()


def band_keys(signature: np.ndarray, bands: int, each: int) -> np.ndarray:
    """Array (rows, bands) of signed 64-bit keys."""
    out = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(each):
            out = mix(out * np.uint64(0x100000001B3) + signature[:, k : bands * each : each][:, :bands] + np.uint64(k + 1))
        out = mix(out + np.arange(bands, dtype=np.uint64)[None, :] * _GOLDEN)
    return out.view(np.int64)
