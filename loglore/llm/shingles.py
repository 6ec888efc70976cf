"""Hashes of words and shingles of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: A-Z to a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased word, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    borders = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, borders), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), _MUL, np.uint64))
    letters = np.flatnonzero(inside)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = _BYTES[_LOWER[data[letters]]] * powers[place]
    first = np.cumsum(lengths) - lengths
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text.

    A text of fewer than `size` words has its whole sequence as one, without words it has none.
    """
    words, counts = word_hashes(texts)
    out, at = [], 0
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * _MUL + words[k : len(words) - size + 1 + k]
        rolled = mix(rolled)
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            whole = np.uint64(n)
            for w in words[at : at + n]:
                whole = mix(np.array([whole]))[0] ^ w
            out.append(mix(np.array([whole])))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
