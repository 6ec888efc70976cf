"""Log-space forward and backward recursions over all segmentations of words into pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Words longer than this are worked off one by one, so many bytes at a time.
_LONG = 64
_BLOCK = 4096
_FIRST_BITS = 20


class Lattice:
    """Pieces (byte strings) with their natural-log probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        # Most runs of bytes are no piece: a look at the hash's first bits spares them the search.
        self.begun = np.zeros(1 << _FIRST_BITS, bool)
        self.begun[hashes >> np.uint64(64 - _FIRST_BITS)] = True
        self.logp = np.asarray(logp, np.float64)
        self.longest = max(map(len, pieces))
        self.sizes = {len(p) for p in pieces}

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Log of the sum, over all segmentations of a word, of the product of the pieces' probabilities."""
        out = np.empty(len(words))
        for rows, edges, n in self._groups(words):
            out[rows] = self._forward(edges, n, len(rows))[n]
        for row in _long_ones(words):
            out[row] = self._forward_of_one(np.frombuffer(words[row], np.uint8))[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, by the posterior of all segmentations, in so many copies of the words."""
        total = np.zeros(len(self.logp))
        for rows, edges, n in self._groups(words):
            alpha = self._forward(edges, n, len(rows))
            beta = np.full((n + 1, len(rows)), -np.inf)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                for end, at, piece in edges[i]:
                    beta[i, at] = np.logaddexp(beta[i, at], self.logp[piece] + beta[end, at])
            for i in range(n):
                for end, at, piece in edges[i]:
                    weight = np.exp(alpha[i, at] + self.logp[piece] + beta[end, at] - alpha[n, at])
                    total += np.bincount(piece, weight * counts[rows[at]], len(total))
        for row in _long_ones(words):
            total += counts[row] * self._expected_of_one(np.frombuffer(words[row], np.uint8))
        return total

    def _forward(self, edges: list, n: int, rows: int) -> np.ndarray:
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0.0
        for i in range(n):
            for end, at, piece in edges[i]:
                alpha[end, at] = np.logaddexp(alpha[end, at], alpha[i, at] + self.logp[piece])
        return alpha

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, list, int]]:
        """Short words of one length together: their rows, the pieces found at each place, the length."""
        lengths = np.array([len(w) for w in words], np.int64)
        for n in np.unique(lengths[lengths <= _LONG]).tolist():
            rows = np.flatnonzero(lengths == n)
            step = max(1, 1_000_000 // max(n, 1))
            for s in range(0, len(rows), step):
                some = rows[s : s + step]
                data = np.frombuffer(b"".join(words[r] for r in some), np.uint8).reshape(len(some), n)
                yield some, self._edges(data), n

    def _edges(self, data: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each place, the pieces that start there: where they end, in which rows, their numbers."""
        rows, n = data.shape
        columns = data.T.astype(np.uint64) + np.uint64(1)
        out = []
        for i in range(n):
            h = np.zeros(rows, np.uint64)
            here = []
            for j in range(i, min(n, i + self.longest)):
                h = h * _MUL + columns[j]
                which, piece = self._pieces(h)
                if len(which):
                    here.append((j + 1, which, piece))
            out.append(here)
        return out

    def _pieces(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of pieces, and the pieces' numbers."""
        which = np.flatnonzero(self.begun[h >> np.uint64(64 - _FIRST_BITS)])
        at = np.searchsorted(self.hashes, h[which])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h[which]
        return which[hit], self.number[at[hit]]

    def _forward_of_one(self, data: np.ndarray) -> np.ndarray:
        """The forward recursion over one long word; the pieces of a block are found when it is reached."""
        alpha = np.full(len(data) + 1, -np.inf)
        alpha[0] = 0.0
        for first in range(0, len(data), _BLOCK):
            start, size, piece = self._found(data, first)
            here = alpha[first : first + _BLOCK + self.longest].tolist()
            for i, n, logp in zip(start.tolist(), size.tolist(), self.logp[piece].tolist(), strict=True):
                here[i + n] = _log_add(here[i + n], here[i] + logp)
            alpha[first : first + len(here)] = here
        return alpha

    def _expected_of_one(self, data: np.ndarray) -> np.ndarray:
        """How often each piece is used in one long word; the backward recursion goes block by block as well."""
        total = np.zeros(len(self.logp))
        alpha = self._forward_of_one(data)
        beta = np.full(len(data) + 1, -np.inf)
        beta[-1] = 0.0
        for first in reversed(range(0, len(data), _BLOCK)):
            start, size, piece = self._found(data, first)
            here = beta[first : first + _BLOCK + self.longest].tolist()
            back = zip(start[::-1].tolist(), size[::-1].tolist(), self.logp[piece[::-1]].tolist(), strict=True)
            for i, n, logp in back:
                here[i] = _log_add(here[i], logp + here[i + n])
            beta[first : first + len(here)] = here
            at = first + start
            weight = np.exp(alpha[at] + self.logp[piece] + beta[at + size] - alpha[-1])
            total += np.bincount(piece, weight, len(total))
        return total

    def _found(self, data: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that start in the block at `first`: where in the block, in order, their sizes and numbers."""
        width = min(_BLOCK, len(data) - first)
        columns = data[first : first + width + self.longest - 1].astype(np.uint64) + np.uint64(1)
        h = np.zeros(width, np.uint64)
        found = []
        for size in range(1, min(self.longest, len(columns)) + 1):
            h = h[: len(columns) - size + 1]
            h = h * _MUL + columns[size - 1 : size - 1 + len(h)]
            if size not in self.sizes:
                continue
            hit, piece = self._pieces(h)
            found.append((hit, np.full(len(hit), size), piece))
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], size[order], piece[order]


def _long_ones(words: list[bytes]) -> list[int]:
    return [row for row, w in enumerate(words) if len(w) > _LONG]


def _log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_MUL) + b + 1) & (1 << 64) - 1
    return h
