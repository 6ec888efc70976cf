"""Which similarity the k-th best document of a query reaches, found by counting.

A document's place in the ranking of a query is its key: the similarity, then its name. The keys are
counted in steps, and again in finer steps inside the one that holds the k-th best, until few enough
are left. First float32 similarities are counted in even steps; where these no longer tell documents
apart, the DOUBLE ones by their order-preserving bits; and where many are equal to the last bit, the
names by their bytes, eight at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Steps in which one pass counts each query's documents; one more holds what lies above them.
BINS = 1024
#: Counting goes on until at most so many times k documents are left.
SPARE = 2

_ROUGH, _EXACT = 0, 1
_SIGN = np.uint64(1 << 63)
_LAST = (1 << 64) - 1


def key_of(scores: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def score_of(key: int) -> float:
    bits = np.uint64(key)
    return float(np.array([bits ^ _SIGN if bits & _SIGN else ~bits], np.uint64).view(np.float64)[0])


def name_chunks(names: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 x chunk bytes of names, and the eight after them as a number; short names end in zeros."""
    wide = names.astype(f"S{8 * (chunk + 1)}")
    matrix = np.frombuffer(wide.tobytes(), np.uint8).reshape(len(wide), 8 * (chunk + 1))
    number = np.ascontiguousarray(matrix[:, 8 * chunk :]).view(">u8")[:, 0].astype(np.uint64)
    return wide.astype(f"S{max(1, 8 * chunk)}") if chunk else np.zeros(len(wide), "S1"), number


@dataclass
class Floor:
    """What is known of a query's k-th best document.

    `score` is reached by k documents at least, by none where there are fewer. With `name`, of those
    that reach it to the last bit only names up to it, by its own length, are in. `level` and the
    range from `low` to `high` (of scores, of score keys or of reversed name bytes behind `prefix`)
    say what the next pass counts; None once nothing is left to count.
    """

    score: float = -np.inf
    name: bytes | None = None
    level: int | None = _ROUGH
    low: float | int = -1.001
    high: float | int = 1.001
    prefix: bytes = b""

    def narrowed(self, counts: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, margin: float) -> None:
        """Take in the counts of a pass, one per step and behind them those above the range.

        `least` and `most` are the ends of the keys met in each step.
        """
        through = np.cumsum(counts[::-1])[::-1]  # of each step and all above it
        if through[0] < k:
            # Fewer than k in all. In a later pass a floor is known, and stays.
            self.level = None
            return
        step = int(np.flatnonzero(through >= k)[-1])
        if self.level == _ROUGH:
            self._rough(through, step, k, margin)
        else:
            self._keyed(through, step, int(least[step]), int(most[step]), k)

    def _rough(self, through: np.ndarray, step: int, k: int, margin: float) -> None:
        width = (self.high - self.low) / BINS
        edge = self.low + step * width
        # A rough similarity is off by less than the margin.
        self.score = edge - 2 * margin
        last = max(0, step - 1 - int(3 * margin / width))
        if through[last] <= SPARE * k:
            self.level = None
        elif width > 8 * margin:
            self.low, self.high = edge - 4 * margin - width / 16, edge + width
        else:
            self.level = _EXACT
            self.low, self.high = (int(key_of(np.array([s]))[0]) for s in (edge - 2 * margin, edge + width + 2 * margin))

    def _keyed(self, through: np.ndarray, step: int, low: int, high: int, k: int) -> None:
        if self.level == _EXACT:
            self.score = score_of(low)
        else:
            self.name = self.prefix + (_LAST - low).to_bytes(8, "big")
        if through[step] <= SPARE * k:
            self.level = None
        elif low < high:
            self.low, self.high = low, high
        elif self.level > _EXACT and low == _LAST:
            self.level = None  # rows of one name: nothing tells them apart
        else:
            self.prefix = self.name or b""
            self.level, self.low, self.high = self.level + 1, 0, _LAST

    def width(self) -> int:
        """Keys in one step."""
        return -(-(int(self.high) - int(self.low) + 1) // BINS)


class Counting:
    """Counts of one pass in a task: `floors` are those of the queries, in their order."""

    def __init__(self, floors: list[Floor]) -> None:
        self.floors = floors
        self.counts = np.zeros((len(floors), BINS + 1), np.int64)
        self.least = np.full((len(floors), BINS + 1), _LAST, np.uint64)
        self.most = np.zeros((len(floors), BINS + 1), np.uint64)
        self.rough = np.array([f.level == _ROUGH for f in floors])
        self._low = np.array([f.low if f.level == _ROUGH else np.inf for f in floors])
        self._scale = np.array([BINS / (f.high - f.low) if f.level == _ROUGH else 0.0 for f in floors])
        # What an exact pass has to look at, before the margin.
        self.from_score = np.array([np.inf if f.level == _ROUGH else f.score for f in floors])

    def add_rough(self, rough: np.ndarray) -> None:
        """Count a block of float32 similarities, a row per query."""
        own = np.flatnonzero(self.rough)
        if not len(own):
            return
        place = (rough[own] - self._low[own, None]) * self._scale[own, None]
        seen = place >= 0
        steps = np.minimum(place, BINS).astype(np.int64) + (np.arange(len(own)) * (BINS + 1))[:, None]
        found = np.bincount(steps[seen], minlength=len(own) * (BINS + 1))
        self.counts[own] += found.reshape(len(own), BINS + 1)

    def add_exact(self, query: int, scores: np.ndarray, names: Callable[[np.ndarray], np.ndarray]) -> None:
        """Count DOUBLE similarities of one query; `names` gives the names of some of their documents."""
        floor = self.floors[query]
        if floor.level == _EXACT:
            keys = key_of(scores)
        else:
            tied = np.flatnonzero(scores == floor.score)
            self.counts[query, BINS] += int((scores > floor.score).sum())
            before, number = name_chunks(names(tied), floor.level - _EXACT - 1)
            prefix = np.array([floor.prefix], before.dtype)[0]
            self.counts[query, BINS] += int((before < prefix).sum())
            keys = ~number[before == prefix]
        keys = keys[keys >= np.uint64(floor.low)]
        inside = keys <= np.uint64(floor.high)
        self.counts[query, BINS] += int((~inside).sum())
        keys = keys[inside]
        steps = ((keys - np.uint64(floor.low)) // np.uint64(floor.width())).astype(np.int64)
        self.counts[query] += np.bincount(steps, minlength=BINS + 1)
        np.minimum.at(self.least[query], steps, keys)
        np.maximum.at(self.most[query], steps, keys)

    def rows(self) -> list[np.ndarray]:
        """q, bin, n, least, most of all steps met; the keys as signed numbers of the same order."""
        q, step = np.nonzero(self.counts)
        ends = ((a[q, step] ^ _SIGN).view(np.int64) for a in (self.least, self.most))
        return [q.astype(np.int32), step.astype(np.int32), self.counts[q, step], *ends]


def unsigned(ends: np.ndarray) -> np.ndarray:
    return ends.view(np.uint64) ^ _SIGN
