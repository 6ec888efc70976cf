"""Benchmark passages in documents: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.llm.common import bytes_of, slices
from loglore.operators.sizing import fits_broadcast, measured_bytes
from loglore.session import materialise, work_path

#: Words of a seed.
SEED = 3
#: Alignment: points of an equal word, of another word, of a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage counts if its alignment reaches this share of the points of the whole item.
LEAST_SCORE = 0.5
#: A shorter item has to stand there whole: half of it is a phrase that anyone may write.
SHORT = 8
#: So many equal words, or an alignment of as many points, count however long the item is.
EXCERPT = 30
#: A seed is rare if at most so many items hold it; by itself it joins a text with all of them.
RARE_ITEMS = 8
#: Benchmark text that is sent to the tasks at once; more is worked off in blocks of about this size.
BLOCK_BYTES = 16 * 1024 * 1024

_PUNCTUATION = string.punctuation.encode()
_FOUND = "doc_id long, item_id long, score double, start_word long, end_word long, item_words long"


def passage_words(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return text.lower().translate(None, _PUNCTUATION).split()


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman score of two word sequences, and where in `window` the best alignment ends.

    A row is filled at once: what comes from the left with a linear gap is a running maximum.
    """
    slope = -GAP * np.arange(len(window))
    above = np.zeros(len(window), np.int64)
    best, end = 0, 0
    for word in item:
        before = np.concatenate([[0], above[:-1]])
        row = np.maximum(before + np.where(window == word, MATCH, MISMATCH), above + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top + 1
        above = row
    return best, end


def most_score(item: np.ndarray, window: np.ndarray) -> int:
    """A bound that no alignment of the two exceeds: the best stretch of `window`, its words matched wherever `item` has them."""
    sums = np.cumsum(np.where(np.isin(window, item), MATCH, max(MISMATCH, GAP)))
    lowest = np.minimum.accumulate(np.concatenate([[0], sums[:-1]]))
    return min(MATCH * len(item), int((sums - lowest).max(initial=0)))


@dataclass
class Lists:
    """Lists of whole numbers one after the other: list k is values[starts[k]:starts[k + 1]]."""

    starts: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, owner: np.ndarray, values: np.ndarray, owners: int) -> Lists:
        """`values` by their owner, each list in ascending order."""
        order = np.lexsort((values, owner))
        return cls(np.searchsorted(owner[order], np.arange(owners + 1)), values[order])

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.starts[which + 1] - self.starts[which]

    def places(self, which: np.ndarray) -> np.ndarray:
        """Where the values of the lists `which` stand, list after list."""
        return _ranges(self.starts[which], self.starts[which + 1])


@dataclass
class Items:
    """Benchmark items of one block as word numbers, and what finds them."""

    ids: list[int]
    words: list[np.ndarray]
    number: dict[bytes, int]
    #: Points that each item's alignment must reach, and the equal words without which it cannot.
    points: np.ndarray
    needs: np.ndarray
    #: Seeds in order; the items that hold each, and beside them where; which are rare.
    keys: np.ndarray
    holders: Lists
    held_at: np.ndarray
    rare: np.ndarray
    #: Distinct words of each item, beside them how often; items by their leading words.
    own: Lists
    times: np.ndarray
    led_by: Lists

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], least_score: float = LEAST_SCORE) -> Items:
        number: dict[bytes, int] = {}
        ids, words = [], []
        for item_id, text in rows:
            own = [number.setdefault(w, len(number) + 1) for w in passage_words(text)]
            if len(own) >= SEED:
                ids.append(item_id)
                words.append(np.array(own, np.int64))
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.minimum(least_score * MATCH * lengths, MATCH * EXCERPT)
        points = np.where(lengths < SHORT, MATCH * lengths, points)
        needs = np.ceil(points / MATCH - 1e-9).astype(np.int64)

        none = np.empty(0, np.int64)
        seeds = [_seeds(w) for w in words]
        of_item = np.repeat(np.arange(len(words)), [len(x) for x in seeds])
        at = np.concatenate([none, *[np.arange(len(x)) for x in seeds]])
        keys, seed = np.unique(np.concatenate([none, *seeds]), return_inverse=True)
        order = np.lexsort((at, of_item, seed))
        holders = Lists.of(seed, of_item, len(keys))
        items_of_seed = np.unique(seed * max(1, len(words)) + of_item) // max(1, len(words))
        rare = np.bincount(items_of_seed, minlength=len(keys)) <= RARE_ITEMS

        # Distinct words per item; an item's leading words are its rarest, so many that one at least
        # stands in every text that has the equal words it needs.
        width = len(number) + 1
        pairs, times = np.unique(
            np.repeat(np.arange(len(words)), lengths) * width + np.concatenate([none, *words]), return_counts=True
        )
        own_item, own_word = np.divmod(pairs, width)
        held_by = np.bincount(own_word, minlength=width)
        rarest = np.lexsort((own_word, held_by[own_word], own_item))
        before = np.cumsum(times[rarest]) - times[rarest]
        before -= (np.cumsum(lengths) - lengths)[own_item]
        leads = rarest[before <= (lengths - needs)[own_item]]
        return cls(
            ids, words, number, points, needs, keys, holders, at[order], rare,
            Lists.of(own_item, own_word, len(words)), times, Lists.of(own_word[leads], own_item[leads], width),
        )

    def near(self, numbers: np.ndarray, place: np.ndarray, k: np.ndarray) -> dict[int, list[int]]:
        """Items that the text may hold, and where they seem to start, from the places of its seeds.

        A rare seed joins the text with the items that hold it. A frequent one joins it with those
        among them that have a leading word in the text, so the others are not even listed. What has
        too few words in the text to reach its points is left out. All this leaves out nothing more.
        """
        present = np.zeros(len(self.number) + 1, bool)
        present[numbers] = True
        present[0] = False
        alone = self.rare[k]
        which = self.holders.values[self.holders.places(np.unique(k[alone]))]
        if not alone.all():
            led = self.led_by.values[self.led_by.places(np.flatnonzero(present))]
            which = np.concatenate([which, led])
        which = np.unique(which)
        found: dict[int, list[int]] = defaultdict(list)
        if not len(which):
            return found
        at, sizes = self.own.places(which), self.own.sizes(which)
        shared = np.add.reduceat(present[self.own.values[at]] * self.times[at], np.cumsum(sizes) - sizes)
        which = which[shared >= self.needs[which]]
        if not len(which):
            return found
        for p, seed in zip(place.tolist(), k.tolist(), strict=True):
            first, last = self.holders.starts[seed], self.holders.starts[seed + 1]
            holders = self.holders.values[first:last]
            at = first + _ranges(np.searchsorted(holders, which), np.searchsorted(holders, which, "right"))
            for i, start in zip(self.holders.values[at].tolist(), (p - self.held_at[at]).tolist(), strict=True):
                found[i].append(start)
        return found

    def hits(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of each text, and of every seed in them: text, place, number of the seed."""
        get = self.number.get
        cut = [passage_words(t) for t in texts]
        numbers = [np.fromiter((get(w, 0) for w in words), np.int64, len(words)) for words in cut]
        flat = np.concatenate([np.empty(0, np.int64), *numbers])
        counts = np.array([len(n) for n in numbers], np.int64)
        of_text = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        if len(flat) < SEED or not len(self.keys):
            none = np.empty(0, np.int64)
            return numbers, none, none, none
        keys = _seeds(flat)
        whole = of_text[: len(keys)] == of_text[SEED - 1 :]
        for k in range(SEED):
            whole &= flat[k : len(keys) + k] > 0
        at = np.flatnonzero(whole)
        k = np.searchsorted(self.keys, keys[at])
        k[k == len(self.keys)] = 0
        at, k = at[self.keys[k] == keys[at]], k[self.keys[k] == keys[at]]
        return numbers, of_text[at], place[at], k


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end (exclusive), range after range."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _seeds(words: np.ndarray) -> np.ndarray:
    """Keys of all runs of SEED word numbers; numbers are below 2**21, so keys are exact."""
    keys = np.zeros(max(0, len(words) - SEED + 1), np.int64)
    for k in range(SEED):
        keys = (keys << 21) | words[k : len(words) - SEED + 1 + k]
    return keys


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents that hold a copy, whole or edited, of a benchmark item: one row per row of `docs` and item.

    doc_id, item_id, score (share of the points of the whole item), start_word and end_word of the
    best passage (words of the document without punctuation, end exclusive), item_words.

    An item counts if the alignment reaches least_score of the points of all its words, or those of
    EXCERPT equal words, whichever is less; an item of fewer than SHORT words has to stand there whole.

    One pass over the documents looks for the items' seeds. How rare a seed is, the benchmark alone
    tells, as a leak makes its own seeds frequent among documents: one that few items hold joins a
    text with them by itself; of those that hold a frequent one (a stock phrase), only items whose
    rarest words are in the text too are looked at (`Items.near`). What cannot reach the score by the
    words that it shares with the item (`most_score`) is not aligned. Neither leaves out a passage that
    would count: only one edited so closely that none of its runs of SEED words is left is not seen.
    The item is aligned with the words around its hits, where the document is; no document is shuffled.
    A benchmark beyond BLOCK_BYTES is worked off in blocks, one pass each, whose answers are written
    out before the driver reads the next.

    Null texts count as empty. Items of fewer than SEED words are like any phrase and match nothing.
    Rows that repeat a document, and items that repeat a text, are answered each; a null doc_id or
    item_id stays null. Columns other than doc_id, item_id and text are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = 1 + measured_bytes(items) // BLOCK_BYTES
    path = work_path(spark, "passages") if blocks > 1 else None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = Items.of([(r.item_id, (r.text or "").encode()) for r in own.collect()], least_score)
        found = docs.mapInArrow(_finder(held), _FOUND)
        if path is None:
            return found
        found.write.parquet(f"{path}/block={block}")
    return spark.read.schema(_FOUND).parquet(*[f"{path}/block={block}" for block in range(blocks)])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs`, all columns, without the rows whose text holds a benchmark item.

    Rows go by a hash of their text, as a doc_id may be null or stand for several texts: a row with a
    leak goes whatever its doc_id, and one without stays. The few hashes travel to the documents
    behind a check of their size.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    found = contaminated(docs.select(mark.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_leak"))
    found = materialise(found.distinct(), "leaks")
    return docs.join(F.broadcast(found) if fits_broadcast(found) else found, mark == F.col("_leak"), "left_anti")


def _finder(items: Items) -> Callable:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip([f.split()[0] for f in _FOUND.split(", ")], kinds, strict=True)))

    def best(numbers: np.ndarray, item: np.ndarray, starts: list[int], points: float) -> tuple[float, int, int]:
        """Share, start and end of the best passage near the places where the item seems to start; zeros below `points`."""
        slack, whole = len(item) // 2 + 2, MATCH * len(item)
        spans: list[list[int]] = []
        for s in sorted(starts):
            left, right = max(0, s - slack), s + len(item) + slack
            if spans and left <= spans[-1][1]:
                spans[-1][1] = right
            else:
                spans.append([left, right])
        top = (0, 0, 0)
        for left, right in spans:
            window = numbers[left:right]
            if most_score(item, window) < points:
                continue
            score, end = align(item, window)
            if score > top[0]:
                top = (score, left, left + end)
        score, left, end = top
        if not score or score < points:
            return 0, 0, 0
        _, back = align(item[::-1], numbers[left:end][::-1])
        return score / whole, end - back, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            numbers, text, place, k = items.hits(bytes_of(some.column("text")))
            ids = some.column("doc_id").to_pylist()
            out = []
            with_seeds, first = np.unique(text, return_index=True)
            for t, a, b in zip(with_seeds.tolist(), first, np.append(first[1:], len(text)), strict=False):
                for i, starts in items.near(numbers[t], place[a:b], k[a:b]).items():
                    item = items.words[i]
                    share, start, end = best(numbers[t], item, starts, items.points[i])
                    if share:
                        out.append((ids[t], items.ids[i], share, start, end, len(item)))
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run
