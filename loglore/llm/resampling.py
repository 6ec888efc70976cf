"""Importance resampling: documents drawn by how much they look like a target's n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.llm.common import bytes_of, slices
from loglore.llm.ngram_table import NgramTable
from loglore.operators.number import number_rows
from loglore.session import materialise, staging

#: Hashed features: an n-gram's bucket is its crc32 modulo this.
BUCKETS = 10_000
#: Documents of fewer words are weighed, but never drawn.
LEAST_WORDS = 20
#: Of the others, so many of a hundred are drawn.
DRAWN_PERCENT = 25
SEED = 7
#: Gains and scores are in thousandths.
SCALE = 1000
#: Bytes of text whose n-grams share one table; a longer text takes several.
BATCH_BYTES = 1 << 21
_ROWS = 1024

# Letters of a word, in UTF-8: digits, a-z, and every byte of a character beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE = 0x20
_LETTERS = bytes([*np.flatnonzero(_LETTER).tolist(), *range(0x41, 0x5B)])
_GAPS = bytes(set(range(256)) - set(_LETTERS))
_WORDS, _GAP = re.compile(b"[" + re.escape(_LETTERS) + b"]+"), re.compile(b"[" + re.escape(_GAPS) + b"]")


class Words(NamedTuple):
    """The words of some texts, joined by single spaces; `owner` is the text of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray

    def pairs(self) -> np.ndarray:
        """The words that another one of the same text follows."""
        return np.flatnonzero(self.owner[1:] == self.owner[:-1]) if len(self.owner) else np.empty(0, np.int64)


def find_words(texts: list[bytes]) -> Words:
    """Lower-cases A-Z and cuts at everything that is no letter; no word spans two texts."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = _LETTER[raw]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(before & ~inside) - starts
    borders = np.cumsum([len(t) + 1 for t in texts])
    # Each word keeps its bytes and the one that follows it, which becomes a space.
    keep = inside | before
    data = np.where(inside, raw, np.uint8(_SPACE))[keep]
    ends = np.cumsum(lengths + 1) - 1
    return Words(data, ends - lengths, ends, np.searchsorted(borders, starts, "right"))


def _pieces(texts: list[bytes], size: int) -> Iterator[tuple[list[bytes], list[int], list[bool]]]:
    """Runs of texts of about `size` bytes: the bytes, whose they are, and whether they go on.

    A longer text is cut where a word ends. Its next piece then begins with the last word of the
    piece before, which is counted there and stands here for the pair that it begins.
    """
    some: list[bytes] = []
    owners: list[int] = []
    goes_on: list[bool] = []
    held = 0
    for i, text in enumerate(texts):
        at, on = 0, False
        while at is not None:
            cut = _cut(text, at, size)
            some.append(text[at:cut])
            owners.append(i)
            goes_on.append(on)
            held += len(some[-1])
            last = some[-1].rstrip(_GAPS)
            word = len(last.rstrip(_LETTERS))
            on = word < len(last)
            at = None if cut is None else at + word if on else cut
            if held >= size:
                yield some, owners, goes_on
                some, owners, goes_on, held = [], [], [], 0
    if some:
        yield some, owners, goes_on


def _cut(text: bytes, start: int, size: int) -> int | None:
    """Where the piece from `start` ends: at the first gap after `size` bytes; None is the text's end.

    A piece that begins with a word holds two at least, or the next one would begin there again.
    """
    gap = _GAP.search(text, start + size)
    if gap is None:
        return None
    first = _WORDS.match(text, start)
    if first is None:
        return gap.start()
    more = _WORDS.search(text, first.end())
    if more is None or more.end() == len(text):
        return None
    return max(gap.start(), more.end())


class _Counted(NamedTuple):
    """One table's n-grams: which text and which slot each occurrence has."""

    table: NgramTable
    owner: np.ndarray
    is_word: np.ndarray


def _tables(texts: list[bytes], buckets: int, size: int) -> Iterator[_Counted]:
    """N-gram tables over all the texts, a bounded number of bytes each."""
    for some, owners, goes_on in _pieces(texts, size):
        words = find_words(some)
        first = words.pairs()
        whose = np.asarray(owners)[words.owner]
        # The word carried over begins its piece, and is not counted again.
        begins = np.r_[True, words.owner[1:] != words.owner[:-1]][: len(words.owner)]
        own = np.flatnonzero(~(begins & np.asarray(goes_on)[words.owner]))
        starts = np.concatenate([words.starts[own], words.starts[first]])
        ends = np.concatenate([words.ends[own], words.ends[first + 1]])
        table = NgramTable(words.data, starts, ends, buckets)
        yield _Counted(table, np.concatenate([whose[own], whose[first]]), np.arange(len(starts)) < len(own))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, size: int = BATCH_BYTES) -> np.ndarray:
    """Occurrences of all features of all texts by bucket: `buckets` numbers, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for some in slices(batches, _ROWS):
            for counted in _tables(bytes_of(some.column("text")), buckets, size):
                sums += counted.table.bucket_counts(buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long")
    sums = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What an occurrence of each bucket adds: the smoothed log ratio of target to raw, floored."""
    n = len(raw)
    all_raw, all_target = int(raw.sum()), int(target.sum())
    return np.array(
        [
            math.floor(SCALE * math.log((t + 1) * (all_raw + n) / ((s + 1) * (all_target + n))))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weigh(docs: DataFrame, by_bucket: np.ndarray, size: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of a document's gains, 0 without any."""
    buckets = len(by_bucket)
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for some in slices(batches, _ROWS):
            n = some.num_rows
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            for counted in _tables(bytes_of(some.column("text")), buckets, size):
                each = gain[counted.table.bucket][counted.table.slots]
                np.add.at(total, counted.owner, each)
                features += np.bincount(counted.owner, minlength=n)
                words += np.bincount(counted.owner[counted.is_word], minlength=n)
            mean = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(words), pa.array(features), pa.array(mean)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    kinds = "doc_id long, n_words long, n_features long, weight long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def seeded_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Add `score`: the weight and a Gumbel number that the seed and the doc_id settle."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + luck).cast("long"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    size: int = BATCH_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document of `docs`.

    Features are the words and the pairs of following words of a text, hashed into `buckets`. Two
    counts of them, over all of `docs` and all of `target` (both with a column `text`), give each
    bucket a gain. Of the documents with at least `least_words` words, the floor of `percent` in a
    hundred with the highest scores are drawn and ranked from 1; `rank` is null for the others.

    The texts are read twice and never shuffled; a task sends one number per bucket, and the gains
    are as many. Only narrow rows are sorted, by ranges, so no task gathers the drawn ones.

    A null or empty text has no words, no features and weight 0; a null doc_id draws its luck as an
    empty name. Equal scores rank by doc_id, nulls last, then by weight and features, so that rows
    of one doc_id have a defined order; equal rows may change places, which changes no result. An
    empty table gives no rows, an empty target equal gains. Other columns are not looked at.
    """
    spark = docs.sparkSession
    by_bucket = gains(bucket_counts(docs, buckets, size), bucket_counts(target, buckets, size))
    weighed = materialise(seeded_score(weigh(docs, by_bucket, size), seed), "weighed")
    able = weighed.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features")]
    with staging(spark) as folder:
        ranked = number_rows(able, [], order, "rank", folder)
        ranked = materialise(ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))), "ranked")
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
