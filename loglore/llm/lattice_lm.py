"""Language-model score of whole texts: the marginal over all subword segmentations."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglore.llm.common import bytes_of, slices
from loglore.llm.encoding import byte_table
from loglore.llm.lattice import Lattice
from loglore.session import materialise, staging, work_path

#: Words at least once in so many training tokens go to every task; there can't be more of them than this.
FREQUENT = 100_000
#: Rounds that fit the pieces' probabilities to the training words.
ROUNDS = 2
#: What an unseen word adds in the word model, an unseen piece to the pieces' counts, an end to the ends.
WORD_PRIOR, PIECE_PRIOR, END_PRIOR = 0.1, 0.1, 0.5
#: Different words that a task counts before it hands them on; documents of one block of postings.
_COUNTED, _BLOCK = 300_000, 4096
_LN10 = math.log(10)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 10 is 0; a null doc_id is an empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pieces_of(content: str) -> list[bytes]:
    """The vocabulary's pieces that can stand in a lower-cased word with a space before it."""
    table = dict.fromkeys(byte_table(content))
    space = b"\t\n\x0b\x0c\r "
    return [p for p in table if p and p == p.lower() and not any(c in space for c in p[1:]) and p[0] not in space[:5]]


def scores(docs: DataFrame, content: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    Tokens are lower-cased words and one end per text. Both models learn from all documents that
    are not held out. The base is a smoothed word model. The subword model takes the pieces of an
    existing vocabulary. Its scores start from the pieces' ranks and are fitted to all training
    words: each round sums, per piece, how often all segmentations of all words use it, weighted by
    their probability. A word of the training texts is an edge of its lattice as a whole, too: its
    count less a discount, as a share of all words. What the discounts leave is the weight of the
    pieces, which therefore learn from each different word once, as a new word would come.

    `score` is the log10 probability of a text: for each word, with the space before it, the sum
    over all its segmentations, and the end, a token of its own. No piece reaches over a space, so
    the text's marginal is the product of its words'. Each first piece starts with the space and no
    other does, so the words' probabilities sum to 1, as the texts' do.

    Counts of words are summed before they are shuffled. Words that make up at least one in FREQUENT
    training tokens, FREQUENT of them at most, go to every task, and their sums never leave the
    document. Of the others a block of documents sends each word once, with its documents' numbers,
    to the word's count and score; the sums go back by document.

    A null text counts as empty: its end alone is scored. A null doc_id is held out. Rows that repeat
    are scored each. Without training documents no word is known and pieces keep the ranks' scores.
    Columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    pieces = pieces_of(content)
    with staging(spark) as folder:
        counted = docs.mapInArrow(_count_words, "word binary, c long")
        words = materialise(counted.groupBy("word").agg(F.sum("c").alias("c")), "words", folder)
        ends = docs.where("NOT held_out").count()
        seen = words.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
            *[F.count_if(x).alias(a) for a, x in (("v", F.col("c") > 0), ("once", F.col("c") == 1), ("twice", F.col("c") == 2))],
        ).first()
        n, v = seen.n + ends, seen.v + (1 if ends else 0)
        # Absolute discounting; half a count where the data don't tell.
        discount = seen.once / (seen.once + 2 * seen.twice) if seen.once and seen.twice else 0.5
        ended = (ends + END_PRIOR) / (n + 2 * END_PRIOR)

        logp = np.log(1.0 / (np.arange(len(pieces)) + 10.0))
        logp -= np.logaddexp.reduce(logp)
        for _ in range(rounds):
            used = np.full(len(pieces), PIECE_PRIOR)
            learnt = words.where("c > 0").mapInArrow(_expect(pieces, logp), "piece int, uses double")
            for row in learnt.groupBy("piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
                used[row.piece] += row.uses
            logp = np.log(used / used.sum())

        base = F.log10((F.col("c") + WORD_PRIOR) / F.lit(float(n + WORD_PRIOR * (v + 1))))
        marginals = _marginals(pieces, logp, seen.n, seen.v, discount, math.log1p(-ended))
        scored = words.mapInArrow(marginals, "word binary, c long, sub double")
        scored = materialise(scored.select("word", "c", base.alias("base"), "sub"), "scored", folder)
        often = scored.where(F.col("c") * FREQUENT >= n)
        known = {bytes(r.word): (r.c > 0, r.base, r.sub) for r in often.toLocalIterator()} if n else {}
        end = (ends > 0, math.log10((ends + WORD_PRIOR) / (n + WORD_PRIOR * (v + 1))), math.log10(ended))

        split = materialise(docs.mapInArrow(_postings(known, end), _ROWS), "postings", folder)
        texts = split.where("word IS NULL").drop("word", "places", "times")
        rare = split.where("word IS NOT NULL").select("block", "word", "places", "times")
        joined = rare.join(scored.withColumnRenamed("word", "w"), F.col("word") == F.col("w"))
        joined = joined.select("block", "c", "base", "sub", F.explode(F.arrays_zip("places", "times")).alias("x"))
        times = F.col("x.times")
        sums = joined.groupBy("block", F.col("x.places").alias("place")).agg(
            F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("more_known"),
            F.sum(times * F.col("base")).alias("more_base"),
            F.sum(times * F.col("sub")).alias("more_sub"),
        )
        result = texts.join(sums, ["block", "place"], "left").select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
            (F.col("sub") + F.coalesce("more_sub", F.lit(0.0))).alias("score"),
        )
        path = work_path(spark, "scores")
        result.write.parquet(path)
    return spark.read.parquet(path)


_ROWS = (
    "block long, place int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, sub double, "
    "word binary, places array<int>, times array<int>"
)
_COUNTS = pa.schema([("word", pa.binary()), ("c", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts in training texts; those of held-out texts alone count 0."""
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS
        )

    for some in slices(batches):
        for text, apart in zip(bytes_of(some.column("text")), some.column("held_out").to_pylist(), strict=True):
            words = text.lower().split()
            counts.update(dict.fromkeys(words, 0) if apart else words)
        if len(counts) >= _COUNTED:
            yield out()
            counts.clear()
    yield out()


def _expect(pieces: list[bytes], logp: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logp)
        total = np.zeros(len(pieces))
        for some in slices(batches, 100_000):
            words = [b" " + w for w in some.column("word").to_pylist()]
            total += lattice.expected(words, np.ones(len(words)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])

    return run


def _marginals(pieces: list[bytes], logp: np.ndarray, n: int, v: int, discount: float, go_on: float) -> Callable:
    """Log10 of each word's sum over all segmentations: as a whole (if known), or in pieces."""
    by_pieces = math.log(discount * v / n) if n else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, logp)
        for some in slices(batches, 100_000):
            sub = by_pieces + lattice.marginals([b" " + w for w in some.column("word").to_pylist()])
            counts = some.column("c").to_numpy()
            known = counts > 0
            sub[known] = np.logaddexp(sub[known], np.log((counts[known] - discount) / max(n, 1)))
            sub = (sub + go_on) / _LN10
            yield pa.RecordBatch.from_arrays(
                [some.column("word"), some.column("c"), pa.array(sub)], ["word", "c", "sub"]
            )

    return run


def _postings(known: dict[bytes, tuple[bool, float, float]], end: tuple[bool, float, float]) -> Callable:
    """A row per text with the sums of its frequent words, and a row per block and other word."""
    ints = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip([f.split()[0] for f in _ROWS.split(", ")], [*kinds, pa.binary(), ints, ints], strict=True)))

    def text_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
        columns += [pa.nulls(len(rows), f.type) for f in list(schema)[len(columns) :]]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def word_rows(block: int, words: list[bytes], number: list[int], place: list[int], times: list[int]) -> pa.RecordBatch:
        number_ = np.array(number)
        order = np.argsort(number_, kind="stable")
        offsets = np.searchsorted(number_[order], np.arange(len(words) + 1)).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(x, np.int32)[order])) for x in (place, times)
        ]
        n = len(words)
        columns = [pa.array(np.full(n, block)), *[pa.nulls(n, f.type) for f in list(schema)[1:8]]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.binary()), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        at = 0
        numbers: dict[bytes, int] = {}
        number: list[int] = []
        place: list[int] = []
        times: list[int] = []
        for some in slices(batches):
            rows = []
            columns = [some.column("doc_id").to_pylist(), some.column("held_out").to_pylist()]
            for doc_id, apart, text in zip(*columns, bytes_of(some.column("text")), strict=True):
                words = text.lower().split()
                n_known, base, sub = int(end[0]), end[1], end[2]
                for word, n in Counter(words).items():
                    found = known.get(word)
                    if found is None:
                        number.append(numbers.setdefault(word, len(numbers)))
                        place.append(at)
                        times.append(n)
                    else:
                        n_known += n * found[0]
                        base += n * found[1]
                        sub += n * found[2]
                rows.append((block, at, doc_id, apart, len(words) + 1, n_known, base, sub))
                at += 1
            yield text_rows(rows)
            if at >= _BLOCK or len(numbers) >= _COUNTED:
                if numbers:
                    yield word_rows(block, list(numbers), number, place, times)
                block, at = block + 1, 0
                numbers, number, place, times = {}, [], [], []
        if numbers:
            yield word_rows(block, list(numbers), number, place, times)

    return run
