"""Exact top-k search of many query vectors over the index.

The corpus stays where it is: each task streams its vectors in Arrow blocks
past a broadcast matrix of queries and keeps the best k of every query, so no
query-document pairs leave a task beyond its own k best. Where tasks may be so
many that these rows are too many for one ranking, groups of tasks are merged
first. For a very large k the floor of each query is found by counting (see
`floors`), and only what reaches it leaves a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import astuple
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglore.functions.vectors import vector_problem
from loglore.operators.floors import BINS, Counting, Floor, unsigned
from loglore.operators.number import number_rows
from loglore.operators.sizing import BROADCAST_BYTES
from loglore.schema import DEFAULT_K, SCORED
from loglore.session import materialise, staging, work_path

# Queries up to this number are read in one go; more are staged and cut up.
FIRST_READ = 4096
# Best rows a task keeps at once, or counts; more queries than that take another pass.
STATE_ROWS = 1_000_000
# A task keeps the k best itself up to this k; beyond it, counts of scores give a floor first.
MAX_LOCAL_K = 10_000
# Scored rows that may meet in the last ranking, and those of one query.
SCORED_ROWS = 200_000_000
WINDOW_ROWS = 5_000_000
# So many tasks a scoring stage may have before groups of them are merged, whatever k.
UNMERGED_TASKS = 100_000
# Entries of one block of scores in a task.
BLOCK_SCORES = 2_000_000


class QueryBlock(NamedTuple):
    """A bounded set of query vectors of one model and dimension."""

    ids: list[str]
    vectors: np.ndarray
    model: str


def search(queries: DataFrame, index: DataFrame, k: int = DEFAULT_K, local_k: int = MAX_LOCAL_K) -> DataFrame:
    """The k most similar documents of every query, ranked from 1.

    `queries` has `query_id` (unique), `vector` and `model`; a query meets the
    documents of its own model and dimension. A query vector that is empty,
    zero or not finite has no similarity to anything and gets no hits
    (`query_rejects` lists them). Equal similarities rank by sha, then source.
    k above the number of documents gives them all; k below 1 gives none.

    Up to `local_k`, every task keeps its own k best. For a larger k the corpus
    is read several times: scores are counted until each query has a floor that
    no hit lies below and 2 x k documents reach at most, however close to each
    other they are, and then only those leave a task. Either way gives the same
    hits.

    More than FIRST_READ queries are written first, so the plan behind `queries`
    runs up to twice: write queries that are dear to make.
    """
    spark = queries.sparkSession
    if k <= 0:
        return _rank(spark.createDataFrame([], SCORED), DEFAULT_K)
    usable = queries.filter(vector_problem(F.col("vector")).isNull()).select(
        F.col("query_id").cast("string"), "vector", "model"
    )
    first = usable.limit(FIRST_READ + 1).toArrow()
    if first.num_rows <= FIRST_READ and first.nbytes <= BROADCAST_BYTES:
        blocks = _blocks(first)
        if not blocks:
            return _rank(spark.createDataFrame([], SCORED), DEFAULT_K)
        scored = [
            _score(spark, index, part, k, local_k) for block in blocks for part in _passes(block, k, local_k)
        ]
        together = scored[0]
        for more in scored[1:]:
            together = together.unionByName(more)
        return _rank(together, k, local_k)
    return _search_in_chunks(spark, usable, index, k, local_k)


def query_rejects(queries: DataFrame) -> DataFrame:
    """REJECT rows of the queries that cannot be scored."""
    return (
        queries.withColumn("reason", vector_problem(F.col("vector")))
        .filter(F.col("reason").isNotNull())
        .select(
            F.lit("search").alias("stage"),
            "reason",
            F.lit(None).cast("string").alias("sha"),
            F.col("query_id").cast("string").alias("detail"),
        )
    )


def count_documents(index: DataFrame) -> DataFrame:
    """Documents per model and dimension."""
    return index.groupBy("model", "dim").agg(F.count("*").alias("n_docs"))


def best_per_commit(hits: DataFrame) -> DataFrame:
    """One row per query and commit: its best similarity over several embeddings."""
    return hits.groupBy("query_id", "sha").agg(
        F.max("similarity").alias("similarity"), F.count("*").alias("n_embeddings")
    )


def _rank(scored: DataFrame, k: int, local_k: int = MAX_LOCAL_K, folder: str | None = None) -> DataFrame:
    columns = ["query_id", "rank", "sha", "source", "similarity"]
    if k > local_k:
        # So many hits per query must not meet in one task to be numbered.
        ranked = number_rows(scored, ["query_id"], _order(), "rank", folder and f"{folder}/{uuid.uuid4().hex}")
    else:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
        ranked = scored.withColumn("rank", place.cast("long"))
    return ranked.filter(F.col("rank") <= k).select(*columns)


def _order() -> list[Column]:
    return [F.col("similarity").desc(), F.col("sha"), F.col("source")]


def _merged(scored: DataFrame, n_queries: int, k: int) -> DataFrame:
    """The k best of every query in each group of scoring tasks.

    There are as many groups as the last ranking can take in. With few queries and a small k that is
    more than any job has tasks, and the rows go on as they are.
    """
    groups = max(1, min(SCORED_ROWS // (n_queries * k), WINDOW_ROWS // k))
    if groups >= UNMERGED_TASKS:
        return scored
    grouped = scored.withColumn("_group", F.spark_partition_id() % groups)
    place = F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(*_order()))
    return grouped.withColumn("_place", place).filter(F.col("_place") <= k).select(*scored.columns)


def _search_in_chunks(
    spark: SparkSession, usable: DataFrame, index: DataFrame, k: int, local_k: int
) -> DataFrame:
    """The hits of a large query table, ranked one bounded chunk at a time, into one written table."""
    path = work_path(spark, "hits")
    with staging(spark) as folder:
        staged = materialise(usable, "queries", folder)
        groups = (
            staged.groupBy("model", F.size("vector").alias("dim"))
            .agg(F.count("*").alias("rows"), F.sum(F.octet_length("query_id") + 16).alias("id_bytes"))
            .collect()
        )
        doubled = staged.groupBy("query_id").count().filter("count > 1").head(1)
        if doubled:
            raise ValueError(f"query_id is not unique: {doubled[0]['query_id']}")
        nothing = _rank(spark.createDataFrame([], SCORED), DEFAULT_K)
        nothing.write.parquet(path)
        for group in groups:
            total = group["rows"] * group["dim"] * 8 + group["id_bytes"]
            # Ids are unique, so their hashes fill the chunks evenly.
            chunks = max(1, -(-2 * total // BROADCAST_BYTES))
            mine = staged.filter((F.col("model") == group["model"]) & (F.size("vector") == group["dim"]))
            for chunk in range(chunks):
                part = mine.filter(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == chunk).toArrow()
                for block in _blocks(part):
                    for one in _passes(block, k, local_k):
                        shared = _broadcast(spark, one)
                        scored = _score(spark, index, one, k, local_k, shared)
                        _rank(scored, k, local_k, folder).write.mode("append").parquet(path)
                        shared.destroy()
    return spark.read.schema(nothing.schema).parquet(path)


def _blocks(queries: pa.Table) -> list[QueryBlock]:
    """Queries in hand, grouped by model and dimension."""
    ids = queries.column("query_id").to_pylist()
    if len(set(ids)) != len(ids):
        raise ValueError("query_id is not unique")
    vectors = queries.column("vector").combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    groups: dict[tuple[str, int], list[int]] = {}
    for i, group in enumerate(zip(queries.column("model").to_pylist(), sizes.tolist())):
        groups.setdefault(group, []).append(i)
    return [
        QueryBlock(
            [ids[i] for i in rows],
            vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim),
            model,
        )
        for (model, dim), rows in groups.items()
    ]


def _passes(block: QueryBlock, k: int, local_k: int) -> list[QueryBlock]:
    """The block cut so that a task's best rows, or counts, stay within STATE_ROWS."""
    step = max(1, STATE_ROWS // (k if k <= local_k else BINS + 1))
    return [
        QueryBlock(block.ids[i : i + step], block.vectors[i : i + step], block.model)
        for i in range(0, len(block.ids), step)
    ]


def _broadcast(spark: SparkSession, block: QueryBlock) -> Broadcast:
    """Plain values, which a worker can load without this package."""
    return spark.sparkContext.broadcast((block.ids, block.vectors))


def _score(
    spark: SparkSession,
    index: DataFrame,
    block: QueryBlock,
    k: int,
    local_k: int,
    shared: Broadcast | None = None,
) -> DataFrame:
    """SCORED rows of one query block: the k best of every group of tasks, or all above the floor.

    Every split of the index is a task. Behind a floor at most 2 x k rows per query are left.
    """
    dim = block.vectors.shape[1]
    docs = index.filter((F.col("model") == block.model) & (F.col("dim") == dim)).select(
        "sha", "source", "vector", "norm"
    )
    if shared is None:
        shared = _broadcast(spark, block)
    if k > local_k:
        floors = _floors(docs, block.vectors, k)
        return docs.mapInArrow(_scorer(shared, dim, k, floors), SCORED)
    return _merged(docs.mapInArrow(_scorer(shared, dim, k), SCORED), len(block.ids), k)


def _floors(docs: DataFrame, vectors: np.ndarray, k: int) -> list[Floor]:
    """A floor for each query that its k best documents reach, and 2 x k at most.

    Each pass counts for the queries that are not settled; a count is at most BINS + 1 numbers per
    query, and _passes bounds the queries.
    """
    dim = vectors.shape[1]
    floors = [Floor() for _ in vectors]
    while open_ones := [i for i, f in enumerate(floors) if f.level is not None]:
        shared = docs.sparkSession.sparkContext.broadcast((vectors[open_ones], [astuple(floors[i]) for i in open_ones]))
        counted = docs.mapInArrow(_counter(shared, dim, k), "q int, bin int, n long, least long, most long")
        sums = F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
        found = counted.groupBy("q", "bin").agg(*sums).toArrow()
        at = found["q"].to_numpy(), found["bin"].to_numpy()
        counts, least, most = (np.zeros((len(open_ones), BINS + 1), t) for t in (np.int64, np.uint64, np.uint64))
        counts[at] = found["n"].to_numpy()
        least[at], most[at] = (unsigned(found[c].to_numpy()) for c in ("least", "most"))
        for i, *row in zip(open_ones, counts, least, most):
            floors[i].narrowed(*row, k, _margin(dim))
        shared.destroy()
    return floors


def _counter(shared: Broadcast, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of documents by query and step; only sums leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, floors = shared.value
        queries = _Side.of(raw)
        counting = Counting([Floor(*f) for f in floors])
        margin = _margin(dim)
        for batch in batches:
            for docs in _doc_blocks(batch, dim, len(raw), k):
                rough = queries.rough @ docs.side.rough.T
                counting.add_rough(rough)
                q, d = np.nonzero(rough >= (counting.from_score - margin)[:, None])
                for qi, di, score in _exact(queries, docs.side, q, d):
                    for one, own in _runs(qi):
                        counting.add_exact(one, score[own], lambda some, d=di[own], of=docs: _names(*of.names(d[some])))
        names = ["q", "bin", "n", "least", "most"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in counting.rows()], names=names)

    return run


def _names(sha: np.ndarray, source: np.ndarray) -> np.ndarray:
    """One byte string in the order of sha, then source."""
    return np.char.add(np.char.add(sha, b"\x00"), source)


def _scorer(
    shared: Broadcast, dim: int, k: int, floors: list[Floor] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The per-task part: blocks of documents against all queries of the broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw = shared.value
        queries = _Side.of(raw)
        best = _Best(len(ids), k) if floors is None else None
        least = best.floor if best else np.array([f.score for f in floors])
        floor = least if best else least.copy()
        for batch in batches:
            for docs in _doc_blocks(batch, dim, len(ids), k):
                for q, d, score in _candidates(queries, docs.side, k, floor):
                    if best is None:
                        q, d, score = (c[score >= least[q]] for c in (q, d, score))
                    names = docs.names(d)
                    if best is None:
                        own = ~_beyond(floors, q, score, _names(*names))
                        yield _scored_batch(ids, q[own], *(c[own] for c in names), score[own])
                    else:
                        best.add(q, *names, score)
        if best is not None:
            yield from (_scored_batch(ids, *part) for part in best.rows())

    return run


def _beyond(floors: list[Floor], q: np.ndarray, score: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which rows have just the score of their query's floor, and a name behind its last one."""
    out = np.zeros(len(q), bool)
    for one, own in _runs(q):
        floor = floors[one]
        if floor.name is not None:
            width = f"S{len(floor.name)}"
            out[own] = (score[own] == floor.score) & (names[own].astype(width) > np.array([floor.name], width)[0])
    return out


def _runs(q: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each query of ascending `q` with its stretch."""
    cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
    for a, b in zip(cuts, [*cuts[1:], len(q)]):
        yield int(q[a]), slice(a, b)


class _Side(NamedTuple):
    """Vectors of one side of the product: exact, their lengths, and rough unit form."""

    exact: np.ndarray
    lengths: np.ndarray
    rough: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, lengths: np.ndarray | None = None) -> _Side:
        exact = vectors.astype(np.float64)
        if lengths is None:
            lengths = np.sqrt(np.cumsum(exact * exact, axis=1)[:, -1])
        return cls(exact, lengths, (exact / lengths[:, None]).astype(np.float32))


class _Docs(NamedTuple):
    sha: pa.Array
    source: pa.Array
    side: _Side

    def names(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = pa.array(rows)
        return _bytes(self.sha.take(taken)), _bytes(self.source.take(taken))


def _doc_blocks(batch: pa.RecordBatch, dim: int, n_queries: int, k: int) -> Iterator[_Docs]:
    """Documents of one Arrow batch in pieces few enough for one block of scores."""
    vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    sha, source = batch.column("sha"), batch.column("source")
    norms = batch.column("norm").to_numpy(zero_copy_only=False)
    keep = _without_surplus_copies(vectors, sha, source, k)
    if keep is not None:
        taken = pa.array(keep)
        sha, source, vectors, norms = sha.take(taken), source.take(taken), vectors[keep], norms[keep]
    step = max(64, BLOCK_SCORES // n_queries)
    for start in range(0, len(vectors), step):
        rows = slice(start, start + step)
        yield _Docs(sha[rows], source[rows], _Side.of(vectors[rows], norms[rows]))


def _without_surplus_copies(
    vectors: np.ndarray, sha: pa.Array, source: pa.Array, k: int
) -> np.ndarray | None:
    """Rows to keep where more than k share one vector, or None to keep all.

    Copies score the same for every query and rank by sha and source, so at
    most the first k of them can be a hit. Without this, a batch full of copies
    would be all candidates.
    """
    if len(vectors) <= k:
        return None
    bits = np.ascontiguousarray(vectors).view(np.uint32).astype(np.uint64)
    odd = np.random.default_rng(len(bits[0])).integers(1, 2**63, bits.shape[1], dtype=np.uint64) * 2 + 1
    _, first, group, size = np.unique(
        (bits * odd).sum(axis=1), return_index=True, return_inverse=True, return_counts=True
    )
    if size.max() <= k:
        return None
    copies = np.flatnonzero((size[group] > k) & (bits == bits[first[group]]).all(axis=1))
    taken = pa.array(copies)
    by_name = np.lexsort((_bytes(source.take(taken)), _bytes(sha.take(taken)), group[copies]))
    ordered = copies[by_name]
    drop = ordered[_places(group[ordered]) >= k]
    return np.setdiff1d(np.arange(len(vectors)), drop, assume_unique=True)


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of each row, from 0, in its run of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _bytes(strings: pa.Array) -> np.ndarray:
    """UTF-8 bytes, which order like Spark strings."""
    return np.array(strings.cast(pa.binary()).to_pylist(), dtype=np.bytes_)


def _margin(dim: int) -> float:
    """More than a float32 product of unit vectors can be off."""
    return 4 * dim * float(np.finfo(np.float32).eps)


def _candidates(
    queries: _Side, docs: _Side, k: int, floor: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, document, similarity) of every pair that may be among the k best.

    A float32 matrix product finds the candidates. It is off by less than the
    margin, so no hit is missed. The pairs that pass are summed again in DOUBLE,
    element by element, and only that number counts: it does not depend on
    where a row lies in a block.
    """
    margin = _margin(queries.exact.shape[1])
    step = max(1, BLOCK_SCORES // len(docs.lengths))
    for start in range(0, len(queries.exact), step):
        rough = queries.rough[start : start + step] @ docs.rough.T
        q, d = np.nonzero(_passing(rough, floor[start : start + step], k, margin))
        yield from _exact(queries, docs, q + start, d)


def _exact(
    queries: _Side, docs: _Side, q: np.ndarray, d: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, document, similarity) of the given pairs, in pieces that keep the products small."""
    piece = max(1, BLOCK_SCORES // queries.exact.shape[1])
    for at in range(0, len(q), piece):
        qi, di = q[at : at + piece], d[at : at + piece]
        exact = np.cumsum(queries.exact[qi] * docs.exact[di], axis=1)[:, -1]
        yield qi, di, exact / (queries.lengths[qi] * docs.lengths[di])


def _passing(rough: np.ndarray, floor: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Which scores may reach the floor; raises `floor` by the block's own k best."""
    passing = rough >= (floor - margin)[:, None]
    many = np.flatnonzero(passing.sum(axis=1) > k)
    if len(many):
        at = rough.shape[1] - k
        kth = np.partition(rough[many], at, axis=1)[:, at]
        floor[many] = np.maximum(floor[many], kth - margin)
        passing[many] = rough[many] >= (floor[many] - margin)[:, None]
    return passing


class _Best:
    """The best k of every query so far, with a floor below which none can enter."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self._kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._pending = 0
        self._limit = max(4 * n_queries * k, 50_000)

    def add(self, q: np.ndarray, sha: np.ndarray, source: np.ndarray, score: np.ndarray) -> None:
        self._kept.append((q, sha, source, score))
        self._pending += len(q)
        if self._pending > self._limit:
            self._prune()

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        if self._kept:
            self._prune()
            yield from self._kept

    def _prune(self) -> None:
        q, sha, source, score = (np.concatenate(column) for column in zip(*self._kept))
        order = np.lexsort((source, sha, -score, q))
        place = _places(q[order])
        order, place = order[place < self.k], place[place < self.k]
        self._kept = [(q[order], sha[order], source[order], score[order])]
        self._pending = len(order)
        last = order[place == self.k - 1]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])


def _scored_batch(
    ids: list[str], q: np.ndarray, sha: np.ndarray, source: np.ndarray, score: np.ndarray
) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.string()).take(pa.array(q)),
            pa.array(sha.tolist(), pa.binary()).cast(pa.string()),
            pa.array(source.tolist(), pa.binary()).cast(pa.string()),
            pa.array(score, pa.float64()),
        ],
        names=SCORED.names,
    )
