"""Embedding as a job over a table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglore.functions.embedders import EmbedderFactory, Reply, model_or_default
from loglore.schema import BATCH_SIZE, EMBEDDING, SOURCE_MESSAGE

_MADE = (
    T.StructType()
    .add("vector", T.ArrayType(T.FloatType()))
    .add("model", T.StringType())
    .add("error", T.StringType())
)


def embed(
    df: DataFrame,
    factory: EmbedderFactory,
    model: str = "",
    text: str = "message",
    batch_size: int = BATCH_SIZE,
    batch: list[str] | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Add `vector`, `model` and `error` to every row.

    Texts go to the embedder in slices of at most `batch_size`. A slice whose
    call fails, or whose reply has the wrong length, keeps its rows with
    `error` set and no vector; the other slices go on. The rest of the row
    passes through untouched, so no join brings the vector back to its commit.

    Slices follow the rows of a task. With `batch`, the columns that number
    batches beforehand, a slice is exactly one numbered batch. `concurrency`
    spreads the rows of a table scan with fewer splits over that many tasks; a
    scan with enough of them stays where it is.
    """
    wanted = model_or_default(model)
    if batch:
        df = df.repartition(*([concurrency] if concurrency else []), *batch).sortWithinPartitions(*batch)
    elif concurrency and df.rdd.getNumPartitions() < concurrency:
        df = df.repartition(concurrency)
    if batch:
        df = df.withColumn("_batch", F.to_json(F.struct(*batch)))
    out = T.StructType([f for f in df.schema.fields if f.name != "_batch"] + _MADE.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = None
        for piece in _slices(batches, batch_size, "_batch" if batch else None):
            if embedder is None:
                embedder = factory(wanted)
            texts = piece.column(text).to_pylist()
            try:
                reply = embedder(texts)
                vectors, used = _checked(reply, len(texts))
                error = None
            except Exception as failure:  # noqa: BLE001  a failed call rejects its slice, not the job
                vectors, used, error = [None] * len(texts), None, f"{type(failure).__name__}: {failure}"
            kept = [(n, c) for n, c in zip(piece.schema.names, piece.columns) if n != "_batch"]
            made = [
                pa.array(vectors, pa.list_(pa.float32())),
                pa.array([used] * len(texts), pa.string()),
                pa.array([error] * len(texts), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept] + made, names=[n for n, _ in kept] + _MADE.names
            )

    return df.mapInArrow(run, out)


def embedded(df: DataFrame) -> DataFrame:
    """Rows that have a vector, with source tag and dimension."""
    return (
        df.filter(F.col("error").isNull())
        .withColumn("source", F.lit(SOURCE_MESSAGE))
        .withColumn("dim", F.size("vector"))
        .drop("error")
    )


def embedding_rows(df: DataFrame) -> DataFrame:
    return embedded(df).select(*EMBEDDING.names)


def embed_rejects(df: DataFrame) -> DataFrame:
    """REJECT rows of failed slices."""
    return df.filter(F.col("error").isNotNull()).select(
        F.lit("embed").alias("stage"),
        F.lit("embedding failed").alias("reason"),
        "sha",
        F.col("error").alias("detail"),
    )


def attach_vectors(commits: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join vectors made elsewhere (`id, vector, model`) to their commits.

    Returns the enriched commits, and a REJECT row for every result whose id is
    no commit. Commits without a result are not part of either.
    """
    enriched = embedded(
        commits.join(results.withColumnRenamed("id", "sha"), "sha").withColumn("error", F.lit(None).cast("string"))
    )
    unknown = (
        results.select(F.col("id").alias("sha"), "model")
        .join(commits.select("sha"), "sha", "left_anti")
        .select(
            F.lit("embed").alias("stage"),
            F.lit("unknown commit id").alias("reason"),
            "sha",
            F.col("model").alias("detail"),
        )
    )
    return enriched, unknown


def _checked(reply: Reply, asked: int) -> tuple[list[np.ndarray], str]:
    vectors = [np.asarray(v, dtype=np.float32) for v in reply.vectors]
    if len(vectors) != asked:
        raise ValueError(f"reply has {len(vectors)} vectors for {asked} texts")
    return vectors, reply.model


def _slices(batches: Iterator[pa.RecordBatch], size: int, key: str | None) -> Iterator[pa.RecordBatch]:
    """Cut a stream of Arrow batches at every `size` rows, or where `key` changes.

    Only a slice that spans batches is copied, so a task holds the batches it is given and no more.
    """
    parts: list[pa.RecordBatch] = []  # a slice that may go on in the next batch
    for incoming in batches:
        at = 0
        for cut in _cuts(incoming, size, key, parts):
            yield pa.concat_batches([*parts, incoming.slice(at, cut - at)]) if parts else incoming.slice(at, cut - at)
            parts, at = [], cut
        if at < incoming.num_rows:
            parts.append(incoming.slice(at))
    if parts:
        yield pa.concat_batches(parts)


def _cuts(incoming: pa.RecordBatch, size: int, key: str | None, parts: list[pa.RecordBatch]) -> list[int]:
    """Where slices end in `incoming`, of which the first began with `parts`."""
    if key is None:
        return list(range(size - sum(p.num_rows for p in parts), incoming.num_rows + 1, size))
    if not incoming.num_rows:
        return []
    keys = incoming.column(key).to_numpy(zero_copy_only=False)
    ends = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    return [0, *ends] if parts and parts[-1].column(key)[-1].as_py() != keys[0] else ends
