"""Indexing commits as they arrive."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loglore.functions.embedders import EmbedderFactory
from loglore.operators.index import settle
from loglore.operators.tables import TableSet
from loglore.plans.indexing import index_commits


def index_stream(
    raw_stream: DataFrame,
    tables: TableSet,
    factory: EmbedderFactory,
    checkpoint: str,
    model: str = "",
    processing_time: str | None = None,
    concurrency: int | None = None,
) -> StreamingQuery:
    """Start a stream that indexes every micro-batch of raw commits.

    What an earlier run left unmarked is repaired first. Each micro-batch is a
    run of its own in the ledger, with its counts and errors, and takes up the
    commits whose call failed in an earlier one. Without
    `processing_time` the stream takes what is available and stops. A batch that
    is replayed after a failure stores nothing twice, as every append leaves out
    what is stored, and replaces that batch's rejects, which are named after the
    checkpoint and the batch. Commits of any date are taken at any time, so there is no
    watermark and no state beyond the tables.
    """
    settle(tables)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, batch_id: int) -> None:
        here = replace(tables, spark=batch.sparkSession)
        index_commits(batch, here, factory, model, f"stream-{stream}-batch-{batch_id}", concurrency=concurrency, repair=False)

    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return (
        raw_stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
