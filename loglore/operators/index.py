"""The vector index: built from the embeddings table, marked in the sync log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.functions.text import doc_id
from loglore.functions.vectors import norm, vector_problem
from loglore.operators.sizing import exclude, fits_broadcast, restrict
from loglore.operators.tables import TableSet
from loglore.schema import EMBEDDING_KEY, INDEX_DOC
from loglore.session import materialise, remove, staging

# The name under which tables are noted as settled, with no keys.
_SETTLED = "settled"


def index_docs(embeddings: DataFrame) -> DataFrame:
    """INDEX_DOC rows of the embeddings that can be indexed."""
    return (
        embeddings.filter(vector_problem(F.col("vector")).isNull())
        .withColumns({"doc_id": doc_id(), "norm": norm(F.col("vector"))})
        .select(*INDEX_DOC.names)
    )


def index_rejects(embeddings: DataFrame) -> DataFrame:
    """REJECT rows of the embeddings that must not reach the index."""
    return (
        embeddings.withColumn("reason", vector_problem(F.col("vector")))
        .filter(F.col("reason").isNotNull())
        .select(F.lit("index").alias("stage"), "reason", "sha", doc_id().alias("detail"))
    )


def unsynced(embeddings: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Embeddings without a mark in the sync log, marker columns left out.

    Keys are compared first; where the missing ones are few, they travel to the
    vectors, which stay in place.
    """
    missing = exclude(embeddings.select(*EMBEDDING_KEY), sync_log, EMBEDDING_KEY, small=False).distinct()
    return restrict(embeddings, missing, EMBEDDING_KEY, fits_broadcast(missing))


def sync_status(sync_log: DataFrame) -> DataFrame:
    """The last mark of every key."""
    return sync_log.groupBy(*EMBEDDING_KEY).agg(F.max("synced_at").alias("synced_at"))


def marks(docs: DataFrame) -> DataFrame:
    return docs.select("sha", "source", "model").withColumn("synced_at", F.current_timestamp())


def mark_synced(tables: TableSet, keys: DataFrame) -> None:
    """Mark keys as synced; unknown keys change nothing, a repeat renews the time."""
    with staging(tables.spark) as folder:
        wanted = materialise(keys.select(*EMBEDDING_KEY).distinct(), "wanted", folder)
        found = restrict(tables.embeddings(), wanted, EMBEDDING_KEY, fits_broadcast(wanted), tables.prefix_length)
        tables.append_sync_log(marks(found))


def index_batch(tables: TableSet, fresh: DataFrame) -> int:
    """Index embeddings that were just stored for the first time, from the rows in hand.

    The stored table is not read, so a small batch costs the same however large
    the table is. The index is written before the log. Returns the rows added.
    """
    docs = index_docs(fresh)
    added = tables.append_index_docs(docs)
    tables.append_sync_log(marks(docs))
    return added


def settle(tables: TableSet) -> None:
    """Bring the index up to date at the start of a run.

    After runs that ended there is nothing to do, and no stored key is read.
    Keys that a run noted as begun and never indexed are looked up, and they
    alone. Only tables that were never settled are compared as a whole.
    """
    if not tables.exists("begun", _SETTLED):
        sync_index(tables)
        tables.begin(_SETTLED, tables.begun().limit(0))
        return
    begun = tables.begun()
    runs = [r["run"] for r in begun.select("run").distinct().collect()]  # a name per run that broke off
    if runs:
        _repair(tables, begun.select(*EMBEDDING_KEY).distinct())
        close_runs(tables, runs)


def close_runs(tables: TableSet, runs: list[str]) -> None:
    """Drop the notes of runs whose embeddings are indexed."""
    for run in runs:
        remove(tables.spark, tables.path("begun", run))


def _repair(tables: TableSet, begun: DataFrame) -> None:
    """Index the embeddings among `begun` that are stored and not marked."""
    with staging(tables.spark) as folder:
        begun = materialise(begun, "begun", folder)
        few = fits_broadcast(begun)
        stored = restrict(tables.embeddings(), begun, EMBEDDING_KEY, few, tables.prefix_length).select(*EMBEDDING_KEY)
        missing = exclude(stored, tables.sync_log(), EMBEDDING_KEY, few, tables.prefix_length)
        _add_missing(tables, missing, folder)


def sync_index(tables: TableSet) -> None:
    """Repair: add every unsynced embedding to the index, then mark it.

    Keys are compared first, and vectors are read for the missing ones alone.
    The index is written before the log, so a crash in between leaves rows
    unmarked; the next call finds their documents in place and adds only the
    marks.
    """
    keys = tables.embeddings().select(*EMBEDDING_KEY)
    if keys.isEmpty():
        return
    begun = [r["run"] for r in tables.begun().select("run").distinct().collect()] if tables.exists("begun") else []
    with staging(tables.spark) as folder:
        _add_missing(tables, exclude(keys, tables.sync_log(), EMBEDDING_KEY, small=False), folder)
    close_runs(tables, begun)


def _add_missing(tables: TableSet, missing: DataFrame, folder: str) -> None:
    missing = materialise(missing, "unsynced", folder)
    if missing.isEmpty():
        return
    few = fits_broadcast(missing)
    absent = exclude(missing, tables.index_docs(), EMBEDDING_KEY, few)
    lacking = restrict(tables.embeddings(), absent, EMBEDDING_KEY, few, tables.prefix_length)
    tables.append_index_docs(index_docs(lacking))
    tables.append_sync_log(marks(restrict(tables.index_docs(), missing, EMBEDDING_KEY, few)))
