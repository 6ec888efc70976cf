"""Commits whose call failed, kept until a later run has their vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.operators.clean import commit_order
from loglore.operators.sizing import fits_broadcast, restrict
from loglore.operators.tables import TableSet, absent_rows
from loglore.schema import COMMIT, COMMIT_KEY, PENDING
from loglore.session import materialise, remove


def queue_of(model: str) -> str:
    """The folder of a model's queue; names of models may hold anything."""
    return hashlib.sha256(model.encode()).hexdigest()[:16]


def waiting(tables: TableSet, model: str) -> DataFrame:
    """The waiting commits of a model: content, tries and last error.

    A run that was cut short between writing its own failures and dropping those it had claimed
    leaves a commit twice; the row with more tries counts.
    """
    return tables.pending().filter(F.col("queue") == queue_of(model))


def claim(tables: TableSet, model: str, folder: str) -> tuple[DataFrame | None, list[str]]:
    """Id and tries of the waiting commits of a model, written under `folder`, and the runs they failed in."""
    if not tables.exists("pending", queue_of(model)):
        return None, []
    rows = waiting(tables, model)
    claimed = rows.groupBy("sha").agg(F.max("tries").alias("tries"))
    runs = rows.select("run").distinct().collect()  # a name per run that had failures since
    return materialise(claimed, "claimed", folder), [r["run"] for r in runs]


def taken_up(tables: TableSet, claimed: DataFrame, fresh: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """The claimed commits that are not `stored` yet, each as it comes in now (`fresh`) or else as it waited."""
    ids = claimed.select(*COMMIT_KEY)
    seen = restrict(fresh, ids, COMMIT_KEY, fits_broadcast(ids)).withColumn("_tries", F.lit(None).cast("int"))
    both = seen.unionByName(waiting(tables, model).select(*COMMIT.names, F.col("tries").alias("_tries")))
    order = [F.col("_tries").desc_nulls_first(), *commit_order()]
    return absent_rows(both, stored, COMMIT_KEY, order, folders=tables.prefix_length).select(*COMMIT.names)


def failures(answered: DataFrame, claimed: DataFrame | None, model: str) -> DataFrame:
    """PENDING rows of the commits that `answered` has no vector for."""
    failed = answered.filter(F.col("error").isNotNull()).select(*COMMIT.names, "error", F.lit(model).alias("model"))
    if claimed is None:
        return failed.withColumn("tries", F.lit(1)).select(*PENDING.names)
    few = F.broadcast(claimed) if fits_broadcast(claimed) else claimed
    again = failed.join(few, "sha", "left")
    return again.withColumn("tries", F.coalesce("tries", F.lit(0)) + 1).select(*PENDING.names)


def put_back(tables: TableSet, failed: DataFrame | None, model: str, run: str, claimed_runs: list[str]) -> None:
    """Write this run's failures and drop those that it had claimed, in that order."""
    if failed is not None:
        tables.write_pending(failed, queue_of(model), run)
    for old in claimed_runs:
        if failed is None or old != run:
            remove(tables.spark, tables.path("pending", queue_of(model), old))
