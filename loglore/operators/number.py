"""Row numbers inside groups without a group ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglore.operators.sizing import fits_broadcast
from loglore.schema import BATCH_SIZE
from loglore.session import materialise

# monotonically_increasing_id counts the rows of a partition in its low 33 bits.
_POSITION_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str, folder: str | None = None) -> DataFrame:
    """Add `name`, the row's number from 1 in its `by` group, in `order`.

    Rows are range partitioned by group and order, so a large group spans many
    partitions. A row's number is its place in its partition plus the rows of
    its group in earlier partitions; only one row per group and partition is
    needed to work that out. The sorted rows are written once, as range bounds
    are sampled and must not change between the two uses.

    Bounds are sampled from the ordering columns, so those must be short: order
    by a hash of a long text, not by the text.

    Rows equal in every ordering column are told apart by a running id, so they
    spread too. For that id to come out the same when a lost task runs again,
    `df` must read a table or written rows without a shuffle in between;
    `materialise` it first where it does not.

    `folder` takes the written rows; who names it removes it. The starts, a row
    per group and partition, are broadcast where they are measured to be small.
    """
    groups = [F.col(c) for c in by]
    running = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*groups, *order, F.col("_tie")]
    placed = (
        running.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)))
        .drop("_tie")
    )
    placed = materialise(placed, "numbered", folder)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*by, "_part")
        .agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1)
        .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_shift")
    )
    starts = materialise(starts, "starts", folder)
    if fits_broadcast(starts):
        starts = F.broadcast(starts)
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.join(starts, same)
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .select(*df.columns, name)
    )


def with_batch_no(
    df: DataFrame,
    order: list[Column],
    by: tuple[str, ...] = ("repo",),
    size: int = BATCH_SIZE,
    folder: str | None = None,
) -> DataFrame:
    """Number batches of `size` rows from 0 inside each group; the last is shorter."""
    numbered = number_rows(df, list(by), order, "_row", folder)
    return numbered.withColumn("batch_no", F.floor((F.col("_row") - 1) / size)).drop("_row")
