"""From raw commits to checked COMMIT rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglore.functions.text import is_commit_id
from loglore.schema import COMMIT, MAX_EPOCH, MIN_EPOCH, ZERO_TIME

REQUIRED = ["author_name", "committer_name", "message"]

# Columns that decide which of several rows of one commit is kept.
_PREFERENCE = [
    "committer_date",
    "repo",
    "author_date",
    "message",
    "author_name",
    "author_email",
    "committer_name",
    "committer_email",
]


def commit_order() -> list[Column]:
    """The row kept of one commit: the earliest, then by label and content."""
    return [F.col(c).asc_nulls_last() for c in _PREFERENCE]


def drop_merges(raw: DataFrame) -> DataFrame:
    """Commits with at most one parent; roots stay."""
    return raw.filter(F.coalesce(F.size("parents"), F.lit(0)) <= 1)


def flatten(raw: DataFrame) -> DataFrame:
    """Author and committer as columns, dates in UTC, body as message.

    A date outside the four-digit years comes out as NULL here and is reported
    by `commit_problem` through `date_out_of_range`. `malformed` stays, where
    the source has it.
    """
    return raw.select(
        "repo",
        "sha",
        F.col("author.name").alias("author_name"),
        F.col("author.email").alias("author_email"),
        utc_date(F.col("author.epoch")).alias("author_date"),
        F.col("committer.name").alias("committer_name"),
        F.col("committer.email").alias("committer_email"),
        utc_date(F.col("committer.epoch")).alias("committer_date"),
        F.col("body").alias("message"),
        (_out_of_range("author.epoch") | _out_of_range("committer.epoch")).alias("date_out_of_range"),
        *[c for c in raw.columns if c == "malformed"],
    )


def utc_date(epoch: Column) -> Column:
    """Seconds since 1970 as a zone-free UTC timestamp, whatever the session zone."""
    inside = F.when(epoch.between(MIN_EPOCH, MAX_EPOCH), epoch)
    return F.timestamp_add("SECOND", inside, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty e-mails and zero times become NULL; names and message stay."""
    zero = F.lit(ZERO_TIME).cast("timestamp_ntz")
    return df.withColumns(
        {c: F.nullif(F.col(c), F.lit("")) for c in ("author_email", "committer_email")}
        | {c: F.nullif(F.col(c), zero) for c in ("author_date", "committer_date")}
    )


def null_to_empty(df: DataFrame) -> DataFrame:
    """The read-back form: NULL e-mails as empty, NULL dates as the zero time."""
    zero = F.lit(ZERO_TIME).cast("timestamp_ntz")
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("author_email", "committer_email")}
        | {c: F.coalesce(F.col(c), zero) for c in ("author_date", "committer_date")}
    )


def commit_problem() -> Column:
    """Why a flattened commit cannot be stored, or NULL."""
    problem = F.when(F.col("sha").isNull(), F.lit("sha is null")).when(
        ~is_commit_id("sha"), F.lit("invalid commit id")
    )
    for name in REQUIRED:
        problem = problem.when(F.col(name).isNull(), F.lit(f"{name} is null"))
    return problem.when(F.col("date_out_of_range"), F.lit("date out of range"))


def check_commits(raw: DataFrame) -> DataFrame:
    """Raw commits to COMMIT rows with a `reason` column, NULL for good rows.

    A record that the source could not read has that for a reason, its file as
    `repo` and its text as `message`.
    """
    flat = flatten(drop_merges(raw))
    problem = commit_problem()
    if "malformed" in flat.columns:
        problem = F.when(F.col("malformed"), F.lit("malformed record")).otherwise(problem)
    return empty_to_null(flat.withColumn("reason", problem)).select(*COMMIT.names, "reason")


def good_commits(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).select(*COMMIT.names)


def rejected_commits(checked: DataFrame, stage: str = "clean") -> DataFrame:
    """REJECT rows of checked commits."""
    return checked.filter(F.col("reason").isNotNull()).select(
        F.lit(stage).alias("stage"), "reason", "sha", F.col("repo").alias("detail")
    )


def reject_whole_batches(checked: DataFrame, batch: list[str]) -> DataFrame:
    """Strict mode: one bad row rejects every row of its batch.

    `batch` names the columns that number the batches (see number.with_batch_no).
    Nulls in them are equal, as they are to the numbering.
    """
    named = [F.col(c).alias(f"_bad{i}") for i, c in enumerate(batch)]
    bad = checked.filter(F.col("reason").isNotNull()).select(*named, F.lit(True).alias("_spoilt")).distinct()
    same = F.lit(True)
    for i, c in enumerate(batch):
        same = same & F.col(c).eqNullSafe(F.col(f"_bad{i}"))
    spoilt = F.when(F.col("_spoilt"), F.lit("batch holds an invalid commit"))
    return (
        checked.join(bad, same, "left")
        .withColumn("reason", F.coalesce("reason", spoilt))
        .select(*checked.columns)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    The rank filter becomes a group limit on both sides of the shuffle, so a
    key with very many copies sends at most one row per input partition.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def _out_of_range(epoch: str) -> Column:
    return F.coalesce(~F.col(epoch).between(MIN_EPOCH, MAX_EPOCH), F.lit(False))
