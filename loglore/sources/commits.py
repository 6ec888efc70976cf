"""Readers for exported commit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from loglore.schema import RAW_COMMIT

# Separators of a log dump, as written by
#   git log --all --format='%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%cn%x1f%ce%x1f%ct%x1f%B%x1e'
RECORD_SEPARATOR = "\x1e"
FIELD_SEPARATOR = "\x1f"
DUMP_FIELDS = ["sha", "parents", "an", "ae", "at", "cn", "ce", "ct", "body"]


def read_commits(
    spark: SparkSession, path: str | list[str], fmt: str = "json", tolerant: bool = False
) -> DataFrame:
    """Exported raw commits; a malformed JSON record ends the job.

    With `tolerant`, malformed records come along and are told by a further
    column, see `quarantined`; an index run then rejects them one by one.
    """
    if tolerant:
        return quarantined(spark.read.text(path), fmt)
    reader = spark.read.schema(RAW_COMMIT)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def read_commit_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    files_per_trigger: int | None = None,
    tolerant: bool = False,
) -> DataFrame:
    """The same exports as they arrive in a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if tolerant:
        return quarantined(reader.text(path), fmt)
    reader = reader.schema(RAW_COMMIT).format(fmt)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.load(path)


def quarantined(lines: DataFrame, fmt: str = "json") -> DataFrame:
    """RAW_COMMIT columns and `malformed` from lines of JSON.

    A malformed line keeps its whole record as `body`, the file it lies in as
    `repo`, and its id if that could be read; its other columns are NULL. Blank
    lines are passed over; a line that is no object, `null` and arrays included,
    is malformed.
    """
    if fmt != "json":
        raise ValueError(f"only JSON is read with malformed records, not {fmt}")
    schema = T.StructType([*RAW_COMMIT.fields, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.filter(F.col("value").rlike(r"\S")).select(
        "value", F.col("_metadata.file_path").alias("file"), parsed.alias("r")
    )
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull() | ~F.col("value").rlike(r"\A\s*\{")
    instead = {"repo": F.col("file"), "sha": F.col("r.sha"), "body": F.col("value")}
    return rows.withColumn("malformed", broken).select(
        *[
            F.when(~F.col("malformed"), F.col(f"r.{c}")).otherwise(instead.get(c, F.lit(None))).alias(c)
            for c in RAW_COMMIT.names
        ],
        "malformed",
    )


def read_log_dump(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """Raw commits of delimited log dumps.

    `repo` labels a dump of one repository; without it, dumps are expected
    under `repo=<name>/` folders. The message is the last field, so it may hold
    newlines and field separators. A record with too few fields, or a time that
    is no number, ends the job.
    """
    schema = "value string" if repo is not None else "value string, repo string"
    lines = spark.read.schema(schema).text(path, lineSep=RECORD_SEPARATOR)
    label = F.lit(repo) if repo is not None else F.col("repo")
    record = F.regexp_replace("value", r"\A\r?\n", "")
    split = (
        lines.select(label.alias("repo"), record.alias("record"))
        .filter(F.col("record") != "")
        .withColumn("f", F.split("record", FIELD_SEPARATOR, len(DUMP_FIELDS)))
        .withColumn(
            "f",
            F.when(F.size("f") == len(DUMP_FIELDS), F.col("f"))
            # Filters may be reordered, so the empty record is named here too.
            .when(
                F.col("record") != "",
                F.raise_error(F.concat(F.lit("log dump record with too few fields: "), F.col("f")[0])),
            ),
        )
    )
    at = {name: F.col("f")[i] for i, name in enumerate(DUMP_FIELDS)}
    return split.select(
        "repo",
        at["sha"].alias("sha"),
        F.filter(F.split(at["parents"], " "), lambda p: p != "").alias("parents"),
        at["body"].alias("body"),
        _person(at["an"], at["ae"], at["at"]).alias("author"),
        _person(at["cn"], at["ce"], at["ct"]).alias("committer"),
    )


def dump_record() -> Column:
    """One record of a log dump from RAW_COMMIT columns; NULL becomes empty."""
    fields = [
        F.col("sha"),
        F.array_join("parents", " "),
        F.col("author.name"),
        F.col("author.email"),
        F.col("author.epoch").cast("string"),
        F.col("committer.name"),
        F.col("committer.email"),
        F.col("committer.epoch").cast("string"),
        F.col("body"),
    ]
    return F.concat_ws(FIELD_SEPARATOR, *[F.coalesce(f, F.lit("")) for f in fields])


def write_log_dump(raw: DataFrame, path: str) -> None:
    """Write raw commits as log dumps, one folder per repository."""
    raw.select("repo", dump_record().alias("value")).write.partitionBy("repo").text(path, lineSep=RECORD_SEPARATOR)


def union_exports(*exports: DataFrame) -> DataFrame:
    """All exports as one; the same commit may be in several of them, `malformed` in some."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)


def _person(name: Column, email: Column, epoch: Column) -> Column:
    return F.struct(
        name.alias("name"),
        email.alias("email"),
        F.nullif(epoch, F.lit("")).cast("long").alias("epoch"),
        F.lit(None).cast("int").alias("tz_min"),
    )
