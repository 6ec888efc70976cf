"""Commits, vectors and queries derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglore.schema import MIN_EPOCH, SOURCE_MESSAGE

FIXTURE_MODEL = "fixture-64"
FIRST_EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_of(key: Column) -> Column:
    """A valid 64-digit id of a row key."""
    return F.sha2(key.cast("string"), 256)


def raw_from_documents(documents: DataFrame, sha: Column | None = None) -> DataFrame:
    """RAW_COMMIT rows, one per document, the text as message.

    A missing author date is the zero time, a missing committer date is NULL;
    both mean the same to the index.
    """
    key = F.col("doc_id")
    parents = F.array(sha_of(F.concat(key, F.lit("-p1"))), sha_of(F.concat(key, F.lit("-p2"))))
    n_parents = F.when(key % 7 == 0, 2).when(key % 11 == 0, 0).otherwise(1)
    return documents.select(
        F.col("source").alias("repo"),
        (sha_of(key) if sha is None else sha).alias("sha"),
        F.slice(parents, F.lit(1), n_parents).alias("parents"),
        F.col("text").alias("body"),
        _person(key, 0, F.lit(MIN_EPOCH).cast("long")).alias("author"),
        _person(key + 1, 60, F.lit(None).cast("long")).alias("committer"),
    )


def raw_from_conversations(conversations: DataFrame) -> DataFrame:
    """A second feed: one root commit per turn, written by its role."""
    key = F.concat(F.lit("conv-"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    person = F.struct(
        F.col("role").alias("name"),
        F.lit("").alias("email"),
        (F.col("conv_id") * 60 + F.col("turn") + FIRST_EPOCH).alias("epoch"),
        F.lit(0).alias("tz_min"),
    )
    return conversations.select(
        F.lit("conversations").alias("repo"),
        sha_of(key).alias("sha"),
        F.array().cast("array<string>").alias("parents"),
        F.col("text").alias("body"),
        person.alias("author"),
        person.alias("committer"),
    )


def spoilt_sha() -> Column:
    """Ids of documents of which half are malformed, in one of five ways."""
    key = F.col("doc_id")
    sha = sha_of(key)
    return (
        F.when(key % 10 == 0, F.upper(sha))
        .when(key % 10 == 1, F.substring(sha, 1, 38))
        .when(key % 10 == 2, F.concat(F.lit("z"), F.substring(sha, 2, 63)))
        .when(key % 10 == 3, F.lit(""))
        .when(key % 10 == 4, F.concat(sha, F.lit("\n")))
        .otherwise(sha)
    )


def fixture_embeddings(vectors: DataFrame, source: str = SOURCE_MESSAGE) -> DataFrame:
    """EMBEDDING rows of the stored vectors."""
    return vectors.select(
        sha_of(F.col("vec_id")).alias("sha"),
        F.lit(source).alias("source"),
        F.size("embedding").alias("dim"),
        F.col("embedding").alias("vector"),
        F.lit(FIXTURE_MODEL).alias("model"),
    )


def benchmark_vectors(benchmark: DataFrame, vectors: DataFrame) -> DataFrame:
    """Query vectors: the stored vector with the number of each benchmark item."""
    return benchmark.join(vectors, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").cast("string").alias("query_id"),
        F.col("embedding").alias("vector"),
        F.lit(FIXTURE_MODEL).alias("model"),
    )


def _person(key: Column, later: int, missing: Column) -> Column:
    name = F.concat(F.lit("dev"), key % 17)
    return F.struct(
        name.alias("name"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(name, F.lit("@example.com"))).alias("email"),
        F.when(key % 13 == 0, missing).otherwise(key * 3600 + FIRST_EPOCH + later).alias("epoch"),
        F.lit(0).alias("tz_min"),
    )
