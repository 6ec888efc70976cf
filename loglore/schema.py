"""Table schemas and the fixed values every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
BATCH_SIZE = 50
DEFAULT_K = 10
DEFAULT_MODEL = "nomic-embed-text"
SOURCE_MESSAGE = "message"
SOURCE_DIFF_SUMMARY = "diff_summary"
ZERO_TIME = "0001-01-01 00:00:00"
COMMIT_ID_PATTERN = r"^(?:[0-9a-f]{40}|[0-9a-f]{64})\z"
SHORT_ID_LENGTH = 7
NO_HITS_LINE = "No matching commits found."

# Seconds of the first and last instant a four-digit year can hold.
MIN_EPOCH = -62135596800
MAX_EPOCH = 253402300799

_PERSON = (
    T.StructType()
    .add("name", T.StringType())
    .add("email", T.StringType())
    .add("epoch", T.LongType())
    .add("tz_min", T.IntegerType())
)

RAW_COMMIT = (
    T.StructType()
    .add("repo", T.StringType())
    .add("sha", T.StringType())
    .add("parents", T.ArrayType(T.StringType()))
    .add("body", T.StringType())
    .add("author", _PERSON)
    .add("committer", _PERSON)
)

COMMIT = (
    T.StructType()
    .add("repo", T.StringType())
    .add("sha", T.StringType())
    .add("author_name", T.StringType())
    .add("author_email", T.StringType())
    .add("author_date", T.TimestampNTZType())
    .add("committer_name", T.StringType())
    .add("committer_email", T.StringType())
    .add("committer_date", T.TimestampNTZType())
    .add("message", T.StringType())
)

EMBEDDING = (
    T.StructType()
    .add("sha", T.StringType())
    .add("source", T.StringType())
    .add("dim", T.IntegerType())
    .add("vector", T.ArrayType(T.FloatType()))
    .add("model", T.StringType())
)

SYNC_LOG = (
    T.StructType()
    .add("sha", T.StringType())
    .add("source", T.StringType())
    .add("model", T.StringType())
    .add("synced_at", T.TimestampType())
)

# The unit vector is kept as its two parts: the float32 vector as embedded and
# its DOUBLE length. That is half the bytes of a stored DOUBLE unit vector and
# loses nothing; functions.vectors.unit puts the parts together.
INDEX_DOC = (
    T.StructType()
    .add("doc_id", T.StringType())
    .add("sha", T.StringType())
    .add("source", T.StringType())
    .add("vector", T.ArrayType(T.FloatType()))
    .add("norm", T.DoubleType())
    .add("dim", T.IntegerType())
    .add("model", T.StringType())
)

# A hit before its commit is looked up.
SCORED = (
    T.StructType()
    .add("query_id", T.StringType())
    .add("sha", T.StringType())
    .add("source", T.StringType())
    .add("similarity", T.DoubleType())
)

HIT = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ]
    + [f for f in COMMIT.fields if f.name != "sha"]
)

REJECT = (
    T.StructType()
    .add("stage", T.StringType())
    .add("reason", T.StringType())
    .add("sha", T.StringType())
    .add("detail", T.StringType())
)

# A commit whose call to the embedder failed.
PENDING = T.StructType(
    [*COMMIT.fields]
    + [
        T.StructField("model", T.StringType()),
        T.StructField("tries", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

# One row per run: rows by stage, and what went wrong.
RUN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("model", "state")]
    + [
        T.StructField(n, T.LongType())
        for n in ("read", "rejected", "asked", "claimed", "failed", "commits", "embeddings", "indexed", "unindexed")
    ]
    + [
        T.StructField("error", T.StringType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("ended", T.TimestampType()),
    ]
)

# The name a model was asked by, and the one it answered with.
MODEL_NAME = T.StructType().add("asked", T.StringType()).add("answered", T.StringType())

COMMIT_KEY = ["sha"]
EMBEDDING_KEY = ["sha", "model", "source"]
