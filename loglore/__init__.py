"""Commit memory on Spark: logs of many repositories in, ranked similar commits out."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from loglore.schema import (
    BATCH_SIZE,
    COMMIT,
    DEFAULT_K,
    DEFAULT_MODEL,
    EMBEDDING,
    HIT,
    INDEX_DOC,
    RAW_COMMIT,
    REJECT,
    SOURCE_MESSAGE,
    SYNC_LOG,
)

__all__ = [
    "BATCH_SIZE",
    "COMMIT",
    "DEFAULT_K",
    "DEFAULT_MODEL",
    "EMBEDDING",
    "HIT",
    "INDEX_DOC",
    "RAW_COMMIT",
    "REJECT",
    "SOURCE_MESSAGE",
    "SYNC_LOG",
]

# Functions of this package travel to the Python workers with the job, so the
# executors need no installed copy of it.
register_pickle_by_value(sys.modules[__name__])
