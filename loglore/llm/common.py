"""Small helpers of the operators: tables, words, Arrow columns."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Words are runs of anything but space and 0x09 to 0x0D. `bytes.split()` splits at just these
# bytes and `bytes.lower()` changes A-Z alone, so words of a UTF-8 text are cut without a decode.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that Python objects are made for a few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks.

    Functions reach the workers by value, so a module's own globals start anew in each task.
    """
    holder = sys.modules.setdefault("_loglore_process_cache", types.ModuleType("_loglore_process_cache"))
    return holder.__dict__.setdefault(name, {})


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file's content, read on the driver; it travels with the job.

    Its size is fixed by the vocabulary (1.5 MB), whatever the data.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")
