"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", app: str = "loglore") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    parts = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of every column expression cost more here than small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    global _local_dir
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="loglore-")
    return _local_dir


def work_path(spark: SparkSession, label: str) -> str:
    """A new path for one intermediate table."""
    return f"{shared_dir(spark)}/loglore/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage without tying the rows to the executors that made them.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables of one run, removed when it ends."""
    folder = work_path(spark, "staging")
    try:
        yield folder
    finally:
        remove(spark, folder)


def observed(metrics: Observation) -> dict[str, int]:
    """What was counted while rows were written.

    A table that is known to be empty beforehand is written without its counters, and has none.
    """
    try:
        return metrics.get
    except Py4JJavaError as missing:
        if "assertion failed" not in str(missing.java_exception):
            raise
        return {}


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote; one that is not there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def mark(spark: SparkSession, file: str) -> None:
    """Write an empty file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    if not exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [entry.getPath().getName() for entry in found]
