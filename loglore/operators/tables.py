"""The stored tables: read, append what is new, check, cascade."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglore.functions.text import id_folder
from loglore.functions.vectors import blob_problem
from loglore.operators.clean import commit_order, first_per_key
from loglore.operators.sizing import exclude, fits_broadcast
from loglore.schema import (
    COMMIT,
    COMMIT_KEY,
    EMBEDDING,
    EMBEDDING_KEY,
    INDEX_DOC,
    MODEL_NAME,
    PENDING,
    REJECT,
    RUN,
    SYNC_LOG,
)
from loglore.session import exists, mark, observed, remove, subfolders

_PREFIX = T.StructField("sha_prefix", T.StringType())
#: Tables that grow by appends, and so are worth compacting.
COMPACTED = ("commits", "embeddings", "index_docs", "sync_log")
_COMPLETE = "_COMPLETE"  # readers pass over names that begin so
_KEYS = T.StructType([EMBEDDING[n] for n in EMBEDDING_KEY])


def _by(schema: T.StructType, *folders: str) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(f, T.StringType()) for f in folders)])


@dataclass(frozen=True)
class TableSet:
    """The Parquet tables under one base path; one not yet written reads as empty.

    `commits`, `embeddings` and `sync_log` are laid out by the first
    `prefix_length` digits of the id: ids are uniform, so the folders are even,
    and a look-up of a few ids, or an append of a few rows, reads only their
    folders; with 0 there are none. `embeddings` and `index_docs` are laid out
    by model, as a search reads all vectors of one model. One writer at a time.

    Many small appends leave many small files; `compact` writes them anew, as
    the next version of the table.

    `begun` holds, by run, the keys of embeddings that are being stored; they go
    when the run has indexed them. `pending` holds commits whose call failed, by
    model and run, `runs` what each run came to, `models` the names models
    answered with.
    """

    spark: SparkSession
    base: str
    prefix_length: int = 2

    def commits(self) -> DataFrame:
        """COMMIT columns, and `sha_prefix` where there are folders; so embeddings and sync log."""
        return self._read("commits")

    def embeddings(self) -> DataFrame:
        return self._read("embeddings")

    def index_docs(self) -> DataFrame:
        return self._read("index_docs")

    def sync_log(self) -> DataFrame:
        return self._read("sync_log")

    def rejects(self) -> DataFrame:
        return self._read("rejects")

    def begun(self) -> DataFrame:
        return self._read("begun")

    def pending(self) -> DataFrame:
        return self._read("pending")

    def runs(self) -> DataFrame:
        return self._read("runs")

    def models(self) -> DataFrame:
        return self._read("models")

    def append_commits(self, new: DataFrame, unique: bool = False, small: bool | None = None) -> int:
        """Store commits whose id is not stored; the first write wins. Returns how many.

        `unique` says that `new` holds no id twice, which saves a shuffle, and
        `small` that its keys have been found to fit a broadcast.
        """
        return self._append_absent("commits", new, COMMIT_KEY, None if unique else commit_order(), small)

    def append_embeddings(self, new: DataFrame, unique: bool = False, small: bool | None = None) -> int:
        """Store embeddings whose (sha, model, source) is not stored; flags as for commits.

        Their keys count as begun until an index run or `sync_index` has them in the index.
        """
        order = [F.col("dim"), F.col("vector")]
        order = None if unique else order
        fresh = absent_rows(new, self.embeddings(), EMBEDDING_KEY, order, small, self.prefix_length)
        self.begin(f"append-{uuid.uuid4().hex}", new)
        return self._append("embeddings", fresh)

    def add_embeddings(self, fresh: DataFrame) -> int:
        """Store embeddings whose keys are known to be unique and not stored, and begun."""
        return self._append("embeddings", fresh)

    def append_index_docs(self, docs: DataFrame) -> int:
        return self._append("index_docs", docs)

    def append_sync_log(self, marks: DataFrame) -> int:
        return self._append("sync_log", marks)

    def write_rejects(self, rejects: DataFrame, run: str) -> None:
        """Replace the rejects of one run, so a repeated run reports once."""
        self._replace("rejects", rejects, run)

    def begin(self, run: str, keys: DataFrame) -> None:
        """Note the keys of embeddings before they are stored."""
        self._replace("begun", keys, run)

    def write_pending(self, failed: DataFrame, queue: str, run: str) -> None:
        self._replace("pending", failed, queue, run)

    def write_run(self, row: DataFrame, run: str) -> None:
        """Replace a run's row in the ledger."""
        self._replace("runs", row.coalesce(1), run)

    def add_models(self, names: DataFrame) -> None:
        self._append("models", names.coalesce(1))

    def path(self, name: str, *folders: str) -> str:
        """The folder of a table, or of a part that is written and removed as a whole."""
        for folder in folders:
            if not re.fullmatch(r"[\w.-]+", folder):
                raise ValueError(f"run name is not fit for a folder: {folder!r}")
        _, layout = self._specs()[name]
        return "/".join([self._path(name), *(f"{c}={f}" for c, f in zip(layout, folders))])

    def exists(self, name: str, *folders: str) -> bool:
        """Whether anything was written to a table, or to a part of it."""
        return exists(self.spark, self.path(name, *folders))

    def _replace(self, name: str, rows: DataFrame, *folders: str) -> None:
        schema, layout = self._specs()[name]
        path = self.path(name, *folders)
        rows.select(*[n for n in schema.names if n not in layout]).write.mode("overwrite").parquet(path)

    def prefix(self, sha: Column | str = "sha") -> Column:
        """The folder of an id in `commits`."""
        return id_folder(F.col(sha) if isinstance(sha, str) else sha, self.prefix_length)

    def _append_absent(
        self, name: str, new: DataFrame, keys: list[str], order: list[Column] | None, small: bool | None
    ) -> int:
        return self._append(name, absent_rows(new, self._read(name), keys, order, small, self.prefix_length))

    def _append(self, name: str, rows: DataFrame) -> int:
        """Add rows and tell how many, counted as they are written."""
        schema, layout = self._specs()[name]
        if "sha_prefix" in layout:
            check_layout(self._read(name), self.prefix_length)
            rows = rows.withColumn("sha_prefix", self.prefix())
        written = Observation()
        rows = rows.select(*schema.names).observe(written, F.count("*").alias("rows"))
        if "sha_prefix" in layout:
            # Many folders: rebalancing gives each few files of even size. By
            # model there are few folders, and the index need not travel for them.
            rows = rows.hint("rebalance", "sha_prefix")
        rows.write.mode("append").partitionBy(*layout).parquet(self._path(name))
        return observed(written).get("rows", 0)

    def compact(self, name: str) -> int:
        """Write a table anew in few files, as its next version. Returns how many rows it has.

        Files get the session's advisory partition size, folders stay. The new
        version holds as soon as it is marked, after its last file; a run that
        dies before leaves the old one in force. Readers of the old version go
        on undisturbed until `drop_versions`. It reads and writes the whole
        table, so it pays when small files have come to be many.
        """
        if name not in COMPACTED:
            raise ValueError(f"{name} is not compacted; it is kept by run")
        schema, layout = self._specs()[name]
        if not exists(self.spark, self._path(name)):
            return 0
        path = f"{self.base}/{name}@{max(self._versions(name), default=0) + 1:06d}"
        written = Observation()
        rows = self._read(name).select(*schema.names).observe(written, F.count("*").alias("rows"))
        rows.hint("rebalance", *layout).write.partitionBy(*layout).parquet(path)
        mark(self.spark, f"{path}/{_COMPLETE}")
        return observed(written).get("rows", 0)

    def drop_versions(self, name: str) -> int:
        """Remove versions that are not in force, those of compactions that died included."""
        current = self._path(name)
        known = [f"{self.base}/{name}", *(f"{self.base}/{name}@{v:06d}" for v in self._versions(name))]
        old = [path for path in known if path != current and exists(self.spark, path)]
        for path in old:
            remove(self.spark, path)
        return len(old)

    def _versions(self, name: str) -> list[int]:
        """Numbers of the versions that were begun, whole or not."""
        found = [re.fullmatch(rf"{name}@(\d+)", folder) for folder in subfolders(self.spark, self.base)]
        return [int(m.group(1)) for m in found if m]

    def _read(self, name: str) -> DataFrame:
        schema, _ = self._specs()[name]
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _path(self, name: str) -> str:
        """The version in force: the last that is marked, or the folder that was there first."""
        if name in COMPACTED:
            for number in sorted(self._versions(name), reverse=True):
                path = f"{self.base}/{name}@{number:06d}"
                if exists(self.spark, f"{path}/{_COMPLETE}"):
                    return path
        return f"{self.base}/{name}"

    def _specs(self) -> dict[str, tuple[T.StructType, list[str]]]:
        folders = [_PREFIX] if self.prefix_length else []
        names = [f.name for f in folders]
        return {
            "commits": (T.StructType([*COMMIT.fields, *folders]), names),
            "embeddings": (T.StructType([*EMBEDDING.fields, *folders]), ["model", *names]),
            "index_docs": (INDEX_DOC, ["model"]),
            "sync_log": (T.StructType([*SYNC_LOG.fields, *folders]), names),
            "rejects": (_by(REJECT, "run"), ["run"]),
            "begun": (_by(_KEYS, "run"), ["run"]),
            "pending": (_by(PENDING, "queue", "run"), ["queue", "run"]),
            "runs": (_by(RUN, "run"), ["run"]),
            "models": (MODEL_NAME, []),
        }


def check_layout(stored: DataFrame, prefix_length: int) -> None:
    """Fail if stored rows lie in folders of another prefix: looking there would find nothing."""
    row = stored.filter(F.col("sha").isNotNull()).select(F.length("sha_prefix").alias("n")).first()
    if row and row["n"] != prefix_length:
        raise ValueError(f"rows are stored by {row['n'] or 0} digits of the id, not by {prefix_length}")


def absent_rows(
    new: DataFrame,
    stored: DataFrame,
    keys: list[str],
    order: list[Column] | None,
    small: bool | None = None,
    folders: int = 0,
) -> DataFrame:
    """One row, the first in `order`, of every key of `new` that is not stored.

    `folders` is the length of the `sha_prefix` that `stored` is laid out by.

    Without `order`, `new` holds no key twice. A small `new` loses its stored
    rows before the rest is shuffled by key. A large one is cut to one row per
    key first: that happens before the shuffle, so copies of a key never meet,
    and the join that follows finds its rows already in place.
    """
    one = (lambda df: first_per_key(df, keys, order)) if order else (lambda df: df)
    existing = stored.select(*keys, *(["sha_prefix"] if folders else []))
    if existing.isEmpty():
        return one(new)
    if small is None:
        small = fits_broadcast(new.select(*keys))
    if small:
        return one(exclude(new, existing, keys, small, folders))
    return exclude(one(new), existing, keys, small)


def embedding_problem() -> Column:
    """Why an embedding row breaks the table's own rules, or NULL."""
    problem = F.when(F.col("sha").isNull(), F.lit("sha is null"))
    for name in ("source", "model", "dim"):
        problem = problem.when(F.col(name).isNull(), F.lit(f"{name} is null"))
    return problem.when(F.col("vector").isNull(), F.lit("vector is null")).when(
        F.size("vector") != F.col("dim"), F.lit("vector size does not match dim")
    )


def check_embeddings(embeddings: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split embeddings into those that may be stored and REJECT rows.

    An embedding needs its commit, its required columns and a vector as long as
    `dim`. The search for orphans compares ids only, and the orphans travel to
    the vectors where they are measured to be few.
    """
    checked = embeddings.withColumn("reason", embedding_problem())
    sound = checked.filter(F.col("reason").isNull()).drop("reason")
    broken = checked.filter(F.col("reason").isNotNull()).select("reason", "sha", "model", "source")
    orphans = (
        sound.select("sha", "model", "source")
        .join(commits.select("sha"), "sha", "left_anti")
        .withColumn("reason", F.lit("no such commit"))
    )
    rejects = broken.unionByName(orphans).select(
        F.lit("store").alias("stage"), "reason", "sha", F.concat_ws("|", "model", "source").alias("detail")
    )
    gone = orphans.select("sha").distinct()
    if fits_broadcast(gone):
        return sound.join(F.broadcast(gone), "sha", "left_anti"), rejects
    return sound.join(commits.select("sha"), "sha", "left_semi"), rejects


def check_packed(packed: DataFrame, vector: str = "vector") -> DataFrame:
    """Add `reason` to packed vectors: NULL where the bytes fit `dim`."""
    return packed.withColumn("reason", blob_problem(F.col(vector), F.col("dim")))


def cascade(embeddings: DataFrame, surviving: DataFrame) -> DataFrame:
    """Embeddings left once only `surviving` commits are; write to a new path.

    Only ids are compared with the commits; ids to delete then go to the vectors.
    """
    known = embeddings.filter(F.col("sha").isNotNull())
    gone = known.select("sha").distinct().join(surviving.select("sha"), "sha", "left_anti")
    return cascade_delete(known, gone)


def cascade_delete(embeddings: DataFrame, deleted: DataFrame) -> DataFrame:
    """Embeddings left once the `deleted` ids are gone.

    A deletion that fits a broadcast leaves the vectors where they are.
    """
    ids = deleted.select("sha")
    return embeddings.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "sha", "left_anti")

