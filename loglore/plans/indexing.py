"""The whole index run: raw commits in, stored commits, embeddings and index out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loglore.functions.embedders import EmbedderFactory, model_or_default
from loglore.operators.clean import (
    check_commits,
    commit_order,
    good_commits,
    reject_whole_batches,
    rejected_commits,
)
from loglore.operators.embed import embed, embed_rejects, embedded
from loglore.operators.index import close_runs, index_batch, index_rejects, settle
from loglore.operators.number import with_batch_no
from loglore.operators.pending import claim, failures, put_back, taken_up
from loglore.operators.runs import RunOutcome, error_lines, recorded
from loglore.operators.sizing import exclude, fits_broadcast, restrict
from loglore.operators.tables import TableSet, absent_rows
from loglore.schema import COMMIT, COMMIT_KEY, EMBEDDING_KEY, MODEL_NAME, REJECT, SOURCE_MESSAGE
from loglore.session import materialise, observed, staging


def arrival_order() -> list[Column]:
    """The order in which strict mode numbers its batches."""
    return [F.col("committer_date").asc_nulls_last(), F.col("sha").asc_nulls_last()]


def index_commits(
    raw: DataFrame,
    tables: TableSet,
    factory: EmbedderFactory,
    model: str = "",
    run: str | None = None,
    strict: bool = False,
    concurrency: int | None = None,
    repair: bool = True,
) -> RunOutcome:
    """Index raw commits into `tables`; running it again changes nothing stored.

    Returns what the run came to, which the ledger `tables.runs()` keeps as
    well, also for a run that dies. A run starts by repairing what an earlier
    one that was cut short had begun; a stream does that once and not for every
    batch.

    Commits that already have a vector of `model`, or of a name that this model
    has answered with before, are left out before the embedder is called.
    Commits whose call failed earlier are taken up again, one to a call, so that
    one that always fails holds no others back, as they are now if they come in again; those that fail now wait for the
    next run. The checked input and the embedded rows are written once each, as
    both feed several sinks and an embedder need not answer twice the same.
    Tables are written in the order commits, embeddings, index, log. `strict`
    rejects the whole batch of a bad commit instead of the row. `run` names the
    run; one of the same name replaces its rejects and its row of the ledger,
    one without a name gets a name of its own. `concurrency` sets how many tasks
    call the embedder at a time.
    """
    wanted = model_or_default(model)
    run = f"run-{uuid.uuid4().hex}" if run is None else run
    tables.path("runs", run)  # the name must be fit for a folder
    with recorded(tables, run, wanted) as outcome:
        if repair:
            settle(tables)
        with staging(raw.sparkSession) as folder:
            checked = _checked(raw, strict, folder, outcome)
            claimed, claimed_runs = claim(tables, wanted, folder)
            answered = _answered(checked, claimed, tables, factory, wanted, concurrency, folder, outcome)
            good = embedded(answered)
            if outcome.counts["asked"] > outcome.counts["failed"]:
                _store(good, tables, run, wanted, folder, outcome)
            failed = failures(answered, claimed, wanted) if outcome.counts["failed"] else None
            put_back(tables, failed, wanted, run, claimed_runs)
            rejects = rejected_commits(checked).unionByName(embed_rejects(answered)).unionByName(index_rejects(good))
            written = Observation()
            tables.write_rejects(rejects.observe(written, F.count("*").alias("rows")), run)
            if observed(written).get("rows"):
                mine = raw.sparkSession.read.schema(REJECT).parquet(tables.path("rejects", run))
                outcome.errors += error_lines(mine)
    return outcome


def _checked(raw: DataFrame, strict: bool, folder: str, outcome: RunOutcome) -> DataFrame:
    read, found = Observation(), Observation()
    checked = check_commits(raw.observe(read, F.count("*").alias("rows")))
    if strict:
        numbered = with_batch_no(checked, arrival_order(), folder=folder)
        checked = reject_whole_batches(numbered, ["repo", "batch_no"])
    checked = checked.observe(found, F.count_if(F.col("reason").isNotNull()).alias("rows"))
    checked = materialise(checked, "checked", folder)
    outcome.counts["read"] = observed(read).get("rows", 0)
    outcome.counts["rejected"] = observed(found).get("rows", 0)
    return checked


def _answered(
    checked: DataFrame,
    claimed: DataFrame | None,
    tables: TableSet,
    factory: EmbedderFactory,
    wanted: str,
    concurrency: int | None,
    folder: str,
    outcome: RunOutcome,
) -> DataFrame:
    """The commits that still lack a vector, with the embedder's answers."""
    names = [wanted, *_answered_names(tables, wanted)]
    known = tables.embeddings().filter(F.col("model").isin(names) & (F.col("source") == SOURCE_MESSAGE))
    good = good_commits(checked)
    new = good
    if claimed is not None:
        ids = claimed.select(*COMMIT_KEY)
        new = good.join(F.broadcast(ids) if fits_broadcast(ids) else ids, COMMIT_KEY, "left_anti")
    todo = absent_rows(new, known, COMMIT_KEY, commit_order(), folders=tables.prefix_length)
    if concurrency:
        todo = todo.repartition(concurrency)
    answered = embed(todo, factory, wanted)
    if claimed is not None:
        again = materialise(taken_up(tables, claimed, good, known, wanted), "again", folder)
        answered = answered.unionByName(embed(again, factory, wanted, batch_size=1))
        outcome.counts["claimed"] = again.count()
    made = Observation()
    asked = F.count("*").alias("asked"), F.count_if(F.col("error").isNotNull()).alias("failed")
    renamed = F.count_if(F.col("model") != wanted).alias("renamed")
    answered = materialise(answered.observe(made, *asked, renamed), "embedded", folder)
    found = observed(made)
    outcome.counts |= {c: found.get(c, 0) for c in ("asked", "failed")}
    if found.get("renamed"):
        others = answered.filter(F.col("error").isNull()).select("model").distinct()
        new = [r["model"] for r in others.collect() if r["model"] not in names]  # a name or two
        if new:
            tables.add_models(tables.spark.createDataFrame([(wanted, n) for n in new], MODEL_NAME))
    return answered


def _answered_names(tables: TableSet, asked: str) -> list[str]:
    """Names under which a model has answered when asked by this one."""
    if not tables.exists("models"):
        return []
    return [r["answered"] for r in tables.models().filter(F.col("asked") == asked).distinct().collect()]


def _store(
    good: DataFrame, tables: TableSet, run: str, wanted: str, folder: str, outcome: RunOutcome
) -> None:
    keys = good.select(*EMBEDDING_KEY)
    small = fits_broadcast(keys)
    fresh = good
    if not keys.filter(F.col("model") != wanted).isEmpty():
        # Answers under another name than asked for may be stored already.
        absent = exclude(keys, tables.embeddings(), EMBEDDING_KEY, small, tables.prefix_length)
        new_keys = materialise(absent, "fresh", folder)
        fresh = restrict(good, new_keys, EMBEDDING_KEY, small)
    counts = outcome.counts
    counts["commits"] = tables.append_commits(good, unique=True, small=small)
    tables.begin(run, fresh)
    counts["embeddings"] = tables.add_embeddings(fresh)
    counts["indexed"] = index_batch(tables, fresh)
    counts["unindexed"] = counts["embeddings"] - counts["indexed"]
    close_runs(tables, [run])
