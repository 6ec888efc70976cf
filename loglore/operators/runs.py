"""What each run came to: a ledger of runs, and the marks of those that have not ended."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.operators.tables import TableSet
from loglore.schema import RUN

#: Kinds of errors that an outcome spells out, the most frequent first; the rejects table has them all.
MOST_ERRORS = 20

DONE, FAILED = "done", "failed"
#: Counts of a run, in the order of its stages.
STAGES = ["read", "rejected", "asked", "claimed", "failed", "commits", "embeddings", "indexed", "unindexed"]


@dataclass
class RunOutcome:
    """Rows per stage and the errors of a run.

    read: raw rows; rejected: commits that cannot be stored; asked: texts sent to the embedder, of
    which `claimed` had failed before; failed: texts without a vector; commits, embeddings, indexed:
    rows added; unindexed: vectors that cannot be searched.
    """

    run: str
    model: str
    state: str = DONE
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(STAGES, 0))
    errors: list[str] = field(default_factory=list)

    @property
    def error(self) -> str | None:
        """All errors as one text, or None."""
        return "\n".join(self.errors) or None


@contextmanager
def recorded(tables: TableSet, run: str, model: str) -> Iterator[RunOutcome]:
    """An outcome that is written to the ledger however the run ends; an exception goes on."""
    outcome = RunOutcome(run, model)
    started = time.time()
    try:
        yield outcome
    except Exception as failure:
        outcome.state = FAILED
        outcome.errors.append(f"store: {_first_line(failure)}")
        raise
    finally:
        row = (run, model, outcome.state, *outcome.counts.values(), outcome.error, started, time.time())
        # Names as given here, times as timestamps.
        names = ["run", "model", "state", *STAGES, "error", "started", "ended"]
        kinds = ", ".join(f"{n} {'long' if n in STAGES else 'double' if n in ('started', 'ended') else 'string'}" for n in names)
        ledger = tables.spark.createDataFrame([row], kinds).withColumns(
            {c: F.timestamp_seconds(c) for c in ("started", "ended")}
        )
        tables.write_run(ledger.select(*RUN.names), run)


def _first_line(failure: Exception) -> str:
    return f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"


def error_lines(rejects: DataFrame, most: int = MOST_ERRORS) -> list[str]:
    """A line per kind of error with its rows: the reason, or what a failed call said."""
    said = F.when(F.col("stage") == "embed", F.col("detail")).otherwise(F.col("reason"))
    kinds = rejects.groupBy("stage", said.alias("said")).agg(F.count("*").alias("n_rows"))
    top = kinds.orderBy(F.col("n_rows").desc(), "stage", "said").limit(most + 1).collect()
    lines = [f"{r['stage']}: {r['said']} ({r['n_rows']} rows)" for r in top[:most]]
    return lines + ["and more kinds, see the rejects"] * (len(top) > most)
