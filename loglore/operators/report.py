"""What a run rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reject_report(rejects: DataFrame) -> DataFrame:
    """Rejected rows by stage and reason."""
    return rejects.groupBy("stage", "reason").agg(F.count("*").alias("n_rows"))
