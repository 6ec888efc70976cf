"""Small commits for tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from loglore.schema import RAW_COMMIT


def sha(i: int) -> str:
    return f"{i:040x}"


def person(name: str | None = "Ada", email: str = "ada@example.com", epoch: int | None = 1767225600) -> dict:
    return {"name": name, "email": email, "epoch": epoch, "tz_min": 0}


def commit(i: int | str, **changes: object) -> dict:
    number = i if isinstance(i, str) else sha(i)
    return {
        "repo": "r",
        "sha": number,
        "parents": ["p"],
        "body": f"commit body {i}",
        "author": person(),
        "committer": person("Bob", "bob@example.com", 1767312000),
    } | changes


def raw(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame(list(rows), RAW_COMMIT)
