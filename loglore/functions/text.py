"""Column functions over ids and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglore.schema import COMMIT_ID_PATTERN, SHORT_ID_LENGTH


def is_commit_id(sha: Column | str) -> Column:
    """Lower-case hex of exactly 40 or 64 characters; NULL counts as invalid."""
    return F.coalesce(_col(sha).rlike(COMMIT_ID_PATTERN), F.lit(False))


def id_folder(sha: Column, length: int) -> Column:
    """The first digits of an id, filled up where the id is shorter, so that every id has a folder."""
    return F.rpad(F.substring(sha, 1, length), length, "_")


def short_id(sha: Column | str) -> Column:
    return F.substring(_col(sha), 1, SHORT_ID_LENGTH)


def first_line(text: Column | str) -> Column:
    """Everything before the first newline, untrimmed."""
    return F.substring_index(_col(text), "\n", 1)


def doc_id(sha: Column | str = "sha", model: Column | str = "model", source: Column | str = "source") -> Column:
    return F.concat_ws("|", _col(sha), _col(model), _col(source))


def hit_line(rank: Column | str, sha: Column | str, similarity: Column | str, message: Column | str) -> Column:
    """One numbered entry of a result list."""
    return F.format_string(
        "%d. %s  (similarity: %.4f)\n   %s",
        _col(rank),
        short_id(sha),
        _col(similarity),
        first_line(message),
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
