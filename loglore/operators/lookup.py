"""Commits by id, and hits with their commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglore.functions.text import hit_line
from loglore.operators.number import number_rows
from loglore.operators.sizing import fits_broadcast
from loglore.operators.tables import check_layout
from loglore.schema import COMMIT_ID_PATTERN, HIT, NO_HITS_LINE
from loglore.session import materialise


def request_list(lists: DataFrame, ids: str = "ids") -> DataFrame:
    """A row per id of every array in `ids`, with `pos` from 0 and `sha`; other columns stay."""
    kept = [c for c in lists.columns if c != ids]
    return lists.select(*kept, F.posexplode(ids).alias("pos", "sha"))


def find_commits(
    commits: DataFrame, ids: DataFrame, small: bool | None = None, prefix_length: int = 0
) -> DataFrame:
    """The commit of every row of `ids` (`sha` and anything else).

    Unknown ids drop out and repeated ids repeat. With `prefix_length`, that of
    the stored `sha_prefix` folders, only the folders of the wanted ids are
    read; another length than the stored one is an error. A small id table is broadcast; a large one is joined by shuffle, where
    the adaptive plan splits an id that is asked for very often.
    """
    if small is None:
        small = fits_broadcast(ids)
    # A plain pattern filter also tells the optimizer that pruning folders pays.
    wanted = ids.filter(F.col("sha").rlike(COMMIT_ID_PATTERN))
    keys = ["sha"]
    if prefix_length:
        check_layout(commits, prefix_length)
        wanted = wanted.withColumn("sha_prefix", F.substring("sha", 1, prefix_length))
        keys = ["sha_prefix", "sha"]
    found = commits.join(F.broadcast(wanted) if small else wanted, keys)
    return found.drop("sha_prefix")


def lookup(
    commits: DataFrame, ids: DataFrame, order: tuple[str, ...] = ("pos",), prefix_length: int = 0
) -> DataFrame:
    """Commits of request lists, in request order; `order` names the list before `pos` if there are several."""
    return find_commits(commits, ids, prefix_length=prefix_length).orderBy(*order)


def with_commits(
    hits: DataFrame, commits: DataFrame, small: bool | None = None, prefix_length: int = 0
) -> DataFrame:
    """HIT rows; a hit without commit is dropped, ranks stay those of the hit list."""
    return find_commits(commits, hits, small, prefix_length).select(*HIT.names)


def hit_list(hits: DataFrame, many: bool = False) -> DataFrame:
    """Add `display`, one numbered entry per hit; numbers have no gaps.

    With `many` hits per query these do not meet in one task to be numbered:
    their ranks are numbered by ranges, without the messages, and joined back.
    """
    if many:
        hits = materialise(hits, "hits-with-commits")
        places = number_rows(hits.select("query_id", "rank"), ["query_id"], [F.col("rank")], "line_no")
        numbered = hits.join(places, ["query_id", "rank"])
    else:
        number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        numbered = hits.withColumn("line_no", number.cast("long"))
    return numbered.withColumn("display", hit_line("line_no", "sha", "similarity", "message"))


def result_pages(queries: DataFrame, listed: DataFrame) -> DataFrame:
    """The hit list of every query; a query without hits gets one line that says so."""
    return (
        queries.select("query_id")
        .join(listed, "query_id", "left")
        .withColumn("display", F.coalesce("display", F.lit(NO_HITS_LINE)))
    )
