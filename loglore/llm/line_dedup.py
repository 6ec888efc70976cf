"""Boilerplate lines of a site: lines that stand on too large a share of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglore.operators.sizing import fits_broadcast
from loglore.session import materialise

#: A line is boilerplate if it stands on more than this share of its host's pages,
RATIO = 0.08
#: and on so many pages at least: a share means little on a small site.
LEAST_PAGES = 5

_LINES, _HOST = "__ll_lines", "__ll_host"


def boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES
) -> DataFrame:
    """Host and the hash of each of its boilerplate lines.

    A page counts once for a line, however often it repeats it. Pages of a host with one and the same
    text count as one, in a line's pages and in the host's total, so copies of a document do not
    make its lines boilerplate. A host has at most (distinct lines
    of a page on average) / ratio such lines, however many pages it has. Pages are counted per host
    and line with partial sums, so a host with a third of all pages meets nowhere in one task.
    """
    once = F.array_distinct(F.transform(_worded(F.col("text")), lambda x: F.xxhash64(x)))
    page = F.xxhash64("text").alias("page")
    lines = docs.select(F.col(host).alias(_HOST), page, F.explode(once).alias("line")).distinct()
    pages = docs.select(F.col(host).alias("of_host"), page).distinct()
    common = lines.groupBy(_HOST, "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    totals = pages.groupBy("of_host").agg(F.count("*").alias("of_pages"))
    joined = common.join(totals, F.col(_HOST).eqNullSafe(F.col("of_host")))
    return joined.where(F.col("pages") > ratio * F.col("of_pages")).select(_HOST, "line")


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES, counts: bool = False
) -> DataFrame:
    """`docs`, all columns, with the boilerplate lines of each row's host taken out of `text`.

    With `counts`, n_lines and n_dropped are added (and replace columns of these names). Lines end
    at \\n and are compared whole; lines without a word are never dropped. A null text stays null
    and has no lines. Null is a host of its own. Rows that repeat a text are answered each, and are one
    page (`boilerplate`). Documents stay where they are; the boilerplate travels, broadcast behind a check of its size.
    """
    found = materialise(boilerplate(docs, host, ratio, least), "boilerplate-lines")
    small = fits_broadcast(found)
    grouped = found.groupBy(_HOST).agg(F.collect_set("line").alias(_LINES))
    joined = docs.join(
        F.broadcast(grouped) if small else grouped, docs[host].eqNullSafe(grouped[_HOST]), "left"
    )
    lines = F.split(F.col("text"), "\n", -1)
    stays = F.filter(
        lines, lambda x: ~F.coalesce(F.array_contains(F.col(_LINES), F.xxhash64(x)), F.lit(False)) | ~_has_word(x)
    )
    columns = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    out = [F.array_join(stays, "\n").alias("text") if c == "text" else docs[c] for c in columns]
    if counts:
        total = F.coalesce(F.size(lines), F.lit(0))
        total = F.when(F.col("text").isNull(), 0).otherwise(total)
        dropped = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(stays))
        out += [total.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")]
    return joined.select(*out)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _worded(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), _has_word)
