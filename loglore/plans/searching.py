"""The whole search: text queries in, numbered commit lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.functions.embedders import EmbedderFactory
from loglore.operators.embed import embed
from loglore.operators.lookup import hit_list, with_commits
from loglore.operators.search import MAX_LOCAL_K, search
from loglore.schema import DEFAULT_K
from loglore.session import materialise, staging


def embed_queries(queries: DataFrame, factory: EmbedderFactory, model: str = "") -> DataFrame:
    """Add the vectors of a table of queries `query_id, text`.

    A query that cannot be embedded ends the job: there is nothing to search for.
    """
    answered = embed(queries, factory, model, text="text")
    failed = F.raise_error(F.concat(F.lit("embedding query: "), F.col("error")))
    return answered.withColumn(
        "vector", F.when(F.col("error").isNull(), F.col("vector")).otherwise(failed)
    ).drop("error")


def search_text(
    queries: DataFrame,
    index: DataFrame,
    commits: DataFrame,
    factory: EmbedderFactory,
    model: str = "",
    k: int = DEFAULT_K,
    prefix_length: int = 0,
) -> DataFrame:
    """HIT rows with their display lines for many text queries at once.

    Each text is embedded once: the query vectors are written, as a search may
    read them several times. The hits are narrow and dear, so they are written
    before the look-up; their measured size decides how they meet the commits.
    """
    with staging(queries.sparkSession) as folder:
        asked = materialise(embed_queries(queries, factory, model), "asked", folder)
        hits = materialise(search(asked, index, k), "hits")
    return hit_list(with_commits(hits, commits, prefix_length=prefix_length), many=k > MAX_LOCAL_K)
