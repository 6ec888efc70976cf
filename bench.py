"""

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loglore.functions.embedders import HASHED_MODEL, hashed_words  # noqa: E402
from loglore.operators.embed import embed  # noqa: E402
from loglore.operators.index import index_docs  # noqa: E402
from loglore.operators.search import search  # noqa: E402
from loglore.plans.fixture import benchmark_vectors, fixture_embeddings, table  # noqa: E402
from loglore.plans.queries import QUERIES  # noqa: E402
from loglore.session import local_session  # noqa: E402


def timed(run: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def median_of(run: Callable[[], DataFrame], times: int = 5) -> float:
    timed(run)
    return round(statistics.median(timed(run) for _ in range(times)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "loglore-bench")
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        table(spark, sf_dir, name).count()

    vectors = table(spark, sf_dir, "embeddings")
    stored = fixture_embeddings(vectors)
    docs = index_docs(stored)
    some = benchmark_vectors(table(spark, sf_dir, "benchmark"), vectors)
    every = stored.select(F.col("sha").alias("query_id"), "vector", "model")
    documents = table(spark, sf_dir, "documents")

    seconds = {name: timed(lambda q=query: q(spark, sf_dir)) for name, query in QUERIES.items()}
    extra = {
        "top10_benchmark_queries_median": median_of(lambda: search(some, docs)),
        "top10_every_vector_as_query_median": median_of(lambda: search(every, docs)),
        "hashed_embedding_of_documents_median": median_of(
            lambda: embed(documents, hashed_words, HASHED_MODEL, text="text", concurrency=int(cpus))
        ),
    }
    print(
        json.dumps(
            {
                "metric": "total of registered queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds | extra,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
