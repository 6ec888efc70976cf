from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loglore.functions.embedders import HASHED_MODEL, Reply, hashed_words
from loglore.operators.clean import check_commits, good_commits
from loglore.operators.embed import _slices, attach_vectors, embed, embed_rejects, embedded, embedding_rows
from loglore.operators.number import number_rows, with_batch_no
from loglore.plans.searching import embed_queries
from loglore.schema import DEFAULT_MODEL
from tests.commits import commit, raw, sha


def fixed(model):
    return lambda texts: Reply([[0.1, 0.2]] * len(texts), "fake-model")


def counting(model):
    """Answers with the size of the call and its number within the task."""
    calls = []

    def call(texts):
        calls.append(len(texts))
        return Reply([[float(len(texts)), float(len(calls))]] * len(texts), model)

    return call


def refuses(model):
    def call(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("embed boom")
        return Reply([[1.0]] * len(texts), model)

    return call


def short(model):
    return lambda texts: Reply([[1.0]] * (len(texts) - 1), model)


def long(model):
    return lambda texts: Reply([[1.0]] * (len(texts) + 1), model)


def silent(model):
    return lambda texts: Reply([], model)


def broken_factory(model):
    raise AssertionError("built without need")


def commits_of(spark, n, **changes):
    rows = [commit(i, **changes) for i in range(n)]
    return good_commits(check_commits(raw(spark, rows))).coalesce(1)


@pytest.mark.parametrize(
    ("n", "calls"),
    [(3, {3.0: 3}), (49, {49.0: 49}), (50, {50.0: 50}), (51, {50.0: 50, 1.0: 1}), (100, {50.0: 100})],
)
def test_batches_of_fifty(spark, n, calls):
    rows = embed(commits_of(spark, n), counting).collect()
    sizes = [r["vector"][0] for r in rows]
    assert {s: sizes.count(s) for s in sizes} == calls


def test_slices_do_not_depend_on_arrow_batches(spark, conf):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch=7)
    sizes = [r["vector"][0] for r in embed(commits_of(spark, 120), counting).collect()]
    assert sizes == [50.0] * 100 + [20.0] * 20


def test_full_mapping(spark):
    row = embedded(embed(commits_of(spark, 1), fixed)).first()
    assert (row["sha"], row["message"], row["author_name"]) == (sha(0), "commit body 0", "Ada")
    assert (row["model"], row["source"], row["dim"]) == ("fake-model", "message", 2)
    assert row["vector"] == [pytest.approx(0.1), pytest.approx(0.2)]


def test_model_name_falls_back_to_the_default(spark):
    assert embed(commits_of(spark, 1), counting).first()["model"] == DEFAULT_MODEL
    assert embed(commits_of(spark, 1), counting, "mine").first()["model"] == "mine"


def test_failed_call_rejects_its_slice_and_the_rest_goes_on(spark):
    commits = commits_of(spark, 120).withColumn(
        "message", F.when(F.col("sha") == sha(60), F.lit("bad")).otherwise(F.col("message"))
    )
    answered = embed(commits.orderBy("sha").coalesce(1), refuses)
    assert {r["sha"] for r in embedding_rows(answered).collect()} == {sha(i) for i in (*range(50), *range(100, 120))}
    rejects = embed_rejects(answered).collect()
    assert len(rejects) == 50
    assert {(r["stage"], r["detail"]) for r in rejects} == {("embed", "RuntimeError: embed boom")}


@pytest.mark.parametrize("factory", [short, long, silent])
def test_reply_of_wrong_length_rejects_the_slice(spark, factory):
    answered = embed(commits_of(spark, 3), factory)
    assert embedding_rows(answered).count() == 0
    assert embed_rejects(answered).count() == 3


def test_no_embedder_is_built_for_no_rows(spark):
    assert embed(commits_of(spark, 3).filter("false"), broken_factory).count() == 0


def test_numbered_batches_are_the_calls(spark):
    commits = commits_of(spark, 130).withColumn("repo", F.when(F.col("sha") < sha(70), "a").otherwise("b"))
    numbered = with_batch_no(commits.repartition(5), [F.col("sha")])
    rows = embed(numbered, counting, batch=["repo", "batch_no"]).collect()
    sizes = {(r["repo"], r["batch_no"]): r["vector"][0] for r in rows}
    assert sizes == {("a", 0): 50, ("a", 1): 20, ("b", 0): 50, ("b", 1): 10}
    assert {r["sha"]: r["batch_no"] for r in rows if r["repo"] == "a"} == {sha(i): i // 50 for i in range(70)}


def test_numbering_of_a_hot_group_with_ties(spark, conf):
    conf(spark__sql__shuffle__partitions=6, spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = [("hot", i % 3) for i in range(900)] + [(f"g{i % 7}", i) for i in range(200)] + [(None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    numbered = number_rows(df, ["g"], [F.col("v")], "n").collect()
    groups: dict = {}
    for r in numbered:
        groups.setdefault(r["g"], []).append((r["n"], r["v"]))
    assert len(numbered) == len(rows)
    for got in groups.values():
        got.sort()
        assert [n for n, _ in got] == list(range(1, len(got) + 1))
        assert [v for _, v in got] == sorted(v for _, v in got)


def test_hot_group_is_spread(spark, conf):
    conf(spark__sql__shuffle__partitions=6, spark__sql__adaptive__enabled="false")
    df = spark.range(6000).select(F.lit("hot").alias("g"), F.lit(1).alias("v"))
    placed = df.withColumn("t", F.monotonically_increasing_id()).repartitionByRange("g", "v", "t")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2000


def test_vectors_made_elsewhere(spark):
    commits = commits_of(spark, 3)
    results = spark.createDataFrame(
        [(sha(0), [1.0, 2.0], "m"), (sha(2), [3.0], "m"), (sha(9), [4.0], "m")], "id string, vector array<float>, model string"
    )
    enriched, unknown = attach_vectors(commits, results)
    assert {(r["sha"], r["dim"], r["message"]) for r in enriched.collect()} == {
        (sha(0), 2, "commit body 0"),
        (sha(2), 1, "commit body 2"),
    }
    assert [(r["sha"], r["reason"]) for r in unknown.collect()] == [(sha(9), "unknown commit id")]


def test_query_that_cannot_be_embedded_ends_the_search(spark):
    queries = spark.createDataFrame([("1", "bad words")], "query_id string, text string")
    with pytest.raises(PySparkException, match="embedding query: RuntimeError: embed boom"):
        embed_queries(queries, refuses).collect()


def test_hashed_words():
    vectors = hashed_words()(["Fix the Parser", "fix\tthe\n\n parser ", "", "fix fix fix"]).vectors
    assert np.array_equal(vectors[0], vectors[1])
    assert not vectors[2].any()
    assert vectors[3].max() == 1.0
    assert math.isclose(float(np.linalg.norm(vectors[0])), 1.0, rel_tol=1e-6)
    assert hashed_words("whatever")(["x"]).model == HASHED_MODEL


@pytest.mark.parametrize("key", [None, "k"])
def test_batches_are_cut_without_a_copy(key):
    """Slices are as before, and of two batches only the slice between them is copied."""
    rng = np.random.default_rng(5)
    for sizes in ([10_000, 10_000], [0, 3, 0, 7], [50, 50], [120, 1, 1, 200]):
        keys = np.sort(rng.integers(0, max(sum(sizes) // 40, 1), sum(sizes))).astype(str)
        texts = [f"text {i}" * 10 for i in range(len(keys))]
        whole = pa.RecordBatch.from_pydict({"text": texts, "k": keys.tolist()})
        starts = np.cumsum([0, *sizes[:-1]])
        batches = [whole.take(pa.array(np.arange(a, a + n))) for a, n in zip(starts, sizes)]
        before = pa.total_allocated_bytes()
        found, most = [], 0
        for piece in _slices(iter(batches), 50, key):
            found.append(piece.column("text").to_pylist())
            most = max(most, pa.total_allocated_bytes() - before)
            if key:
                assert len(set(piece.column("k").to_pylist())) == 1
        assert [t for f in found for t in f] == texts
        assert len(found) == (len(set(keys)) if key else -(-len(texts) // 50))
        assert most < 100_000
