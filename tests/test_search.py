"""Search against brute force, with the sizes that switch its ways turned down."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import loglore.operators.floors as floors
import loglore.operators.search as searching
from loglore.functions.text import first_line
from loglore.functions.vectors import cosine
from loglore.operators.index import index_docs
from loglore.operators.lookup import find_commits, hit_list, lookup, request_list, with_commits
from loglore.operators.search import best_per_commit, count_documents, query_rejects, search
from loglore.plans.searching import search_text
from loglore.functions.embedders import HASHED_MODEL, hashed_words
from loglore.operators.clean import check_commits, good_commits
from loglore.operators.embed import embed, embedding_rows
from tests.commits import commit, raw, sha

DOC = "sha string, source string, dim int, vector array<float>, model string"


def documents(spark, vectors, model="m", source="message", first=0):
    rows = [
        (sha(first + i), source, len(v), [float(x) for x in v], model)
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, DOC)


def queries(spark, vectors, model="m"):
    rows = [(f"q{i}", [float(x) for x in v], model) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "query_id string, vector array<float>, model string")


def brute(asked, docs, k):
    """Rank every pair by similarity, then sha, then source, in plain Python."""
    found = []
    for q in asked.collect():
        u = np.array(q["vector"], np.float64)
        scored = []
        for d in docs.collect():
            if d["model"] != q["model"] or d["dim"] != len(u):
                continue
            v = np.array(d["vector"], np.float64)
            lengths = np.sqrt(np.cumsum(u * u)[-1]) * np.sqrt(np.cumsum(v * v)[-1])
            scored.append((-(np.cumsum(u * v)[-1] / lengths), d["sha"], d["source"]))
        for rank, (s, number, source) in enumerate(sorted(scored)[:k], 1):
            found.append((q["query_id"], rank, number, source, -s))
    return sorted(found)


def got(hits):
    return sorted(tuple(r) for r in hits.collect())


@pytest.fixture
def corpus(spark):
    """Random vectors, a third of them one and the same, and some scaled copies."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(240, 8)).astype(np.float32)
    vectors[rng.permutation(240)[:80]] = vectors[0]
    vectors[100] = vectors[0] * 2
    asked = np.vstack([vectors[0], -vectors[0], rng.normal(size=(6, 8))]).astype(np.float32)
    return queries(spark, asked), documents(spark, vectors).repartition(3)


@pytest.mark.parametrize("k", [1, 3, 10, 100, 500])
def test_equals_brute_force(corpus, conf, monkeypatch, k):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch=16)
    asked, docs = corpus
    assert got(search(asked, index_docs(docs), k)) == brute(asked, docs, k)


@pytest.mark.parametrize(
    "limits",
    [
        {"FIRST_READ": 3},
        {"FIRST_READ": 3, "BROADCAST_BYTES": 400},
        {"STATE_ROWS": 25},
        {"WINDOW_ROWS": 1},
        {"BLOCK_SCORES": 70},
        {"SCORED_ROWS": 1},
        {"SCORED_ROWS": 160, "FIRST_READ": 3},
    ],
)
def test_every_way_gives_the_same(corpus, conf, monkeypatch, limits):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch=64)
    asked, docs = corpus
    for name, value in limits.items():
        monkeypatch.setattr(searching, name, value)
    assert got(search(asked, index_docs(docs), 10)) == brute(asked, docs, 10)


def narrow(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(searching, name, value)
        if name == "BINS":
            monkeypatch.setattr(floors, name, value)


@pytest.mark.parametrize(("k", "local_k"), [(10, 5), (100, 1), (239, 5), (500, 5)])
@pytest.mark.parametrize("limits", [{}, {"BINS": 16}, {"STATE_ROWS": 4096}, {"FIRST_READ": 3}])
def test_a_large_k_emits_what_reaches_the_floor(corpus, conf, monkeypatch, k, local_k, limits):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch=64)
    asked, docs = corpus
    narrow(monkeypatch, limits)
    assert got(search(asked, index_docs(docs), k, local_k)) == brute(asked, docs, k)


def scored_rows(spark, asked, docs, k):
    (block,) = searching._blocks(asked.toArrow())
    rows = searching._score(spark, index_docs(docs), block, k, 0).groupBy("query_id").count().collect()
    return {r["query_id"]: r["count"] for r in rows}


def crowd(rng, n, dim=16):
    """Vectors that are all nearly the same: similarities of more than 0.99."""
    return (1 + rng.normal(size=(n, dim)) / 50).astype(np.float32)


@pytest.mark.parametrize("kind", ["spread", "crowded", "tied", "closest"])
@pytest.mark.parametrize("k", [7, 60])
def test_at_most_twice_k_rows_leave_the_scoring(spark, conf, kind, k):
    """Far apart, all close to each other, most of them equal, or apart by the last bits alone."""
    conf(spark__sql__execution__arrow__maxRecordsPerBatch=32)
    rng = np.random.default_rng(k)
    vectors = rng.normal(size=(600, 16)).astype(np.float32) if kind == "spread" else crowd(rng, 600)
    if kind == "tied":
        vectors[rng.permutation(600)[:500]] = vectors[0]
    if kind == "closest":
        vectors = (1 + rng.integers(0, 3, (600, 16)) * 1.2e-7).astype(np.float32)
    docs = documents(spark, vectors).repartition(5)
    asked = queries(spark, np.vstack([vectors[:3], crowd(rng, 3)]).astype(np.float32))
    counts = scored_rows(spark, asked, docs, k)
    assert len(counts) == 6 and all(k <= n <= 2 * k for n in counts.values())
    assert got(search(asked, index_docs(docs), k, 1)) == brute(asked, docs, k)


def test_ties_are_settled_by_source_too(spark):
    """Rows of one commit and one vector differ by their source alone."""
    vectors = [[1.0, 2.0]] * 3
    docs = documents(spark, vectors)
    for i in range(8):
        docs = docs.unionByName(documents(spark, vectors, source=f"source-{i:02}"))
    docs = docs.coalesce(2)
    asked = queries(spark, [[2.0, 4.0], [1.0, 0.0]])
    for k in (1, 11):
        assert got(search(asked, index_docs(docs), k, 0)) == brute(asked, docs, k)
        assert all(n <= 2 * k for n in scored_rows(spark, asked, docs, k).values())


def test_every_split_is_a_scoring_task(spark, monkeypatch, tmp_path):
    """Groups of tasks are merged before the ranking; no task takes the splits of others."""
    rng = np.random.default_rng(1)
    index_docs(documents(spark, rng.normal(size=(300, 8))).repartition(12)).write.parquet(str(tmp_path / "index"))
    docs = spark.read.option("mergeSchema", "false").parquet(str(tmp_path / "index")).repartition(12)
    asked = queries(spark, rng.normal(size=(5, 8)))
    (block,) = searching._blocks(asked.toArrow())
    monkeypatch.setattr(searching, "SCORED_ROWS", 3 * 5 * 10)
    merged = searching._score(spark, docs, block, 10, 100)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "_group" in plan
    assert merged.count() <= 3 * 5 * 10
    assert docs.mapInArrow(searching._scorer(searching._broadcast(spark, block), 8, 10), searching.SCORED).rdd.getNumPartitions() == 12
    assert got(search(asked, docs, 10)) == brute(asked, docs, 10)


def test_keys_keep_the_order_of_scores_and_names():
    rng = np.random.default_rng(5)
    scores = np.sort(np.r_[rng.normal(size=500), -1.0, 1.0, 0.0, -1e-310, 1e-310])
    keys = floors.key_of(scores)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [floors.score_of(int(k)) for k in keys] == scores.tolist()
    assert floors.key_of(np.array([-0.0]))[0] == floors.key_of(np.array([0.0]))[0]
    names = np.array([b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgi", b"b"])
    before, number = floors.name_chunks(names, 0)
    assert (np.diff(number.astype(object)) >= 0).all() and set(before) == {b""}
    before, number = floors.name_chunks(names, 1)
    assert before.tolist() == [b"ab", b"abcdefgh", b"abcdefgh", b"abcdefgi", b"b"] and number[1] == 0 < number[2]


def test_scoring_equals_the_column_function(spark, corpus):
    asked, docs = corpus
    hits = search(asked, index_docs(docs), 20)
    pairs = hits.join(asked.withColumnRenamed("vector", "qv"), "query_id").join(
        docs.select("sha", F.col("vector").alias("dv")), "sha"
    )
    row = pairs.select(F.min(F.col("similarity") == cosine(F.col("qv"), F.col("dv"))).alias("same")).first()
    assert row["same"]


def test_pending_rows_are_pruned(corpus, conf, monkeypatch):
    conf(spark__sql__execution__arrow__maxRecordsPerBatch=4)
    best = searching._Best(2, 3)
    best._limit = 4
    rng = np.random.default_rng(0)
    score = rng.normal(size=60)
    names = np.array([sha(i).encode() for i in range(60)])
    for i in range(0, 60, 2):
        best.add(np.array([0, 1]), names[i : i + 2], np.array([b"s", b"s"]), score[i : i + 2])
        assert best._pending <= 8
    (q, kept, _, s), = best.rows()
    for one in (0, 1):
        expected = sorted(score[one::2], reverse=True)[:3]
        assert sorted(s[q == one], reverse=True) == expected
        assert best.floor[one] == expected[-1]


def test_copies_beyond_k_are_left_out_by_name():
    import pyarrow as pa

    vectors = np.array([[1, 2]] * 6 + [[3, 4]], np.float32)
    names = pa.array(["f", "a", "e", "b", "d", "c", "z"])
    source = pa.array(["s"] * 7)
    assert searching._without_surplus_copies(vectors, names, source, 2).tolist() == [1, 3, 6]
    assert searching._without_surplus_copies(vectors, names, source, 6) is None
    assert searching._without_surplus_copies(vectors[-2:], names[-2:], source[-2:], 1) is None


def test_models_and_dimensions_do_not_mix(spark):
    docs = documents(spark, [[1, 0], [0, 1]]).unionByName(documents(spark, [[1, 0, 0]], first=10)).unionByName(
        documents(spark, [[1, 0]], model="other", first=20)
    )
    asked = queries(spark, [[1, 0], [1, 0, 0]]).unionByName(
        queries(spark, [[1, 1]], model="other").withColumn("query_id", F.lit("o"))
    )
    hits = search(asked, index_docs(docs), 5)
    assert got(hits) == brute(asked, docs, 5)
    assert {(r["query_id"], r["sha"]) for r in hits.collect()} == {
        ("q0", sha(0)), ("q0", sha(1)), ("q1", sha(10)), ("o", sha(20)),
    }


@pytest.mark.parametrize(("k", "n"), [(0, 0), (-1, 0), (1, 1), (3, 3), (50, 3), (10**9, 3)])
def test_k_is_clamped(spark, k, n):
    docs = documents(spark, [[1, 0], [0, 1], [1, 1]])
    hits = search(queries(spark, [[1, 0]]), index_docs(docs), k)
    assert hits.columns == ["query_id", "rank", "sha", "source", "similarity"]
    assert hits.count() == n


def test_default_is_ten(spark):
    docs = documents(spark, [[1, i] for i in range(30)])
    assert search(queries(spark, [[1, 0]]), index_docs(docs)).count() == 10


def test_empty_index_and_no_queries(spark):
    docs = index_docs(documents(spark, [[1, 0]]))
    assert search(queries(spark, [[1, 0]]), docs.filter("false")).count() == 0
    assert search(queries(spark, [[1, 0]]).filter("false"), docs).count() == 0
    assert count_documents(docs).first()["n_docs"] == 1


def test_query_without_direction_gets_no_hits_and_is_reported(spark):
    asked = queries(spark, [[0, 0], [1, 0], []])
    assert {r["query_id"] for r in search(asked, index_docs(documents(spark, [[1, 0]]))).collect()} == {"q1"}
    assert {(r["detail"], r["reason"]) for r in query_rejects(asked).collect()} == {
        ("q0", "vector is zero"), ("q2", "vector is empty"),
    }


@pytest.mark.parametrize("first_read", [100, 1])
def test_query_ids_must_be_unique(spark, monkeypatch, first_read):
    monkeypatch.setattr(searching, "FIRST_READ", first_read)
    asked = queries(spark, [[1, 0], [0, 1]]).withColumn("query_id", F.lit("same"))
    with pytest.raises(ValueError, match="not unique"):
        search(asked, index_docs(documents(spark, [[1, 0]])))


def test_no_pairs_are_joined(spark, corpus):
    asked, docs = corpus
    plan = search(asked, index_docs(docs))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_best_per_commit(spark):
    docs = documents(spark, [[1, 0], [0, 1]]).unionByName(documents(spark, [[1, 1], [1, 0]], source="diff_summary"))
    best = best_per_commit(search(queries(spark, [[1, 0]]), index_docs(docs)))
    assert {(r["sha"], r["similarity"], r["n_embeddings"]) for r in best.collect()} == {(sha(0), 1.0, 2), (sha(1), 1.0, 2)}


def test_dangling_hits_drop_and_lines_have_no_gaps(spark):
    commits = good_commits(check_commits(raw(spark, [commit(0, body="zero\nx"), commit(2, body="two")])))
    hits = search(queries(spark, [[1, 0]]), index_docs(documents(spark, [[1, 0], [2, 1], [1, 1]])))
    found = hit_list(with_commits(hits, commits)).orderBy("rank").collect()
    assert [(r["rank"], r["line_no"], r["sha"]) for r in found] == [(1, 1, sha(0)), (3, 2, sha(2))]
    assert [r["display"] for r in found] == [
        "1. 0000000  (similarity: 1.0000)\n   zero",
        "2. 0000000  (similarity: 0.7071)\n   two",
    ]


@pytest.mark.parametrize("small", [True, False])
def test_request_order_repeats_and_unknown_ids(spark, small):
    commits = good_commits(check_commits(raw(spark, [commit(i) for i in range(5)])))
    asked = request_list(spark.createDataFrame([([sha(4), sha(9), sha(1), sha(4), "junk"],)], "ids array<string>"))
    assert [(r["pos"], r["sha"]) for r in lookup(commits, asked).collect()] == [(0, sha(4)), (2, sha(1)), (3, sha(4))]
    assert find_commits(commits, asked, small).count() == 3
    assert lookup(commits, asked.filter("false")).count() == 0


def test_text_search_finds_the_same_words(spark):
    messages = ["Fix parser crash", "add streaming sink", "fix crash in parser\n\nlong body", "docs"]
    commits = good_commits(check_commits(raw(spark, [commit(i, body=m) for i, m in enumerate(messages)])))
    index = index_docs(embedding_rows(embed(commits, hashed_words, HASHED_MODEL)))
    asked = spark.createDataFrame([("a", "parser crash fix"), ("b", "Streaming sink add"), ("c", "  ")], "query_id string, text string")
    found = search_text(asked, index, commits, hashed_words, HASHED_MODEL, k=1).select(
        "query_id", "sha", "rank", first_line("display").alias("line")
    )
    assert {r["query_id"]: (r["sha"], r["line"]) for r in found.collect()} == {
        "a": (sha(0), "1. 0000000  (similarity: 1.0000)"),
        "b": (sha(1), "1. 0000000  (similarity: 1.0000)"),
    }


def test_many_hits_are_numbered_alike(spark):
    commits = good_commits(check_commits(raw(spark, [commit(i) for i in range(0, 40, 3)])))
    docs = index_docs(documents(spark, [[1, i] for i in range(40)]))
    hits = with_commits(search(queries(spark, [[1, 0], [0, 1]]), docs, 40), commits)
    many = hit_list(hits, many=True)
    assert got(many.select(sorted(many.columns))) == got(hit_list(hits).select(sorted(many.columns)))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("first_read", [100, 2])
def test_each_query_text_is_embedded_once(spark, tmp_path, monkeypatch, first_read):
    monkeypatch.setattr(searching, "FIRST_READ", first_read)
    calls = str(tmp_path / "calls")

    def noted(model):
        answer = hashed_words()

        def call(texts):
            with open(calls, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return answer(texts)

        return call

    commits = good_commits(check_commits(raw(spark, [commit(i) for i in range(6)])))
    index = index_docs(embedding_rows(embed(commits, hashed_words, HASHED_MODEL)))
    texts = [f"commit body {i}" for i in range(5)]
    asked = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")
    assert search_text(asked, index, commits, noted, HASHED_MODEL, k=2).count() == 10
    assert sorted(open(calls).read().splitlines()) == texts
