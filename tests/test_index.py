from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import loglore.operators.sizing as sizing
from loglore.functions.embedders import HASHED_MODEL, Reply, hashed_words
from loglore.operators.index import index_batch, index_docs, index_rejects, mark_synced, marks, sync_index, sync_status, unsynced
from loglore.operators.report import reject_report
from loglore.operators.search import search
from loglore.operators.tables import TableSet
from loglore.plans.indexing import index_commits
from loglore.plans.searching import search_text
from loglore.schema import EMBEDDING, EMBEDDING_KEY
from loglore.sources.commits import read_commit_stream
from loglore.streaming.index_stream import index_stream
from tests.commits import commit, raw, sha


def vectors_of(spark, numbers, model="m"):
    return spark.createDataFrame([(sha(i), "message", 2, [1.0, float(i)], model) for i in numbers], EMBEDDING)


def refuses(model):
    def call(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("embed boom")
        return Reply([[1.0, float(len(t))] for t in texts], model)

    return call


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, str(tmp_path / "base"), prefix_length=1)


def counts(tables):
    return tuple(
        df.count() for df in (tables.commits(), tables.embeddings(), tables.index_docs(), tables.sync_log())
    )


def test_unsynced_then_synced(spark, tables):
    tables.append_embeddings(vectors_of(spark, range(4)))
    assert unsynced(tables.embeddings(), tables.sync_log()).count() == 4
    sync_index(tables)
    assert unsynced(tables.embeddings(), tables.sync_log()).count() == 0
    assert {r["doc_id"] for r in tables.index_docs().collect()} == {f"{sha(i)}|m|message" for i in range(4)}
    sync_index(tables)
    assert counts(tables)[2:] == (4, 4)


def test_batch_is_indexed_from_the_rows_in_hand(spark, tables, monkeypatch):
    def unread(self):
        raise AssertionError("a batch must not read the stored vectors")

    with monkeypatch.context() as patch:
        patch.setattr(TableSet, "embeddings", unread)
        index_batch(tables, vectors_of(spark, [1, 2]))
    assert {r["sha"] for r in tables.index_docs().collect()} == {sha(1), sha(2)}
    assert {r["sha"] for r in tables.sync_log().collect()} == {sha(1), sha(2)}


@pytest.mark.parametrize("limit", [sizing.BROADCAST_BYTES, 0])
def test_crash_between_index_and_log_is_repaired(spark, tables, monkeypatch, limit):
    monkeypatch.setattr(sizing.fits_broadcast, "__defaults__", (limit,))
    tables.append_embeddings(vectors_of(spark, range(4)))
    tables.append_index_docs(index_docs(vectors_of(spark, [0, 1])))
    sync_index(tables)
    assert counts(tables)[2:] == (4, 4)
    assert tables.index_docs().select("doc_id").distinct().count() == 4


def test_answers_under_another_name_are_stored_once(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)])
    for run in "ab":
        index_commits(feed, tables, hashed_words, run=run)
        assert counts(tables) == (3, 3, 3, 3)


def test_marks_of_unknown_keys_change_nothing_and_repeats_renew(spark, tables):
    tables.append_embeddings(vectors_of(spark, [1]))
    mark_synced(tables, vectors_of(spark, [1, 9]))
    first = sync_status(tables.sync_log()).collect()
    assert [r["sha"] for r in first] == [sha(1)]
    time.sleep(0.01)
    mark_synced(tables, vectors_of(spark, [1]))
    again = sync_status(tables.sync_log()).collect()
    assert len(again) == 1 and again[0]["synced_at"] > first[0]["synced_at"]


def test_vectors_that_cannot_be_indexed_stay_unmarked(spark, tables):
    rows = vectors_of(spark, [1]).unionByName(
        spark.createDataFrame([(sha(2), "message", 0, [], "m"), (sha(3), "message", 2, [0.0, 0.0], "m")], EMBEDDING)
    )
    tables.append_embeddings(rows)
    sync_index(tables)
    assert [r["sha"] for r in tables.index_docs().collect()] == [sha(1)]
    assert {r["sha"] for r in unsynced(tables.embeddings(), tables.sync_log()).collect()} == {sha(2), sha(3)}
    assert {(r["sha"], r["reason"]) for r in index_rejects(tables.embeddings()).collect()} == {
        (sha(2), "vector is empty"),
        (sha(3), "vector is zero"),
    }


def test_indexing_twice_changes_nothing(spark, tables):
    feed = raw(spark, [commit(i) for i in range(60)] + [commit(1), commit("junk"), commit(99, parents=["a", "b"])])
    index_commits(feed, tables, hashed_words, HASHED_MODEL, run="a")
    assert counts(tables) == (60, 60, 60, 60)
    marked = {r["sha"]: r["synced_at"] for r in sync_status(tables.sync_log()).collect()}
    index_commits(feed, tables, hashed_words, HASHED_MODEL, run="a")
    index_commits(feed.filter("false"), tables, hashed_words, HASHED_MODEL, run="b")
    assert counts(tables) == (60, 60, 60, 60)
    assert {r["sha"]: r["synced_at"] for r in sync_status(tables.sync_log()).collect()} == marked
    assert [tuple(r) for r in reject_report(tables.rejects()).collect()] == [("clean", "invalid commit id", 1)]


def test_stored_commits_are_not_embedded_again(spark, tables):
    index_commits(raw(spark, [commit(i) for i in range(3)]), tables, hashed_words, HASHED_MODEL)

    def only_new(model):
        def call(texts):
            assert texts == ["commit body 3"]
            return hashed_words()(texts)

        return call

    index_commits(raw(spark, [commit(i) for i in range(4)]), tables, only_new, HASHED_MODEL, run="second")
    assert counts(tables) == (4, 4, 4, 4)
    assert tables.rejects().isEmpty()


def test_failed_embedding_stores_nothing_and_is_reported(spark, tables):
    index_commits(raw(spark, [commit(i, body="bad") for i in range(3)]), tables, refuses)
    assert counts(tables) == (0, 0, 0, 0)
    assert [tuple(r) for r in reject_report(tables.rejects()).collect()] == [("embed", "embedding failed", 3)]
    index_commits(raw(spark, [commit(i) for i in range(3)]), tables, refuses, run="retry")
    assert counts(tables) == (3, 3, 3, 3)


def test_second_model_is_a_second_embedding(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)])
    index_commits(feed, tables, refuses, "one")
    index_commits(feed, tables, refuses, "two", run="two")
    assert counts(tables) == (3, 6, 6, 6)


def test_crash_after_commits_is_finished_by_the_next_run(spark, tables):
    from loglore.operators.clean import check_commits, good_commits

    feed = raw(spark, [commit(i) for i in range(3)])
    tables.append_commits(good_commits(check_commits(feed)))
    index_commits(feed, tables, hashed_words, HASHED_MODEL)
    assert counts(tables) == (3, 3, 3, 3)


def test_crash_after_embeddings_is_repaired_by_the_next_run(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)])
    tables.append_embeddings(vectors_of(spark, range(3)))
    index_commits(feed.filter("false"), tables, hashed_words, HASHED_MODEL)
    assert counts(tables)[1:] == (3, 3, 3)


def test_strict_run_rejects_the_batch(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)] + [commit("junk")] + [commit(i, repo="clean") for i in (7, 8)])
    index_commits(feed, tables, hashed_words, HASHED_MODEL, strict=True)
    assert {r["sha"] for r in tables.commits().collect()} == {sha(7), sha(8)}
    assert {(r["reason"], r["n_rows"]) for r in reject_report(tables.rejects()).collect()} == {
        ("invalid commit id", 1),
        ("batch holds an invalid commit", 3),
    }


def test_staging_is_removed(spark, tables):
    import os

    from loglore.session import shared_dir

    def left():
        root = shared_dir(spark) + "/loglore"
        return {n for n in os.listdir(root) if n.startswith("staging")} if os.path.isdir(root) else set()

    before = left()
    index_commits(raw(spark, [commit(i) for i in range(3)]), tables, hashed_words, HASHED_MODEL)
    assert left() == before


def test_index_then_search(spark, tables):
    feed = raw(spark, [commit(i, body=b) for i, b in enumerate(["write docs", "add sink", "fix sink\nmore"])])
    index_commits(feed, tables, hashed_words, HASHED_MODEL)
    asked = spark.createDataFrame([("q", "sink add")], "query_id string, text string")
    found = search_text(
        asked, tables.index_docs(), tables.commits(), hashed_words, HASHED_MODEL, k=2, prefix_length=tables.prefix_length
    ).orderBy("rank")
    assert [r["display"].split("\n")[1].strip() for r in found.collect()] == ["add sink", "fix sink"]


def run_stream(spark, folder, tables, checkpoint, factory=hashed_words):
    index_stream(read_commit_stream(spark, folder), tables, factory, checkpoint, HASHED_MODEL).awaitTermination()


def test_stream_equals_batch_and_takes_repeats(spark, tables, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    raw(spark, [commit(i) for i in range(51)] + [commit("junk")]).coalesce(1).write.mode("append").json(folder)
    run_stream(spark, folder, tables, checkpoint)
    assert counts(tables) == (51,) * 4
    raw(spark, [commit(i) for i in range(40, 60)]).coalesce(1).write.mode("append").json(folder)
    run_stream(spark, folder, tables, checkpoint)
    assert counts(tables) == (60,) * 4
    # A lost checkpoint replays everything.
    run_stream(spark, folder, tables, str(tmp_path / "other"))
    assert counts(tables) == (60,) * 4
    # Each stream reports what it rejected, once.
    junk = tables.rejects().filter(F.col("sha") == "junk")
    assert junk.count() == junk.select("run").distinct().count() == 2

    batch = TableSet(spark, str(tmp_path / "batch"))
    index_commits(raw(spark, [commit(i) for i in range(60)]), batch, hashed_words, HASHED_MODEL)
    columns = ["doc_id", "vector", "norm", "dim", "model"]
    assert sorted(map(tuple, tables.index_docs().select(columns).collect())) == sorted(
        map(tuple, batch.index_docs().select(columns).collect())
    )


def test_stream_repairs_before_it_starts(spark, tables, tmp_path):
    tables.append_embeddings(vectors_of(spark, range(3)))
    folder = str(tmp_path / "in")
    raw(spark, [commit(7)]).write.json(folder)
    run_stream(spark, folder, tables, str(tmp_path / "ck"))
    assert tables.index_docs().count() == 4


def test_failing_store_is_retried_with_the_same_batch(spark, tables, tmp_path, monkeypatch):
    """A micro-batch that dies half way is done again in full."""
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    raw(spark, [commit(i) for i in range(5)]).write.json(folder)

    def dies(self, docs):
        raise RuntimeError("store boom")

    with monkeypatch.context() as patch:
        patch.setattr(TableSet, "append_index_docs", dies)
        with pytest.raises(Exception, match="store boom"):
            run_stream(spark, folder, tables, checkpoint)
    assert counts(tables) == (5, 5, 0, 0)
    run_stream(spark, folder, tables, checkpoint)
    assert counts(tables) == (5, 5, 5, 5)


def test_marks_carry_the_key(spark):
    assert marks(index_docs(vectors_of(spark, [1]))).columns == ["sha", "source", "model", "synced_at"]
    assert set(EMBEDDING_KEY) == {"sha", "source", "model"}


def test_search_sees_only_the_settled_index(spark, tables):
    tables.append_embeddings(vectors_of(spark, range(3)))
    asked = spark.createDataFrame([("q", [1.0, 0.0], "m")], "query_id string, vector array<float>, model string")
    assert search(asked, tables.index_docs()).count() == 0
    sync_index(tables)
    assert search(asked, tables.index_docs()).count() == 3


def test_search_reads_one_model_and_the_columns_it_needs(spark, tables):
    for model in ("one", "two"):
        rows = vectors_of(spark, range(3), model)
        tables.append_embeddings(rows)
    sync_index(tables)
    asked = spark.createDataFrame([("q", [1.0, 0.0], "one")], "query_id string, vector array<float>, model string")
    hits = search(asked, tables.index_docs())
    assert hits.count() == 3
    plan = hits._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(model" in plan and "= one)]" in plan
    assert "EqualTo(dim,2)" in plan
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert schema.count(":") == 1 + 5 and "doc_id" not in schema
