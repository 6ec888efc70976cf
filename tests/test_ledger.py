"""What runs leave behind: their outcome, what waits, what was begun."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import loglore.operators.index as indexing
from loglore.functions.embedders import HASHED_MODEL, Reply, hashed_words
from loglore.operators.index import settle, sync_index
from loglore.operators.pending import waiting
from loglore.operators.tables import TableSet
from loglore.plans.indexing import index_commits
from loglore.plans.queries import stream_of_files
from loglore.session import shared_dir
from loglore.sources.commits import read_commit_stream
from loglore.streaming.index_stream import index_stream
from tests.commits import commit, raw, sha
from tests.test_index import counts, refuses, vectors_of


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, str(tmp_path / "base"), prefix_length=0)


def dead(model):
    def call(texts):
        raise ConnectionError("no embedder")

    return call


def fails_on(word):
    """Refuses a call with a text that holds the word, and answers others with their length."""

    def factory(model):
        def call(texts):
            if any(word in t for t in texts):
                raise RuntimeError("embed boom")
            return Reply([[1.0, float(len(t))] for t in texts], model)

        return call

    return factory


def test_outcome_of_an_ordinary_run(spark, tables):
    feed = [commit(i) for i in range(5)] + [commit(1), commit("junk"), commit(9, parents=["a", "b"])]
    found = index_commits(raw(spark, feed), tables, hashed_words, HASHED_MODEL, run="a")
    expected = {"read": 8, "rejected": 1, "asked": 5, "claimed": 0, "failed": 0, "commits": 5, "embeddings": 5, "indexed": 5, "unindexed": 0}
    assert found.counts == expected and found.state == "done"
    assert found.error == "clean: invalid commit id (1 rows)"
    row = tables.runs().first()
    assert {c: row[c] for c in expected} == expected
    assert (row["run"], row["model"], row["state"], row["error"]) == ("a", HASHED_MODEL, "done", found.error)
    assert row["started"] <= row["ended"]
    again = index_commits(raw(spark, feed[:5]), tables, hashed_words, HASHED_MODEL, run="b")
    assert again.error is None and again.counts == dict.fromkeys(expected, 0) | {"read": 5}
    assert {r["run"] for r in tables.runs().collect()} == {"a", "b"}


def test_vectors_without_direction_show_in_the_outcome(spark, tables):
    found = index_commits(raw(spark, [commit(1, body=" "), commit(2)]), tables, hashed_words, HASHED_MODEL)
    assert (found.counts["embeddings"], found.counts["indexed"], found.counts["unindexed"]) == (2, 1, 1)
    assert found.error == "index: vector is zero (1 rows)"


def test_all_errors_of_a_run_are_joined(spark, tables):
    feed = [commit(i, body="bad") for i in range(3)] + [commit("junk"), commit(7, body=None)]
    found = index_commits(raw(spark, feed), tables, refuses)
    assert set(found.errors) == {
        "embed: RuntimeError: embed boom (3 rows)",
        "clean: invalid commit id (1 rows)",
        "clean: message is null (1 rows)",
    }


def test_a_failed_call_is_made_again_without_the_commit(spark, tables):
    feed = raw(spark, [commit(i, body=f"body {i}") for i in range(4)])
    first = index_commits(feed, tables, fails_on("body 2"), "m", run="first")
    assert first.counts["failed"] == 4 and counts(tables) == (0, 0, 0, 0)
    # Taken up one by one, the others go through.
    second = index_commits(feed.limit(0), tables, fails_on("body 2"), "m", run="second")
    assert (second.counts["claimed"], second.counts["failed"]) == (4, 1)
    assert counts(tables) == (3, 3, 3, 3)
    (left,) = waiting(tables, "m").collect()
    assert (left["sha"], left["tries"], left["error"], left["message"]) == (sha(2), 2, "RuntimeError: embed boom", "body 2")
    third = index_commits(feed.limit(0), tables, fails_on("nothing"), "m", run="third")
    assert third.error is None and counts(tables) == (4, 4, 4, 4)
    assert tables.pending().count() == 0
    assert index_commits(feed, tables, dead, "m", run="fourth").counts["asked"] == 0


def test_queues_of_models_are_apart(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)])
    index_commits(feed, tables, dead, "one/with=odd name", run="a")
    index_commits(feed, tables, dead, "two", run="a")
    assert tables.pending().count() == 6
    index_commits(feed.limit(0), tables, fails_on("nothing"), "two", run="b")
    assert {r["model"] for r in tables.pending().collect()} == {"one/with=odd name"}
    assert counts(tables) == (3, 3, 3, 3)


def test_the_same_run_again_counts_its_tries(spark, tables):
    feed = raw(spark, [commit(i) for i in range(2)])
    for tries in (1, 2, 3):
        index_commits(feed, tables, dead, "m", run="same")
        assert [r["tries"] for r in tables.pending().collect()] == [tries, tries]


def test_a_claim_that_was_stored_meanwhile_is_dropped(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)])
    index_commits(feed, tables, dead, "m", run="a")
    tables.append_embeddings(vectors_of(spark, range(3)))
    found = index_commits(feed.limit(0), tables, dead, "m", run="b")
    assert found.counts["asked"] == 0 and tables.pending().count() == 0


def test_a_stream_takes_up_what_failed(spark, tables, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")

    def run(factory):
        index_stream(read_commit_stream(spark, folder, files_per_trigger=1), tables, factory, checkpoint, "m").awaitTermination()

    raw(spark, [commit(i) for i in range(3)]).coalesce(1).write.mode("append").json(folder)
    run(dead)
    assert counts(tables) == (0, 0, 0, 0) and tables.pending().count() == 3
    raw(spark, [commit(i) for i in range(3, 5)]).coalesce(1).write.mode("append").json(folder)
    run(fails_on("nothing"))
    assert counts(tables) == (5, 5, 5, 5) and tables.pending().count() == 0
    ledger = sorted((r["run"][-7:], r["failed"], r["claimed"], r["embeddings"]) for r in tables.runs().collect())
    assert ledger == [("batch-0", 3, 0, 0), ("batch-1", 0, 3, 5)]


class Full(TableSet):
    def append_index_docs(self, docs):
        raise OSError("no space left\nmore")


def test_a_run_that_dies_is_in_the_ledger_and_repaired_by_its_notes(spark, tables, monkeypatch):
    index_commits(raw(spark, [commit(0)]), tables, hashed_words, HASHED_MODEL, run="good")
    with pytest.raises(OSError):
        index_commits(raw(spark, [commit(1), commit(2)]), Full(spark, tables.base, 0), hashed_words, HASHED_MODEL, run="bad")
    row = tables.runs().filter("run = 'bad'").first()
    assert (row["state"], row["error"], row["embeddings"], row["indexed"]) == ("failed", "store: OSError: no space left", 2, 0)
    assert {r["sha"] for r in tables.begun().collect()} == {sha(1), sha(2)}
    assert counts(tables) == (3, 3, 1, 1)

    def whole(tables):
        raise AssertionError("all keys were compared")

    monkeypatch.setattr(indexing, "sync_index", whole)
    index_commits(raw(spark, []), tables, hashed_words, HASHED_MODEL, run="next")
    assert counts(tables) == (3, 3, 3, 3) and tables.begun().count() == 0


def test_nothing_is_compared_after_a_clean_run(spark, tables, monkeypatch):
    index_commits(raw(spark, [commit(0)]), tables, hashed_words, HASHED_MODEL)

    def unread(self):
        raise AssertionError("stored keys were read")

    with monkeypatch.context() as patch:
        for name in ("embeddings", "sync_log", "index_docs"):
            patch.setattr(TableSet, name, unread)
        settle(tables)


@pytest.mark.parametrize("how", [settle, sync_index])
def test_appended_embeddings_are_begun_until_they_are_indexed(spark, tables, how):
    settle(tables)
    tables.append_embeddings(vectors_of(spark, range(3)))
    assert tables.begun().count() == 3
    how(tables)
    assert tables.begun().count() == 0 and counts(tables) == (0, 3, 3, 3)


def test_another_name_is_remembered(spark, tables):
    feed = raw(spark, [commit(i) for i in range(3)])
    assert index_commits(feed, tables, hashed_words, run="a").counts["asked"] == 3
    assert index_commits(feed, tables, hashed_words, run="b").counts["asked"] == 0
    assert [tuple(r) for r in tables.models().collect()] == [("nomic-embed-text", HASHED_MODEL)]
    more = raw(spark, [commit(i) for i in range(5)])
    assert index_commits(more, tables, hashed_words, run="c").counts["asked"] == 2
    assert tables.models().count() == 1


def test_unsynced_leaves_vectors_in_place(spark, tables):
    tables.append_embeddings(vectors_of(spark, range(6)))
    sync_index(tables)
    tables.append_embeddings(vectors_of(spark, range(6, 8)))
    rows = indexing.unsynced(tables.embeddings(), tables.sync_log())
    assert {r["sha"] for r in rows.collect()} == {sha(6), sha(7)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan.split("LeftSemi")[1].splitlines()[0] + plan
    assert rows.select(F.size("vector").alias("n")).agg(F.sum("n")).first()[0] == 4


def test_exports_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    """Each of the three exports is a run, and none passes whole through one task."""
    texts = spark.range(80).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("some words of text "), "id").alias("text"),
        *[F.lit("x").alias(c) for c in ("lang", "source")],
    )
    texts.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(shared_dir(spark)) / "loglore"
    earlier = set(shared.glob("arriving-*"))
    found = stream_of_files(spark, str(tmp_path)).filter("sha = 'runs'").first()
    assert (found["bucket"], found["weight"]) == (3, 80.0)
    (arriving,) = set(shared.glob("arriving-*")) - earlier
    assert len(list(arriving.glob("part-*"))) > 3
