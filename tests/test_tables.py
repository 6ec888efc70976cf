from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import loglore.operators.sizing as sizing
from loglore.operators.clean import check_commits, good_commits
from loglore.operators.lookup import find_commits
from loglore.operators.sizing import exclude, fits_broadcast, measured_bytes, restrict
from loglore.operators.tables import TableSet, cascade, cascade_delete, check_embeddings
from loglore.schema import EMBEDDING
from tests.commits import commit, raw, sha


def commits_of(spark, numbers, repo="r"):
    return good_commits(check_commits(raw(spark, [commit(i, repo=repo) for i in numbers])))


def vectors_of(spark, numbers, model="m", source="message", value=1.0):
    return spark.createDataFrame([(sha(i), source, 2, [value, 2.0], model) for i in numbers], EMBEDDING)


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, str(tmp_path / "base"))


def test_unwritten_tables_are_empty(tables):
    for df in (tables.commits(), tables.embeddings(), tables.index_docs(), tables.sync_log(), tables.rejects()):
        assert df.isEmpty()


@pytest.mark.parametrize("small", [None, True, False])
def test_first_write_wins(spark, tables, small):
    tables.append_commits(commits_of(spark, range(3), "first"), small=small)
    tables.append_commits(commits_of(spark, range(5), "second"), small=small)
    again = commits_of(spark, [*range(6), *range(6)], "third")
    tables.append_commits(again, small=small)
    tables.append_commits(again, small=small)
    kept = {r["sha"]: r["repo"] for r in tables.commits().collect()}
    assert kept == {sha(i): "first" if i < 3 else "second" if i < 5 else "third" for i in range(6)}
    assert tables.commits().count() == 6


@pytest.mark.parametrize("small", [None, True, False])
def test_embeddings_are_unique_by_commit_model_and_source(spark, tables, small):
    tables.append_embeddings(vectors_of(spark, [1, 1, 2]), small=small)
    tables.append_embeddings(vectors_of(spark, [1], value=9.0), small=small)
    tables.append_embeddings(vectors_of(spark, [1], model="n"), small=small)
    tables.append_embeddings(vectors_of(spark, [1], source="diff_summary"), small=small)
    stored = {(r["sha"], r["model"], r["source"]): r["vector"][0] for r in tables.embeddings().collect()}
    assert stored == {
        (sha(1), "m", "message"): 1.0,
        (sha(2), "m", "message"): 1.0,
        (sha(1), "n", "message"): 1.0,
        (sha(1), "m", "diff_summary"): 1.0,
    }
    assert tables.embeddings().count() == 4


def test_empty_append_is_a_no_op(spark, tables):
    tables.append_commits(commits_of(spark, [1]))
    tables.append_commits(commits_of(spark, [1]).filter("false"))
    assert tables.commits().count() == 1


def test_folder_names_stay_text(spark, tables):
    """Digits only, leading zeros and exponents must come back as written."""
    ids = ["00" + "a" * 38, "07" + "b" * 38, "1e" + "5" * 38, "5d" + "0" * 38]
    tables.append_commits(good_commits(check_commits(raw(spark, [commit(i) for i in ids]))))
    assert {r["sha_prefix"] for r in tables.commits().collect()} == {"00", "07", "1e", "5d"}
    found = find_commits(tables.commits(), spark.createDataFrame([(i,) for i in ids], "sha string"), prefix_length=2)
    assert {r["sha"] for r in found.collect()} == set(ids)


def test_look_up_reads_only_the_folders_of_its_ids(spark, tables):
    ids = [f"{i:02x}" + "c" * 38 for i in range(0, 256, 16)]
    tables.append_commits(good_commits(check_commits(raw(spark, [commit(i) for i in ids]))))
    asked = spark.createDataFrame([(ids[3],)], "sha string")
    found = find_commits(tables.commits(), asked, True, prefix_length=2)
    assert [r["sha"] for r in found.collect()] == [ids[3]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    files = [
        node.metrics().apply("numFiles").value() for node in scans(found) if node.metrics().contains("numPartitions")
    ]
    assert files == [1]


def scans(df):
    """File scans of an executed plan."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            found.append(node)
        inner = []
        if name == "AdaptiveSparkPlan":
            inner = [node.executedPlan()]
        elif "QueryStage" in name:
            inner = [node.plan()]
        else:
            kids = node.children()
            inner = [kids.apply(i) for i in range(kids.size())]
        for child in inner:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_small_addition_leaves_the_stored_side_in_place(spark, tables):
    tables.append_commits(commits_of(spark, range(50)))
    new = commits_of(spark, range(45, 55))
    rest = exclude(new, tables.commits(), ["sha"], small=True)
    assert {r["sha"] for r in rest.collect()} == {sha(i) for i in range(50, 55)}
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_restrict_and_exclude_agree_both_ways(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 10)
    keys = spark.createDataFrame([(3,), (3,), (77,)], "k long")
    for small in (True, False):
        assert restrict(big, keys, ["k"], small).count() == 10
        assert exclude(big, keys, ["k"], small).count() == 90


def test_sizes_are_measured(spark):
    df = spark.createDataFrame([("é" * 10, 1), (None, None)], "s string, n int")
    assert measured_bytes(df) == (32 + 20 + 16 + 16) + (32 + 0 + 16 + 16)
    assert measured_bytes(df.filter("false")) == 0
    assert fits_broadcast(df, 148) and not fits_broadcast(df, 147)
    with pytest.raises(TypeError):
        measured_bytes(spark.sql("select array(1) as a"))


def test_large_keys_are_not_broadcast(spark, tables, monkeypatch):
    tables.append_commits(commits_of(spark, range(10)))
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    found = find_commits(tables.commits(), spark.createDataFrame([(sha(1),)], "sha string"), False, prefix_length=2)
    assert found.count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_broken_embeddings_and_orphans_are_rejected(spark):
    rows = [
        (sha(1), "message", 2, [1.0, 2.0], "m"),
        (sha(2), "message", 3, [1.0, 2.0], "m"),
        (sha(3), "message", 2, [1.0, 2.0], "m"),
        (sha(1), None, 2, [1.0, 2.0], "m"),
        (sha(1), "message", 2, [1.0, 2.0], None),
        (sha(1), "message", 2, None, "m"),
        (None, "message", 2, [1.0, 2.0], "m"),
    ]
    valid, rejects = check_embeddings(spark.createDataFrame(rows, EMBEDDING), commits_of(spark, [1, 2]))
    assert [r["sha"] for r in valid.collect()] == [sha(1)]
    assert sorted((r["reason"], r["sha"] or "") for r in rejects.collect()) == sorted(
        [
            ("vector size does not match dim", sha(2)),
            ("no such commit", sha(3)),
            ("source is null", sha(1)),
            ("model is null", sha(1)),
            ("vector is null", sha(1)),
            ("sha is null", ""),
        ]
    )


def test_deleting_commits_takes_their_embeddings_along(spark):
    rows = vectors_of(spark, range(4)).unionByName(vectors_of(spark, range(4), model="n"))
    kept = cascade(rows, commits_of(spark, [0, 1]))
    assert {(r["sha"], r["model"]) for r in kept.collect()} == {(sha(i), m) for i in (0, 1) for m in "mn"}
    left = cascade_delete(rows, commits_of(spark, [0, 1]))
    assert {r["sha"] for r in left.collect()} == {sha(2), sha(3)}
