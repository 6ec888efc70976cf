"""Appends that read only the folders of their ids, and tables written anew in few files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loglore.functions.embedders import HASHED_MODEL, hashed_words
from loglore.operators.sizing import exclude, restrict
from loglore.operators.tables import COMPACTED, TableSet
from loglore.plans.indexing import index_commits
from loglore.schema import COMMIT_KEY, EMBEDDING_KEY
from tests.commits import commit, raw, sha
from tests.test_tables import commits_of, scans, vectors_of


@pytest.fixture
def tables(spark, tmp_path):
    return TableSet(spark, str(tmp_path / "base"))


def files(df):
    return len(df.inputFiles())


def files_read(df):
    df.collect()
    return [n.metrics().apply("numFiles").value() for n in scans(df) if n.metrics().contains("numPartitions")]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_an_append_reads_the_folders_of_its_keys(spark, tables):
    spread = [i * 16**38 for i in range(60)]  # each in a folder of its own
    tables.append_commits(commits_of(spark, spread))
    tables.append_embeddings(vectors_of(spark, spread))
    assert files(tables.commits()) == files(tables.embeddings()) == 60
    keys = vectors_of(spark, [spread[3], 200 * 16**38])
    for stored, names in ((tables.embeddings(), EMBEDDING_KEY), (tables.commits(), COMMIT_KEY)):
        held = restrict(stored, keys, names, True, 2)
        assert files_read(held) == [1]
        assert [r["sha"] for r in held.collect()] == [sha(spread[3])]
    rest = exclude(keys, tables.embeddings(), EMBEDDING_KEY, True, 2)
    assert files_read(rest) == [1]
    assert [r["sha"] for r in rest.collect()] == [sha(200 * 16**38)]


def test_folders_change_no_result(spark, tables):
    tables.append_embeddings(vectors_of(spark, range(20)))
    keys = vectors_of(spark, [2, 2, 19, 50])
    for small in (True, False):
        assert restrict(tables.embeddings(), keys, EMBEDDING_KEY, small, 2).count() == 2
        assert exclude(keys, tables.embeddings(), EMBEDDING_KEY, small, 2).count() == 1


def test_ids_of_any_form_are_stored_once(spark, tables):
    odd = vectors_of(spark, [1]).withColumn("sha", F.explode(F.array(*map(F.lit, ("", "a", "é/=", "ab", "abc")))))
    for small in (True, False, None):
        tables.append_embeddings(odd, small=small)
    assert sorted(r["sha"] for r in tables.embeddings().collect()) == sorted(["", "a", "é/=", "ab", "abc"])


def test_another_layout_of_the_keys_is_an_error(spark, tables):
    tables.append_embeddings(vectors_of(spark, [1]))
    other = TableSet(spark, tables.base, prefix_length=1)
    with pytest.raises(ValueError, match="2 digits"):
        other.append_embeddings(vectors_of(spark, [2]))


def test_compaction_keeps_rows_and_readers(spark, tables):
    for i in range(4):
        tables.append_commits(commits_of(spark, range(10 * i, 10 * i + 12)))
        tables.append_embeddings(vectors_of(spark, range(8)) if i % 2 else vectors_of(spark, range(i, 9), "n"))
    before = {name: rows_of(getattr(tables, name)()) for name in ("commits", "embeddings")}
    reader, n_files = tables.commits(), files(tables.commits())
    assert tables.compact("commits") == len(before["commits"])
    assert tables.compact("embeddings") == len(before["embeddings"])
    for name, rows in before.items():
        assert rows_of(getattr(tables, name)()) == rows
    assert files(tables.commits()) < n_files
    assert rows_of(reader) == before["commits"]
    assert tables.drop_versions("commits") == 1 and tables.drop_versions("commits") == 0
    assert rows_of(tables.commits()) == before["commits"]
    # What is stored is still known, and found by its folder.
    assert tables.append_commits(commits_of(spark, range(43))) == 1
    assert tables.compact("commits") == 43 == tables.commits().count()
    assert tables.drop_versions("commits") == 1


def test_a_compaction_that_dies_changes_nothing(spark, tables, monkeypatch):
    tables.append_commits(commits_of(spark, range(5)))

    def dies(spark, file):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr("loglore.operators.tables.mark", dies)
        with pytest.raises(OSError, match="disk full"):
            tables.compact("commits")
    assert tables.append_commits(commits_of(spark, range(7))) == 2
    assert tables.commits().count() == 7
    assert tables.compact("commits") == 7
    assert tables.drop_versions("commits") == 2  # the first folder and the one that was not finished
    assert tables.commits().count() == 7


def test_only_growing_tables_are_compacted(tables):
    with pytest.raises(ValueError, match="kept by run"):
        tables.compact("rejects")
    assert [tables.compact(name) for name in COMPACTED] == [0, 0, 0, 0]


def test_runs_go_on_over_compacted_tables(spark, tables):
    index_commits(raw(spark, [commit(i) for i in range(6)]), tables, hashed_words, HASHED_MODEL)
    for name in COMPACTED:
        assert tables.compact(name) == 6
    outcome = index_commits(raw(spark, [commit(i) for i in range(9)]), tables, hashed_words, HASHED_MODEL)
    assert [outcome.counts[c] for c in ("asked", "commits", "embeddings", "indexed")] == [3, 3, 3, 3]
    for name in COMPACTED:
        assert getattr(tables, name)().count() == 9
        tables.drop_versions(name)
        assert getattr(tables, name)().count() == 9
