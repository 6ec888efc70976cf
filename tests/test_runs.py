"""Options of an index run that change how it runs, not what it stores."""

from __future__ import annotations

import pytest

from loglore.functions.embedders import HASHED_MODEL, hashed_words
from loglore.operators.clean import check_commits, commit_order, good_commits
from loglore.operators.tables import TableSet, absent_rows
from loglore.plans.indexing import index_commits
from tests.commits import commit, raw, sha


def test_concurrency_changes_nothing_stored(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path / "t"), prefix_length=0)
    index_commits(raw(spark, [commit(i) for i in range(120)]), tables, hashed_words, HASHED_MODEL, concurrency=3)
    assert tables.commits().columns[-1] == "message"
    assert tables.index_docs().count() == 120


@pytest.mark.parametrize("run", ["a/b", "", "x y", "run=1"])
def test_run_names_are_folder_names(spark, tmp_path, run):
    tables = TableSet(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="run name"):
        tables.write_rejects(tables.rejects(), run)


@pytest.mark.parametrize("small", [True, False])
def test_hot_copies_in_an_append_are_cut_before_the_shuffle(spark, tmp_path, small):
    tables = TableSet(spark, str(tmp_path / "t"), prefix_length=0)
    feed = good_commits(check_commits(raw(spark, [commit(1)] * 300 + [commit(i) for i in range(5)])))
    tables.append_commits(good_commits(check_commits(raw(spark, [commit(0)]))))
    rows = absent_rows(feed, tables.commits(), ["sha"], commit_order(), small)
    assert sorted(r["sha"] for r in rows.collect()) == [sha(i) for i in range(1, 5)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    if small:
        assert plan.index("WindowGroupLimit") < plan.index("LeftAnti")
    else:
        assert plan.index("LeftAnti") < plan.index("WindowGroupLimit")
