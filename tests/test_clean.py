from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglore.functions.text import doc_id, first_line, hit_line, is_commit_id, short_id
from loglore.operators.clean import (
    check_commits,
    commit_order,
    drop_merges,
    empty_to_null,
    first_per_key,
    flatten,
    good_commits,
    null_to_empty,
    reject_whole_batches,
    rejected_commits,
)
from loglore.operators.report import reject_report
from tests.commits import commit, person, raw, sha

SHA1 = "1234567890abcdef1234567890abcdef12345678"
SHA256 = "1234567890abcdef1234567890abcdef1234567890abcdef1234567890abcdef"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("number", "valid"),
    [
        (SHA1, True),
        (SHA256, True),
        ("", False),
        ("abc123", False),
        ("1234567890ABCDEF1234567890abcdef12345678", False),
        ("123456789zabcdef1234567890abcdef123456zz", False),
        ("1234567890abcdef1234567890abcdef123456", False),
        (SHA1 + "\n", False),
        ("\n" + SHA1, False),
        (SHA1 + "0" * 12, False),
        (None, False),
    ],
)
def test_commit_id(spark, number, valid):
    assert value(spark, is_commit_id(F.lit(number).cast("string"))) is valid


@pytest.mark.parametrize(
    ("text", "line"),
    [
        ("fix: a\n\nbody", "fix: a"),
        ("one line", "one line"),
        ("", ""),
        ("\nlate", ""),
        ("keeps \r\nreturn", "keeps \r"),
        ("  spaces  \nx", "  spaces  "),
    ],
)
def test_first_line(spark, text, line):
    assert value(spark, first_line(F.lit(text))) == line


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0")), min_size=1, max_size=20))
def test_first_line_of_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", first_line("t").alias("line"))
    assert all(r["line"] == r["t"].split("\n", 1)[0] for r in df.collect())


def test_short_id_and_lines(spark):
    assert value(spark, short_id(F.lit(SHA1))) == "1234567"
    assert value(spark, short_id(F.lit("abc"))) == "abc"
    assert value(spark, doc_id(F.lit("s"), F.lit("m"), F.lit("message"))) == "s|m|message"
    shown = hit_line(F.lit(3).cast("long"), F.lit(SHA1), F.lit(0.98765), F.lit("fix\nmore"))
    assert value(spark, shown) == "3. 1234567  (similarity: 0.9877)\n   fix"


def test_merges_go_and_roots_stay(spark):
    rows = [commit(1, parents=[]), commit(2, parents=["a"]), commit(3, parents=["a", "b"]), commit(4, parents=None)]
    assert {r["sha"] for r in drop_merges(raw(spark, rows)).collect()} == {sha(1), sha(2), sha(4)}


def test_full_mapping(spark):
    row = good_commits(check_commits(raw(spark, [commit(SHA1, body="fix: something")]))).first()
    assert row.asDict() == {
        "repo": "r",
        "sha": SHA1,
        "author_name": "Ada",
        "author_email": "ada@example.com",
        "author_date": dt.datetime(2026, 1, 1),
        "committer_name": "Bob",
        "committer_email": "bob@example.com",
        "committer_date": dt.datetime(2026, 1, 2),
        "message": "fix: something",
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_session_zone(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    row = flatten(raw(spark, [commit(1)])).select(F.col("author_date").cast("string").alias("d")).first()
    assert row["d"] == "2026-01-01 00:00:00"


def test_empty_becomes_null_and_back(spark):
    rows = [commit(1, author=person("", "", -62135596800), committer=person("B", "", None), body="")]
    text = lambda df: df.withColumns(  # noqa: E731  year 1 does not fit every client date
        {c: F.col(c).cast("string") for c in ("author_date", "committer_date")}
    ).first()
    stored = empty_to_null(flatten(raw(spark, rows)))
    row = text(stored)
    assert (row["author_email"], row["author_date"], row["committer_date"]) == (None, None, None)
    assert (row["author_name"], row["message"]) == ("", "")
    back = text(null_to_empty(stored))
    assert (back["author_email"], back["author_date"]) == ("", "0001-01-01 00:00:00")
    assert back["committer_date"] == "0001-01-01 00:00:00"


def test_epoch_zero_is_a_date(spark):
    row = empty_to_null(flatten(raw(spark, [commit(1, author=person(epoch=0))]))).first()
    assert row["author_date"] == dt.datetime(1970, 1, 1)


def test_rejects_have_a_reason_and_the_rest_goes_on(spark):
    rows = [
        commit(1),
        commit("abc"),
        commit(9, sha=None),
        commit(2, author=person(None)),
        commit(3, body=None),
        commit(4, author=person(epoch=10**15)),
        commit(5, author=person(epoch=253402300799)),
    ]
    checked = check_commits(raw(spark, rows))
    assert {r["sha"] for r in good_commits(checked).collect()} == {sha(1), sha(5)}
    report = {(r["stage"], r["reason"]): r["n_rows"] for r in reject_report(rejected_commits(checked)).collect()}
    assert report == {
        ("clean", "invalid commit id"): 1,
        ("clean", "sha is null"): 1,
        ("clean", "author_name is null"): 1,
        ("clean", "message is null"): 1,
        ("clean", "date out of range"): 1,
    }


def test_strict_mode_rejects_the_whole_batch(spark):
    rows = [commit(i) for i in range(6)] + [commit("bad")]
    checked = check_commits(raw(spark, rows)).withColumn(
        "batch_no", F.when(F.col("sha").isin(sha(0), sha(1), "bad"), 0).otherwise(1)
    )
    strict = reject_whole_batches(checked, ["batch_no"])
    assert {r["sha"] for r in good_commits(strict).collect()} == {sha(i) for i in range(2, 6)}
    assert rejected_commits(strict).count() == 3


def test_one_row_per_commit_whatever_the_order(spark):
    rows = [
        commit(1, repo="b", committer=person(epoch=10)),
        commit(1, repo="a", committer=person(epoch=10)),
        commit(1, repo="0", committer=person(epoch=None)),
        commit(2, repo="x", committer=person(epoch=5)),
    ]
    for feed in (rows, rows[::-1]):
        commits = good_commits(check_commits(raw(spark, feed).repartition(3)))
        kept = {r["sha"]: r["repo"] for r in first_per_key(commits, ["sha"], commit_order()).collect()}
        assert kept == {sha(1): "a", sha(2): "x"}


def test_copies_are_cut_before_the_shuffle(spark):
    """A hot key must not meet in one task: the group limit runs on both sides."""
    plan = first_per_key(
        good_commits(check_commits(raw(spark, [commit(1)]))), ["sha"], commit_order()
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan and "Final" in plan
