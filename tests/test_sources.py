from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from loglore.operators.clean import check_commits, good_commits, rejected_commits
from loglore.sources.commits import read_commit_stream, read_commits, read_log_dump, union_exports, write_log_dump
from tests.commits import commit, person, raw, sha


def test_json_and_parquet_exports(spark, tmp_path):
    rows = [commit(i) for i in range(3)]
    raw(spark, rows).write.json(str(tmp_path / "j"))
    raw(spark, rows).write.parquet(str(tmp_path / "p"))
    read = [read_commits(spark, str(tmp_path / "j")), read_commits(spark, str(tmp_path / "p"), "parquet")]
    for df in read:
        assert sorted(r["sha"] for r in df.collect()) == [sha(0), sha(1), sha(2)]
    assert union_exports(*read).count() == 6


def test_broken_json_ends_the_job(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"sha": sha(1)}) + "\n{broken\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_commits(spark, str(tmp_path)).collect()


def test_dump_round_trip(spark, tmp_path):
    rows = [
        commit(1, body="subject\n\nbody with \x1f a separator\n"),
        commit(2, body="", parents=[]),
        commit(3, parents=["a", "b"], author=person("", "", None)),
        commit(4, body="\nstarts with a newline", repo="007"),
    ]
    path = str(tmp_path / "dump")
    write_log_dump(raw(spark, rows), path)
    back = {r["sha"]: r.asDict(recursive=True) for r in read_log_dump(spark, path).collect()}
    for row in rows:
        got = back[row["sha"]]
        assert got["repo"] == row["repo"]
        assert got["body"] == row["body"]
        assert got["parents"] == row["parents"]
        assert got["author"]["epoch"] == row["author"]["epoch"]
        assert got["committer"]["name"] == row["committer"]["name"]


def test_dump_as_a_log_writes_it(spark, tmp_path):
    """A log puts a newline after every record, and the zone is already dropped."""
    records = [
        "\x1f".join([sha(i), "p1 p2" if i == 2 else "p1", "Ada", "a@x", "1767225600", "Bob", "", "1767312000", f"m{i}\n"])
        for i in range(3)
    ]
    (tmp_path / "log.txt").write_text("".join(r + "\x1e\n" for r in records))
    dump = read_log_dump(spark, str(tmp_path / "log.txt"), repo="mine")
    commits = good_commits(check_commits(dump)).orderBy("sha").collect()
    assert [(r["sha"], r["repo"], r["message"], r["committer_email"]) for r in commits] == [
        (sha(0), "mine", "m0\n", None),
        (sha(1), "mine", "m1\n", None),
    ]


@pytest.mark.parametrize("record", ["only\x1fthree\x1ffields", "\x1f".join([sha(1), "", "A", "a", "noon", "B", "b", "1", "m"])])
def test_broken_dump_ends_the_job(spark, tmp_path, record):
    (tmp_path / "log.txt").write_text(record + "\x1e\n")
    with pytest.raises(PySparkException):
        read_log_dump(spark, str(tmp_path / "log.txt"), repo="r").collect()


BROKEN = ["{broken", "null", "[]", '[{"sha": "x"}]', '"text"', '{"sha": "5", "author": {"epoch": "noon"}}', "5"]


@pytest.mark.parametrize("stream", [False, True])
def test_malformed_records_keep_text_and_file(spark, tmp_path, stream):
    good = [json.dumps(commit(i)) for i in range(3)]
    (tmp_path / "a.json").write_text("\n".join([good[0], *BROKEN, "", " \t", good[1]]) + "\n")
    (tmp_path / "b.json").write_text(good[2] + "\n")
    (tmp_path / "c.json").write_text("")
    if stream:
        feed = read_commit_stream(spark, str(tmp_path), tolerant=True)
        running = feed.writeStream.format("memory").queryName("malformed").trigger(availableNow=True).start()
        running.awaitTermination()
        read = spark.table("malformed")
    else:
        read = read_commits(spark, str(tmp_path), tolerant=True)
    checked = check_commits(read)
    assert sorted(r["sha"] for r in good_commits(checked).collect()) == [sha(0), sha(1), sha(2)]
    bad = checked.filter("reason is not null").collect()
    assert sorted(r["message"] for r in bad) == sorted(BROKEN)
    assert {r["reason"] for r in bad} == {"malformed record"}
    assert all(r["repo"].endswith("/a.json") for r in bad)
    assert {r["detail"] for r in rejected_commits(checked).collect()} == {r["repo"] for r in bad}


def test_tolerant_rows_equal_strict_ones(spark, tmp_path):
    rows = [commit(1, body="two\nlines \"quoted\" é"), commit(2, author=person("", "", None)), commit(3, parents=[])]
    raw(spark, rows).write.json(str(tmp_path / "j"))
    strict, tolerant = (read_commits(spark, str(tmp_path / "j"), tolerant=t) for t in (False, True))
    assert sorted(map(str, strict.collect())) == sorted(map(str, tolerant.drop("malformed").collect()))
    both = check_commits(union_exports(strict, tolerant))
    assert both.count() == 6 and both.filter("reason is not null").isEmpty()
    with pytest.raises(ValueError, match="only JSON"):
        read_commits(spark, str(tmp_path / "j"), "parquet", tolerant=True)
