"""Cases in which rows were once lost without a word."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loglore.functions.embedders import HASHED_MODEL, hashed_words
from loglore.operators.clean import reject_whole_batches
from loglore.operators.lookup import find_commits
from loglore.operators.tables import TableSet, cascade, check_embeddings
from loglore.plans.fixture import raw_from_documents, spoilt_sha, table
from loglore.plans.indexing import index_commits

SF_DIR = "/root/testdata/sf0.001"


def raw(spark, where: str, spoilt: bool = False):
    docs = table(spark, SF_DIR, "documents").where(where)
    return raw_from_documents(docs, spoilt_sha() if spoilt else None)


def test_another_prefix_length_is_an_error(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path), prefix_length=2)
    index_commits(raw(spark, "doc_id < 5"), tables, hashed_words, HASHED_MODEL)
    stored = tables.commits()
    ids = stored.select("sha")
    assert find_commits(stored, ids, prefix_length=2).count() == stored.count() > 0
    with pytest.raises(ValueError, match="by 2 digits"):
        find_commits(stored, ids, prefix_length=3)
    with pytest.raises(ValueError, match="by 2 digits"):
        TableSet(spark, str(tmp_path), prefix_length=3).append_commits(stored.drop("sha_prefix"))


def test_two_unnamed_runs_keep_both_rejects(spark, tmp_path):
    tables = TableSet(spark, str(tmp_path))
    index_commits(raw(spark, "doc_id < 20", True), tables, hashed_words, HASHED_MODEL)
    once = tables.rejects().count()
    index_commits(raw(spark, "doc_id BETWEEN 20 AND 39", True), tables, hashed_words, HASHED_MODEL)
    assert tables.rejects().count() > once > 0
    assert tables.rejects().select("run").distinct().count() == 2


def test_strict_rejects_a_batch_without_a_repository(spark):
    rows = [(None, 0, "a", None), (None, 0, "b", "bad"), (None, 1, "c", None), ("r", 0, "d", None)]
    checked = spark.createDataFrame(rows, "repo string, batch_no long, sha string, reason string")
    found = {r.sha: r.reason for r in reject_whole_batches(checked, ["repo", "batch_no"]).collect()}
    assert found == {"a": "batch holds an invalid commit", "b": "bad", "c": None, "d": None}


def test_vectors_stay_in_place(spark, tmp_path):
    embeddings = spark.range(50).select(
        F.col("id").cast("string").alias("sha"), F.lit("message").alias("source"), F.lit("m").alias("model"),
        F.lit(1).alias("dim"), F.array(F.lit(1.0).cast("float")).alias("vector"),
    )
    embeddings.write.parquet(str(tmp_path / "e"))
    embeddings = spark.read.parquet(str(tmp_path / "e"))
    commits = spark.range(40).select(F.col("id").cast("string").alias("sha"))
    sound, rejects = check_embeddings(embeddings, commits)
    left = cascade(embeddings, commits)
    assert (sound.count(), rejects.count(), left.count()) == (40, 10, 40)
    for df in (sound, left):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "vector" in x)
        above = [x for x in lines[:scan] if x.index("+-" if "+-" in x else x.strip()[0]) < lines[scan].index("FileScan")]
        assert not any("Exchange hashpartitioning" in x for x in above)
