"""Operators that SQL can express, on ordinary and odd tables."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loglore.llm.common import table
from loglore.llm.line_dedup import drop_boilerplate
from loglore.llm.oracles import ORACLES
from loglore.llm.quality import passing, quality
from loglore.llm.queries import QUERIES
from loglore.llm.secrets import ACCESS, ASSIGN, HEX, KINDS, OPAQUE, secrets
from loglore.llm.url_filter import url_verdicts
from tests.oracle import normal, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, odd_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, odd_dir))
    sql_names, expected = sql_rows(ORACLES[name], odd_dir)
    assert sorted(names) == sorted(sql_names)
    assert normal(names, rows) == normal(sql_names, expected)


def test_repeated_line_is_dropped_and_columns_stay(docs):
    found = drop_boilerplate(docs)
    assert found.columns == docs.columns
    texts = {r.doc_id: r.text for r in found.collect()}
    assert texts[11] == "keep this" and texts[20] == "page 0 is its own\n" and texts[4] is None
    assert passing(docs).columns == docs.columns


def test_copies_do_not_become_the_reference(spark):
    """A third of all rows are copies of one long junk text."""
    given = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    junk = " ".join(f"#{i} *x{i % 13}| $% {i * i}&" for i in range(300))
    given = given.unionByName(spark.createDataFrame([(-1, junk, "en")], given.schema))
    copies = spark.range(given.count() // 2).select((-2 - F.col("id")).alias("doc_id"), F.lit(junk).alias("text"), F.lit("en").alias("lang"))
    alone = {r.doc_id: r for r in quality(given).collect()}
    found = {r.doc_id: r for r in quality(given.unionByName(copies)).collect()}
    assert {i: r for i, r in found.items() if i >= -1} == alone
    assert not any(r.kept for i, r in found.items() if i < 0) and sum(r.kept for r in alone.values()) > len(alone) / 2


def test_copies_keep_their_lines(spark):
    """A third of a source are copies of one text; a footer stands on every page."""
    own = [(i, f"page {i} is its own\nand so is {i * i}\nfooter line here", "site") for i in range(40)]
    copied = "a whole document\nof several lines\nthat was copied\nfooter line here"
    rows = own + [(100 + i, copied, "site") for i in range(20)] + [(200, None, "site"), (201, None, "site")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = drop_boilerplate(docs).collect()
    expected = [(i, t and t.removesuffix("\nfooter line here")) for i, t, _ in rows]
    assert sorted((r.doc_id, r.text) for r in found) == expected


def brute_spans(text: str) -> list[tuple]:
    """All spans of a text whose opaque runs stand nowhere else, by start, then kind."""
    found = []
    for rank, pattern in enumerate((ASSIGN, ACCESS, HEX, OPAQUE)):
        for m in re.finditer(pattern, text):
            value = m[2] if rank == 0 else m[0]
            if rank == 3:
                counts = all(re.search(c, value) for c in ("[A-Z]", "[a-z]", "[0-9]"))
                counts = counts and not any(s < m.end() and m.start() < e for s, k, e in found if k < 3)
            else:
                counts = rank > 0 or len(value) >= 8
            if counts:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def test_many_spans_in_one_text(spark):
    """More spans than one list holds, of all kinds, some inside and across others."""
    draw = random.Random(3)
    run = lambda letters, n: "".join(draw.choices(letters, k=n))
    kinds = [
        lambda: f"token={run('abcXYZ019/+', draw.randint(4, 40))}", lambda: "AKIA" + run("ABC012", 13),
        lambda: run("0123456789abcdef", 40), lambda: run("abcXYZ019/+_", 30), lambda: run("XYZ_/", 9) + run("abcdef01", 33),
        lambda: "secret: 'é", lambda: run("XYZ_/", 9) + "AKIA" + run("ABC012", 20) + run("xyz", 9), lambda: "plain words",
    ]
    texts = [" ".join(draw.choice(kinds)() for _ in range(n)) for n in (1, 2, 255, 256, 257, 3000)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in secrets(docs).collect():
        assert r.spans == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(texts[r.doc_id]))
    assert len(brute_spans(texts[-1])) > 1000


def test_empty_tables(spark, no_docs):
    assert quality(no_docs).count() == drop_boilerplate(no_docs, counts=True).count() == secrets(no_docs).count() == 0
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
