"""The source mix: targets, flow and selection."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loglore.llm import mixing
from loglore.llm.common import table
from loglore.llm.mixing import flow, mix, nearest_sum, sized, source_targets
from loglore.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def words(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes: dict, share: float) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, active = share, set(order)
    while left > 1e-9 and active:
        total = sum(weight[s] for s in active)
        for s in active:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in order)
        for s in list(active):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                active.discard(s)
    return target


def check_mix(rows: list, given: list[tuple]) -> None:
    sizes: dict = {}
    for _, text, source in given:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = shared(sizes, 1.5 * sum(sizes.values()))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), words(t)) for d, t, _ in given)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(2.0, 0.01 * target[s]), (s, n, target[s])


def test_query(spark):
    given = [tuple(r) for r in table(spark, SF_DIR, "documents").select("doc_id", "text", "source").collect()]
    found = QUERIES["op11_source_mix"](spark, SF_DIR).collect()
    check_mix(found, given)
    assert sorted(found) == sorted(QUERIES["op11_source_mix"](spark, SF_DIR).collect())


def test_odd_documents(spark, odd_dir):
    """Nulls, repeated rows, sources without words."""
    given = [tuple(r) for r in table(spark, odd_dir, "documents").select("doc_id", "text", "source").collect()]
    rows = QUERIES["op11_source_mix"](spark, odd_dir).collect()
    assert len(rows) == len(given)
    sizes: dict = {}
    for _, text, source in given:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = shared(sizes, 1.5 * sum(sizes.values()))
    assert all(r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source]) for r in rows)


def test_repeated_rows_are_split(spark):
    """A third of all rows are one row; its copies are taken apart from each other, and alike in each run."""
    given = [(1, "one two three", "hot")] * 400 + [(i, "a b c d " * (i % 5), f"s{i % 4}") for i in range(2, 800)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string").withColumn("part", F.lit("x"))
    runs = []
    for n in (2, 5):
        mixed, targets, _ = mix(docs.repartition(n), F.array("source"))
        rows = mixed.withColumn("source", F.col("sources")[0]).join(targets, "source").collect()
        check_mix(rows, given)
        runs.append(sorted((r.doc_id, r.taken) for r in rows))
    assert runs[0] == runs[1]


def test_empty(no_docs):
    mixed, targets, routes = mix(no_docs, F.array("source"))
    assert mixed.count() == targets.count() == routes.count() == 0


def test_targets_of_given_sizes(spark):
    rng = random.Random(3)
    for n in (1, 2, 9):
        sizes = {rng.choice(["a", "B", "é", "日", "z"]) + str(i): rng.choice([0, 1, 10, 1000]) for i in range(n)} | {None: 7}
        docs = spark.createDataFrame([([s], k) for s, k in sizes.items()], "sources array<string>, size long")
        found = {r.source: r.target for r in source_targets(docs).collect()}
        assert found == pytest.approx(shared(sizes, 1.5 * sum(sizes.values())))


def best_flow(patterns: dict, quotas: dict, most: int) -> tuple[int, int]:
    """Largest flow and its least cost, by trying all."""
    edges = [(p, s) for p, (_, near) in patterns.items() for s in near]
    best = (0, 0)
    for amounts in itertools.product(*(range(min(patterns[p][0] * most, quotas[s]) + 1) for p, s in edges)):
        used: dict = dict.fromkeys(patterns, 0)
        got: dict = dict.fromkeys(quotas, 0)
        for (p, s), n in zip(edges, amounts):
            used[p] += n
            got[s] += n
        if any(used[p] > patterns[p][0] * most for p in used) or any(got[s] > quotas[s] for s in got):
            continue
        cost = sum(sum(range(1, n // c + 1)) * c + (n // c + 1) * (n % c) for c, n in ((patterns[p][0], used[p]) for p in used))
        best = max(best, (sum(amounts), -cost))
    return best[0], -best[1]


def test_flow_is_largest_and_cheapest():
    rng = random.Random(11)
    for _ in range(60):
        sources = "xyz"[: rng.randrange(1, 4)]
        quotas = {s: rng.randrange(0, 4) for s in sources}
        patterns = {p: (rng.randrange(1, 3), rng.sample(sources, rng.randrange(1, min(2, len(sources)) + 1))) for p in "ab"}
        found = flow([(p, c, s, quotas[s]) for p, (c, near) in patterns.items() for s in near], 2)
        used = {p: sum(n for q, _, n in found if q == p) for p in patterns}
        cost = sum(sum(range(1, used[p] // c + 1)) * c + (used[p] // c + 1) * (used[p] % c) for p, (c, _) in patterns.items())
        assert all(n <= patterns[p][0] * 2 for p, n in used.items())
        assert all(sum(n for _, s, n in found if s == q) <= quotas[q] for q in quotas)
        assert (sum(used.values()), cost) == best_flow(patterns, quotas, 2)


def test_overlapping_sources(spark):
    """Documents of two sources serve the one that lacks words; each target is met."""
    rows = [(i, "w " * 5, ["a"] if i % 3 else ["a", "b"]) for i in range(300)] + [(1000 + i, "w " * 5, [None] if i % 2 else ["c", "c"]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own array<string>")
    mixed, targets, routes = mix(docs, F.col("own"), weights=(1, 4, 1))
    quota = {r.source: r.target for r in targets.collect()}
    got = {r.source: r.n for r in routes.groupBy("source").agg(F.sum("routed").alias("n")).collect()}
    assert sum(got.values()) == pytest.approx(sum(quota.values()), abs=4) and quota["b"] > 500
    assert all(got[s] == round(quota[s]) for s in quota)
    by_pattern = {r.pattern: r.n for r in routes.groupBy("pattern").agg(F.sum("routed").alias("n")).collect()}
    taken = {r.p: r.n for r in mixed.groupBy(F.to_json("sources", {"ignoreNullFields": "false"}).alias("p")).agg(F.sum("taken").alias("n")).collect()}
    assert all(abs(taken[p] - n) < 5 for p, n in by_pattern.items())
    assert sized(docs, F.col("own")).where("size <> 5").count() == 0


def test_nearest_sum(monkeypatch):
    rng = random.Random(9)
    for _ in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        taken = [rng.random() < 0.5 for _ in sizes]
        left = rng.randrange(1, 40)
        wanted = left + sum(n for n, t in zip(sizes, taken) if t)
        found = nearest_sum(sizes, taken, left)
        best = min(abs(wanted - sum(c)) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k))
        assert abs(wanted - sum(n for n, t in zip(sizes, found) if t)) == best
    monkeypatch.setattr(mixing, "STEPS", 1000)
    sizes = [rng.randrange(1, 10**6) for _ in range(60)]
    found = nearest_sum(sizes, [False] * 60, 5 * 10**6)
    assert abs(sum(n for n, t in zip(sizes, found) if t) - 5 * 10**6) < sum(sizes) / 1000 * 60
