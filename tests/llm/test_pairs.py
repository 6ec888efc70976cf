"""Near-duplicates, benchmark passages and language-model scores against brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loglore.llm import decontaminate, neardup
from loglore.llm import lattice as lattice_code
from loglore.llm.common import table, tokenizer_json
from loglore.llm.decontaminate import MATCH, Items, align, contaminated, most_score, passage_words, without_contaminated
from loglore.llm.lattice import Lattice
from loglore.llm.lattice_lm import pieces_of, scores
from loglore.llm.line_dedup import drop_boilerplate
from loglore.llm.neardup import near_duplicates, one_of_each
from loglore.llm.quality import quality
from tests.llm.conftest import BASE

SF_DIR = "/root/testdata/sf0.001"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def brute_components(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    led = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(len(rows)), 2):
            if rows[a][0] is None or rows[b][0] is None or led[a] == led[b] or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                led[a] = led[b] = min(led[a], led[b])
                changed = True
    return sorted(
        (str(i), len(s), str(c), c is None or i == c) for (i, _), s, c in zip(rows, sets, led, strict=True)
    )


@pytest.mark.parametrize("block", [neardup.BLOCK, 300])
def test_near_duplicates(spark, docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    given = table(spark, SF_DIR, "documents").select("doc_id", "text").where("doc_id < 100").collect()
    family = [(1000 + i, " ".join(f"f{k}" if (k * 7 + i) % (5 + i % 9) else f"v{i}x{k}" for k in range(90))) for i in range(30)]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(r.doc_id + 500, r.text) for r in given] + family
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == brute_components(rows)


def test_one_of_each(docs, no_docs):
    left = one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 0 in ids and not {1, 2, 3} & set(ids) and ids.count(None) == 2
    assert near_duplicates(no_docs).count() == 0


def test_one_row_of_each(spark):
    """Rows, not ids: repeated rows of a leader, a doc_id with two texts, rows without doc_id."""
    one, two, three = (" ".join(f"{name}{k}" for k in range(30)) for name in "abc")
    near = one + " more"
    rows = [
        *[(1, one, "x")] * 5, (1, one.upper(), "x"), (2, one, "x"), (3, near, "x"),
        (4, two, "x"), (4, one, "x"), (4, two, "y"),
        (None, two, "x"), (None, one.upper(), "x"), *[(None, three, "x")] * 3, (None, three.upper(), "x"),
        (5, "", "x"), (5, "", "x"), (None, None, "x"), (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = one_of_each(docs)
    assert left.columns == docs.columns
    found = sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect())
    assert found == sorted(
        [("1", one), ("4", two), ("None", three), ("5", ""), ("5", ""), ("None", ""), ("None", "")]
    )


def test_benchmark_passages(spark, docs, no_docs):
    item = " ".join(f"Alpha{i}, beta{i % 7}" for i in range(10, 25))
    items = spark.createDataFrame([(1, item, 0), (2, None, 0), (None, "too short", 0), (3, item, 0)], "item_id long, text string, doc_id long")
    edited = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(900, "start " + BASE.replace("alpha12 ", "").replace("alpha20", "new") + " end")], "doc_id long, text string")
    )
    found = {(r.doc_id, r.item_id): r for r in contaminated(edited, items).collect()}
    assert {i for i, _ in found} == {0, 1, 2, 3, 900} and {j for _, j in found} == {1, 3}
    assert found[0, 1].score == 1 and (found[0, 1].start_word, found[0, 1].end_word) == (20, 50)
    assert 0.5 < found[900, 1].score < 1
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 5
    assert contaminated(no_docs, items).count() == contaminated(docs, items.limit(0)).count() == 0


def brute_shares(docs: list[tuple], items: list[tuple], least: float = 0.5) -> dict[tuple, float]:
    """Whole documents aligned with every item."""
    number: dict[bytes, int] = {}
    numbers = lambda text: np.array([number.setdefault(w, len(number)) for w in passage_words(text.encode())], np.int64)
    held = [(j, numbers(text)) for j, text in items]
    shares = {}
    for i, text in docs:
        window = numbers(text)
        for j, item in held:
            score, _ = align(item, window)
            assert score <= most_score(item, window)
            if score >= least * MATCH * len(item):
                shares[i, j] = score / (MATCH * len(item))
    return shares


@pytest.mark.parametrize("copies", [9, 2000])
@pytest.mark.parametrize("exact", [0, 1])
def test_frequent_leaks(spark, copies, exact):
    """Leaks make their own seeds frequent, whether edited, cut to half or more, or whole."""
    kinds = []
    for name, edit in (("a", lambda k: k % 5 == 4), ("b", lambda k: k >= 24)):
        words = [f"{name}{k}" for k in range(40)]
        edited = [f"new{k}" if edit(k) else w for k, w in enumerate(words)]
        kinds.append((" ".join(words), " ".join(edited)))
    items = [(j, whole) for j, (whole, _) in enumerate(kinds)]
    rows = [(2 * i + j, f"start{i} here {edited} end{i}") for i in range(copies) for j, (_, edited) in enumerate(kinds)]
    rows += [(10_000 + j, whole) for j, whole in items if exact]
    rows += [(20_000 + i, " ".join(f"a{k} a{k + 1} a{k + 2} other{i}" for k in range(0, 12, 6))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_shares(rows, items)
    assert len(expected) == 2 * copies + 2 * exact
    assert {(r.doc_id, r.item_id): r.score for r in found} == pytest.approx(expected) and len(found) == len(expected)


def test_stock_phrase(monkeypatch):
    """Items that share a phrase, edited copies of some, and texts that hold the phrase alone."""
    monkeypatch.setattr(decontaminate, "RARE_ITEMS", 2)
    stock = "which of the following statements is true"
    items = [(j, f"{stock} " + " ".join(f"q{j}x{k}" for k in range(12))) for j in range(60)]
    items += [(60 + j, f"{stock} or {j} all things that one may name here") for j in range(6)] + [(70, items[3][1]), (71, items[3][1]), (72, items[3][1])]
    rows = [(i, f"start{i} then {stock} end{i}") for i in range(20)]
    rows += [(100 + j, f"before {stock} " + " ".join(f"q{j}x{k}" for k in range(12) if k != 5)) for j in range(0, 60, 7)]
    # The stock phrase is the only seed left: other words stand in pairs.
    rows += [(200, f"{stock} " + " ".join(f"q4x{k} q4x{k + 1} new{k}" for k in range(0, 12, 2))), (201, items[3][1])]
    rows += [(300, " ".join(text for _, text in items))]
    held = Items.of([(j, text.encode()) for j, text in items])
    assert not held.rare.all() and held.rare.any()
    numbers, text, place, k = held.hits([t.encode() for _, t in rows])
    near = [held.near(numbers[t], place[text == t], k[text == t]) for t in range(len(rows))]
    assert not any(near[:20])
    expected = brute_shares(rows, items)
    assert {(i, items[j][0]) for (i, _), n in zip(rows, near, strict=True) for j in n} >= set(expected)
    assert (200, 4) in expected and (201, 72) in expected and (300, 59) in expected


def test_excerpt_and_blocks(spark, monkeypatch):
    """A long item's excerpt counts by its words; several blocks find what one does."""
    long = [f"w{k}" for k in range(300)]
    items = [(1, " ".join(long)), (2, " ".join(f"v{k}" for k in range(20))), (2, " ".join(f"v{k}" for k in range(20)))]
    rows = [(n, "a b " + " ".join(long[50 : 50 + n]) + " c d") for n in (28, 29, 30, 40, 200)] + [(1, items[1][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, contaminated(docs, benchmark).collect()))
    assert [r[:2] for r in whole] == [(1, 2), (1, 2), (30, 1), (40, 1), (200, 1)]
    assert whole[2][2:] == (0.1, 2, 32, 300)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, contaminated(docs, benchmark).collect())) == whole


def test_lattice_against_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"c"]
    p = np.array([0.2, 0.1, 0.3, 0.05, 0.25, 0.1])

    def whole(word: bytes) -> list[list[int]]:
        if not word:
            return [[]]
        return [[i, *rest] for i, x in enumerate(pieces) if word.startswith(x) for rest in whole(word[len(x) :])]

    words = [b"abab", b"a", b"cabac", b"abababababa", b"ab" * 40]
    lattice = Lattice(pieces, np.log(p))
    small = words[:4]
    expected = np.zeros(len(pieces))
    for word, got in zip(small, lattice.marginals(small), strict=True):
        ways = whole(word)
        each = np.array([np.prod(p[w]) for w in ways])
        assert got == pytest.approx(math.log(each.sum()))
        for way, share in zip(ways, each / each.sum(), strict=True):
            np.add.at(expected, way, 2 * share)
    assert lattice.expected(small, np.full(4, 2.0)) == pytest.approx(expected)
    # A long word, worked off alone, agrees with the recursion over short ones.
    assert lattice.marginals(words)[4] == pytest.approx(lattice._forward(lattice._edges(np.frombuffer(words[4], np.uint8).reshape(1, -1)), 80, 1)[80, 0])


def test_long_words_in_blocks(monkeypatch):
    """A long word worked off in blocks equals the recursion over short ones."""
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"c", b"bcabcab"]
    lattice = Lattice(pieces, np.log([0.2, 0.1, 0.3, 0.05, 0.15, 0.1, 0.1]))
    draw = np.random.default_rng(4)
    words = [bytes(draw.choice([97, 98, 99], n).astype(np.uint8)) for n in (65, 66, 71, 72, 200, 200)]
    counts = np.arange(1.0, 7.0)
    monkeypatch.setattr(lattice_code, "_LONG", 1000)
    plain, used = lattice.marginals(words), lattice.expected(words, counts)
    monkeypatch.setattr(lattice_code, "_LONG", 64)
    for block in (7, 65, 4096):
        monkeypatch.setattr(lattice_code, "_BLOCK", block)
        assert lattice.marginals(words) == pytest.approx(plain, rel=1e-12)
        assert lattice.expected(words, counts) == pytest.approx(used, rel=1e-9)


def test_scores(spark, docs, no_docs):
    apart = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    strange = next(i for i in range(100, 200) if apart(i))
    more = spark.createDataFrame([(strange, "xq" * 15_000)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = scores(docs, tokenizer_json(), 1).collect()
    tokens = [(d.doc_id, [*words_of(d.text), b""]) for d in docs.select("doc_id", "text").collect()]
    counts = Counter(t for i, ts in tokens if not apart(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), apart(i), len(ts), sum(counts[t] > 0 for t in ts), n,
         round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 4))
        for i, ts in tokens
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == expected
    assert all(r.score < 0 for r in rows)
    # Neither is in the training texts: pieces alone tell words from none.
    plain = {r.doc_id: r.score / r.n_tokens for r in rows if r.doc_id in (6, strange)}
    assert apart(6) and plain[6] > plain[strange]
    assert scores(no_docs, tokenizer_json(), 1).count() == 0


def test_scores_against_their_definition(spark, docs):
    """Without fitting, so that the pieces' scores are those of their ranks."""
    found = scores(docs, tokenizer_json(), 0).collect()
    apart = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    texts = [(d.doc_id, words_of(d.text)) for d in docs.select("doc_id", "text").collect()]
    counts = Counter(w for i, ws in texts if not apart(i) for w in ws)
    n, ends = sum(counts.values()), sum(not apart(i) for i, _ in texts)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    pieces = pieces_of(tokenizer_json())
    logp = np.log(1 / (np.arange(len(pieces)) + 10.0))
    lattice = Lattice(pieces, logp - np.logaddexp.reduce(logp))
    words = sorted({w for _, ws in texts for w in ws})
    ended = (ends + 0.5) / (n + ends + 1)
    each = {}
    for w, spelt in zip(words, lattice.marginals([b" " + w for w in words]), strict=True):
        ways = [spelt + math.log(discount * len(counts) / n)]
        ways += [math.log((counts[w] - discount) / n)] if w in counts else []
        each[w] = (np.logaddexp.reduce(ways) + math.log(1 - ended)) / math.log(10)
    expected = sorted((str(i), sum(each[w] for w in ws) + math.log10(ended)) for i, ws in texts)
    assert [i for i, _ in expected] == [i for i, _ in sorted((str(r.doc_id), r.score) for r in found)]
    assert [x for _, x in sorted((str(r.doc_id), r.score) for r in found)] == pytest.approx([x for _, x in expected])


def test_pipeline(spark, odd_dir, tmp_path):
    """Odd documents and ordinary ones with their copies and benchmark passages."""
    for p in Path(odd_dir).iterdir():
        if p.stem != "documents":
            (tmp_path / p.name).symlink_to(p)
    odd = table(spark, odd_dir, "documents")
    given = table(spark, SF_DIR, "documents").withColumn("doc_id", F.col("doc_id") + 1000)
    odd.unionByName(given.select(odd.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]

    judged = quality(docs)
    good = judged.where("kept").select("doc_id")
    texts = drop_boilerplate(docs.join(good, "doc_id", "left_semi")).select("doc_id", "text").collect()
    led = [int(i) for i, _, _, kept in brute_components([tuple(r) for r in texts]) if kept]
    items = table(spark, str(tmp_path), "benchmark")
    leaks = {r.doc_id for r in contaminated(spark.createDataFrame([r for r in texts if r.doc_id in set(led)]), items).collect()}
    assert sorted(ids) == sorted(set(led) - leaks)
    # Each stage takes something out.
    assert len(texts) < docs.count() and len(led) < len(texts) and leaks
    # Texts 0 to 2 pass the base rules, but none of their words is a common one of their language.
    found = {r.doc_id: r for r in judged.where("doc_id < 3").collect()}
    assert all(not r.base_failed and r.words_apart > 0.3 and not r.kept for r in found.values())
    assert 3 in ids


def test_rows_with_a_leak_go_by_their_text(spark):
    """A null doc_id hides no leak, and a clean text that shares its doc_id with one stays."""
    leak = " ".join(f"item word {i}" for i in range(12))
    rows = [(1, f"before {leak} after"), (1, "its own clean text"), (None, leak), (None, None), (2, "clean"), (None, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, leak)], "item_id long, text string")
    left = sorted(map(str, without_contaminated(docs, items).collect()))
    assert left == sorted(map(str, docs.where("text IS NULL OR text NOT LIKE '%item word%'").collect()))
