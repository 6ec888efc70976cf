"""Token files, chunked BPE and token totals against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglore.llm import chunked_bpe, encoding
from loglore.llm.chunked_bpe import ChunkEncoder, encode_documents
from loglore.llm.common import WORD, table, tokenizer_json
from loglore.llm.encoding import COUNTED, PieceCounter, PieceEncoder, _Pieces, byte_table
from loglore.llm.lattice import Lattice
from loglore.llm.queries import QUERIES
from loglore.llm.token_files import read_ids, read_token_files, write_token_files
from loglore.llm.token_rollup import TokenRollup, count_tokens, spelt_word_count, word_count
from tests.llm.conftest import DOCS

CONTENT = tokenizer_json()
LIBRARY = Tokenizer.from_str(CONTENT)


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [0, 50, 10**6])
def test_pieces_and_chunks_give_the_library_s_ids(remembered):
    rng = random.Random(7)
    parts = ["a", "Z", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "'s", "1", "!", "\x85", "😀", " ", "x" * 400]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(120)]
    texts += [d[1] or "" for d in DOCS]
    pieces = PieceEncoder(CONTENT, remembered)
    chunks = ChunkEncoder(pieces, byte_table(CONTENT), remembered * 100)
    expected = [ids_of(t) for t in texts]
    assert [np.frombuffer(b, pieces.dtype).tolist() for b in pieces.encode(texts)] == expected
    found = chunks.encode(texts)
    assert [x.tolist() for x in found] == expected
    assert [chunks.decode(x) for x in found] == [LIBRARY.decode(x, skip_special_tokens=False) for x in expected]
    chunks.encode(texts)
    assert chunks.reused > 0


@pytest.mark.parametrize("remembered", [0, 50, COUNTED])
def test_counted_pieces_give_the_library_s_number_of_ids(remembered):
    rng = random.Random(11)
    parts = ["a", "Z", " ", "  ", "\n", "é", "日本", "<|endoftext|>", "'s", "1", "!", "\x85", "😀", " ", "x" * 400]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(120)]
    texts += ["", " ", "one two", *(d[1] or "" for d in DOCS)]
    pieces = PieceCounter(CONTENT, remembered)
    for _ in range(2):
        assert pieces.count(texts).tolist() == [len(ids_of(t)) for t in texts]
    assert len(pieces._later) <= remembered + 1 and pieces.count([]).tolist() == []


def test_counting_tokens_remembers_numbers_alone_and_few(docs):
    """Ids of a million pieces took two workers of an executor beyond its memory, together with the JVM."""
    run = count_tokens(docs, CONTENT, "v")
    assert run.count() == len(DOCS)
    cache: dict = {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("loglore.llm.encoding.process_cache", lambda name: cache)
        (held,) = {encoding.counter(CONTENT) for _ in range(2)}
    texts = [" ".join(f"{i:x}" for i in range(at, at + 2500)) for at in range(0, COUNTED + 50_000, 2500)]
    found = [held.count(texts[i : i + 20]) for i in range(0, len(texts), 20)]
    assert np.concatenate(found)[::25].tolist() == [len(ids_of(t)) for t in texts[::25]]
    assert COUNTED <= len(held._later) <= COUNTED + 1
    kept = sum(sys.getsizeof(p) for p in held._later) + sys.getsizeof(held._later)
    assert kept < 32 * 1024 * 1024 and all(n is None or type(n) is int for n in held._later.values())


def test_words_are_counted_without_a_list_of_them(spark):
    rng = random.Random(5)
    parts = ["a", "Z", " ", "  ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "é", "日", "𝒳", "😀", "٣", "½", "-", "--", "$1", "\\", "_", "e\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 60]))) for _ in range(600)]
    texts += [None, "", " ", " - ", "-" * 100_000, "x" * 100_000, "--a " * 20_000, "-- " * 20_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    spelt = F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]"))
    counted = rows.select(word_count(F.col("text")), spelt_word_count(F.col("text")))
    assert "regexp_extract_all" not in counted._jdf.queryExecution().optimizedPlan().toString()
    # The size of no array is -1 or null, by setting; a null text has no count.
    listed = rows.select(F.when(F.col("text").isNotNull(), F.size(words)), F.when(F.col("text").isNotNull(), F.size(spelt)))
    assert list(map(tuple, counted.collect())) == list(map(tuple, listed.collect()))


def test_ids_of_words_are_remembered_in_arrays():
    """A string and a bytes object for each piece took twice the memory: two workers and the JVM went beyond an executor's."""
    rng = random.Random(3)
    words = [f"{rng.getrandbits(rng.choice([20, 28, 40])):x}" for _ in range(250_000)]
    pieces = PieceEncoder(CONTENT)
    texts = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
    pieces.encode(["What is imported late, and what arrays are made of"])
    tracemalloc.start()
    try:
        first = [hash(x) for i in range(0, len(texts), 25) for x in pieces.encode(texts[i : i + 25])]
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 100 * len(set(words))
    again = [x for i in range(0, len(texts), 25) for x in pieces.encode(texts[i : i + 25])]
    assert [hash(x) for x in again] == first
    assert [np.frombuffer(x, pieces.dtype).tolist() for x in again[:5]] == [ids_of(t) for t in texts[:5]]


@pytest.mark.parametrize("remembered", [0, 700, 10**6])
def test_short_pieces_are_found_by_all_their_bytes(remembered):
    """Zeros at the end, prefixes, the longest short piece and one byte more are pieces of their own."""
    rng = random.Random(9)
    parts = ["a", "b", "\x00", "é", "日", "\n"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 17))) for _ in range(3000)]
    words += ["a" * n + "\x00" * m for n in range(18) for m in range(18 - n)]
    words = [w for w in words if w and w[-1] != "\n"]
    pieces = PieceEncoder(CONTENT, remembered)
    for _ in range(3):
        rng.shuffle(words)
        texts = [" ".join(words[i : i + 30]) for i in range(0, len(words), 30)]
        texts[1::9] = [f"{t}\n a  b" for t in texts[1::9]]
        texts[2::9] = [f"{t} " for t in texts[2::9]]
        found = [x for i in range(0, len(texts), 8) for x in pieces.encode(texts[i : i + 8])]
        assert [np.frombuffer(x, pieces.dtype).tolist() for x in found] == [ids_of(t) for t in texts]
    assert pieces._short_later._held <= remembered


def test_each_shard_is_a_row_group(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(10_000))) for i in range(40)]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path), CONTENT)
    groups = [
        meta.row_group(g).num_rows
        for f in (tmp_path / "shards").glob("*.parquet")
        for meta in [pq.ParquetFile(f).metadata]
        for g in range(meta.num_row_groups)
    ]
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(groups) > 2 and set(groups) == {1}
    assert read_token_files(spark, str(tmp_path)).count() == len(rows)


def test_chunks_depend_on_content_alone():
    text = np.frombuffer(" ".join(f"w{i * i}" for i in range(4000)).encode(), np.uint8)
    ends = {int(s) for s in chunked_bpe.chunk_starts(text)}
    later = {int(s) - 500 for s in chunked_bpe.chunk_starts(np.concatenate([text[:500], text]))}
    assert len(ends & later) > len(ends) // 2


def test_encoded_documents(docs, no_docs):
    rows = encode_documents(docs, CONTENT).collect()
    expected = []
    for d in DOCS:
        ids = ids_of(d[1])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((d[0], len(ids), digest, hashlib.sha256((d[1] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert encode_documents(no_docs, CONTENT).count() == 0


def test_token_files(spark, docs, no_docs, tmp_path):
    write_token_files(docs.repartition(3), str(tmp_path / "f"), CONTENT)
    rows = read_token_files(spark, str(tmp_path / "f")).orderBy("start").collect()
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in rows] == sorted((d[0] for d in DOCS), key=lambda i: -1 if i is None else i)
    crc = {d[0]: zlib.crc32(np.array([*ids_of(d[1]), 2], "<u4").tobytes()) for d in DOCS if d[0] is not None}
    assert all(r.ids_crc32 == crc[r.doc_id] for r in rows if r.doc_id is not None)
    some = read_ids(spark, str(tmp_path / "f"), [3, 40]).collect()
    assert {r.doc_id: r.ids for r in some} == {i: [*ids_of(next(d[1] for d in DOCS if d[0] == i)), 2] for i in (3, 40)}
    write_token_files(no_docs, str(tmp_path / "none"), CONTENT)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_rollup(spark, docs, no_docs, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    assert rollup.upsert("none", count_tokens(no_docs, CONTENT, "v"))
    assert rollup.totals().count() == 0
    assert rollup.upsert("a", count_tokens(docs, CONTENT, "v"))
    best: dict = {}
    for d in DOCS:
        best[d[0]] = max(best.get(d[0], (-1, "", "")), (len(ids_of(d[1])), d[3] or "", d[2] or ""))
    total = lambda: sum(r.n_tokens for r in rollup.totals().collect())
    assert total() == sum(b[0] for b in best.values())
    assert sum(r.n_docs for r in rollup.totals().collect()) == len(best)
    assert not rollup.upsert("a", count_tokens(docs, CONTENT, "v"))
    known = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
    rollup.upsert("b", spark.createDataFrame([(0, "z", "en", "v", 5), (99, None, None, "v", None)], known))
    assert total() == sum(b[0] for b in best.values()) - best[0][0] + 5
    rollup.delete("c", spark.createDataFrame([(0, "v"), (1, "v"), (1, "v"), (77, "v")], "doc_id long, tokenizer_version string"))
    assert total() == sum(b[0] for i, b in best.items() if i not in (0, 1))
    # A batch that broke off before its commit is written anew.
    spark.range(3).write.parquet(str(tmp_path / "ledger" / "batch=d"))
    assert rollup.upsert("d", spark.createDataFrame([(0, "z", "en", "v", 5)], known))
    assert total() == sum(b[0] for i, b in best.items() if i not in (0, 1)) + 5


def test_rollup_query(spark, odd_dir):
    """The query's four batches one by one, in plain Python."""
    rows = table(spark, odd_dir, "documents").select("doc_id", "text", "source", "lang").collect()
    words = lambda text: (text or "").encode().split()
    spelt = lambda text: [w for w in words(text) if regex.search(r"[\p{L}\p{N}]", w.decode())]
    first: dict = {}
    for r in rows:
        if r.doc_id is not None and r.text is not None:
            first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    copies = {r.doc_id for r in rows if r.doc_id is not None and r.text is not None and first[r.text] != r.doc_id}

    def greatest(given, count):
        best: dict = {}
        for r in given:
            value = (count(r.text), r.source is not None, r.source or "", r.lang is not None, r.lang or "")
            best[r.doc_id] = max(best.get(r.doc_id, value), value)
        return best

    held = {"byte_bpe_50k": greatest(rows, lambda t: len(ids_of(t))), "words": greatest(rows, lambda t: len(words(t)))}
    for best in held.values():
        for i in copies:
            best.pop(i, None)
    held["words"].update(greatest([r for r in rows if r.doc_id not in copies], lambda t: len(spelt(t))))
    cells: dict = {}
    for version, best in held.items():
        for n, has_source, source, has_lang, lang in best.values():
            cell = (source if has_source else None, lang if has_lang else None, version)
            docs, tokens = cells.get(cell, (0, 0))
            cells[cell] = (docs + 1, tokens + n)
    found = QUERIES["op7_token_rollup"](spark, odd_dir).collect()
    assert copies and {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in found} == cells
    assert len(found) == len(cells)


def test_each_different_piece_is_looked_up_once_a_call():
    class Counted(_Pieces):
        n = 0

        def __getitem__(self, piece):
            Counted.n += 1
            return super().__getitem__(piece)

        def get(self, *args):
            Counted.n += 1
            return super().get(*args)

    pieces = PieceEncoder(CONTENT)
    pieces._later = Counted({"": None})
    texts = ["one two three four " * 50 + "five", "six  two one", "", "one", "two two"] * 4
    expected = [np.array(e.ids, pieces.dtype).tobytes() for e in pieces.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert pieces.encode(texts) == expected
    assert Counted.n < 30


def test_few_runs_of_bytes_are_searched_in_the_lattice(monkeypatch):
    pieces = [b" ", *[bytes([c]) for c in range(97, 123)], b" ab", b"abc", b"zz"]
    lattice = Lattice(pieces, np.full(len(pieces), -3.0))
    searched = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: searched.append(len(v)) or search(a, v, *rest, **more))
    words = [b" abcdefghijklm", b" zzzzzzzzzzzzzz", b" ab", b" " + b"qabc" * 40]
    found = lattice.marginals(words)
    # ` ab` at once or in three pieces; `qabc` forty times, with `abc` at once or in three pieces.
    assert np.isclose(found[2], np.logaddexp(-3, -9))
    assert np.isclose(found[3], -3 + 40 * (-3 + np.logaddexp(-3, -9)))
    runs = sum(len(w) - i for n in (1, 2, 3) for w in words for i in range(n))
    hits = sum(w[i : i + n] in pieces for n in (1, 2, 3) for w in words for i in range(len(w) - n + 1))
    assert sum(searched) < hits + runs // 20
