"""Importance resampling against its definition."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from loglore.llm import ngram_table, resampling
from loglore.llm.common import table
from loglore.llm.ngram_table import NgramTable, crc32, xxhash64
from loglore.llm.queries import QUERIES
from loglore.llm.resampling import BUCKETS, find_words, resample
from tests.llm.conftest import DOCS

SF_DIR = "/root/testdata/sf0.001"


def features(text: str | None) -> tuple[list[str], list[str]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def defined(docs: list[tuple], target: list[str | None], percent: int = 25, least: int = 20) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % BUCKETS
    raw = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    wanted = Counter(bucket(f) for t in target for f in features(t)[1])
    all_raw, all_wanted = raw.total(), wanted.total()

    def gain(b: int) -> int:
        return math.floor(1000 * math.log((wanted[b] + 1) * (all_raw + BUCKETS) / ((raw[b] + 1) * (all_wanted + BUCKETS))))

    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(words)))
    able = [r for r in rows if r[4] >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    drawn = percent * len(able) // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least]


def normal(rows) -> list[str]:
    return sorted(str(tuple(r)) for r in rows)


def test_query_equals_its_definition(spark):
    rows = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    target = [r.text for r in table(spark, SF_DIR, "benchmark").collect()]
    found = QUERIES["op13_target_resampling"](spark, SF_DIR)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert set(dict(found.dtypes).values()) == {"bigint"}
    assert normal(found.collect()) == normal(defined(rows, target))


@pytest.mark.parametrize("size", [1, 40, 1 << 21])
def test_odd_documents_in_small_batches(docs, size):
    """Nulls, repeated rows, long texts, clashing columns; a table for a few bytes, or for all."""
    target = docs.select("text").limit(6)
    some = docs.where("doc_id IS NULL OR doc_id <> 6") if size == 1 else docs  # the long one takes long by the byte
    found = resample(some, target, percent=60, least_words=2, size=size).select("doc_id", "n_features", "weight", "score", "rank")
    given = [(d[0], d[1]) for d in DOCS if size > 1 or d[0] != 6]
    assert normal(found.collect()) == normal(defined(given, [r.text for r in target.collect()], 60, 2))


def test_empty_tables(docs, no_docs):
    assert resample(no_docs, docs).count() == 0
    assert resample(docs, no_docs).count() == len(DOCS)


def test_keys_and_checksums():
    rng = np.random.default_rng(3)
    for length in (*range(1, 70), 300):
        rows = rng.integers(0, 256, (20, length), dtype=np.uint8)
        assert xxhash64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]
        assert crc32(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


@pytest.mark.parametrize("keys", [None, 0, 1])
def test_equal_keys_are_told_apart_by_bytes(monkeypatch, keys):
    if keys is not None:
        monkeypatch.setattr(ngram_table, "xxhash64", lambda rows: np.full(len(rows), keys, np.uint64) | rows[:, 0] % 2)
    words = find_words([b"a b c a b dd ee dd x a", b"", b"a b"])
    held = NgramTable(words.data, words.starts, words.ends, 1000)
    text = [bytes(words.data[s:e]) for s, e in zip(words.starts, words.ends)]
    assert {t: int(held.count[s]) for t, s in zip(text, held.slots)} == Counter(text)
    assert all(held.bucket[s] == zlib.crc32(t) % 1000 for t, s in zip(text, held.slots))
    assert held.bucket_counts(1000).sum() == len(text)


def test_a_text_is_cut_at_words():
    text = b"aa, bb " + b"c" * 50 + b"  dd" + b"!" * 30 + b"ee"
    for size in range(1, 60):
        pieces = [p for some, _, _ in resampling._pieces([text, b"", text], size) for p in some]
        assert max(map(len, pieces)) <= len(text)
        firsts = [on for _, _, goes_on in resampling._pieces([text], size) for on in goes_on]
        assert firsts[0] is False
