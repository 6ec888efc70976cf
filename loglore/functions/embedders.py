"""The embedder contract and the built-in stand-in.

An embedder takes a list of texts and answers with their vectors, in order,
and the name of the model that made them. Jobs are given a factory, called
with the wanted model name once per task, so a model is loaded where it runs.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np

from loglore.schema import DEFAULT_MODEL


class Reply(NamedTuple):
    vectors: Sequence[Sequence[float]]
    model: str


Embedder = Callable[[list[str]], Reply]
EmbedderFactory = Callable[[str], Embedder]


def model_or_default(model: str) -> str:
    return model or DEFAULT_MODEL


HASHED_DIM = 64
HASHED_MODEL = f"hashed-words-{HASHED_DIM}"

_WORD = re.compile(r"\S+", re.ASCII)
_REMEMBERED_WORDS = 200_000


class _Buckets(dict):
    """Bucket of every word met so far; the common ones are hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED_WORDS:
            self.clear()
        found = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % HASHED_DIM
        return found


def hashed_words(model: str = HASHED_MODEL) -> Embedder:
    """Factory of the built-in embedder: word counts hashed to 64 buckets.

    It matches words, not meaning. The bucket of a word is the number in the
    first six hex digits of its md5, modulo 64; a vector has length one, or is
    all zero for a text without words. It always answers with its own name.
    """
    buckets = _Buckets()

    def one(text: str) -> np.ndarray:
        words = Counter(_WORD.findall(text.lower()))
        at = np.fromiter((buckets[w] for w in words), np.int64, len(words))
        counts = np.bincount(at, np.fromiter(words.values(), np.float64, len(words)), HASHED_DIM)
        length = np.sqrt((counts * counts).sum())
        return (counts / length if length else counts).astype(np.float32)

    return lambda texts: Reply([one(t) for t in texts], HASHED_MODEL)
