"""Encode and decode whole texts with a byte-level BPE of the tokenizers library."""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loglore.llm.common import process_cache

#: Pieces that a worker remembers; beyond it, new ones are encoded each time they come.
REMEMBERED = 1_000_000
#: Of these, pieces too long for the table of short ones; strings in a dictionary take several times the memory.
REMEMBERED_LONG = 200_000
#: Pieces whose number of ids a worker remembers; a job that counts goes on in the JVM, beside the workers' memory.
COUNTED = 200_000
_LONGEST = 64
#: Bytes of a key, of which the last holds how many bytes the piece has.
_KEY = 16
_SHORT = _KEY - 1
# Odd multipliers of a 64-bit hash, from xxHash.
_P1, _P2 = np.uint64(11400714785074694791), np.uint64(14029467366897019727)
#: New pieces that are encoded as one text.
_RUN = 256


#: Stands for the ids of a piece that is not known.
_NEW = b"new"


class _Pieces(dict):
    """Ids of pieces, or their numbers."""

    def __init__(self, known: dict[str, bytes | int | None]) -> None:
        super().__init__(known)
        self._kept = len(known)

    def forget(self, most: int) -> None:
        """Drop what came in since the last time, if it is too much: the newest pieces, and long ones."""
        if len(self) == self._kept:
            return
        new = list(itertools.islice(reversed(self), len(self) - self._kept))
        for piece in new:
            if len(piece) > _LONGEST or len(self) > most + 1:
                del self[piece]
        self._kept = len(self)


class _ShortPieces:
    """Ids of pieces of 1 to _SHORT bytes, in an open-addressed table of NumPy arrays.

    A key is the piece's bytes and their number, so equal keys are equal pieces. A piece looks at
    the slot its key's hash points to, and goes one further while another piece sits there. At
    least half of the slots are free. A count of -1 marks a piece that can't stand alone.
    """

    def __init__(self, dtype: str, most: int) -> None:
        self._most, self._held, self._used = most, 0, 0
        self.ids = np.empty(1 << 12, dtype)
        self._make(1 << 12)

    def _make(self, size: int) -> None:
        self._keys = np.zeros((size, 2), np.uint64)
        self.starts, self.counts = np.zeros(size, np.int32), np.zeros(size, np.int16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for an unknown one."""
        found = np.full(len(keys), -1, np.int64)
        at, todo = self._places(keys), np.arange(len(keys))
        while len(todo):
            held = self._keys[at]
            hit = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])
            found[todo[hit]] = at[hit]
            on = ~hit & (held[:, 1] != 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self._keys) - 1)
        return found

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Remember different, unknown pieces with their ids one after the other, as many as there is room for."""
        room = self._most - self._held
        keys, counts = keys[:room], counts[:room]
        if not len(keys):
            return
        ends = self._used + np.cumsum(np.maximum(counts, 0))
        if ends[-1] > len(self.ids):
            grown = np.empty(2 * int(ends[-1]), self.ids.dtype)
            grown[: self._used] = self.ids[: self._used]
            self.ids = grown
        self.ids[self._used : ends[-1]] = ids[: ends[-1] - self._used]
        self._used = int(ends[-1])
        self._held += len(keys)
        if 2 * self._held > len(self._keys):
            old, starts, was = self._keys, self.starts, self.counts
            self._make(1 << (2 * self._held - 1).bit_length())
            taken = np.flatnonzero(old[:, 1])
            self._put(old[taken], starts[taken], was[taken])
        self._put(keys, ends - np.maximum(counts, 0), counts)

    def _put(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        at, todo = self._places(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self._keys[at, 1] == 0)
            # Of several that want a free slot one comes to own it.
            self.starts[at[free]] = todo[free]
            won = free[self.starts[at[free]] == todo[free]]
            own, mine = at[won], todo[won]
            self._keys[own], self.starts[own], self.counts[own] = keys[mine], starts[mine], counts[mine]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, at = todo[on], (at[on] + 1) & (len(self._keys) - 1)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * _P2)) * _P1
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _P2
        return (mixed >> np.uint64(64 - (len(self._keys) - 1).bit_length())).astype(np.int64)


class PieceEncoder:
    """Ids as the library gives them for a whole text, with words remembered.

    A text is cut before each space that follows a character which is no white space. The
    pre-tokenizer always cuts there, and neither part's cuts depend on the other part, so the ids
    of the pieces, joined, are the ids of the text. A text with another kind of space run is
    encoded whole. Ids come as little-endian bytes of `width` each.
    """

    #: What is kept of a piece without ids.
    _nothing: bytes | int = b""

    def __init__(self, content: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.dtype = f"<u{self.width}"
        self._remembered = remembered
        self._lengths = np.array([len(b) for b in byte_table(content)], np.int64)
        self._short_first, self._short_later = (_ShortPieces(self.dtype, remembered) for _ in range(2))
        self._first, self._later = _Pieces({"": self._nothing}), _Pieces({"": None})

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        pieces, firsts, index, bounds = _cut(texts)
        used = np.bincount(index, minlength=len(pieces) + len(firsts))[: len(pieces)] > 0
        later, later_ids = self._found(pieces, used, self._short_later, self._later, " ")
        first, first_ids = self._found(firsts, np.ones(len(firsts), bool), self._short_first, self._first, "")
        counts = np.concatenate([later, first])
        offsets = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))]) * self.width
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate([later_ids, first_ids]))]
        joined = pa.Array.from_buffers(pa.large_binary(), len(counts), buffers).take(pa.array(index))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(index) + 1)[bounds].tolist()
        data = joined.buffers()[2]
        out = [data.slice(a, b - a).to_pybytes() if b > a else b"" for a, b in zip(ends, ends[1:], strict=False)]
        if (counts < 0).any():
            whole = _not_alone(counts >= 0, index, bounds)
            for i, found in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
                out[i] = found
        return out

    def _found(
        self, pieces: pa.Array, used: np.ndarray, short: _ShortPieces, long: _Pieces, lead: str
    ) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each different piece has, 0 for one that is not used and -1 for one that can't stand alone; the ids."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, pieces.offset * 8)
        sizes = np.diff(offsets)
        counts = np.zeros(len(pieces), np.int64)
        is_short = (sizes > 0) & (sizes <= _SHORT)
        own = np.flatnonzero(is_short & used)
        keys = _keys(pieces, offsets[own], sizes[own])
        slots = short.find(keys)
        known, new = own[slots >= 0], own[slots < 0]
        slots, keys = slots[slots >= 0], keys[slots < 0]
        counts[known] = short.counts[slots]

        texts = pieces.take(pa.array(new)).to_pylist()
        alone = np.array([not p[-1].isspace() for p in texts], bool)
        counts[new] = -1
        lone = new[alone]
        counts[lone], new_ids = self._encoded(list(itertools.compress(texts, alone)), sizes[lone], lead)

        rest = np.flatnonzero(~is_short & used)
        texts = pieces.take(pa.array(rest)).to_pylist()
        self._learn(long, {p for p in texts if p not in long}, lead)
        rest_ids = [long[p] for p in texts]
        counts[rest] = [-1 if ids is None else len(ids) // self.width for ids in rest_ids]
        long.forget(min(self._remembered, REMEMBERED_LONG))

        n = np.maximum(counts, 0)
        starts = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), self.dtype)
        ids[_runs(starts[known], n[known])] = short.ids[_runs(short.starts[slots].astype(np.int64), n[known])]
        ids[_runs(starts[lone], n[lone])] = new_ids
        ids[_runs(starts[rest], n[rest])] = np.frombuffer(b"".join(filter(None, rest_ids)), self.dtype)
        short.add(keys, counts[new], new_ids)
        return counts, ids

    def _learn(self, cache: _Pieces, new: set[str], lead: str) -> None:
        """Add the ids of `new` pieces; None marks one that ends in white space."""
        alone = []
        for p in new:
            if p and not p[-1].isspace():
                alone.append(p)
            else:
                cache[p] = cache.get(p)
        counts, ids = self._encoded(alone, np.array([len(p.encode()) for p in alone], np.int64), lead)
        stops = (np.cumsum(counts) * self.width).tolist()
        raw = ids.tobytes()
        found = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        cache.update(zip(alone, map(self._kept, found), strict=True))

    def _kept(self, ids: bytes) -> bytes | int:
        return ids

    def _encoded(self, pieces: list[str], sizes: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, with a space before it or as a text's first, and the ids.

        Pieces with a space are encoded many as one text. The library cuts at those spaces, so a
        piece's ids are those that end within its bytes. `sizes` are the pieces' bytes.
        """
        if not lead:
            return self._one_by_one(pieces)
        runs = [pieces[i : i + _RUN] for i in range(0, len(pieces), _RUN)]
        out = [self._one_by_one([])]
        for at, raw in enumerate(self._ids([" " + " ".join(run) for run in runs])):
            ids = np.frombuffer(raw, self.dtype)
            ends = np.cumsum(sizes[at * _RUN : (at + 1) * _RUN] + 1)
            reached = np.cumsum(self._lengths[ids])
            last = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[last] == ends).all():
                out.append((np.diff(last, prepend=-1), ids))
            else:
                out.append(self._one_by_one([" " + p for p in runs[at]]))
        counts, ids = zip(*out, strict=True)
        return np.concatenate(counts), np.concatenate(ids)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts) if texts else []
        counts = np.array([len(i) // self.width for i in ids], np.int64)
        return counts, np.frombuffer(b"".join(ids), self.dtype)

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]


class PieceCounter(PieceEncoder):
    """How many ids the library gives for a whole text; of a word, the number alone is remembered."""

    _nothing = 0

    def __init__(self, content: str, remembered: int = COUNTED) -> None:
        super().__init__(content, remembered)

    def count(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0, np.int64)
        numbers, index, bounds = self._looked_up(texts)
        out = np.add.reduceat(np.array([n or 0 for n in numbers], np.int64)[index], bounds[:-1])
        if None in numbers:
            whole = _not_alone(np.array([n is not None for n in numbers]), index, bounds)
            out[whole] = list(map(self._kept, self._ids([texts[i] for i in whole]))) if whole else 0
        return out

    def _looked_up(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """The number kept of each different piece, None where it can't stand alone; the texts' pieces, and their bounds."""
        coded, first, index, bounds = _cut(texts)
        pieces, firsts = (a.to_numpy(zero_copy_only=False).tolist() for a in (coded, first))
        self._learn(self._first, {p for p in firsts if p not in self._first}, "")
        numbers = list(map(self._later.get, pieces, itertools.repeat(_NEW)))
        used = np.bincount(index, minlength=len(pieces) + len(firsts))
        new = [i for i, found in enumerate(numbers) if found is _NEW]
        self._learn(self._later, {pieces[i] for i in new if used[i]}, " ")
        for i in new:
            numbers[i] = self._later[pieces[i]] if used[i] else self._nothing
        numbers += [self._first[p] for p in firsts]
        self._first.forget(self._remembered)
        self._later.forget(self._remembered)
        return numbers, index, bounds

    def _kept(self, ids: bytes) -> int:
        return len(ids) // self.width


def _cut(texts: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The different pieces, the different first ones, the number of each text's pieces among both, and the texts' bounds."""
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    bounds = cut.offsets.to_numpy()
    coded = cut.values.dictionary_encode()
    firsts = cut.values.take(pa.array(bounds[:-1])).dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    # A first piece has no space before it, so other ids than the same piece further on.
    index[bounds[:-1]] = len(coded.dictionary) + firsts.indices.to_numpy()
    return coded.dictionary, firsts.dictionary, index, bounds


def _keys(pieces: pa.Array, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two integers for each piece of up to _SHORT bytes: its bytes, and their number last."""
    if not len(starts):
        return np.empty((0, 2), np.uint64)
    data = np.concatenate([np.frombuffer(pieces.buffers()[2], np.uint8), np.zeros(_KEY, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(data, _KEY)[starts]
    rows *= np.arange(_KEY) < sizes[:, None]
    rows[:, _SHORT] = sizes
    return rows.view(np.uint64)


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places from each start on, `counts` of them, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())


def _not_alone(alone: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> list[int]:
    """The texts with a piece that may not stand alone."""
    return np.flatnonzero(~np.logical_and.reduceat(alone[index], bounds[:-1])).tolist()


def encoder(content: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return _cached("encoders", PieceEncoder, content)


def counter(content: str) -> PieceCounter:
    """One counter per worker process and vocabulary."""
    return _cached("counters", PieceCounter, content)


def _cached(name: str, kind: type[PieceEncoder], content: str) -> PieceEncoder:
    cache = process_cache(name)
    key = hash(content)
    if key not in cache:
        cache[key] = kind(content)
    return cache[key]


def byte_table(content: str) -> list[bytes]:
    """The bytes that each id stands for, by id.

    Byte-level vocabularies write a byte as one character: printable Latin-1 as itself, the
    others, in order, from code point 256 on. Added tokens stand for their own text.
    """
    vocabulary = json.loads(content)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
    table: dict[int, bytes] = {
        i: bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        for piece, i in vocabulary["model"]["vocab"].items()
    }
    table |= {t["id"]: t["content"].encode() for t in vocabulary["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]
