"""BPE over content-defined chunks: a chunk is encoded once, joins of chunks are repaired."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglore.llm.common import process_cache, slices, texts_of
from loglore.llm.encoding import PieceEncoder, byte_table, encoder

#: Bytes of a chunk: least, about the mean, most.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Bytes of chunks that a worker remembers; the store is emptied when they are reached.
REMEMBERED_BYTES = 24 * 1024 * 1024
_BASE = 0x9E3779B97F4A7C15


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The polynomial hash of the 16 bytes that end at each byte, modulo 2**64.

    A window of 16 is put together from two of 8, these from two of 4, and so on.
    """
    h = data.astype(np.uint64)
    for step in (1, 2, 4, 8):
        power = np.uint64(pow(_BASE, step, 1 << 64))
        longer = h.copy()
        longer[step:] += h[:-step] * power
        h = longer
    return h


def chunk_starts(data: np.ndarray) -> list[int]:
    """Where chunks of a UTF-8 text begin: where the rolling hash says so, at whole characters."""
    n = len(data)
    if n <= LEAST:
        return [0]
    marks = np.flatnonzero((rolling_hash(data) >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    starts, at, i = [0], 0, 0
    while n - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        cut = int(marks[i]) if i < len(marks) and marks[i] <= at + MOST else at + MOST
        while cut < n and 0x80 <= data[cut] < 0xC0:
            cut += 1
        if cut >= n:
            break
        starts.append(cut)
        at = cut
    return starts


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer cuts whatever stands around: a space or line end after a visible ASCII byte."""
    space = (data[1:] == 0x20) | (data[1:] == 0x0A)
    return np.flatnonzero(space & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1


class ChunkEncoder:
    """Ids of whole texts from the ids of their chunks."""

    def __init__(self, pieces: PieceEncoder, table: list[bytes], remembered: int = REMEMBERED_BYTES) -> None:
        self.pieces, self.table = pieces, table
        self.lengths = np.array([len(b) for b in table], np.int64)
        self._chunks: dict[bytes, np.ndarray] = {}
        self._bytes, self._remembered = 0, remembered
        self.encoded = self.reused = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8") for t in texts]
        arrays = [np.frombuffer(b, np.uint8) for b in raw]
        starts = [chunk_starts(a) for a in arrays]
        self._learn([b[s:e] for b, cut in zip(raw, starts, strict=True) for s, e in _spans(cut, len(b))])
        parts: list[list[np.ndarray | int]] = []  # ids, or the number of a window to encode
        windows: list[str] = []
        for b, data, cut in zip(raw, arrays, starts, strict=True):
            parts.append(self._joined(b, data, cut, windows))
        repaired = [np.frombuffer(x, self.pieces.dtype) for x in self.pieces.encode(windows)]
        none = np.empty(0, self.pieces.dtype)
        return [np.concatenate([none, *(repaired[p] if isinstance(p, int) else p for p in ps)]) for ps in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def _learn(self, chunks: list[bytes]) -> None:
        if self._bytes > self._remembered:
            self._chunks, self._bytes = {}, 0
        new = list(dict.fromkeys(c for c in chunks if c not in self._chunks))
        for c, ids in zip(new, self.pieces.encode([c.decode("utf-8") for c in new]), strict=True):
            self._chunks[c] = np.frombuffer(ids, self.pieces.dtype)
            self._bytes += len(c) + len(ids) + 200
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)

    def _joined(self, raw: bytes, data: np.ndarray, cut: list[int], windows: list[str]) -> list[np.ndarray | int]:
        """Ids of the chunks, with a window around each join marked to be encoded anew.

        A window reaches from the last safe cut before the join to the first one after it. It is
        widened, cut by cut, until both its ends are ends of tokens in the chunks' own ids too:
        from there on, what the chunks say and what the whole text says agree.
        """
        spans = _spans(cut, len(raw))
        own = [self._chunks[raw[s:e]] for s, e in spans]
        if len(cut) == 1:
            return list(own)
        ends = [np.cumsum(self.lengths[ids]) + s for ids, (s, _) in zip(own, spans, strict=True)]
        safe = safe_cuts(data)
        bad: list[list[int]] = []
        for join in cut[1:]:
            i = int(np.searchsorted(safe, join, "right")) - 1
            j = int(np.searchsorted(safe, join, "left"))
            if i >= 0 and safe[i] == join:
                continue
            while i >= 0 and not _is_end(int(safe[i]), cut, ends):
                i -= 1
            while j < len(safe) and not _is_end(int(safe[j]), cut, ends):
                j += 1
            left, right = int(safe[i]) if i >= 0 else 0, int(safe[j]) if j < len(safe) else len(raw)
            if bad and left < bad[-1][1]:
                bad[-1] = [min(left, bad[-1][0]), max(right, bad[-1][1])]
            else:
                bad.append([left, right])
        out: list[np.ndarray | int] = []
        at = 0
        for left, right in [*bad, [len(raw), len(raw)]]:
            for ids, stops, (s, e) in zip(own, ends, spans, strict=True):
                if e > at and s < left:
                    first = 0 if at <= s else int(np.searchsorted(stops, at, "right"))
                    last = len(ids) if left >= e else int(np.searchsorted(stops, left, "right"))
                    out.append(ids[first:last])
            if right > left:
                out.append(len(windows))
                windows.append(raw[left:right].decode("utf-8"))
            at = right
        return out


def _spans(cut: list[int], n: int) -> list[tuple[int, int]]:
    return list(zip(cut, [*cut[1:], n], strict=True))


def _is_end(place: int, cut: list[int], ends: list[np.ndarray]) -> bool:
    """Whether tokens of the chunk that holds `place` end there; a chunk's own start counts."""
    k = int(np.searchsorted(cut, place, "right")) - 1
    if cut[k] == place:
        return True
    i = int(np.searchsorted(ends[k], place))
    return i < len(ends[k]) and int(ends[k][i]) == place


def chunk_encoder(content: str) -> ChunkEncoder:
    """One per worker process and vocabulary."""
    cache = process_cache("chunk encoders")
    key = hash(content)
    if key not in cache:
        cache[key] = ChunkEncoder(encoder(content), byte_table(content))
    return cache[key]


def encode_documents(docs: DataFrame, content: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; `ids` too where asked.

    A chunk that documents share is encoded once per worker process; nothing is shuffled, so there
    is no hot key. A null text counts as empty: no ids, and the hashes of empty strings. Rows that
    repeat are answered one by one. Columns other than doc_id and text are not looked at.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())]
    fields += [("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(content)
        digits = [b"%d" % i for i in range(len(enc.table))]
        for some in slices(batches, 64):
            out = []
            for doc_id, ids in zip(
                some.column("doc_id").to_pylist(), enc.encode(texts_of(some.column("text"))), strict=True
            ):
                written = b",".join(map(digits.__getitem__, ids.tolist()))
                row = [doc_id, len(ids), hashlib.sha256(written).hexdigest()]
                row.append(hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest())
                out.append(row + [ids.astype(np.int32)] * with_ids)
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    names = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, names)
