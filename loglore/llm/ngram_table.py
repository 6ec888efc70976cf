"""An open-addressed table of the n-grams of a batch, in NumPy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash

# The primes of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        11400714785074694791,
        14029467366897019727,
        1609587929392839161,
        9650029242287828579,
        2870177450012600261,
    )
)

#: Keys of shorter runs of bytes are worked out for many at a time.
_SHORT = 32
#: Checksums of so many bytes or more are worked out one by one.
_LONG = 256
# Fixed value: the reversed polynomial of CRC-32.
_CRC_POLYNOMIAL = np.uint32(0xEDB88320)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(rows: np.ndarray) -> np.ndarray:
    """The 64-bit xxHash, seed 0, of every row of a matrix of bytes."""
    n, length = rows.shape
    if length >= _SHORT:
        return np.fromiter((xxhash.xxh64_intdigest(r) for r in rows), np.uint64, n)
    acc = np.full(n, _P5 + np.uint64(length), np.uint64)
    at = 0
    while at + 8 <= length:
        lane = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0]
        acc = _rotated(acc ^ _rotated(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        at += 8
    if at + 4 <= length:
        lane = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)
        acc = _rotated(acc ^ lane * _P1, 23) * _P2 + _P3
        at += 4
    for i in range(at, length):
        acc = _rotated(acc ^ rows[:, i].astype(np.uint64) * _P5, 11) * _P1
    acc = (acc ^ (acc >> np.uint64(33))) * _P2
    acc = (acc ^ (acc >> np.uint64(29))) * _P3
    return acc ^ (acc >> np.uint64(32))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, _CRC_POLYNOMIAL ^ (table >> 1), table >> 1)
    return table.astype(np.uint32)


def crc32(rows: np.ndarray) -> np.ndarray:
    """The CRC-32 of every row of a matrix of bytes."""
    if rows.shape[1] >= _LONG:
        return np.fromiter((zlib.crc32(r) for r in rows), np.uint32, len(rows))
    table = _crc_table()
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


class NgramTable:
    """Every distinct n-gram of a batch once, with its bucket and its count.

    `slots` holds the slot of each occurrence, in the order given; `bucket` and `count` are by
    slot. A key is the xxHash of the n-gram's bytes. An occurrence looks at the slot its key points
    to and goes one further while another n-gram sits there; equal keys are believed only when the
    bytes are equal. Occurrences of one length are taken together, so their bytes form a matrix, and
    have a stretch of the table of their own, twice as long as they are many at least.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> None:
        self.slots = np.empty(len(starts), np.int64)
        bucket = [np.empty(0, np.int64)]
        base = 0
        for which, length in _by_length(ends - starts):
            rows = np.lib.stride_tricks.sliding_window_view(data, length)[starts[which]]
            size = 1 << int(2 * len(rows) - 1).bit_length()
            found, new = _interned(xxhash64(rows), rows, size)
            own = np.zeros(size, np.int64)
            own[found[new]] = crc32(rows[new]) % np.uint32(buckets)
            bucket.append(own)
            self.slots[which] = base + found
            base += size
        self.bucket = np.concatenate(bucket)
        self.count = np.bincount(self.slots, minlength=base)

    def bucket_counts(self, buckets: int) -> np.ndarray:
        """Occurrences by bucket."""
        used = np.flatnonzero(self.count)
        sums = np.zeros(buckets, np.int64)
        np.add.at(sums, self.bucket[used], self.count[used])
        return sums


def _interned(keys: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each row, and the rows that came to own theirs."""
    mask = size - 1
    slot_row = np.full(size, -1, np.int64)
    slots = np.empty(len(keys), np.int64)
    todo = np.arange(len(keys))
    place = (keys & np.uint64(mask)).astype(np.int64)
    owners = []
    while len(todo):
        at = place[todo]
        free = slot_row[at] < 0
        # Of several that want a free slot one comes to own it; the others are compared with that.
        slot_row[at[free]] = todo[free]
        owners.append(todo[free][slot_row[at[free]] == todo[free]])
        held = slot_row[at]
        same = keys[held] == keys[todo]
        same[same] = (rows[todo[same]] == rows[held[same]]).all(axis=1)
        slots[todo[same]] = at[same]
        todo = todo[~same]
        place[todo] = (place[todo] + 1) & mask
    return slots, np.concatenate(owners)


def _by_length(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    if not len(lengths):
        return
    order = np.argsort(lengths.astype(np.min_scalar_type(int(lengths.max()))), kind="stable")
    ordered = lengths[order]
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield order[a:b], int(ordered[a])
