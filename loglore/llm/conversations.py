"""Conversation structure: what is wrong with the turns, and the cheapest edits that mend it.

A mended conversation is empty or has an optional system turn and then pairs of user and assistant.
Turns may be kept, given the role user or assistant, or deleted, and empty turns inserted. A path of
edits has one integer as its weight: the high digits are its cost, the low ones its audit letters, in
places of fixed width from the left, with zeros behind the last. The least weight is thus the cheapest
path, and among those the one whose letters come first in ASCII.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loglore.llm.common import slices
from loglore.operators.number import number_rows
from loglore.operators.sizing import fits_broadcast
from loglore.session import materialise, staging

#: Turns of a conversation that one path is worked out for at once; longer ones take several blocks.
BLOCK_TURNS = 128
_ROWS = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# The edits in ASCII order; a letter's code is its place from 1, and 0 ends the audit.
LETTERS = "DIKR"
_D, _I, _K, _R = (i + 1 for i in range(len(LETTERS)))
_WIDTH = 3

# What the turns so far are: none, a system turn, pairs and a user turn, pairs.
_NONE, _SYSTEM, _OPEN, _PAIRS = range(4)
_STATES = range(4)
# The state after a turn whose role begins so.
_AFTER = {("s", _NONE): _SYSTEM} | {("u", q): _OPEN for q in (_NONE, _SYSTEM, _PAIRS)} | {("a", _OPEN): _PAIRS}
_MADE = {"u": "user", "a": "assistant"}
#: Ends that are whole.
_WHOLE = (_NONE, _PAIRS)

BLANK, DUPLICATE, CUT_OFF = "blank", "duplicate", "truncated"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_LEGAL = ("su", "ua", "au")


class Turn(NamedTuple):
    initial: str
    fault: str | None


class Weights:
    """Paths of up to `letters` letters as integers."""

    def __init__(self, letters: int) -> None:
        self.low = _WIDTH * letters
        self._mask = (1 << self.low) - 1

    def led_by(self, letter: int, cost: int, path: int | None) -> int | None:
        """The path with one more edit in front: its letters move one place to the right."""
        if path is None:
            return None
        letters = letter << (self.low - _WIDTH) | (path & self._mask) >> _WIDTH
        return ((path >> self.low) + cost) << self.low | letters

    def cost(self, path: int) -> int:
        return path >> self.low

    def audit(self, path: int) -> str:
        codes = ((path >> at) & (2**_WIDTH - 1) for at in range(self.low - _WIDTH, -1, -_WIDTH))
        return "".join(LETTERS[c - 1] for c in codes if c)


def _least(*paths: int | None) -> int | None:
    return min((p for p in paths if p is not None), default=None)


def _inserted(after: Sequence[int | None], w: Weights) -> list[int | None]:
    """The paths from each state where up to two turns may be inserted first: more would be undone."""
    paths = list(after)
    for _ in range(2):
        paths = [_least(after[q], *(w.led_by(_I, INSERT, paths[_AFTER[r, q]]) for r in _MADE if (r, q) in _AFTER)) for q in _STATES]
    return paths


def best_paths(turns: Sequence[Turn], ends: Sequence[int | None], w: Weights) -> list[int | None]:
    """The least weight from each state before the turns, given that of each state behind them."""
    paths = list(ends)
    for turn in reversed(turns):
        after = [w.led_by(_D, DELETE, p) for p in paths]
        if turn.fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if turn.fault == CUT_OFF else 0
            for q in _STATES:
                if (turn.initial, q) in _AFTER:
                    after[q] = _least(after[q], w.led_by(_K, more, paths[_AFTER[turn.initial, q]]))
                for r in _MADE:
                    if (r, q) in _AFTER:
                        after[q] = _least(after[q], w.led_by(_R, REROLE + more, paths[_AFTER[r, q]]))
        paths = _inserted(after, w)
    return paths


def final_paths(w: Weights) -> list[int | None]:
    """What is still to be inserted behind the last turn."""
    return _inserted([0 if q in _WHOLE else None for q in _STATES], w)


def _between(turns: Sequence[Turn], end: int, w: Weights) -> list[int | None]:
    return best_paths(turns, [0 if q == end else None for q in _STATES], w)


def block_moves(turns: Sequence[Turn]) -> list[tuple[int, int, int, int]]:
    """(state before, state behind, cost, rank) of the best path between any two states.

    Every path of a block ends with the edit of its last turn, so none is the beginning of another,
    and the order of two paths stays the same whatever follows: a rank among the block's own letters
    stands for them.
    """
    w = Weights(3 * len(turns))
    found = [(q, e, p) for e in _STATES for q, p in enumerate(_between(turns, e, w)) if p is not None]
    letters = sorted({w.audit(p) for _, _, p in found})
    return [(q, e, w.cost(p), letters.index(w.audit(p))) for q, e, p in found]


def choices(blocks: Iterable[Sequence[tuple[int, int, int, int]]]) -> list[bytes]:
    """For each block, taken from the last to the first: the state behind it, by the state before it.

    Each state holds the cost of what is to come and a rank of its letters. Ranks are renewed at each
    block, so the numbers stay small however many blocks there are.
    """
    w = Weights(2)
    ends = final_paths(w)
    letters = sorted({w.audit(p) for p in ends})
    to_come = {q: (w.cost(p), letters.index(w.audit(p))) for q, p in enumerate(ends)}
    chosen = []
    for moves in blocks:
        best: dict[int, tuple[int, int, int, int]] = {}
        for q, e, cost, rank in moves:
            path = (cost + to_come[e][0], rank, to_come[e][1], e)
            best[q] = min(best.get(q, path), path)
        chosen.append(bytes(best[q][3] for q in _STATES))
        ranks = sorted({p[1:3] for p in best.values()})
        to_come = {q: (p[0], ranks.index(p[1:3])) for q, p in best.items()}
    return chosen


def edits(turns: Sequence[Turn], begin: int, end: int | None) -> tuple[int, str]:
    """Cost and audit letters of the best path from `begin` to `end`; None is a whole end."""
    w = Weights(3 * len(turns) + 2)
    paths = best_paths(turns, final_paths(w), w) if end is None else _between(turns, end, w)
    best = paths[begin]
    return w.cost(best), w.audit(best)


def edited(rows: Sequence[tuple[str, str]], audit: str, begin: int) -> list[tuple[str, str]]:
    """(role, text) of the mended turns. The letters settle the roles that are given."""
    out, at, state = [], 0, begin
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = _MADE["a" if state == _OPEN else "u"]
        state = _AFTER[role[0], state]
        out.append((role, text))
    return out


def fault_of(text: str, seen: bool) -> str | None:
    """A turn's first fault: blank, seen earlier in the conversation, or without an end mark."""
    last = text.rstrip(_SPACES)[-1:]
    if not last:
        return BLANK
    if seen:
        return DUPLICATE
    return None if last in ".!?" else CUT_OFF


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of what is left after the damage that crc32 of `conv_id:turn` deals.

    Of the remainders by 20, 0 drops the row, 1 empties its text, 2 takes its end marks out, 3 has it
    twice, 4 makes the role user. A null role or text, and a null in the hashed name, is one space.
    """
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    name = F.concat(conv, F.lit(":"), turn)
    dealt = F.crc32(name) % 20
    text = F.coalesce("text", blank)
    hit = conversations.select(
        "conv_id",
        "turn",
        F.when(dealt == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(dealt == 1, F.lit("")).when(dealt == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        dealt.alias("_dealt"),
    ).where(F.col("_dealt") != 0)
    times = F.array_repeat(F.lit(1), F.when(F.col("_dealt") == 3, 2).otherwise(1))
    return hit.withColumn("_time", F.explode(times)).drop("_dealt", "_time")


# The order of a conversation's turns; the long text behind its first characters counts by its hash.
_ORDER = ["turn", "role", "_start", "_hash"]
_START_CHARS = 64


def _ordered(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"),
        F.substring(text, 1, _START_CHARS).alias("_start"),
        F.xxhash64(text).alias("_hash"),
    )


def _same_id(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The mended turns and the findings of every conversation of `rows` (conv_id, turn, role, text).

    One row per block of `block_turns` turns, most conversations being one block: conv_id, block,
    roles and texts of the mended turns, audit, cost, the counts of blank, duplicate and truncated
    turns and of illegal neighbours (initials other than su, ua, au), the first and last initial,
    the lowest and highest turn and how many differ. `findings` puts blocks together.

    Turns stand by `turn`, nulls first; rows of one turn by role and text (its first 64 characters,
    then a hash). A null conv_id is a conversation of its own, a null role or text one space. A
    row that repeats the role and text of an earlier one is a duplicate, also in the same turn.

    A conversation of more turns is numbered by ranges and cut, so that a third of all rows in one
    conversation spread over the cluster: blocks are solved apart, between any two states; only
    a few small numbers of each block meet in one task, and say which path was the best. The edits
    are the same as in one block.
    """
    spark = rows.sparkSession
    rows = _ordered(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("_n"))
    many = materialise(sizes.where(F.col("_n") > block_turns).select(F.col("conv_id").alias("_long")), "long-conversations")
    if many.isEmpty():
        return _finished(_whole(rows))
    many = F.broadcast(many) if fits_broadcast(many) else many
    short = rows.join(many, _same_id("_long"), "left_anti")
    cut = materialise(rows.join(many, _same_id("_long"), "left_semi"), "long-conversations-turns")
    with staging(spark) as folder:
        order = [F.col("turn").asc_nulls_first(), *(F.col(c) for c in _ORDER[1:])]
        numbered = number_rows(cut, ["conv_id"], order, "_at", folder)
        numbered = numbered.withColumn("block", F.floor((F.col("_at") - 1) / block_turns))
        blocks = materialise(_listed(_seen_before(numbered, folder)), "turn-blocks")
    ways = materialise(_ways(_moves(blocks)), "turn-ways")
    led = blocks.join(F.broadcast(ways) if fits_broadcast(ways) else ways, _same_id("_conv") & (F.col("block") == F.col("_block")))
    return _finished(_whole(short)).unionByName(_finished(led))


def _same_id(other: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col(other))


def _seen_before(numbered: DataFrame, folder: str) -> DataFrame:
    """Add `_seen`: an equal row of the conversation stands in an earlier block."""
    keyed = numbered.withColumn("_key", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
    first = keyed.groupBy("conv_id", "_key").agg(F.min("block").alias("_first"), F.max("block").alias("_last"))
    again = first.where("_first < _last").select(F.col("conv_id").alias("_conv"), F.col("_key").alias("_same"), "_first")
    again = materialise(again, "repeated-turns", folder)
    again = F.broadcast(again) if fits_broadcast(again) else again
    joined = keyed.join(again, _same_id("_conv") & (F.col("_key") == F.col("_same")), "left")
    return joined.withColumn("_seen", F.coalesce(F.col("block") > F.col("_first"), F.lit(False))).select(
        *numbered.columns, "_seen"
    )


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations as one block each, from nothing to a whole end."""
    one = _listed(rows.withColumns({"block": F.lit(0).cast("long"), "_seen": F.lit(False)}))
    return one.withColumns({"begin": F.lit(_NONE), "end": F.lit(None).cast("int")})


def _listed(rows: DataFrame) -> DataFrame:
    """conv_id, block and the block's turns, in order, as one list; no list is longer than a block."""
    turn = F.struct(F.col("turn").isNotNull().alias("_known"), *_ORDER, "text", "_seen")
    return rows.groupBy("conv_id", "block").agg(
        F.transform(
            F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["turn"], t["role"], t["text"], t["_seen"])
        ).alias("listed")
    )


class _Block(NamedTuple):
    rows: list[tuple[str, str]]
    turns: list[Turn]
    numbers: list[int]


def _blocks(column: pa.Array) -> Iterator[_Block]:
    for listed in column.to_pylist():
        met: set[tuple[str, str]] = set()
        rows, turns, numbers = [], [], []
        for turn, role, text, seen in (t.values() for t in listed):
            turns.append(Turn(role[:1], fault_of(text, seen or (role, text) in met)))
            met.add((role, text))
            rows.append((role, text))
            if turn is not None:
                numbers.append(turn)
        yield _Block(rows, turns, numbers)


_COUNTS = ("cost", BLANK, DUPLICATE, CUT_OFF, "illegal")
_NUMBERS = ("low", "high", "n_turns")
_LISTS, _STRINGS = ("roles", "texts"), ("audit", "first", "last")
_FINISHED = pa.schema(
    [(n, pa.list_(pa.string())) for n in _LISTS]
    + [(n, pa.string()) for n in _STRINGS]
    + [(n, pa.int64()) for n in (*_COUNTS, *_NUMBERS)]
)


def _finished(blocks: DataFrame) -> DataFrame:
    """The edits of each block, whose states before and behind are known."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def row(b: _Block, begin: int, end: int | None) -> dict:
        cost, audit = edits(b.turns, begin, end)
        mended = edited(b.rows, audit, begin)
        initials, faults = [t.initial for t in b.turns], [t.fault for t in b.turns]
        pairs = zip(initials, initials[1:], strict=False)
        return {
            "roles": [r for r, _ in mended],
            "texts": [t for _, t in mended],
            "audit": audit,
            "first": initials[0],
            "last": initials[-1],
            "cost": cost,
            **{f: faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)},
            "illegal": sum(x + y not in _LEGAL for x, y in pairs),
            "low": min(b.numbers, default=None),
            "high": max(b.numbers, default=None),
            "n_turns": len(set(b.numbers)),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            states = zip(batch.column("begin").to_pylist(), batch.column("end").to_pylist(), strict=True)
            rows = [row(b, *ends) for b, ends in zip(_blocks(batch.column("listed")), states, strict=True)]
            made = pa.RecordBatch.from_pylist(rows, schema=_FINISHED)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), *made.columns],
                names=["conv_id", "block", *_FINISHED.names],
            )

    lists, strings = (", ".join(f"{n} {k}" for n in names) for names, k in ((_LISTS, "array<string>"), (_STRINGS, "string")))
    longs = ", ".join(f"{n} long" for n in (*_COUNTS, *_NUMBERS))
    narrow = blocks.select("conv_id", "block", "listed", "begin", "end")
    return narrow.mapInArrow(run, f"conv_id {kind}, block long, {lists}, {strings}, {longs}")


def _moves(blocks: DataFrame) -> DataFrame:
    """conv_id, block and its moves, four numbers each: sixteen of them at most."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            moves = [[n for move in block_moves(b.turns) for n in move] for b in _blocks(batch.column("listed"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(moves, pa.list_(pa.int64()))],
                names=["conv_id", "block", "moves"],
            )

    return blocks.select("conv_id", "block", "listed").mapInArrow(run, f"conv_id {kind}, block long, moves array<long>")


def _ways(moves: DataFrame) -> DataFrame:
    """_conv, _block, begin, end: the best way through each conversation's blocks.

    Blocks stream by from the last to the first; four small numbers of each are kept.
    """
    kind = moves.schema["conv_id"].dataType.simpleString()
    arrow = to_arrow_type(moves.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in slices(batches) for row in batch.to_pylist())
        for last in rows:
            # The rest of its conversation follows: as many blocks as its number tells.
            rest = itertools.islice(rows, last["block"])
            chosen = choices(zip(*[iter(row["moves"])] * 4, strict=True) for row in itertools.chain([last], rest))
            ends = bytearray([_NONE])
            for by_state in reversed(chosen):
                ends.append(by_state[ends[-1]])
            n = len(chosen)
            for at in range(0, n, _ROWS):
                some = range(at, min(at + _ROWS, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([last["conv_id"]] * len(some), arrow),
                        pa.array(some, pa.int64()),
                        pa.array([ends[i] for i in some], pa.int32()),
                        pa.array([ends[i + 1] if i + 1 < n else None for i in some], pa.int32()),
                    ],
                    names=["_conv", "_block", "begin", "end"],
                )

    ordered = moves.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    return ordered.mapInArrow(run, f"_conv {kind}, _block long, begin int, end int")


def findings(blocks: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """A row for every conv_id of `conv_ids`: what was found, the audit and a hash of the mended turns.

    gaps is how many numbers between the lowest and the highest turn are missing. The hash is of
    `role:text` lines, joined by newlines. It and the audit are put together from the blocks in their
    order, which stream through the task of their conversation. A conversation without rows has
    zeros, no letters and the hash of nothing.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    arrow = to_arrow_type(blocks.schema["conv_id"].dataType)
    asked = conv_ids.select("conv_id").distinct().withColumn("block", F.lit(-1).cast("long"))
    parts = blocks.unionByName(asked, allowMissingColumns=True)
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    names = ["conv_id", "gaps", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            done = []
            for row in batch.to_pylist():
                if row["block"] < 0:
                    done += [total.row()] if total else []
                    total = _Total(row["conv_id"])
                else:
                    total.add(row)
            yield _batch(done, names, arrow)
        if total:
            yield _batch([total.row()], names, arrow)

    longs = ", ".join(f"{n} long" for n in names[1:-2])
    return parts.mapInArrow(run, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


class _Total:
    """What the blocks of one conversation come to, in their order."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.lead = ""
        self.last: str | None = None
        self.low = self.high = None
        self.n_turns = 0

    def add(self, row: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += row[c]
        self.counts["illegal"] += self.last is not None and self.last + row["first"] not in _LEGAL
        self.last = row["last"]
        if row["low"] is not None:
            self.n_turns += row["n_turns"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        self.audit.append(row["audit"])
        for role, text in zip(row["roles"], row["texts"], strict=True):
            self.sha.update(f"{self.lead}{role}:{text}".encode())
            self.lead = "\n"

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return (self.conv_id, gaps, *self.counts.values(), "".join(self.audit), self.sha.hexdigest())


def _batch(rows: list[tuple], names: list[str], conv_id: pa.DataType) -> pa.RecordBatch:
    kinds = [conv_id, *[pa.int64()] * (len(names) - 3), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
