"""Repaired conversations against a search through all edits."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from loglore.llm.common import table
from loglore.llm.conversations import Turn, block_moves, choices, damaged, edits, findings, repair
from loglore.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
_NEXT = {(None, "s"): "s", (None, "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(turns: list[tuple[str, str | None]]) -> tuple[int, str, list]:
    """Cost, letters and (row or None, role or None) of the best edits, by trying all."""
    best: list = [None]

    def go(i: int, last: str | None, cost: int, letters: str, out: list, inserted: int) -> None:
        if best[0] is not None and cost > best[0][0]:
            return
        if i == len(turns) and last in (None, "a") and (best[0] is None or (cost, letters) < best[0][:2]):
            best[0] = (cost, letters, out)
        if inserted < 2:
            for r, name in (("u", "user"), ("a", "assistant")):
                if (last, r) in _NEXT:
                    go(i, r, cost + 3, letters + "I", [*out, (None, name)], inserted + 1)
        if i == len(turns):
            return
        initial, fault = turns[i]
        go(i + 1, last, cost + 4, letters + "D", out, 0)
        if fault in ("blank", "duplicate"):
            return
        more = 3 * (fault == "truncated")
        if (last, initial) in _NEXT:
            go(i + 1, initial, cost + more, letters + "K", [*out, (i, None)], 0)
        for r, name in (("u", "user"), ("a", "assistant")):
            if (last, r) in _NEXT:
                go(i + 1, r, cost + 3 + more, letters + "R", [*out, (i, name)], 0)

    go(0, None, 0, "", [], 0)
    return best[0]


def test_paths_equal_a_search_whole_and_in_blocks():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 8)
        turns = [(rng.choice("suaxu "), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]
        expected = cheapest(turns)[:2]
        turns = [Turn(*t) for t in turns]
        assert edits(turns, 0, None) == expected
        for size in (1, 2, 3):
            blocks = [turns[i : i + size] for i in range(0, n, size)]
            ends = [0]
            for by_state in reversed(choices(block_moves(b) for b in reversed(blocks))):
                ends.append(by_state[ends[-1]])
            parts = [edits(b, ends[i], ends[i + 1] if i + 1 < len(blocks) else None) for i, b in enumerate(blocks)]
            assert (sum(c for c, _ in parts), "".join(a for _, a in parts)) == expected


def defined(rows: list[tuple], damage: bool = True) -> dict:
    """By conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
    conversations: dict = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        dealt = zlib.crc32(name.encode()) % 20 if damage else 19
        if dealt == 1:
            text = ""
        if dealt == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if dealt == 4:
            role = "user"
        kept.extend([(turn, role, text)] * {0: 0, 3: 2}.get(dealt, 1))
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns = set(), []
        for _, role, text in kept:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role[:1], fault))
        cost, audit, made = cheapest(turns)
        lines = [f"{name or kept[i][1]}:{'' if i is None else kept[i][2]}" for i, name in made]
        numbers = {t for t, _, _ in kept if t is not None}
        faults = [f for _, f in turns]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


_NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(df) -> dict:
    rows = df.collect()
    found = {r.conv_id: tuple(r[n] for n in _NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_its_definition(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
        assert by_conversation(QUERIES["op12_conversation_repair"](spark, sf)) == defined(rows)


_SCHEMA = "conv_id long, turn long, role string, text string, block long, cost long, _seen string, listed string"


def odd(rng: random.Random, convs: int, rows: int) -> list[tuple]:
    texts = ["Yes.", "No", "", " \t", None, "Why?", "é.\n", "Yes.", "x" * 200 + "!", "x" * 200 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User"]
    return [
        (rng.choice([None, *range(convs)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts))
        for _ in range(rows)
    ]


@pytest.mark.parametrize("block", [2, 3, 128])
def test_odd_conversations_in_blocks(spark, block):
    """Nulls, ties, repeated rows, odd roles, clashing columns, conversations longer than a block."""
    given = odd(random.Random(block), 12, 70)
    rows = spark.createDataFrame([(*r, 1, 2, "a", "b") for r in given], _SCHEMA).repartition(3)
    found = by_conversation(findings(repair(damaged(rows), block), rows))
    expected = defined(given)
    # Rows of one turn with the same role that share their first characters stand by a hash.
    assert found.keys() == expected.keys()
    assert {c: v[:-2] for c, v in found.items()} == {c: v[:-2] for c, v in expected.items()}
    assert found == by_conversation(findings(repair(damaged(rows), 10**6), rows))


def test_a_hot_conversation_spreads(spark):
    """One conversation with most of the rows; its result is that of one block."""
    given = [(7, i, ("user", "assistant", "tool")[i % 3 if i % 50 == 0 else i % 2], f"turn {i % 700}.") for i in range(1500)]
    rows = spark.createDataFrame(given + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    whole = by_conversation(findings(repair(rows, 10**6), rows))
    assert by_conversation(findings(repair(rows, 16), rows)) == whole
    assert whole[8] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())


def test_nothing_left(spark):
    empty = spark.createDataFrame([], _SCHEMA)
    assert findings(repair(damaged(empty)), empty).count() == 0
    asked = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert by_conversation(findings(repair(empty), asked)) == {1: nothing, None: nothing}
