"""Conversation repair against trying all edits, at several block sizes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from geoledger.llm import turn_repair as R

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain(rows):
    """Expected result of one conversation's rows after damage: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(R.BLANK_CHARS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(maxsize=None)
    def best(i, last, added):
        """(cost, audit, lines) from row i on, after a turn with initial ``last``; no more than two additions on end."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        new = "u" if last != "u" else "a"
        name = "user" if new == "u" else "assistant"
        if added < 2:
            c, e, lines = best(i, new, added + 1)
            ways.append((c + 3, "I" + e, (f"{name}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, e, lines = best(i + 1, last, 0)
            ways.append((c + 4, "D" + e, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                c, e, lines = best(i + 1, new, 0)
                ways.append((c + 3 + more, "R" + e, (f"{name}:{text}", *lines)))
                if role[:1] and role[:1] in NEXT[last]:
                    c, e, lines = best(i + 1, role[:1], 0)
                    ways.append((c + more, "K" + e, (f"{role}:{text}", *lines)))
        return min(ways) if ways else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        role, text = ("user" if h == 4 else role), ("" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        kept += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def some_rows(convs, seed=7):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        n = rnd.choice([1, 1, 2, 3, 5, 8, 11])
        for k in range(n):
            turn = rnd.choice([None, k, k, k, k + 3])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "cut", " \t\n", "", None, "a?\n ", f"t{k}.", "ü", "Yes."])
            rows.append((conv, turn, role, text))
    return rows + rows[:20]


@pytest.mark.parametrize("block", [R.BLOCK_ROWS, 3, 1])
def test_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_ROWS", block)  # conversations of more rows go through checkpoints and streams
    rows = some_rows(150)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, codes string, part int")
    got = {r["conv_id"]: tuple(r)[1:] for r in R.repaired(R.damaged(df)).collect()}
    assert got == {conv: plain(kept) for conv, kept in after_damage(rows).items()}


def test_ties_and_long_conversations():
    assert plain([]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rnd = random.Random(3)
    for _ in range(300):
        rows = [(k, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", f"b{k}", "", f"c{k}."])) for k in range(rnd.randrange(9))]
        stretch = R.Stretch()
        seen = set()
        for turn, role, text in rows:
            stretch.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        result = R._result(1, stretch)
        assert tuple(result.values())[1:] == plain(rows)
    start, low, _ = R.backward(bytes([0, 2, 4] * 100_000), R.AT_END)
    assert len("".join(e for e, _ in R.forward(bytes([0, 2, 4] * 100_000), R.AT_END, 0))) >= 300_000 and start[0] + low > 0


def test_hot_conversation_spreads_and_agrees(spark):
    rows = [(5, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(9_000)] + [(5, 9_000, "user", "same.")] * 500 + some_rows(20)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in R.repaired(R.damaged(df)).collect()}
    expected = after_damage(rows)
    five = R.Stretch()
    seen = set()
    for turn, role, text in expected[5]:
        five.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    assert tuple(got[5]) == tuple(R._result(5, five).values())
    assert set(got) == set(expected)
    assert R.repaired(R.damaged(df.limit(0))).collect() == []
