"""Conversation structure repair: the cheapest edits that make roles alternate, found by checkpointed dynamic programming.

A repaired conversation's role initials read ``(s?(ua)+)?``, so after any turn
it is in one of four states, and the costs of finishing from each of them form
a small vector. Vectors are computed backward and kept only at checkpoints;
the stretch between two is computed again while walking forward, where the
first letter among the cheapest edits is taken each time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: A conversation of more rows or characters than this is cut into blocks that later steps stream.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20
#: States: nothing yet, after system, after user, after assistant. What an inserted or reroled turn leads to:
_ADDED = (2, 2, 3, 2)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = {"su", "ua", "au"}
#: Cost of ending in each state, by adding what is missing.
AT_END = (0, 2 * INSERT, INSERT, 0)
MUST_GO = 8


def row_code(role: str, fault: str) -> int:
    """A row as one byte: what the edits need to know of it."""
    if fault in ("blank", "duplicate"):
        return MUST_GO
    return "sua".find(role[:1]) % 4 * 2 + (fault == "truncated") if role else 6 + (fault == "truncated")


@lru_cache(maxsize=None)
def _choices(state: int, code: int, after: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost, edits, state after) of a row from a state, given the costs after it; the ASCII-least of the cheapest.

    The cost vectors are taken without their least value, so there are few of them and the cache stays small.
    """
    best = None
    initial, cut = "sua"[code // 2 : code // 2 + 1], code % 2 * TRUNCATED
    for added in range(3):  # no cheapest way adds three turns on end before a row
        at = state
        for _ in range(added):
            at = _ADDED[at]
        ways = [(DELETE + after[at], "D", at)]
        if code != MUST_GO:
            if at in _KEPT.get(initial, {}):
                ways.append((cut + after[_KEPT[initial][at]], "K", _KEPT[initial][at]))
            ways.append((REROLE + cut + after[_ADDED[at]], "R", _ADDED[at]))
        for cost, edit, to in ways:
            way = (cost + INSERT * added, "I" * added + edit, to)
            best = way if best is None or way < best else best
    return best


@lru_cache(maxsize=None)
def _before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Cost vector before a row from that after it, less its least value, and that value."""
    costs = [_choices(state, code, after)[0] for state in range(4)]
    low = min(costs)
    return tuple(c - low for c in costs), low


def backward(codes: bytes, after: tuple[int, ...], every: int = 0) -> tuple[tuple[int, ...], int, list[tuple[int, ...]]]:
    """(vector before the rows, cost taken off it, vectors after each ``every`` rows from the front)."""
    total, kept = 0, []
    for i in range(len(codes) - 1, -1, -1):
        if every and (i + 1) % every == 0:
            kept.append(after)
        after, low = _before(codes[i], after)
        total += low
    return after, total, kept[::-1]


def forward(codes: bytes, after: tuple[int, ...], state: int) -> Iterator[tuple[str, int]]:
    """Edits and state before of every row, recomputing the vectors between square-root checkpoints."""
    every = max(1, isqrt(len(codes)))
    marks = backward(codes, after, every)[2]
    for lo in range(0, len(codes), every):
        part = codes[lo : lo + every]
        vectors = [marks[lo // every] if lo // every < len(marks) else after]
        for code in part[:0:-1]:
            vectors.append(_before(code, vectors[-1])[0])
        for code in part:
            _, edits, to = _choices(state, code, vectors.pop())
            yield edits, state
            state = to


def edited(codes: bytes, after: tuple[int, ...], state: int, roles: list[str], texts: list[str]) -> tuple[str, list[str], int]:
    """(edits, repaired lines, state after) of a stretch of rows."""
    audit, lines = [], []
    for i, (edits, at) in enumerate(forward(codes, after, state)):
        audit.append(edits)
        for edit in edits:
            role, text = "", ""
            if edit == "D":
                continue
            if edit == "K":
                at, role, text = _KEPT[roles[i][0]][at], roles[i], texts[i]
            else:
                at = _ADDED[at]
                role, text = ("user" if at == 2 else "assistant"), (texts[i] if edit == "R" else "")
            lines.append(f"{role}:{text}")
        state = at
    return "".join(audit), lines, state


def added_at_end(state: int) -> tuple[str, list[str]]:
    """What ends a conversation left in a state."""
    roles = {1: ["user", "assistant"], 2: ["assistant"]}.get(state, [])
    return "I" * len(roles), [f"{role}:" for role in roles]


class Stretch:
    """Rows of one conversation in order, with what is counted on the way."""

    def __init__(self) -> None:
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        bare = text.rstrip(BLANK_CHARS)
        fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else ""
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None:
            self.counts["turns"] += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.codes.append(row_code(role, fault))
        self.roles.append(role)
        self.texts.append("" if self.codes[-1] == MUST_GO else text)
        self.chars += len(self.texts[-1])


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_BLOCK = "part int, block int, codes binary, roles array<string>, texts array<string>, first string, last string, first_turn long, last_turn long, turns long"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]
_STREAMED = f"{RESULT}, {_BLOCK}"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _schema(ddl))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): what a faulty store might return, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (kept with no copies, so its conversation is not lost), 1
    empties the text, 2 takes ``.!?`` out of it, 3 doubles the row, 4 makes it
    a user's. A null counts as one space, also in what is hashed.
    """
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    there = kind != 0
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(there, F.col("turn").cast("long")).alias("turn"),
        F.when(there, F.when(kind == 4, "user").otherwise(spaced("role"))).alias("role"), F.when(there, text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): its faults, and the cheapest repair.

    Rows are taken by turn (nulls first), then role, then text; ``copies`` of a
    row follow each other, and a conversation all of whose rows have none is
    empty: zeros, an empty audit and the digest of an empty text. A null
    conv_id is a conversation of its own. Role and text are not null where
    there are copies. A role that begins with none of s, u and a (or is empty)
    can't be kept.

    A row's first fault counts: blank (nothing but white space), duplicate
    (role and text seen earlier in the conversation), truncated (does not end
    in ``.!?``). Edits: K keeps at no cost, R makes the row the user's or the
    assistant's for 3, D drops it for 4 and is the only one for blank and
    duplicate rows, I adds an empty turn of user or assistant for 3; keeping a
    truncated row adds 3. ``audit`` is the ASCII-least of the cheapest edits.

    Equal rows are folded before they are shuffled. Then rows are dealt by
    ranges of (conversation, turn, role, start of the text), so a long
    conversation spreads over tasks, and streamed in order. Conversations that
    lie whole within a task and a block are solved there. All others become
    blocks of bounded size: a backward pass over the blocks' codes (a byte a
    row) leaves the cost vector after each block, its checkpoint, and a
    forward pass takes block by block with it. A task of these passes holds
    one block; the digest is a chain, so one conversation is one stream there.
    """
    folded = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    says = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), "role", "text").cast("binary"))
    has = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    named = folded.withColumn("says", F.when(F.col("copies") > 0, says))
    placed = named.where("says is not null").groupBy("says").agg(F.count(F.lit(1)).alias("places"), F.min(has).alias("first"))
    again = written(placed.where("places > 1").select("says", "first"), "said-again")  # its size tells whether to copy it; a hot text then splits the join
    flagged = named.join(again, "says", "left").select(
        "conv_id", "turn", "role", "text", "copies", (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    dealt = flagged.repartitionByRange(*order, F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    streamed = written(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_solve_or_block, _STREAMED), "turn-blocks")
    short = streamed.where("block is null").select(*_RESULT_NAMES)
    blocks = streamed.where("block is not null")
    if blocks.isEmpty():
        return short
    narrow = blocks.select("conv_id", "part", "block", "codes").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    marks = written(narrow.mapInArrow(_checkpoints, "part int, block int, low long, after array<long>"), "turn-marks")
    ready = blocks.join(marks, ["part", "block"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return short.unionByName(ready.mapInArrow(_joined_up, RESULT))


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _result(conv: int | None, s: Stretch) -> dict:
    codes = bytes(s.codes)
    start, low, _ = backward(codes, AT_END)
    audit, lines, state = edited(codes, AT_END, 0, s.roles, s.texts)
    more, last = added_at_end(state)
    return {
        "conv_id": conv, "gaps": _gaps(s.first_turn, s.last_turn, s.counts["turns"]), **{c: s.counts[c] for c in _COUNTS},
        "cost": start[0] + low, "audit": audit + more, "repaired_sha256": digest(lines + last),
    }


def _solve_or_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solve conversations that begin and end within the task and a block; turn the others into blocks."""
    part, block, conv, began, stretch, out, first = 0, 0, None, False, Stretch(), [], True

    def as_block() -> dict:
        nonlocal block, stretch
        s, stretch = stretch, Stretch()
        block += 1
        return {
            "conv_id": conv, **{c: s.counts[c] for c in _COUNTS}, "part": part, "block": block, "codes": bytes(s.codes), "roles": s.roles,
            "texts": s.texts, "first": s.first, "last": s.last, "first_turn": s.first_turn, "last_turn": s.last_turn, "turns": s.counts["turns"],
        }

    def closed(whole: bool) -> dict:
        """The stretch at the end of its conversation, or of the task's rows."""
        nonlocal stretch
        if began or not whole:
            return as_block()
        s, stretch = stretch, Stretch()
        return _result(conv, s)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen", "part")]
        for key, turn, role, text, copies, seen, at in zip(*columns):
            if first:
                part, conv, began, first = at, key, True, False  # the first conversation may have begun in another task
            elif key != conv:
                out.append(closed(True))
                conv, began = key, False
            for copy in range(copies):
                stretch.add(turn, role, text, seen or copy > 0)
                if len(stretch.codes) >= BLOCK_ROWS or stretch.chars >= BLOCK_CHARS:
                    out.append(as_block())
                    began = True
                if len(out) >= 256 or (out and out[-1].get("block")):
                    yield _batch(out, _STREAMED)
                    out = []
    if not first:
        out.append(closed(False))
    if out:
        yield _batch(out, _STREAMED)


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from last to first: the cost vector after each."""
    conv, vector, first = None, AT_END, True
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if first or row["conv_id"] != conv:
                conv, vector, first = row["conv_id"], AT_END, False
            after = vector
            vector, low, _ = backward(row["codes"], after)
            rows.append({"part": row["part"], "block": row["block"], "low": low, "after": list(after)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("low", pa.int64()), ("after", pa.list_(pa.int64()))]))


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from first to last, each repaired from the state the one before it left."""
    now: dict | None = None

    def closed() -> dict:
        more, lines = added_at_end(now["state"])
        add_lines(lines)
        return {
            "conv_id": now["conv"], "gaps": _gaps(now["first_turn"], now["last_turn"], now["turns"]), **now["counts"],
            "cost": now["cost"], "audit": "".join(now["audit"]) + more, "repaired_sha256": now["sha"].hexdigest(),
        }

    def add_lines(lines: list[str]) -> None:
        if lines:
            now["sha"].update((("\n" if now["any"] else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            now["any"] = True

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if now is None or now["conv"] != row["conv_id"]:
                if now is not None:
                    yield _batch([closed()], RESULT)
                now = {
                    "conv": row["conv_id"], "state": 0, "counts": dict.fromkeys(_COUNTS, 0), "cost": None, "audit": [], "sha": hashlib.sha256(), "any": False,
                    "last": None, "first_turn": None, "last_turn": None, "turns": 0,
                }
            after = tuple(row["after"])
            if now["cost"] is None:
                now["cost"] = backward(row["codes"], after)[0][0]
            now["cost"] += row["low"]
            for c in _COUNTS:
                now["counts"][c] += row[c]
            if now["last"] is not None and row["first"] is not None and now["last"] + row["first"] not in _LEGAL:
                now["counts"]["illegal"] += 1
            now["last"] = row["last"] if row["last"] is not None else now["last"]
            if row["first_turn"] is not None:
                now["turns"] += row["turns"] - (row["first_turn"] == now["last_turn"])
                now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = row["last_turn"]
            audit, lines, now["state"] = edited(row["codes"], after, now["state"], row["roles"], row["texts"])
            now["audit"].append(audit)
            add_lines(lines)
    if now is not None:
        yield _batch([closed()], RESULT)
