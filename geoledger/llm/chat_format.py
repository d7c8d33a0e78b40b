"""Chat formatting whose output reads back exactly.

A turn is an opening mark, its text and a closing mark. The grammar is
deterministic: at a turn's start stands one opening mark, and the first mark
after it must be its closing one. Texts that hold marks of their own would be
read wrongly, so every rendered turn is parsed again and compared; whatever
the parser took for a mark or an escape is escaped, until the turn read back
equals the source. An escape is one backslash after a mark's first character,
and a text's own backslashes there are raised by one, so it can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role; any other role name is itself a field between ``[ROLE]`` and ``[TEXT]``."""

    marks: tuple[tuple[str, str, str], ...] = (
        ("system", "[SYS] ", " [/SYS]"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>"),
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/TEXT]")
    loss_role: str = "assistant"

    @cached_property
    def by_role(self) -> dict[str, tuple[str, str]]:
        return {role: (a, b) for role, a, b in self.marks}

    @cached_property
    def opening(self) -> dict[str, str]:
        return {a.strip(): role for role, a, _ in self.marks}

    @cached_property
    def pattern(self) -> re.Pattern[str]:
        """A mark, or a mark with backslashes after its first character."""
        names = {m.strip() for _, a, b in self.marks for m in (a, b)} | {m.strip() for m in self.other}
        heads = "".join(sorted({re.escape(n[0]) for n in names}))
        return re.compile(f"([{heads}])(\\\\*)({'|'.join(sorted(map(re.escape, {n[1:] for n in names}), key=len, reverse=True))})")

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)

    def unescape(self, text: str) -> str:
        return self.pattern.sub(lambda m: f"{m[1]}{m[2][1:]}{m[3]}", text)

    def render(self, role: str, text: str) -> tuple[str, int]:
        """The turn, and where its text begins in it."""
        if role in self.by_role:
            a, b = self.by_role[role]
            return f"{a}{text}{b}", len(a)
        a, middle, b = self.other
        return f"{a}{role}{middle}{text}{b}", len(a) + len(role) + len(middle)

    def parse(self, rendered: str) -> list[tuple[str, str, int, int]] | None:
        """Turns (role, text, start, end of the text in the input), or None if it is not of the grammar."""
        turns, at = [], 0
        marks = [m for m in self.pattern.finditer(rendered) if not m[2]]
        k = 0

        def field(mark: str) -> tuple[str, int, int] | None:
            """Text up to the next mark, which must be ``mark``."""
            nonlocal k, at
            if k >= len(marks) or marks[k][0] != mark.strip():
                return None
            start, end = at, marks[k].start() - (len(mark) - len(mark.lstrip()))
            if end < start:
                return None
            at = marks[k].end() + len(mark) - len(mark.rstrip())
            k += 1
            return self.unescape(rendered[start:end]), start, end

        while at < len(rendered):
            if k >= len(marks) or marks[k].start() != at:
                return None
            opened = marks[k][0]
            if opened in self.opening:
                role = self.opening[opened]
                opening, closing = self.by_role[role]
            elif opened == self.other[0].strip():
                opening, closing, role = self.other[0], self.other[2], None
            else:
                return None
            if not rendered.startswith(opening, at):
                return None
            at, k = at + len(opening), k + 1
            if role is None:
                named = field(self.other[1])
                if named is None:
                    return None
                role = named[0]
            found = field(closing)
            if found is None:
                return None
            turns.append((role, *found))
        return turns

    def settled(self, role: str, text: str) -> tuple[str, int, int, int]:
        """Rendered turn that reads back as (role, text): turn, text start, text length, rounds of escaping."""
        name, body, rounds = role, text, 0
        while True:
            rendered, start = self.render(name, body)
            got = self.parse(rendered)
            if got is not None and len(got) == 1 and got[0][:2] == (role, text):
                return rendered, start, len(body), rounds
            if rounds == 2:
                raise ValueError("a turn can't be made to read back; the marks of the template overlap")
            body = self.escape(text)
            name = role if role in self.by_role else self.escape(role)
            rounds += 1


DEFAULT = ChatTemplate()
RENDERED = T.StructType([
    T.StructField("rendered", T.StringType()), T.StructField("text_start", T.IntegerType()),
    T.StructField("text_length", T.IntegerType()), T.StructField("escape_rounds", T.IntegerType()),
])


def format_turns(turns: DataFrame, role: str = "role", text: str = "text", template: ChatTemplate = DEFAULT) -> DataFrame:
    """Every row with its rendered turn; rows of a conversation, in order, make up its formatted text.

    Adds ``rendered``, ``text_start`` and ``text_length`` (code points, where
    the escaped text lies in it) and ``escape_rounds``; columns of these names
    are replaced, all others pass through. A null role or text counts as empty.
    Works row by row: no shuffle, and no group is ever held.
    """

    @F.pandas_udf(RENDERED)
    def settle(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [template.settled(r or "", t or "") for r, t in zip(roles, texts)],
            columns=RENDERED.fieldNames(),
        )

    made = turns.withColumn("_turn", settle(F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    return made.withColumns({c: F.col(f"_turn.{c}") for c in RENDERED.fieldNames()}).drop("_turn")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long"


def read_back(formatted: DataFrame, order: list[Column], template: ChatTemplate = DEFAULT) -> DataFrame:
    """Parse the rendered text of every conversation again and digest what it says.

    One row per ``conv_id`` (null is a conversation of its own). Rows are dealt
    by conversation, sorted by ``order`` on disk if need be, and streamed: a
    task keeps two running digests and one turn, so the length of a
    conversation costs no memory. The digest of one conversation is a chain and
    can't be split further; rendering and escaping, the costly part, were done
    before and row by row. ``loss_*`` describe the text under the loss mask,
    unescaped: what the loss role says, in order.
    """
    rows = formatted.select("conv_id", "rendered", "escape_rounds", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *keys).select("conv_id", "rendered", "escape_rounds")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def closed() -> tuple:
            return (None if pd.isna(current) else int(current), state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])

        for batch in batches:
            out = []
            for conv, rendered, rounds in zip(batch["conv_id"].tolist(), batch["rendered"], batch["escape_rounds"].tolist()):
                if state is None or not (conv == current or (pd.isna(conv) and pd.isna(current))):
                    if state is not None:
                        out.append(closed())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text, _, _ in template.parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == template.loss_role:
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
                state[5] += rounds > 0
            yield _read_frame(out)
        if state is not None:
            yield _read_frame([closed()])

    return dealt.mapInPandas(stream, READ)


def _read_frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in READ.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if not c.endswith("sha256")})


def conversation_digests(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Format conversations (conv_id, turn, role, text) and read them back; turns in order of turn, role, text."""
    formatted = format_turns(conversations.select("conv_id", "turn", "role", "text"), template=template)
    return read_back(formatted, [F.col("turn"), F.col("role"), F.col("text")], template)
