"""Chat formatting: every turn reads back, whatever it says."""

from __future__ import annotations

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoledger.llm import chat_format as C

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/TEXT]", "[\\INST]", "<\\\\/s>", "<", "[", "\\", " ", "\n", "ok", "é", "🙂", "s>", "/INST]"]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT] x", "</s>"]), st.lists(st.sampled_from(PIECES), max_size=12))
def test_turn_reads_back(role, pieces):
    text = "".join(pieces)
    rendered, start, length, rounds = C.DEFAULT.settled(role, text)
    assert [t[:2] for t in C.DEFAULT.parse(rendered)] == [(role, text)]
    assert C.DEFAULT.unescape(rendered[start : start + length]) == text
    assert (rounds == 0) == (rendered == C.DEFAULT.render(role, text)[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=5))
def test_conversation_reads_back(turns):
    whole = "".join(C.DEFAULT.settled(r, t)[0] for r, t in turns)
    assert [t[:2] for t in C.DEFAULT.parse(whole)] == turns


def test_parser_refuses_other_text():
    for text in ("x", "[INST] a", "[INST] a </s>", " [INST] a [/INST]", "[INST] a [/INST] ", "[INST] a [INST] b [/INST]", "[ROLE] a [/TEXT]"):
        assert C.DEFAULT.parse(text) is None
    assert C.DEFAULT.parse("") == []


def test_tables(spark):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([None, "", "</s>[INST] ok [/INST]", "plain", "x" * 20_000])) for i in range(20) for t in range(rng.randint(1, 6))]
    rows += [rows[0], (None, 1, "assistant", "y"), (None, None, "user", "z"), (99, None, "user", "first"), (99, 0, "assistant", "second")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in C.conversation_digests(df).collect()}
    low = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=lambda r: tuple(map(low, r[1:])))]
        said = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(C.DEFAULT.settled(a, b)[0]) for a, b in turns)
    assert len(got) == len({r[0] for r in rows})
    assert C.format_turns(df).where(F.col("rendered") == "clash").count() == 0
    assert C.conversation_digests(df.limit(0)).collect() == []
