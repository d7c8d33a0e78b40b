"""Chunked encoding against the library on whole texts."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoledger.llm import chunk_bpe, queries

from ..conftest import SF

ODD = [
    None, "", " ", "\n\t ", "a", "don't we'll", "<|endoftext|> x <|startoftext|>y", "İstanbul ΣΑΣ ß ﬁ", "é ́x  y", "x" * 5000,
    "１２３ 漢字 かな 🙂🙂 \x1c\x1d a\x85b\xa0c d", "a  b   c\r\n\r\nd" * 300, "It's <b> 3.14%%% $$$ ### wörld" * 50, "A" * 40 + " " + "A" * 40,
]


def library(name: str):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_library(spark, name):
    rng = random.Random(3)
    words = ["the", "of", "ñandú", "don't", "x1", "###", "  ", "\n"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(texts + texts[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in chunk_bpe.encode_and_decode(docs, public_tokenizers.path(name), mask=3, most_shared=50).collect()}
    tokenizer = library(name)
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, (i, text and text[:60])
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_bpe.encode_and_decode(docs, queries.vocabulary()).collect() == []


def test_query_on_whole_table(spark):
    tokenizer = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_chunk_bpe"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_join_needs_agreement_of_a_wider_window():
    """A token over the joint that only shows with two words on the left: the narrow window begins and ends like its parts."""
    encoder = object.__new__(chunk_bpe.Encoder)
    encoder.drops_space = False

    def plain(texts):
        return [[9 if w == "BCD" else ord(w) for w in t.replace("b c d", "BCD").split()] for t in texts]

    encoder.plain = plain
    left, right = "x y a b c", " d e f g"
    assert encoder.join([left, right], plain([left, right])) == plain([left + right])[0]
