"""Repeated windows against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from geoledger.llm import column_bwt, queries

from ..conftest import SF


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by counting every window."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[a : a + length] for _, b in data for a in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - length + 1):
            if count[b[a : a + length]] > 1:
                gone[a : a + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def texts(rng):
    say = lambda n: "".join(rng.choice("abc ñ") for _ in range(n))
    shared = [say(n) for n in (39, 40, 41, 90, 150)]
    rows = [(i, say(rng.randint(0, 120)) + rng.choice(shared) + say(rng.randint(0, 5)) + rng.choice(shared) + say(rng.randint(0, 80))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x"), (103, "a" * 500), (104, "ab" * 200), (105, rows[0][1]), (0, rows[0][1]), (None, shared[4])]
    return rows


def test_small_windows(spark):
    rows = texts(random.Random(1))
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, copies int")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in column_bwt.remove_repeats(docs, 40).collect()]
    assert sorted(got, key=repr) == plain(rows, 40)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(column_bwt, "CROWD", 3)
    rows = texts(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in column_bwt.remove_repeats(docs, 40).collect()]
    assert sorted(got, key=repr) == plain(rows, 40)


def test_empty_table(spark):
    assert column_bwt.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op7_column_bwt"](spark, SF).collect()]
    wanted = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in plain(rows, 400)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and any(r[2] for r in got)


def test_repeats_are_dropped_as_they_come(monkeypatch):
    """A collection holds the distinct pieces of an anchor, however many rows they come in."""
    held, concat = [], pd.concat
    monkeypatch.setattr(column_bwt.pd, "concat", lambda parts: held.append(sum(map(len, parts))) or concat(parts))
    pieces = [bytes([97 + i]) * 3 + b"same bytes" for i in range(3)]
    rows = pd.DataFrame([(1, p, 5, pieces[p]) for p in range(3) for _ in range(500)], columns=["key", "piece_key", "anchor", "piece"])
    found = concat(list(column_bwt.collections((rows.iloc[i : i + 7] for i in range(0, len(rows), 7)), 8)))
    assert held == [3]
    assert [(k, p, list(a), list(b)) for k, p, a, b in found.itertuples(index=False)] == [(1, p, [3], [5]) for p in range(3)]


def test_busy_anchors_are_dealt_by_piece(spark, monkeypatch):
    """Few kinds of pieces in more rows than CROWD: the result is that of all windows, and the repeats are dropped before the deal by key."""
    monkeypatch.setattr(column_bwt, "CROWD", 3)
    dropped, once = [], type(spark.range(0)).dropDuplicates
    monkeypatch.setattr(type(spark.range(0)), "dropDuplicates", lambda self, *a: dropped.append(self.columns) or once(self, *a))
    rng = random.Random(8)
    same = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, f"{'xy'[i % 2] * 30}{same}{'uv'[i % 2] * 30}") for i in range(40)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in column_bwt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()]
    assert sorted(got, key=repr) == plain(rows, 40) and any("busy" in c for c in dropped)


def test_equal_rows_are_searched_once(spark):
    """Thousands of equal rows cost one search, and the spans reach all of them; rows of one id with other texts stay apart."""
    rng = random.Random(11)
    base = "".join(rng.choice("abcdef ") for _ in range(4000))
    rows = [(1, base)] * 3000 + [(1, base[:1000] + "zz"), (2, base[2000:2600]), (3, "alone" * 3), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    source = docs.selectExpr("doc_id", "coalesce(text, '') as text").withColumn("row_key", column_bwt.F.xxhash64("doc_id", "text"))
    folded = column_bwt._folded(source).collect()
    assert len(folded) == 5 and sum(r["copies"] for r in folded) == len(rows)
    entries = column_bwt.repeated_spans(column_bwt._folded(source)).collect()
    assert max(len(r["first"]) for r in entries) < 100
    got = sorted(map(tuple, column_bwt.remove_repeats(docs).collect()), key=repr)
    distinct = plain([(1, base), (1, base), *rows[3000:]], 400)
    assert sorted(set(got), key=repr) == sorted(set(distinct), key=repr) and len(got) == len(rows)
