"""The pipeline: each stage against a plain version of it, on its own input."""

from __future__ import annotations

import itertools

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from geoledger.llm import importance, surrogates

from ..conftest import SF
from .test_spaced_seeds import plain_pairs


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns == list(P.COLUMNS)


def test_quality(spark, steps):
    before, after = steps[0]
    kept = {r.doc_id for r in importance.resample(before, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert set(rows(after)) == kept
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i in kept for i, q in quality.items() if q == 1]
    assert sum(good) >= 0.95 * len(good)


def test_near_dedup(steps):
    before, after = map(rows, steps[1])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() for w in [t.lower().split()]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    wanted = {i for i in sets if find(i) == i}
    assert set(after) == wanted


def test_decontamination(spark, steps):
    before, after = map(rows, steps[2])
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert set(after) == set(before) - {d for d, _ in plain_pairs(before, items)}


def test_pii(steps):
    before, after = map(rows, steps[3])
    assert set(before) == set(after)
    real = {(k, e) for t in before.values() for _, _, k, e in surrogates.detect(t)}
    assert real and not real & {(k, e) for t in after.values() for _, _, k, e in surrogates.detect(t)}
    assert all(after[i] == t for i, t in before.items() if not surrogates.detect(t))
    assert all(r.n_chars == len(r.text) for r in steps[3][1].collect())


def test_tokens(steps):
    before, after = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in after.collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows(before).items()}


def test_odd_rows_pass_all_stages(spark):
    texts = [None, "", " ", "a", "x " * 40_000, "same words here again and again", "same words here again and again"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(1, "", "en", "s", 0), (None, "same words here again and again", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    deduped = sorted((r.doc_id is None, r.doc_id) for r in P.near_dedup(spark, docs, SF).collect())
    assert deduped == [(False, 0), (False, 3), (False, 4), (False, 5)]
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name != "SimHash near-dedup":
            assert stage(spark, docs, SF).count() == docs.count() or name == "quality classifier"
