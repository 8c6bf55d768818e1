"""Toxicity: n-grams, counts and ratios against plain Python, the fit against its optimum, held-out accuracy, odd rows."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curate.llm import toxicity
from curate.llm.queries import QUERIES

TEXTS = ["You are a CLOWN", "", None, "élan ÀÉÏ straße 日本語のテキスト 🙂 end", "a", "tab\tand\nline", "clown " * 30, "You are a CLOWN"]


def plain_places(text):
    """The places of a text's n-grams, one at a time."""
    folded = [" " if c.isspace() else c.lower() if len(c.lower()) == 1 and ord(c) < 0x800 else c for c in text or ""]
    chars = " " + "".join(folded) + " "
    out = set()
    with np.errstate(over="ignore"):
        single = [toxicity.mix(np.array([(int.from_bytes(c.encode(), "big") + 1)], np.uint64) * toxicity._STEP) for c in chars]
        for i in range(len(chars)):
            h = single[i]
            for k in range(2, toxicity.MOST + 1):
                if i + k > len(chars):
                    break
                h = toxicity.mix(h * toxicity._STEP + single[i + k - 1])
                if k >= toxicity.LEAST:
                    out.add(int(h[0] >> np.uint64(64 - toxicity.BITS)))
    return out


def places_of(texts):
    found = [set() for _ in texts]
    for _, of, place in toxicity.ngrams(pa.array(texts, pa.string())):
        for t, p in zip(of.tolist(), place.tolist(), strict=True):
            found[t].add(p)
    return found


def test_ngrams_equal_a_plain_loop():
    assert places_of(TEXTS) == [plain_places(t) for t in TEXTS]


def test_long_texts_are_seen_whole(monkeypatch):
    text = "Ünä 日本 🙂 wörds and mörds, " * 40
    want = places_of([text, "short", text + "x"])
    for size in (16, 61, 100):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert places_of([text, "short", text + "x"]) == want


def test_counts_and_ratios_equal_a_plain_count():
    label = [1, 0, 0, 1, 0, 0, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(TEXTS, pa.string())], names=["_label", "_text"])
    got = next(toxicity._counts(iter([batch.slice(0, 3), batch.slice(3)]))).to_pydict()
    want = {1: Counter(), 0: Counter()}
    for y, t in zip(label, TEXTS, strict=True):
        want[y].update(plain_places(t))
    table = {p: (a, b) for p, a, b in zip(got["place"], got["toxic"], got["other"], strict=True)}
    assert table.pop(-1) == (3, 5)
    assert table == {p: (want[1][p], want[0][p]) for p in want[1].keys() | want[0].keys()}
    r = toxicity.ratios(np.array([3, 0]), np.array([1, 4]), 3, 5)
    assert np.allclose(r, [math.log((4 / 5) / (2 / 7)), math.log((1 / 5) / (5 / 7))])


def test_fit_reaches_the_optimum():
    draw = np.random.default_rng(1)
    x = draw.random((300, 12)) < 0.3
    y = (x[:, 0] | (draw.random(300) < 0.1)).astype(float)
    ratio = draw.normal(size=12)
    of, s = np.nonzero(x)
    base, weight = toxicity.fit(of, s, y, ratio)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    g = (1 / (1 + np.exp(-(x @ weight + base))) - y) * share
    # The gradient of the loss and its penalty is zero there.
    slope = ratio * (x.T @ g) + toxicity.PENALTY * weight / ratio
    assert np.abs(slope).max() < 1e-3 and abs(g.sum()) < 1e-3


def test_held_out_accuracy(spark, sf):
    sf = os.path.join(os.path.dirname(sf), "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = QUERIES["op12_toxicity"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    known = got.merge(labels, on="doc_id")
    test = known[known.held_out]
    assert (test[test.toxic == 0].predicted == 0).all() and (test.predicted == test.toxic).mean() >= 0.94


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_labels_do_not_matter(tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.base == b.base and (a.weight == b.weight).all() and (a.slot == b.slot).all()


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (3, 0), (None, 1), (4, None), (6, 0), (7, 5), (99, 1), (2, 0)], "doc_id long, toxic int"
    ).withColumn("text", F.lit("clash"))
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["_id"] in (2, 3)}
    assert len({round(x, 12) for x in empty}) == 1 + (plain_places("") != set())
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.train(odd_docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.train(no_docs, labels)).collect()} == {0.5}


def test_learning_rows_are_bounded(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (6, 0)], "doc_id long, toxic int")
    args = ("doc_id", "text", "toxic")
    free = [r for r in (1, 4, 6) if zlib.crc32(str(r).encode()) % 3 != 1]
    assert toxicity.learning_rows(odd_docs, labels, *args, 100).count() == sum(2 if i == 1 else 1 for i in free)
    assert toxicity.learning_rows(odd_docs, labels, *args, 2).count() <= 2
