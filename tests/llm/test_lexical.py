"""Ranked search against a plain loop over all documents: ties, repeats, nulls, long texts, blocks of items."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.llm import lexical, words

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """(item id, rank, doc id, score) by the definition."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [x for x in counted if x[2]]
    total = sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    weight = {w: math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for i, c, n in counted:
            m = 25 + 75 * n * len(counted) // total
            score = sum(q * weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def ranked(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_rid", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1)).withColumn("rank", F.lit(1))
    got = [tuple(r) for r in lexical.rank(d.repartition(3), i, **more).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(got, key=key), sorted(plain(docs, items, more.get("k", 10)), key=key)


def corpus(n=300, seed=3):
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "日本", "averylongwordindeed", "averylongwordinside"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    share /= share.sum()
    text = lambda size: " ".join(draw.choice(vocabulary, size, p=share))
    docs = [(i, text(int(draw.integers(1, 120)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;"), (None, docs[5][1]), (7, docs[7][1]), (7, docs[8][1].upper())]
    docs += [(n + 10 + i, docs[3][1]) for i in range(40)]
    items = [(i, text(int(draw.integers(1, 60)))) for i in range(12)] + [(2, text(5)), (20, None), (21, "nowhere"), (None, text(8)), (22, docs[3][1]), (23, "w0 W0 w0 w1")]
    return docs, items


def test_ranks_equal_a_plain_loop(spark):
    got, want = ranked(spark, *corpus())
    assert got == want


def test_blocks_of_items_change_nothing(spark):
    docs, items = corpus(60)
    got, want = ranked(spark, docs, items, block_terms=40)
    assert got == want


def test_other_k(spark):
    docs, items = corpus(80, 5)
    got, want = ranked(spark, docs, items[:5], k=3)
    assert got == want


def test_empty_tables(spark):
    docs, items = corpus(10)
    for d, i in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, None)])):
        got, want = ranked(spark, d, i)
        assert got == want == []


def test_odd_documents(spark, odd_docs):
    items = [(1, "quick BROWN fox"), (2, "w3x1 w5x2 few"), (3, "日本語 é")]
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(lexical.rank(odd_docs, table).collect(), key=str)
    assert sorted((tuple(r) for r in got), key=str) == sorted(plain(docs, items), key=str)


@pytest.mark.parametrize("limit", [5, 64, 1000])
def test_pieces_of_long_texts_hold_all_words(limit):
    raw = [("Some WORDS of a text, é日本 and " * 20).encode(), b"", b"x" * 300, b"short one"]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    whole = words.Words(data, offsets, words.FOLDED, True)
    want = [sorted(whole.hashes()[whole.first[i] : whole.first[i + 1]].tolist()) for i in range(len(raw))]
    got = [[] for _ in raw]
    for lo, part in words.pieces(data, offsets, words.FOLDED, True, limit):
        for of, h in zip(part.text_of() + lo, part.hashes().tolist(), strict=True):
            got[of].append(h)
    assert [sorted(x) for x in got] == want


def test_common_words_make_no_accumulators(spark, monkeypatch):
    """Once rare words decide, documents that hold only common ones get no accumulator."""
    docs = [(i, "common words all over the place again") for i in range(500)] + [(1000 + i, "rare gem common words") for i in range(12)]
    made = []
    real = lexical.stage

    def watch(df, name="stage"):
        out = real(df, name)
        if name == "accumulators":
            made.append(out.count())
        return out

    monkeypatch.setattr(lexical, "stage", watch)
    got, want = ranked(spark, docs, [(1, "common words all over the place rare gem")])
    assert got == want and max(made) == 12
