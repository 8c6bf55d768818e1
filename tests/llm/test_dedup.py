"""Decontamination, substring dedup and the similarity join against plain versions."""

import pytest
from pyspark.sql import functions as F

from curate.llm import decontam, jaccard, substring
from tests.llm import brute
from tests.llm.conftest import LONG


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_contamination_with_short_items_and_odd_rows(spark, odd_docs):
    items = [(1, "QUICK brown fox jumps, over the lazy dog while seven wizards quietly box"), (2, "few words"), (3, None), (4, "..."), (None, "liquid gold"), (2, "few words"), (5, "w1x0 w2x0 w3x0")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["_id"], r["_th"]): (r["n_words"], r["n_hit"], set(r["items"])) for r in decontam.contamination(odd_docs, table).collect()}
    rows = odd_docs.select("doc_id", F.xxhash64("text"), "text").collect()
    want = brute.contamination([r[2] for r in rows], items)
    assert got == {(r[0], r[1]): w for r, w in zip(rows, want, strict=True)}
    clean = decontam.decontaminate(odd_docs, table)
    assert clean.columns == odd_docs.columns
    assert clean.count() == sum(w[1] == 0 for w in want)


def test_contamination_of_the_small_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute.contamination([r[1] for r in rows], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = {r["_id"]: (r["n_words"], r["n_hit"], set(r["items"])) for r in decontam.contamination(docs, items).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}
    assert any(w[1] for w in want)


def test_empty_tables(spark, no_docs, odd_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.decontaminate(odd_docs, items).count() == odd_docs.count()
    assert substring.substring_dedup(no_docs).count() == 0 and substring.without_repeats(no_docs).count() == 0
    assert jaccard.similarity_join(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0


def test_substring_of_odd_rows(odd_docs):
    for size in (3, 7, 16, 35):
        rows = odd_docs.select("doc_id", "text").collect()
        want = sorted(((r[0], n, gone, brute.sha(kept)) for r, (n, gone, kept) in zip(rows, brute.substring([r[1] for r in rows], size), strict=True)), key=repr)
        assert sorted(collected(substring.digests(odd_docs, size)), key=repr) == want


def test_substring_rewrites_only_repeats(odd_docs):
    out = substring.without_repeats(odd_docs, 12, length_col="n_chars")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id in (3, 4, 7)").collect()}
    assert texts == {3: "", 4: LONG, 7: "few words"}
    again = out.where("doc_id = 1").collect()
    assert sorted(r["text"] for r in again) == ["", "", "again"] and sorted(r["n_chars"] for r in again) == [0, 0, 5]


def test_rewriting_joins_places_and_no_texts(odd_docs):
    plan = substring.without_repeats(odd_docs, 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(_text" not in plan and plan.count("Join") == 1


def test_levels_double():
    assert substring.levels(35) == [18, 35] and substring.levels(64) == [16, 32, 64] and substring.levels(5) == [5]
    for size in range(2, 200):
        steps = substring.levels(size)
        assert steps[-1] == size and all(b <= 2 * a for a, b in zip(steps, steps[1:], strict=False))


def test_similarity_of_odd_rows(odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = brute.similar([r[1] for r in rows])
    got = jaccard.similarity_join(odd_docs).collect()
    assert sorted((r["_id"] is None, r["_id"], r["n_links"], r["group"] is None) for r in got if r["_id"] is not None) == sorted(
        (False, r[0], w[0], w[1] is None) for r, w in zip(rows, want, strict=True) if r[0] is not None
    )
    assert len({r["group"] for r in got if r["group"]}) == len({w[1] for w in want if w[1] is not None})


def test_one_of_each_keeps_one_and_all_columns(odd_docs):
    out = jaccard.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    rows = odd_docs.select("text").collect()
    groups = [g for _, g in brute.similar([r[0] for r in rows])]
    assert out.count() == len({g for g in groups if g is not None}) + sum(g is None for g in groups)


def test_similarity_of_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)
    base = [f"word{i}" for i in range(60)]
    texts = []
    for k in range(40):  # near copies: one word replaced, some beyond the similarity
        w = list(base)
        for p in [(k * 3 + 11 * s) % 60 for s in range(k % 4)]:
            w[p] = f"new{k}_{p}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.similar(texts)
    got = {r["_id"]: (r["n_links"], r["group"]) for r in jaccard.similarity_join(docs).collect()}
    assert [got[i][0] for i in range(40)] == [w[0] for w in want]
    assert len({g for _, g in got.values()}) == len({g for _, g in want})


@pytest.mark.parametrize("apart", [True, False])
def test_groups_dealt_out_by_blocks_or_buckets_have_the_same_links(spark, monkeypatch, apart):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 4)
    ways = jaccard._ways
    monkeypatch.setattr(jaccard, "_ways", lambda candidates: ways(candidates).withColumn("apart", F.lit(apart)))
    texts = []
    for k in range(60):  # a chain of overlapping texts, some of them near copies of their neighbours' neighbours
        w = [f"w{i}" for i in range(5 * (k // 2), 5 * (k // 2) + 60)]
        w[(k * 7) % 60] = f"new{k}" if k % 3 else w[(k * 7) % 60]
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    want = brute.similar(texts + texts[:5])
    got = {r["_id"]: (r["n_links"], r["group"]) for r in jaccard.similarity_join(docs).collect()}
    assert [got[i][0] for i in range(65)] == [w[0] for w in want]
    pairs = {(got[i][1], want[i][1]) for i in range(65)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def _candidates(spark, bands):
    rows = [(b"%06d" % i, b"root", 1, list(b), b"12345678" * 50) for i, b in enumerate(bands)]
    return spark.createDataFrame(rows, "class binary, root binary, copies long, bands array<long>, grams binary")


def test_rows_to_compare_grow_with_a_chain_and_not_with_its_square(spark):
    """Each text meets its neighbours only, in one bucket each."""
    for n in (1000, 4000):
        chain = [(10 * ((i + 1) // 2) + 1, 10 * (i // 2) + 2, -i - 1) for i in range(n)]
        rows = jaccard._blocks(_candidates(spark, chain))
        assert n - 2 <= rows.where("at >= 0").count() <= 2 * n and rows.where("at < 0").count() == 0


def test_a_dense_group_goes_block_against_block(spark):
    rows = jaccard._blocks(_candidates(spark, [(1, 2, 3)] * 1000))
    assert rows.where("at >= 0").count() == 0 and rows.count() == 4 * 1000


def test_similarity_of_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute.similar([r[1] for r in rows])
    got = {r["_id"]: (r["n_links"], r["group"]) for r in jaccard.similarity_join(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {r[0]: w[0] for r, w in zip(rows, want, strict=True)}
    pairs = {(got[r[0]][1], w[1]) for r, w in zip(rows, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_recall_of_the_bands():
    n = jaccard.bands()
    assert 1 - (1 - jaccard.SIMILARITY**jaccard.ROWS) ** n >= jaccard.RECALL > 1 - (1 - jaccard.SIMILARITY**jaccard.ROWS) ** (n - 1)


def test_components_of_a_long_path(spark):
    from curate.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
