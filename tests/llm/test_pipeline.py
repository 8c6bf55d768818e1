"""The pipeline stage by stage, each against a plain version on the same input."""

import corpus_pipeline
from curate.llm import quality
from pyspark.sql import functions as F
from tests.llm import brute


def test_stages_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]

    good = steps["quality"](spark, docs, sf).cache()
    scores = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert good.columns == docs.columns and good.count() == scores.where("score >= 0.3").count()

    single = steps["near_duplicates"](spark, good, sf).cache()
    rows = good.collect()
    groups = [g for _, g in brute.similar([r["text"] for r in rows])]
    assert single.columns == docs.columns and single.count() == len({g for g in groups if g is not None}) + sum(g is None for g in groups)
    by_id = {r["doc_id"]: g for r, g in zip(rows, groups, strict=True)}
    kept = [by_id[r["doc_id"]] for r in single.collect()]
    assert len({g for g in kept if g is not None}) == sum(g is not None for g in kept)

    cut = steps["substrings"](spark, single, sf).cache()
    rows = single.collect()
    want = {r["doc_id"]: kept if gone else r["text"] for r, (_, gone, kept) in zip(rows, brute.substring([r["text"] for r in rows]), strict=True)}
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == want
    assert cut.where(F.length("text") != F.col("n_chars")).count() == single.where(F.length("text") != F.col("n_chars")).count()

    clean = steps["decontamination"](spark, cut, sf).cache()
    rows = cut.collect()
    want = {r["doc_id"] for r, (_, hit, _) in zip(rows, brute.contamination([r["text"] for r in rows], items), strict=True) if not hit}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want

    packed = steps["packing"](spark, clean, sf).toPandas()
    assert set(packed.doc_id) == want and (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, docs, sf).columns == docs.columns
            assert step(spark, docs, sf).count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
