"""Quality classifier and page labeller: held-out accuracy and defined results for odd rows."""

import os
import zlib

import numpy as np
import pytest

from curate.llm import html, quality
from curate.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return quality.train(*tables)


def test_held_out_accuracy(spark, sf):
    sf = os.path.join(os.path.dirname(sf), "sf0.01")  # the smallest table holds 19 held-out labels
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = QUERIES["op5_quality_classifier"](spark, sf).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    known = got.merge(labels, on="doc_id")
    test = known[known.held_out]
    assert len(test) > 50 and (test.predicted == test.quality).mean() >= 0.95
    assert (test[test.quality == 1].predicted == 1).mean() >= 0.95


def test_held_out_labels_do_not_matter(tables, model):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, turned)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_scores_of_odd_rows(odd_docs, no_docs, model):
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["score"] >= 0.3 for r in rows)
    assert quality.score(no_docs, model).count() == 0 and quality.accepted(no_docs, model).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["a b a b", "", "One line.\nOne line.\n", "x" * 50, "é è 12 $$ a"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    together = quality.features(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for k, x in enumerate(raw):
        assert np.allclose(quality.features(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0], together[k])
    names = {n: i for i, n in enumerate(quality.FEATURES)}
    assert together[0, names["distinct"]] == 0.5 and together[2, names["repeat_line"]] == 0.5 and together[1].sum() == 0


def test_no_labels(tables, odd_docs):
    docs, labels = tables
    prior = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(odd_docs, prior).collect()} == {0.5}


def test_pairs_are_learnt():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


@pytest.fixture(scope="module")
def net(spark, sf):
    return html.learn(spark.read.parquet(f"{sf}/pages.parquet"))


def test_pages_of_the_small_table(spark, sf, net):
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, net).collect()}
    right = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h[1-6]|ul|ol|li|pre|blockquote|table|tr|td)\b[^>]*>", inner))
        want = "\n\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)
        right += got[r["page_id"]] == want
    assert right >= 0.99 * len(got)


def test_another_template(net):
    page = """<html><body><header><p>My site</p></header><div class="cookie-notice">We use cookies.</div><div id="sidebar"><ul><li><a href=x>One</a></li></ul></div>
    <main><h1>The title</h1><p>A first <i>paragraph</i>, with
      words.</p><script>var a = "<p>no</p>";</script><p>Second &amp; last &lt;one&gt;. It ends here.</p></main>
    <section class="comments"><p>Nice article, thanks.</p></section><aside>Related</aside><footer>&copy; x</footer></body></html>"""
    assert html.main_texts(net, [page]) == ["The title\n\nA first paragraph, with words.\n\nSecond & last <one>. It ends here."]


def test_main_text_in_tables_headings_and_lists(net):
    page = """<html><body><header><h2>Site</h2><nav><a href=/a>Home</a></nav></header><div class="post-body"><h1>A title of words</h1><p>First of all, the words of a paragraph. More of them follow.</p>
    <h2>Between</h2><table><tr><td>one cell</td><td>two</td></tr></table><ul><li>an entry of the list</li></ul><pre>plain   words</pre><p>And, at the end, more words of it.</p></div>
    <aside><p>Read on elsewhere, please.</p></aside><footer>&copy; x</footer></body></html>"""
    want = ["A title of words", "First of all, the words of a paragraph. More of them follow.", "Between", "one cell", "two", "an entry of the list", "plain words", "And, at the end, more words of it."]
    assert html.main_texts(net, [page]) == ["\n\n".join(want)]


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("a < b <p>c<!-- x --> d<br>e<p>f &am") == ["a < b", "c d e", "f &am"]
    assert texts("<p>one</p><script>two") == ["one"] and texts("x <di") == ["x"] and texts("") == []
    assert texts("<ul><li>a<li>b</ul>c") == ["a", "b", "c"]


def test_an_open_head_ends_where_the_body_begins(net):
    texts = lambda page: [b.text for b in html.blocks(page)]
    rest = "<article><h1>The title</h1><p>First of all, the words of a paragraph. More of them follow.</p></article><footer>&copy; x</footer>"
    want = ["The title", "First of all, the words of a paragraph. More of them follow.", "© x"]
    for head in ("<title>t</title><meta charset=utf-8><link rel=x>", "<style>p {}</style>\n<script>var a = '<p>'</script>\n", ""):
        for end in ("</head><body>", "<body>", ""):
            page = f"<!doctype html><html><head>{head}{end}{rest}"
            assert texts(page) == want
            assert all(tag != "head" for b in html.blocks(page) for tag, _ in b.path)
            assert html.main_texts(net, [page]) == ["\n\n".join(want[:2])]
    assert texts("<head><title>t</title>plain <b>words</b><p>p") == ["plain words", "p"]
    assert texts("<head><meta><noframes>no</noframes></head><br>x") == ["x"] and texts("<head><img src=x>y") == ["y"]


def test_all_words_of_a_class_count(net):
    for word in ("comments", "advert", "cookie"):
        box = f'<div class="mx-auto mt-4 flex flex-col px-2 py-3 rounded shadow-md border {word}"><p>Nice words, thanks.</p></div>'
        page = f"<html><body><article><h1>The title</h1><p>First of all, the words of a paragraph.</p>{box}<p>And, at the end, more words of it.</p></article></body></html>"
        found = html.blocks(page)
        assert word in found[2].path[-2][1] and html.weak_labels(found).tolist() == [1, 1, 0, 1]
        bare = html.blocks(page.replace(f" {word}", ""))
        assert not np.array_equal(html.vectors(found)[2], html.vectors(bare)[2])


def test_pages_with_nulls_and_repeats(spark, net):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>x y</p></article>"), (None, "v", "<article><p>x y</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit(1))
    got = html.extract(pages, net).collect()
    assert len(got) == 4 and [r["text"] for r in got if r["page_id"]] == ["", ""]
    assert html.extract(pages.where("false"), net).count() == 0


def test_long_pages_are_read_whole(net):
    page = "<body><nav><a>m</a></nav><article>" + "".join(f"<p>Paragraph number {i}, with some words.</p>" for i in range(1500)) + "</article><footer>end</footer></body>"
    text = html.main_texts(net, [page])[0]
    assert text.count("\n\n") == 1499 and "number 1499," in text and "end" not in text


def test_a_block_is_judged_with_the_whole_page():
    # A net that opens its state at an h1 and never forgets it, ahead or back; without one it accepts nothing.
    d = html.PATH + html.WORDS + html.SHAPE
    gates, bias = np.zeros((d + html.HIDDEN, 4 * html.HIDDEN), np.float32), np.repeat(np.array([-20, 20, 20, 5], np.float32), html.HIDDEN)
    gates[: html.PATH, : html.HIDDEN] = 40 * html._part("<h1")[:, None]
    for first in (True, False):
        ways = [gates, np.zeros_like(gates)] if first else [np.zeros_like(gates), gates]
        net = html.Net(ways, [bias, bias], np.full(2 * html.HIDDEN, 1.0, np.float32), -8.0)
        text = [f"p{i}" for i in range(1500)]
        plain = "".join(f"<p>{x}</p>" for x in text)
        page = "<h1>t</h1>" + plain if first else plain + "<h1>t</h1>"
        assert html.main_texts(net, [page, plain]) == ["\n\n".join(["t", *text] if first else [*text, "t"]), ""]


def test_training_reads_pages_whole(spark, monkeypatch):
    words = "some words of a paragraph that is long enough to pass the first characters"
    page = "<body><article>" + "".join(f"<p>{i} {words}</p>" for i in range(600)) + "</article><div class=remarks>" + "<p>a remark</p>" * 600 + "</div></body>"
    seen = []
    monkeypatch.setattr(html, "train", lambda v, y, *a: seen.extend(zip(v, y, strict=True)))
    html.learn(spark.createDataFrame([(page,), (page,), (None,), ("",)], "html string"))
    assert len(seen) == -(-html.SEQUENCES // 3) * 1 and all(len(v) == len(y) == html.TRAIN_BLOCKS for v, y in seen)
    # Stretches from all of the page: some of the article alone, some of the remarks behind it alone.
    shares = [y.mean() for _, y in seen]
    assert sum(x > 0.5 for x in shares) > 50 and sum(x == 0 for x in shares) > 50
    # The first copy is the page itself, and its stretch is drawn as well.
    firsts = {html.lessons(page, 1, seed)[0][1].tobytes() for seed in range(20)}
    assert len(firsts) > 1
