"""Main text of ordinary pages: classes of wrappers and bodies, odd attributes, boxes inside the article."""

import os

import pytest

from curate.llm import html

PARAGRAPHS = [
    "The first paragraph says what the story is about, and it does so in two clauses.",
    "A second one goes on with more of it. It has two sentences.",
    "In the end, all of it is told once more, for those who came late.",
]


@pytest.fixture(scope="module")
def net(spark, sf):
    return html.learn(spark.read.parquet(os.path.join(os.path.dirname(sf), "sf0.01", "pages.parquet")))


def page(body="", wrap=None, article="<article>", close="</article>", inside=""):
    text = f"<h1>The title of it</h1>{article and ''}" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:2]) + inside + f"<p>{PARAGRAPHS[2]}</p>"
    main = f"{article}{text}{close}"
    if wrap is not None:
        main = f"<div {wrap}>{main}</div>"
    return f"<html><head><title>t</title></head><body {body}><header><p>Our site</p></header><nav><ul><li><a href=/>Home</a></li><li><a href=/about>About us</a></li></ul></nav>{main}<aside><h3>Related</h3><p>Other things to read.</p></aside><footer><p>&copy; us, all rights reserved</p></footer></body></html>"


WANT = "\n\n".join(["The title of it", *PARAGRAPHS])
BODIES = ['class="has-sidebar single-post"', 'class="header-fixed no-sidebar menu-open"', 'class="logged-in admin-bar"', 'class="home page"', "class='nav-open cookie-notice-shown comments-open' id=menu", "id=footer"]
WRAPS = [
    'class="overflow-hidden"', 'class="comments-open"', 'class="social-share"', 'class="entry-header-wrap"', 'class="related"', 'id=sidebar-left role=banner', 'class="mx-auto mt-4 flex flex-col px-2"',
    'class="widget ad advert"', 'data-title="a hidden gem" title=Bob\'s', "class='container newsletter' style='display:block'", 'class="site-content no-js menu"',
]


@pytest.mark.parametrize("body", BODIES)
def test_words_of_the_body_decide_nothing(net, body):
    assert html.main_texts(net, [page(body)]) == [WANT]


@pytest.mark.parametrize("wrap", WRAPS)
def test_words_around_the_article_decide_nothing(net, wrap):
    assert html.main_texts(net, [page(wrap=wrap)]) == [WANT]
    assert html.main_texts(net, [page('class="has-sidebar"', wrap, "<main><article>", "</article></main>")]) == [WANT]


def test_templates_with_utility_classes(net):
    """Forty pages, most without a landmark element, in layout wrappers: at least 95 of 100 texts are exact."""
    layout = ['class="overflow-hidden"', 'class="mx-auto mt-4 flex flex-col px-2"', 'class="site-content no-js"', 'class="comments-open container"']
    articles = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<section class="entry-body">', "</section>"), ('<div id="story">', "</div>")]
    pages = [page(body, wrap, a, b) for a, b in articles for body, wrap in zip(BODIES[:4], layout, strict=True)]
    pages += [page(body, None, a, b) for a, b in articles for body in BODIES[:4]]
    right = [got == WANT for got in html.main_texts(net, pages)]
    assert sum(right) >= 0.95 * len(pages), right


@pytest.mark.parametrize(
    "inside", ['<div class="advert"><p>Buy now!</p></div>', '<span class="advert">Buy now!</span>', '<div class="comments"><p>Nice one, thanks.</p></div>', '<div class="cookie-notice overflow-hidden"><p>We use cookies.</p></div>']
)
def test_boxes_inside_the_article_go(net, inside):
    assert html.main_texts(net, [page(inside=inside)]) == [WANT]


def test_attributes_are_read_one_at_a_time():
    texts = lambda x: [b.text for b in html.blocks(x)]
    assert texts("See <a href=/x title=Bob's>this link</a> now") == ["See this link now"]
    assert texts("<p title='a > b'>x</p><p title=a>b>y") == ["x", "b>y"]
    assert texts('<p title="never closed>x</p>y') == ["x", "y"]
    path = html.blocks('<div data-title="a hidden class=advert gem" CLASS=story hidden><p>x</p></div>')[0].path
    assert path == (("div", ("story", "hidden")), ("p", ()))
    assert html.blocks('<div class="overflow-hidden has-sidebar menu-open post-body"><p>x')[0].path[0] == ("div", ("post", "body"))


def test_tags_without_end_cost_no_second_reading():
    import time

    start = time.time()
    for part in ("<a title=Bob's ", '<a b="c ', "<a =", "<a b=c"):
        html.blocks(part * 20_000)
    assert time.time() - start < 20


def test_an_inline_box_is_told_from_emphasis():
    found = html.blocks('<article><p><b class="x">all of it</b></p><p>some <i class="y">words</i> here</p><span class="advert">Buy</span></article>')
    assert [b.path[-1] for b in found] == [("b", ("x",)), ("p", ()), ("span", ("advert",))]
    assert html.weak_labels(found).tolist() == [1, 1, 0]
