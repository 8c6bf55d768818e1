"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags. Each block is a vector of hashed tag-path parts
(tags and class or id words of its ancestors, the nearer the heavier), hashed words and a few shapes. A
bidirectional LSTM in numpy reads the blocks of the whole page in both directions and labels each as main text or
not, so a block is judged with the page around it.

The labeller is trained here, on pages of the given table: their landmark elements (article, navigation, footer
and so on) are the weak labels, and copies of the pages are rebuilt with other landmarks, further boilerplate
and without the telling tags, so that it does not hang on one template.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages learnt from, at most: those with the least hashes of their html.
TRAIN_PAGES = 200
#: Training sequences, about: each page as it is, and rebuilt as often as that takes.
SEQUENCES = 1200
EPOCHS = 24
#: Blocks of a training sequence.
TRAIN_BLOCKS = 80
PATH, WORDS, SHAPE, HIDDEN = 64, 16, 6, 16
#: Steps whose gate inputs are held at once; the state goes on from one stretch to the next.
STRETCH = 512
BATCH_BLOCKS = 16_384

MAIN = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
HIDDEN_TEXT = frozenset("script style noscript template svg math iframe object textarea select head title".split())
#: Start tags that leave an open head open; any other one ends it, as its own end tag may be left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: What stands in a tag after its name: a quote counts right after "=" only. Read once, without a second try.
ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?|[^>=]+)*+"
RAW = re.compile(rf"<(script|style|textarea|title|noscript|iframe|template)\b{ATTRIBUTES}>", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
CUT_OFF = re.compile(r"</?[a-zA-Z!?]")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
NAMING = frozenset("class id role itemprop aria-label hidden style".split())
PART = re.compile(r"[a-z]+")
#: Compounds that begin or end so tell a state or a way of layout, not what an element is: has-sidebar, overflow-hidden, menu-open.
STATE_FIRST = frozenset("has no not is with without js overflow align are can show hide on".split())
STATE_LAST = frozenset("open closed fixed sticky hidden visible active enabled disabled in on off loaded left right".split())
#: Elements whose own words say nothing about a part of the page.
WHOLE_PAGE = frozenset(["html", "body"])
#: A start tag closes open elements of these names.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _words_of(attributes: str) -> tuple[str, ...]:
    """What an element is called: the parts of its class, id and role words, but for those that tell a state."""
    names: list[str] = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key not in NAMING:
            continue
        if key == "style":
            names += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
        elif not PART.search(value):
            names.append(key)
        else:
            for token in value.split():
                parts = PART.findall(token)
                if len(parts) < 2 or parts[0] not in STATE_FIRST and parts[-1] not in STATE_LAST:
                    names += parts
    return tuple(names)


@dataclass
class Block:
    """A leaf: its text, its ancestors (tag, words of class, id and role) and how much of the text is links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: float


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; comments, scripts, styles and markup give none. Broken markup is read as it stands.

    Words of ``html``, ``body`` and of the elements around the page's main landmark (the article or main element with the most text) are
    left out of the paths, as they speak of the whole page. An inline element with words belongs to the path of a block that
    stands in it with all its text.
    """
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...], int]] = []
    places: list[tuple[tuple[str, tuple[str, ...], int], ...]] = []
    held: list[str] = []
    links, plain, opened = 0, 0, 0
    around: list[tuple[str, tuple[str, ...], int]] | None = None

    def flush() -> None:
        nonlocal links, plain, around
        text = "".join(held)
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text and not any(x[0] in HIDDEN_TEXT for x in path):
            places.append(tuple(x for x in path if x[0] not in INLINE) + tuple(around or ()))
            out.append(Block(text, (), links / max(links + plain, 1)))
        held.clear()
        links, plain, around = 0, 0, None

    def end_head() -> None:
        while path and path[-1][0] == "head":
            path.pop()

    def words(text: str) -> None:
        nonlocal links, plain, around
        if path and path[-1][0] == "head" and not text.isspace():
            end_head()
        held.append(text)
        if not text.isspace():
            named = [x for x in path if x[0] in INLINE and x[1]]
            around = named if around is None else [x for x in around if x in named]
        if any(x[0] == "a" for x in path):
            links += len(text)
        else:
            plain += len(text)

    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            words(page[at:])
            break
        if low > at:
            words(page[at:low])
        raw = RAW.match(page, low)
        if raw:
            end = RAW_END[raw[1].lower()].search(page, raw.end())
            flush() if raw[1].lower() not in INLINE else None
            at = end.end() if end else n
            continue
        m = TOKEN.match(page, low)
        if not m:
            # A stray "<" is text; one that begins a tag which the page's end cuts off is dropped.
            if CUT_OFF.match(page, low) and page.find(">", low) < 0:
                break
            words("<")
            at = low + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if path and path[-1][0] == "head" and (tag in ("body", "html", "br") if m[1] else tag not in IN_HEAD):
            flush()
            end_head()
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] == tag:
                    del path[i:]
                    break
                if tag in INLINE and path[i][0] not in INLINE:
                    break
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            shut = CLOSES.get(tag, set()) | ({"p"} if tag not in INLINE else set())
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] in shut:
                    del path[i:]
                    break
                if path[i][0] not in INLINE and path[i][0] not in ("p", "td", "th"):
                    break
            opened += 1
            path.append((tag, _words_of(m[3]) if m[3] and tag not in WHOLE_PAGE else (), opened))
    flush()
    outer = _around_main(out, places)
    for block, place in zip(out, places, strict=True):
        block.path = tuple((tag, () if number in outer else names) for tag, names, number in place)
    return out


def _around_main(page: list[Block], places: list) -> set[int]:
    """The elements around the main landmark: the article or main element that holds the most text."""
    held: dict[int, int] = {}
    above: dict[int, tuple] = {}
    for block, place in zip(page, places, strict=True):
        for i, (tag, _, number) in enumerate(place):
            if tag in MAIN:
                held[number] = held.get(number, 0) + len(block.text)
                above.setdefault(number, place[:i])
                break
    if not held:
        return set()
    return {number for _, _, number in above[max(held, key=held.__getitem__)]}


_HASHED: dict[str, np.ndarray] = {}
BUCKETS = 512
#: Directions of the word buckets: a page's vocabulary needs no memory.
_BUCKET = (np.random.default_rng(3).standard_normal((BUCKETS, WORDS)) / np.sqrt(WORDS)).astype(np.float32)


def _part(name: str) -> np.ndarray:
    """A fixed pseudo-random direction of a tag or a class word."""
    if name not in _HASHED:
        if len(_HASHED) > 20_000:
            _HASHED.clear()
        draw = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode("utf-8", "replace"))))
        _HASHED[name] = (draw.standard_normal(PATH) / np.sqrt(PATH)).astype(np.float32)
    return _HASHED[name]


def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for depth, (tag, names) in enumerate(reversed(path)):
        weight = 1.0 / (1.0 + 0.25 * depth)
        v += weight * _part("<" + tag)
        # Many words of layout together weigh little more than one that tells something.
        share = 2.0 * weight / max(1.0, len(names) / 2) ** 0.5
        for name in names:
            v += share * _part("." + name)
    return v


def vectors(page: list[Block], paths: dict | None = None) -> np.ndarray:
    """One row per block: tag path, words, shape. ``paths`` remembers the vectors of paths from page to page."""
    paths = {} if paths is None else paths
    if len(paths) > 5_000:
        paths.clear()
    rows, buckets, counts, shape = [], [], [], []
    for block in page:
        v = paths.get(block.path)
        if v is None:
            v = paths[block.path] = _path_vector(block.path)
        rows.append(v)
        text = block.text
        found = [zlib.crc32(word) % BUCKETS for word in text.lower().encode("utf-8", "replace").split(b" ")]
        n_words = len(found)
        buckets += found
        counts.append(n_words)
        commas = text.count(",") + text.count(";") + text.count(":")
        shape.append((len(text), n_words, block.linked, text[-1] in ".!?", commas / (n_words + 1), len(block.path) / 8))
    out = np.zeros((len(page), PATH + WORDS + SHAPE), np.float32)
    out[:, :PATH] = rows
    # The mean direction of all words of a block.
    n = np.array(counts)
    places = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[:, PATH : PATH + WORDS] = np.add.reduceat(_BUCKET[buckets], places, axis=0) / n[:, None]
    shape = np.array(shape, np.float32)
    shape[:, 0] = np.log1p(shape[:, 0]) / 5
    shape[:, 1] = np.log1p(shape[:, 1]) / 4
    out[:, PATH + WORDS :] = shape
    return out


@dataclass
class Net:
    """Weights: per direction one matrix for input and state of the four gates; a layer on both states."""

    gates: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction: x is (steps, pages, inputs); masked steps leave the state as it was."""
    steps, pages, d = x.shape
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros((pages, HIDDEN), np.float32)
    states = np.zeros((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        if t % STRETCH == 0:
            part = x[t : t + STRETCH]
            drive = (part.reshape(len(part) * pages, d) @ w[:d] + b).reshape(len(part), pages, 4 * HIDDEN)
        z = drive[t % STRETCH] + h @ w[d:]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        if keep is not None:
            keep.append((i, f, o, g, c, new, h, m))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        states[t] = h
    return states


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


def probabilities(net: Net, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Of being main text, per page and block."""
    x, mask = _pad(pages)
    ahead = _run(x, mask, net.gates[0], net.biases[0])
    back = _run(x[::-1], mask[::-1], net.gates[1], net.biases[1])[::-1]
    p = _sigmoid(np.concatenate([ahead, back], axis=2) @ net.out + net.bias)
    return [p[: len(v), k] for k, v in enumerate(pages)]


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS) -> Net:
    """Fit by Adam on batches of pages; the same input gives the same weights. No pages give a net that accepts everything."""
    draw = np.random.default_rng(7)
    d = PATH + WORDS + SHAPE
    net = Net(
        [(draw.standard_normal((d + HIDDEN, 4 * HIDDEN)) / np.sqrt(d + HIDDEN)).astype(np.float32) for _ in range(2)],
        [np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32) for _ in range(2)],
        (draw.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32),
        0.0,
    )
    if not pages:
        net.out[:] = 0
        net.bias = 1.0
        return net
    weights = [*net.gates, *net.biases, net.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    size, step = 16, 0
    by_length = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    groups = [by_length[i : i + size] for i in range(0, len(by_length), size)]
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs) + 0.001
        for k in draw.permutation(len(groups)):
            x, mask = _pad([pages[i] for i in groups[k]])
            y, _ = _pad([labels[i][:, None].astype(np.float32) for i in groups[k]])
            kept: list[list] = [[], []]
            flip = (slice(None), slice(None, None, -1))
            states = [_run(x[f], mask[f], weights[j], weights[2 + j], kept[j])[f] for j, f in enumerate(flip)]
            both = np.concatenate(states, axis=2)
            p = _sigmoid(both @ weights[4] + weights[5][0])
            err = np.where(mask, p - y[:, :, 0], 0).astype(np.float32) / mask.sum()
            grads = [np.zeros_like(w) for w in weights]
            grads[4] = np.einsum("tk,tkh->h", err, both)
            grads[5] = np.array([err.sum()], np.float32)
            for j, f in enumerate(flip):
                up = (err[f][:, :, None] * weights[4][j * HIDDEN : (j + 1) * HIDDEN]).astype(np.float32)
                dh = np.zeros((x.shape[1], HIDDEN), np.float32)
                dc = np.zeros_like(dh)
                w, xs = weights[j], x[f]
                dz_all = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
                h_all = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
                for t in range(len(x) - 1, -1, -1):
                    i, fg, o, g, c, new, h, m = kept[j][t]
                    dh = dh + up[t]
                    tan = np.tanh(new)
                    live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
                    dn = live_c + live_h * o * (1 - tan * tan)
                    dz = np.concatenate([dn * g * i * (1 - i), dn * c * fg * (1 - fg), live_h * tan * o * (1 - o), dn * i * (1 - g * g)], axis=1)
                    dz_all[t], h_all[t] = dz, h
                    dh = np.where(m, 0, dh) + dz @ w[x.shape[2] :].T
                    dc = np.where(m, dn * fg, dc)
                flat = dz_all.reshape(-1, 4 * HIDDEN)
                grads[j] = np.concatenate([xs.reshape(-1, x.shape[2]).T @ flat, h_all.reshape(-1, HIDDEN).T @ flat])
                grads[2 + j] = flat.sum(0)
            step += 1
            for w, g, a, b in zip(weights, grads, first, second, strict=True):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Net(weights[0:2], weights[2:4], weights[4], float(weights[5][0]))


CHROME = frozenset("nav header footer aside form button dialog menu".split())
CHROME_WORDS = (
    "ad ads advert advertisement banner breadcrumb comment comments reply replies cookie consent notice disclaimer footer header legal login "
    "menu modal nav navbar navigation newsletter pagination popup promo related share sharing sidebar signup social sponsor sponsored subscribe "
    "tags toolbar widget hidden"
).split()
MAIN_WORDS = "article content entry post story body main text".split()
#: What compounds are made of besides: words that tell neither.
FILLERS = "box list area wrap wrapper container inner outer block item group row col grid flex card panel px mt top bottom site page layout rounded".split()
#: Where a block of main text may stand besides its own element.
MAIN_LEAVES = [t.split() for t in ("ul li", "ol li", "blockquote p", "table tr td", "table tr th", "dl dd", "pre", "figure figcaption", "h2", "h3")]


def weak_labels(page: list[Block]) -> np.ndarray:
    """1 for blocks inside a main landmark and outside of boilerplate ones, by the page's own markup."""
    out = np.zeros(len(page), np.float32)
    for k, block in enumerate(page):
        inside = any(t in MAIN for t, _ in block.path)
        chrome = any(t in CHROME or any(n in CHROME_WORDS for n in names) for t, names in block.path if t not in WHOLE_PAGE)
        out[k] = inside and not chrome
    return out


def rebuilt(page: list[Block], labels: np.ndarray, draw: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page with another main landmark and with boilerplate of other kinds put around and into it."""
    landmark = [("article", ()), ("main", ()), ("div", (MAIN_WORDS[draw.integers(len(MAIN_WORDS))],)), ("section", (MAIN_WORDS[draw.integers(len(MAIN_WORDS))],))]
    new = landmark[draw.integers(4)]
    if new[1] and draw.random() < 0.5:
        new = (new[0], (*new[1], FILLERS[draw.integers(len(FILLERS))]))
    # A wrapper of many layout words around a landmark that has no tag of its own.
    wrap = ()
    if new[0] not in MAIN and draw.random() < 0.5:
        wrap = (("div", tuple(FILLERS[i] for i in draw.integers(0, len(FILLERS), draw.integers(1, 9)))),)
    out: list[tuple[Block, float]] = []
    texts = [b.text for b in page] or ["text"]

    def chrome(inside: tuple) -> None:
        word = CHROME_WORDS[draw.integers(len(CHROME_WORDS))]
        other = (FILLERS[draw.integers(len(FILLERS))],) if draw.random() < 0.5 else ()
        tags = ["nav", "header", "footer", "aside", "form"]
        box = (tags[draw.integers(5)], ()) if draw.random() < 0.35 else (("div", "section", "ul", "p", "aside")[draw.integers(5)], (word, *other) if draw.random() < 0.5 else (*other, word))
        leaf = (("p", "li", "div", "span", "h2", "label", "h3", "button", "td", "legend")[draw.integers(10)], ())
        head = (("html", ()), ("body", ()))
        for _ in range(draw.integers(1, 5)):
            text = texts[draw.integers(len(texts))][: int(draw.integers(5, 300))].strip() or "text"
            deep = (box,) if leaf[0] == "span" or draw.random() < 0.3 else (box, leaf)
            out.append((Block(text, head + inside + deep, float(draw.random() < 0.4)), 0.0))

    main = [k for k in range(len(page)) if labels[k]]
    places = set(draw.integers(0, len(page) + 1, 5).tolist())
    for k, block in enumerate(page):
        if k in places:
            chrome((*wrap, new) if main and main[0] < k <= main[-1] else wrap if draw.random() < 0.5 else ())
        if labels[k]:
            path = tuple(x for t, n in block.path for x in ((*wrap, new) if t in MAIN else ((t, n),)))
            if draw.random() < 0.25:
                other = MAIN_LEAVES[draw.integers(len(MAIN_LEAVES))]
                path = (path if path[-1] == new else path[:-1]) + tuple((t, ()) for t in other)
            text = block.text
            if draw.random() < 0.25:  # fragments and headings
                text = " ".join(text.split(" ")[: int(draw.integers(1, 4))])
            block = Block(text, path, 0.0 if draw.random() < 0.9 else 0.3)
        for _ in range(1 if draw.random() < 0.9 else int(draw.integers(2, 6))):
            out.append((block, float(labels[k])))
    if len(page) in places:
        chrome(())
    return [b for b, _ in out], np.array([v for _, v in out], np.float32)


def lessons(page: str, copies: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences of a page, read whole: itself and rebuilt copies, of each a stretch of TRAIN_BLOCKS from anywhere in it."""
    draw = np.random.default_rng([11, seed])
    found = blocks(page)
    marks = weak_labels(found)
    out = []
    for copy in range(copies if marks.any() else 0):
        b, y = (found, marks) if copy == 0 else rebuilt(found, marks, draw)
        at = int(draw.integers(0, max(len(b) - TRAIN_BLOCKS, 0) + 1))
        out.append((vectors(b[at : at + TRAIN_BLOCKS]), y[at : at + TRAIN_BLOCKS]))
    return out


def learn(pages: DataFrame, html_col: str = "html", limit: int = TRAIN_PAGES) -> Net:
    """Train on at most ``limit`` whole pages (least hashes of the html) and rebuilt copies of them.

    The pages are read inside tasks; the driver gets about SEQUENCES stretches of TRAIN_BLOCKS vectors, whatever the pages' length.
    """
    rows = pages.select(F.xxhash64(html_col).alias("h"), F.coalesce(html_col, F.lit("")).alias("t"))
    # The hashes alone are sorted; texts stay in the tasks.
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(limit).collect()]
    copies = -(-SEQUENCES // max(len(least), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, t in zip(batch.column("h"), batch.column("t"), strict=True):
                made = lessons(t.as_py(), copies, h.as_py() % 2**64)
                n = len(made)
                v, y = [x.tobytes() for x, _ in made], [x.tobytes() for _, x in made]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(v, pa.binary()), pa.array(y, pa.binary())], names=["h", "copy", "v", "y"]
                )

    sample = rows.where(F.col("h").isin(least)).groupBy("h").agg(F.min("t").alias("t"))
    made = sorted(sample.mapInArrow(run, "h long, copy int, v binary, y binary").collect(), key=lambda r: (r["h"], r["copy"]))
    seen = [np.frombuffer(r["v"], np.float32).reshape(-1, PATH + WORDS + SHAPE) for r in made]
    return train(seen, [np.frombuffer(r["y"], np.float32) for r in made])


def main_texts(net: Net, pages: list[str | None]) -> list[str]:
    """The main text of each page: accepted blocks in page order, joined by an empty line."""
    parsed = [blocks(p or "") for p in pages]
    paths: dict = {}
    # A page is one sequence, however long: each block is judged with all of the page.
    jobs = [(k, vectors(page, paths)) for k, page in enumerate(parsed) if page]
    chosen = [np.zeros(len(p), np.float32) for p in parsed]
    jobs.sort(key=lambda j: len(j[1]))
    lo = 0
    while lo < len(jobs):
        hi = lo + 1
        while hi < len(jobs) and len(jobs[hi][1]) * (hi - lo + 1) <= BATCH_BLOCKS:
            hi += 1
        for (k, _), p in zip(jobs[lo:hi], probabilities(net, [v for _, v in jobs[lo:hi]]), strict=True):
            chosen[k] = p
        lo = hi
    return ["\n\n".join(b.text for b, p in zip(page, marks, strict=True) if p > 0.5) for page, marks in zip(parsed, chosen, strict=True)]


def extract(pages: DataFrame, net: Net | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text): the main text of every row from its whole html.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
    order by two line breaks; nothing of an accepted block is dropped. NULL and empty pages, and pages without an accepted
    block, give an empty text. Repeated rows are read one by one. An empty table gives no rows. Without ``net`` a labeller is
    trained on the table itself.
    """
    net = learn(pages, html_col) if net is None else net
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lo = batch.column("_html"), 0
            while lo < len(batch):
                hi, weight, rows = lo, 0, []
                while hi < len(batch) and (weight < 4_000_000 or hi == lo):
                    rows.append(column[hi].as_py())
                    weight += len(rows[-1] or "")
                    hi += 1
                out = pa.array(main_texts(net, rows), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in kept], out], names=[*kept, "text"])
                lo = hi

    shape = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept], "text string"])
    return pages.select(*kept, F.col(html_col).alias("_html")).mapInArrow(run, shape)
