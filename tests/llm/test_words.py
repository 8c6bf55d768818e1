import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from curate.llm.words import FOLDED, PLAIN, Words, texts, windows, winnow
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB1 \n.é日 -", max_size=40)), max_size=6)


def words_of(rows, rule, lower):
    data, offsets = texts(pa.array(rows, pa.string()))
    w = Words(data, offsets, rule, lower)
    return [[w.string(i, i + 1).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(rows))], w


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(rows):
    assert words_of(rows, FOLDED, True)[0] == [brute.folded(t) for t in rows]
    assert words_of(rows, PLAIN, False)[0] == [brute.plain(t) for t in rows]


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_equal_windows_have_equal_hashes_and_no_others(rows, k):
    parts, w = words_of(rows, PLAIN, False)
    flat = [x for p in parts for x in p]
    h, left = windows(w.hashes(), k), w.left()
    seen = {}
    for i in np.flatnonzero(left >= k):
        assert seen.setdefault(int(h[i]), tuple(flat[i : i + k])) == tuple(flat[i : i + k])
    assert len(seen) == len({tuple(flat[i : i + k]) for i in np.flatnonzero(left >= k)})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.sampled_from("abcd"), max_size=60))
def test_shared_spans_share_a_chosen_window_at_the_same_place(a, b):
    span, k = 6, 3
    _, w = words_of([" ".join(a), " ".join(b)], PLAIN, False)
    h = windows(w.hashes(), k)
    chosen = set(winnow(h, w.left(), k, span).tolist())
    for i in range(len(a) - span + 1):
        for j in range(len(b) - span + 1):
            if a[i : i + span] == b[j : j + span]:
                both = [d for d in range(span - k + 1) if i + d in chosen and len(a) + j + d in chosen]
                assert both


def test_sliced_columns_and_empty_ones():
    column = pa.array(["x y", None, "z"]).slice(1, 2)
    data, offsets = texts(column)
    assert Words(data, offsets, PLAIN, False).count.tolist() == [0, 1]
    data, offsets = texts(pa.array([], pa.string()))
    assert len(Words(data, offsets, PLAIN, False).hashes()) == 0
