"""Token output and packing: round trips against the library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curate.llm import binary, packing
from curate.llm.queries import vocabulary
from curate.llm.tokens import Encoder
from curate.storage import stage_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def encode():
    return Encoder(vocabulary())


TEXT = st.text(
    st.one_of(st.sampled_from("abzAZ019 \n\t.,;'!|<>-é́̌JjKİΣσßＡ  ẞ日#*"), st.characters(exclude_categories=["Cs"])), max_size=40
)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(plain, encode, text):
    got = np.frombuffer(encode.ids([text])[0], "<u4").tolist()
    assert got == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["don't stop. Don't", "J̌ ǰ", "<|endoftext|> x <|EndOfText|>", "a<|startoftext|>.", "ΑΣ ΣΑΣ.", "it's, 'tis''s", "x.́ e.́"])
def test_ids_of_hard_texts(plain, encode, text):
    assert np.frombuffer(encode.ids([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["ANKARA ÜNİVERSİTESİ.", "KİŞİ, EVİ;", "İ!", "xİ.İ, é×. ÷% ǅ. ẞ.", "DİYARBAKIR'İ|"])
def test_ids_of_letters_that_are_none_in_lower_case(plain, encode, text):
    assert np.frombuffer(encode.ids([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_every_last_letter_before_every_mark(plain, encode):
    from curate.llm.tokens import _TAIL

    letters = [chr(c) for c in range(0x21, 0x2000) if not chr(c).isspace()] + ["日", "ﬁ", "Ａ", "🙂"]
    texts = [f"w{letter}{mark}" for letter in letters for mark in _TAIL.decode()]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode.ids(texts)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = ["Hello World, it's", "", " two  spaces\n", None, "ÜNİ. x"]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).ids(texts)]
    assert got == [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded_and_forgetting_changes_nothing(plain, encode, monkeypatch):
    monkeypatch.setattr("curate.llm.tokens.REMEMBERED", 3)
    for text in ["one two three four", "five six one", "two"]:
        assert np.frombuffer(encode.ids([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_planes_round_trip(ids):
    array = np.array(ids, np.uint32)
    assert binary.unshuffle(binary.shuffle(array), len(array)).tolist() == ids


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=50), st.binary(max_size=50))
def test_checksums_join(a, b):
    assert binary.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_written_ids_read_back(spark, odd_docs, plain, block):
    path = stage_path(spark, "ids")
    binary.write_ids(odd_docs, path, vocabulary(), 1, block=block)
    got = sorted((tuple(r) for r in binary.read_documents(spark, path).collect()), key=lambda r: r[1])
    rows = odd_docs.selectExpr("doc_id", "xxhash64(text) th", "text").orderBy("doc_id", "th", "text").collect()
    start, want = 0, []
    for r in rows:
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_no_documents(spark, no_docs):
    path = stage_path(spark, "ids")
    binary.write_ids(no_docs, path, vocabulary(), 1)
    assert binary.read_documents(spark, path).count() == 0
    assert packing.pack(packing.pieces(no_docs, vocabulary(), 0)).count() == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_places_every_piece_once(spark, odd_docs, plain, capacity):
    got = packing.pack(packing.pieces(odd_docs, vocabulary(), 0, capacity), capacity).toPandas()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((r[0], k, a, len(part), zlib.crc32(part.tobytes())))
    rows = [(None if x[0] != x[0] else int(x[0]), *map(int, x[1:])) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= capacity
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]


def best_fit(lengths, capacity):
    """Falling best fit, one piece at a time: how many sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def packed(counts, capacity):
    """Sequences by number, each the sorted (offset, length) of its pieces, from the matched runs."""
    places, used = packing.match(counts, capacity), {}
    for n in counts:
        runs = sorted(p[1:] for p in places if p[0] == n)
        for (rank, first, offset), after in zip(runs, [*(r[0] for r in runs[1:]), counts[n]], strict=True):
            for k in range(after - rank):
                used.setdefault(first + k, []).append((offset, n))
    assert sum(len(v) for v in used.values()) == sum(counts.values())
    for v in used.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1].tolist()] and sum(n for _, n in v) <= capacity
    return used


def sequences(lengths, capacity):
    return sorted(sorted(n for _, n in v) for v in packed({n: lengths.count(n) for n in set(lengths)}, capacity).values())


def best_fit_contents(lengths, capacity):
    """The sequences of falling best fit, one piece at a time."""
    made = []
    for n in sorted(lengths, reverse=True):
        fits = [s for s in made if capacity - sum(s) >= n]
        (min(fits, key=lambda s: capacity - sum(s)) if fits else made.append([]) or made[-1]).append(n)
    return sorted(map(sorted, made))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=80))
def test_rounds_pack_as_one_by_one(lengths):
    assert len(sequences(lengths, 32)) == best_fit(lengths, 32)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=4), st.sampled_from([32, 40, 41]))
def test_few_lengths_in_large_numbers(counts, capacity):
    counts = {n: c for n, c in counts.items() if n <= capacity} or {1: 1}
    assert len(packed(counts, capacity)) == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


@pytest.mark.parametrize("counts, capacity, want", [({600: 4, 482: 3}, 2048, 2), ({10: 4, 7: 3}, 32, 2)])
def test_tails_are_filled_one_after_the_other(counts, capacity, want):
    assert len(packed(counts, capacity)) == want == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40))
def test_sequences_hold_the_same_lengths_as_one_by_one(lengths):
    # Gaps of one size may be taken in another order, which changes no sequence's free space.
    free = lambda made: sorted(24 - sum(s) for s in made)
    assert free(sequences(lengths, 24)) == free(best_fit_contents(lengths, 24))


def test_a_word_that_repeats_is_looked_up_once(encode, monkeypatch):
    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    known = Counting()
    monkeypatch.setattr(encode, "known", known)
    got = encode.ids([" word  other\n" * 500, None, "", "word\t" * 500, " "])
    assert [len(x) for x in got] == [500 * len(b"".join(encode.ids(["word other"]))), 0, 0, 500 * len(encode.ids(["word"])[0]), 0]
    assert known.asked < 50
