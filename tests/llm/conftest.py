import pytest

from curate.llm.registry import importable


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    importable(spark)


LONG = " ".join(f"w{i % 701}x{i // 701}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    story = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up forty jugs of liquid gold for a trip"
    shape = "doc_id long, text string, lang string, source string, n_chars long, _id string, _th long, words array<string>, score string, class int"
    rows = [
        (1, story, "en", "a"),
        (1, story, "en", "a"),
        (1, story + " again", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (None, story, None, "b"),
        (None, "few words", "en", None),
        (4, LONG, "en", "a"),
        (5, " \n\t ", "en", "a"),
        (6, "é ü\u0000   日本語 text <b>&amp;</b> İ ǰ", "xx", "a"),
        (7, "few words", "en", "b"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 5, ["w"], "s", 3) for r in rows]
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
