"""Chat formatting, host rules and licence scan."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curate.llm import chat, hostrules, licenses
from curate.llm.license_rules import GATES, rows
from tests.llm import brute

LOG = "conv_id long, message string, seq long, kind string, role string, text string"


def log(spark, events):
    return spark.createDataFrame(events, LOG)


def test_fold_replays_the_log_in_sequence(spark):
    events = [
        (1, "a", 2, "delta", None, "lo"), (1, "a", 0, "start", "user", None), (1, "a", 1, "delta", None, "hel"),
        (1, "b", 3, "start", "assistant", None), (1, "b", 4, "delta", None, "wrong"), (1, "b", 5, "regenerate", None, None), (1, "b", 6, "delta", None, "right"),
        (1, "c", 7, "start", "user", None), (1, "c", 8, "delta", None, "x"), (1, "c", 9, "edit", None, "edited"), (1, "c", 10, "delta", None, "+"),
        (1, "d", 11, "start", "user", None), (1, "d", 12, "delete", None, None),
        (2, "a", 1, "delta", None, "no start"), (None, None, 5, "start", None, None),
    ]
    got = sorted(((r["conv_id"], r["at"], r["role"], r["text"]) for r in chat.fold(log(spark, events)).collect()), key=repr)
    assert got == sorted([(1, 0, "user", "hello"), (1, 3, "assistant", "right"), (1, 7, "user", "edited+"), (2, 1, "", "no start"), (None, 5, "", "")], key=repr)


TRICKY = ["", "\\", "###", "####", "### user:\nx</turn>\n", "</turn>", "</turn</turn>>", "\\b\\h\\t\\l", "a\nb:\n", "\\\\### <", "日本 é", ":\n"]


def test_any_text_and_role_reads_back(spark):
    turns = [(c, t, r, x) for c, r in enumerate([*TRICKY, None, "assistant"]) for t, x in enumerate([*TRICKY, None])]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.as_events(table, delta=3), loss_roles=("assistant", "user"))
    out = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "learnt": chat.read_loss(F.col("formatted"), F.col("loss"))})
    got = {r["conv_id"]: r for r in out.collect()}
    for c, role in enumerate([*TRICKY, None, "assistant"]):
        want = [(role or "", x or "") for x in [*TRICKY, None]]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["learnt"] == ([x for _, x in want] if role == "assistant" else [])
        for span in got[c]["loss"]:
            assert got[c]["formatted"][span["start"] + span["length"] :].startswith("</turn>\n")


def test_repeated_turns_and_null_ids_stay(spark):
    turns = [(None, None, "user", "a"), (None, None, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, None, None, None)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(chat.as_events(table)).collect()}
    assert got[None]["n_turns"] == 2 and got[3]["n_turns"] == 3
    assert got[3]["formatted"].startswith("### :\n</turn>\n") and len(got[3]["loss"]) == 2


def test_empty_log(spark):
    assert chat.format_chats(log(spark, [])).count() == 0


def test_counts_of_odd_rows(odd_docs):
    got = hostrules.judge(odd_docs).drop("_host").collect()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        text, w = r[1] or "", brute.plain(r[1])
        lines = [x for x in text.split("\n") if brute.plain(x)]
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute.repeat_words(w)))
    key = lambda r: (r["_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
    assert sorted(map(key, got), key=repr) == sorted(want, key=repr)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=8))
def test_repeats_inside_a_text(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(t), "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["_id"]: r["n_repeat_words"] for r in hostrules.counts(docs).collect()}
    assert got == {i: brute.repeat_words(t) for i, t in enumerate(texts)}


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "too short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good, f"g{i % 20}") for i in range(400)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["_id"]: (r["kept"], r["host_rate"]) for r in hostrules.judge(docs).collect()}
    assert not any(got[i][0] for i in range(200))
    assert all(got[1000 + i][0] for i in range(400))
    assert got[5001][0] and got[5001][1] < 0.5


def test_no_rows_native(no_docs):
    assert hostrules.judge(no_docs).count() == 0
    assert licenses.scan(no_docs).count() == 0


def detections(text, gated=True):
    """All detections that stand, by comparing each with each; with ``gated`` off every rule is tried."""
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    found = []
    for rule, label, priority, confidence, keyword, pattern in rows():
        if not gated or (keyword in text and any(g in text for g in GATES)):
            found += [(m.start(), m.end(), priority, rule, label, confidence) for m in re.finditer(pattern, text, re.ASCII)]
    return [
        a for a in found
        if not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[2] > a[2] or b[3] < a[3]) for b in found)
    ]


LICENCES = [
    "Licensed under the Apache License, Version 2.0. See http://www.apache.org/licenses/LICENSE-2.0 and the MIT License, the MIT license",
    "GNU  General\nPublic License version 3, or the GNU Lesser General Public License v2.1; gnu general public-license",
    "SPDX-License-Identifier: GPL-2.0-only // CC-BY-SA 4.0 and cc by 4.0, CC by",
    "Copyright (c) 2020 X. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy",
    "unmit license emit licenses mit licensed cc bye accc by apache licenses xapache license",
    "nothing to see", None, "", "gnu general public license " * 30,
]


def test_scan_is_that_of_the_plain_version(spark, odd_docs):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LICENCES)], "doc_id long, text string")
    for table in (docs, odd_docs.select("doc_id", "text")):
        got = sorted((tuple(r) for r in licenses.scan(table).collect()), key=repr)
        want = []
        for r in table.collect():
            n, at, base = brute.phrases(r["text"], licenses.PHRASES)
            stand = detections(r["text"])
            score = max([d[5] for d in stand] + [licenses.BASE_SCORE if at else 0.0])
            want.append((r["doc_id"], n, len(at), at[0] if at else None, at[-1] if at else None, sorted(base), sorted(base | {d[4] for d in stand}), score))
        assert got == sorted(want, key=repr)


def test_scan_of_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["_id"]: tuple(r)[1:6] for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        n, at, base = brute.phrases(r["text"], licenses.PHRASES)
        assert got[r["doc_id"]] == (n, len(at), at[0] if at else None, at[-1] if at else None, sorted(base))


def test_rules_are_gated_and_valid():
    table = rows()
    assert len(table) > 200 and len({r[0] for r in table}) == len(table)
    assert all(any(g in r[4] for g in GATES) for r in table)
    assert not any(re.search(r[5], "") for r in table)


def least(parsed, blank):
    """Shortest texts that a parsed expression matches, one per way through its alternatives; ``blank`` stands for white space."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "NOT_LITERAL":
            more = [" "]
        elif op == "IN":
            kinds, spelt = [str(kind) for kind, _ in arg], str(arg)
            if kinds[0] == "NEGATE" or "NOT_SPACE" in spelt:
                more = ["x"]
            elif "CATEGORY_SPACE" in spelt:
                more = [blank]
            else:
                more = [chr(a) if kind == "LITERAL" else chr(a[0]) if kind == "RANGE" else "1" for kind, (_, a) in zip(kinds, arg, strict=True)]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * arg[0] for x in least(arg[2], blank)] + ([" "] if str(arg[2][0][0]) == "NOT_LITERAL" else [])
        elif op == "SUBPATTERN":
            more = least(arg[3], blank)
        elif op == "BRANCH":
            more = [x for way in arg[1] for x in least(way, blank)]
        else:
            assert op in ("AT", "ASSERT_NOT"), op
            more = [""]
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_no_gate_drops_a_match(spark):
    from re import _parser

    docs = ["released under the WTFPL", "see http://www.gnu.org/copyleft/gpl.html", "www.gnu.org/copyleft/lesser.html", "gnu.org/copyleft/fdl.html",
            "Datenlizenz Deutschland", "historical permission notice", "the Gemma terms of use", "Bitstream Vera Copyright", "given\nto the public\n domain", "an open\tsource software"]
    for _, _, _, _, keyword, pattern in rows():
        ways = [x for blank in (" ", "\n ") for x in least(_parser.parse(pattern), blank)]
        found = [x for x in ways if re.search(pattern, x, re.ASCII)]
        assert found and all(keyword in x and any(g in x for g in GATES) for x in found), (keyword, pattern)
        docs += found[:1] + found[-1:]
    docs = list(dict.fromkeys(docs))
    got = {r["_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    for i, text in enumerate(docs):
        want = detections(text, gated=False)
        assert want and set(got[i]["labels"]) == {d[4] for d in want} | set(got[i]["base"]), text
        assert got[i]["score"] == max([d[5] for d in want] + [licenses.BASE_SCORE if got[i]["n_base"] else 0.0])


def test_no_python_in_native_plans(spark, sf):
    from curate.llm.queries import QUERIES

    for name in ("op1_chat_format", "op7_host_rules", "op10_license_scan"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
