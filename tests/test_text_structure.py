"""Diffs, sentence places and marked-up text against literal results and plain algorithms."""

from __future__ import annotations

import random

import numpy as np
import pytest

from textloom.operators import diff, sentence_spans

DOCS = "doc_id bigint, text string"


def table_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence_equals_a_quadratic_table():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        got = diff.common(np.array(a, np.int32), np.array(b, np.int32))
        assert len(got) == table_length(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_segments_are_literal_and_rebuild_both_texts():
    assert diff.segments("a b c", "a x c") == [("equal", 0, 2, 0, 2, 2), ("insert", 2, 2, 2, 3, 1), ("delete", 2, 3, 3, 3, 1), ("equal", 3, 5, 3, 5, 2)]
    assert diff.segments("", "") == [] and diff.segments("same é", "same é") == [("equal", 0, 6, 0, 6, 3)]
    assert diff.segments("x", "") == [("delete", 0, 1, 0, 0, 1)]
    assert diff.segments("a a", "b b", max_cells=1) == [("delete", 0, 3, 0, 0, 3), ("insert", 3, 3, 0, 3, 3)]
    rng = random.Random(6)
    for _ in range(200):
        s, c = (" ".join(rng.choice(["é", "b", "cc", "d\n"]) for _ in range(rng.randrange(12))) for _ in range(2))
        parts = diff.segments(s, c)
        assert "".join(s[p[1] : p[2]] for p in parts if p[0] != "insert") == s
        assert "".join(c[p[3] : p[4]] for p in parts if p[0] != "delete") == c
        assert all(s[p[1] : p[2]] == c[p[3] : p[4]] for p in parts if p[0] == "equal")
        assert all(p[0] != q[0] for p, q in zip(parts, parts[1:]))


def earliest_path(a, b):
    """Pairs of the longest common subsequence that leaves out a token of a where it can, and else takes the next equal one of b."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, j = [], 0
    for i, x in enumerate(a):
        if t[i + 1][j] < t[i][j]:
            j = b.index(x, j) + 1
            out.append((i, j - 1))
    return out


def test_common_subsequence_is_the_same_by_any_blocks_and_rows():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        want = earliest_path(a, b)
        assert diff.common(a, b) == want
        assert diff.common(a, b, block=rng.randrange(1, 9), kept_bits=0, kept_rows=rng.randrange(2, 6)) == want


def test_pairs_of_any_size_are_compared_by_token():
    rng = random.Random(8)
    long = "x" * 50_000
    assert diff.segments(f"a b {long}", f"a c {long}") == [("equal", 0, 2, 0, 2, 2), ("insert", 2, 2, 2, 3, 1), ("delete", 2, 3, 3, 3, 1), ("equal", 3, 50_004, 3, 50_004, 2)]
    # 2.2 million cells
    s, c = (" ".join(rng.choice("abcdefgh") for _ in range(750)) for _ in range(2))
    parts = diff.segments(s, c)
    a, b = diff.TOKEN.findall(s), diff.TOKEN.findall(c)
    assert sum(p[5] for p in parts if p[0] == "equal") == table_length(a, b) > 750
    assert "".join(s[p[1] : p[2]] for p in parts if p[0] != "insert") == s and "".join(c[p[3] : p[4]] for p in parts if p[0] != "delete") == c


def test_long_texts_of_many_kinds_take_little_memory():
    import tracemalloc

    s = " ".join(f"w{i}" for i in range(10_000))
    c = s.replace("w5000 ", "v ").replace("w70 ", "")
    tracemalloc.start()
    got = diff.segments(s, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p[0] for p in got] == ["equal", "delete", "equal", "insert", "delete", "equal"] and sum(p[5] for p in got if p[0] == "equal") == 19_996
    # a bit for each place of each kind would be over 50 MB
    assert peak < 45_000_000


def test_rewritten_long_texts_have_their_segments(spark):
    from textloom.operators.forensics import rewritten

    text = " ".join(f"w{i % 900}" for i in range(3_000)) + "."
    docs = spark.createDataFrame([(2, text), (4, text)], DOCS)
    got = {k: sorted(tuple(r)[1:] for r in diff.diff_rows(rewritten(docs), "doc_id").where(f"doc_id = {k}").collect()) for k in (2, 4)}
    n = len(text)
    assert got[2] == [(0, "equal", 0, n, 0, n, 5_999), (1, "insert", n, n, n, n + 32, 6)]
    half = -(-n // 2)
    twice = text[:half] * 2
    assert [(p[1], *p[2:]) for p in got[4]] == diff.segments(text, twice) and sum(p[6] for p in got[4] if p[1] == "equal") > 3_000


def test_diff_rows(spark):
    pairs = spark.createDataFrame([(1, "a b", "a c"), (1, None, "x"), (2, "", None)], "doc_id bigint, source string, candidate string")
    got = sorted(tuple(r) for r in diff.diff_rows(pairs, "doc_id").collect())
    assert got == [(1, 0, "equal", 0, 2, 0, 2, 2), (1, 0, "insert", 0, 0, 0, 1, 1), (1, 1, "insert", 2, 2, 2, 3, 1), (1, 2, "delete", 2, 3, 3, 3, 1)]


def test_diffs_of_long_turns_equal_sql(spark):
    import duckdb

    from tests.compare import differences

    rows = [(1, 0, "a b " + "x" * 50_000), (1, 1, "a c " + "x" * 50_000), (1, 2, "é" * 81_000 + " c"), (1, 2, None), (1, 3, "é"), (2, 5, "y" * 81_000), (2, 6, ""), (3, 0, "\U0001f600 a" * 3), (3, 1, "\U0001f600 a a")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?)", rows)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = differences(diff.turn_diffs(turns), con, diff.TURN_DIFFS_SQL)
    assert got[0] == got[1] == 7 and got[2] == 0, got


def test_diffs_of_turns_of_many_segments(spark):
    import time

    rng = random.Random(9)
    source = [rng.choice("abcdefgh") + "é" * 60 for _ in range(4_000)]
    candidate = [x if rng.random() < 0.5 else rng.choice("abcdefgh") for x in source]
    turns = spark.createDataFrame([(k, i, " ".join(x)) for k in range(20) for i, x in enumerate((source, candidate))], "conv_id bigint, turn bigint, text string")
    began = time.monotonic()
    got = diff.turn_diffs(turns).collect()
    assert len(got) == 20 and all(r["rebuilt"] and r["n_equal"] + r["n_insert"] == r["n_equal"] + r["n_delete"] == 7_999 and r["n_equal"] > 5_900 for r in got)
    assert time.monotonic() - began < 30


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("  \n ", []),
        ("One here. Two there", ["One here.", "Two there"]),
        ("Dr. Smith met J. R. Jones. They left.", ["Dr. Smith met J. R. Jones.", "They left."]),
        ("It is 3.5 long. In the U.S. It ends.", ["It is 3.5 long.", "In the U.S. It ends."]),
        ("Wait... What? “Yes.” (No.) ok", ["Wait...", "What?", "“Yes.”", "(No.) ok"]),
        (" A lead. Etc. Then more etc. ", ["A lead.", "Etc. Then more etc."]),
        ("No stop etc.. Next one", ["No stop etc..", "Next one"]),
        ("ab\u0001cd. Ef gh! Ij", ["ab\u0001cd.", "Ef gh!", "Ij"]),
    ],
)
def test_sentence_spans_are_places_in_the_text(spark, text, want):
    got = sorted(tuple(r) for r in sentence_spans.sentence_spans(spark.createDataFrame([(1, text), (2, None)], DOCS)).collect())
    assert [text[s:e] for _, _, s, e, _, _ in got] == want
    assert [(w, ok) for *_, w, ok in got] == [(len(x.split()), len(x.split()) >= 5) for x in want]


def test_cadence_sentences(spark):
    df = spark.createDataFrame([(1, "We met Dr. Jones, e.g. at noon. \"Late.\" he said! 12. Bye ")], DOCS)
    assert df.select(sentence_spans.cadence_sentences(df["text"]).alias("x")).first()["x"] == ["We met Dr. Jones, e.g. at noon.", '"Late.', "he said!", "Bye"]


# --- mark-up ------------------------------------------------------------------------------


def one(spark, text, column):
    return spark.createDataFrame([(1, text)], DOCS).select(column.alias("x")).first()["x"]


def test_fences_close_by_mark_length_and_nothing_behind(spark):
    from pyspark.sql import functions as F

    from textloom.operators import markdown

    ranges = lambda t: [tuple(r) for r in one(spark, t, markdown.fence_ranges(F.col("text")))]
    assert ranges("no") == [] and ranges("") == []
    text = "a\n```py\nx\n``` no\n~~~\n````  \nb\n~~~\nopen"
    assert [text[a:b] for a, b in ranges(text)] == ["```py\nx\n``` no\n~~~\n````  ", "~~~\nopen"]
    assert ranges("    ```\nfour blanks\n    ```") == []
    masked = lambda t: one(spark, t, markdown.masked_code(F.col("text")))
    assert masked("x `a` y\n```\nb\n```\n``c ` d`` e ` f") == "x     y\n   \n \n   \n" + " " * 10 + "e ` f"
    assert masked("é `x\ny` z") == "é `x\ny` z"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# Head #\ntext", "Head\ntext"),
        ("Title\n=====\n\n\n\nmore  here ", "Title\n\nmore here"),
        ("**1. Step one**\n- *two* _x_", "Step one\ntwo x"),
        ("| a | **b** |\n|---|---|\n| c | |", "a, b\nc"),
        ("> > quote [t](u \"v\") ![i](j) <https://u>", "quote t  https://u".replace("  ", " ")),
        ("```py\n**code**\n```", "code"),
        (r"\*not\* **yes** \# x", "*not* yes # x"),
        ("a ~~b~~ <b>c</b> &amp; `d`\\", "a b c & d"),
        ("***\n---\nsnake_case_name", "snake_case_name"),
        ("x[^1] y\r\nz\\", "x y\nz"),
        ("", ""),
    ],
)
def test_without_markup(text, want):
    from textloom.operators import markdown

    assert markdown.without_markup(text) == want
    assert markdown.without_markup(want) == want or "*" in want or "#" in want


def test_blocks_and_outline(spark):
    from textloom.operators import markdown

    text = "# Sea birds\n**Where**\n- a\n- b\n\nLone line\n\nOne. Two.\nThree.\n\n- x\ny\nz\n\nAll sea birds fly."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS)
    got = sorted(tuple(r) for r in markdown.block_rows(docs).collect())
    assert [(k, c) for _, _, k, c in got] == [("heading", "Sea birds"), ("heading", "Where"), ("bullets", "- a\n- b"), ("heading", "Lone line"), ("para", "One. Two.\nThree."), ("para", "- x\ny\nz"), ("para", "All sea birds fly.")]
    rows = {r["doc_id"]: tuple(r)[1:] for r in markdown.outline(docs).collect()}
    assert rows == {1: ("Sea birds", 3, 2, 3, 1, False, True), 3: ("", 0, 0, 0, 0, False, False)}


# --- source maps -----------------------------------------------------------------------------


def test_runs_lead_back_to_the_source(spark):
    from pyspark.sql import functions as F

    from textloom.operators import source_maps

    html = "<p>a &amp; b</p><script>x<1</script>\U0001f600 é<br/>&#x41;&nope;<!-- c -->z"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")
    text = {r["page_id"]: r["visible"] for r in source_maps.visible(pages).collect()}
    assert text == {1: "\na & b\n" + " " * 20 + "\U0001f600 é\nA&nope;" + " " * 10 + "z", 3: ""}
    runs = sorted(tuple(r) for r in source_maps.source_runs(pages).collect())
    assert [r[1] for r in runs] == list(range(len(runs))) and {r[0] for r in runs} == {1}
    assert runs[0][2] == 0 and runs[-1][3] == len(text[1]) and all(a[3] == b[2] for a, b in zip(runs, runs[1:]))
    for _, _, vs, ve, ss, se, u in runs:
        shown, source = text[1][vs:ve], html[ss:se]
        assert shown == source or shown == "\n" or source.startswith(("&", " ", "<script", "<!--")) or not shown.strip()
        assert u == len(html[:ss].encode("utf-16-le")) // 2
    back = spark.createDataFrame([(i,) for i in range(8)], "u int").select(source_maps.code_point_place(F.lit("a\U0001f600b\U0001f600"), F.col("u"))).collect()
    assert [r[0] for r in back] == [0, 1, 1, 2, 3, 3, 4, 4]


def test_segments_of_a_batch_are_kept_as_numbers():
    import tracemalloc

    import pyarrow as pa

    pairs = [(" ".join(f"a{i} b{i % k}" for i in range(60)), " ".join(f"a{i} c{i % k}" for i in range(60))) for k in range(1, 101)]
    source, candidate = (pa.array([*side, None, None]) for side in zip(*pairs))
    tracemalloc.start()
    got = diff._text_diff(source, candidate)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = len(got.flatten())
    # six numbers of a segment as objects of a dictionary take some 500 bytes
    assert n > 10_000 and peak < 150 * n
    assert got[-1].as_py() == [] and [tuple(x.values()) for x in got[0].as_py()] == diff.segments(*pairs[0])


def test_long_texts_differ_as_fast_as_rows_of_whole_numbers():
    import random
    import time

    draw = random.Random(5)
    a = [draw.randrange(300) for _ in range(8000)]
    b = [x if draw.random() < 0.8 else draw.randrange(300) for x in a]
    began = time.process_time()
    got = diff.common(a, b)
    assert time.process_time() - began < 1.0 and all(a[i] == b[j] for i, j in got)
