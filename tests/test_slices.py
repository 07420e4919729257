"""Queries that go over texts in Arrow slices: no expression per character or word of a text is left, and odd ends are read as the SQL reads them."""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pyarrow as pa
import pytest

from textloom.functions import scan
from textloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sentence_spans", "ngram_repetition", "safe_fixes", "lookalike_words", "integrity_status", "carrier_findings", "frequent_grams"])
def test_plan_has_no_function_per_element(spark, name):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES[name](spark, SF).explain("extended")
    assert "lambda" not in plan.getvalue() and "MapInArrow" in plan.getvalue()


def test_a_next_line_at_the_end_is_no_space(spark):
    from textloom.operators.sentence_spans import sentence_spans

    got = sentence_spans(spark.createDataFrame([(1, "One two \u0085"), (2, "Dr. A. B went. So \U0001f600 it. ﻿"), (3, ""), (4, None)], "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 9, 3, False), (2, 0, 0, 14, 4, False), (2, 1, 15, 23, 3, False)]


def test_a_flag_ends_at_a_line_break(spark):
    from textloom.operators.carriers import carrier_findings

    got = carrier_findings(spark.createDataFrame([(1, "\U0001f3f4\U000e0067\n\U000e0062")], "doc_id bigint, text string")).collect()
    assert [(r["start"], r["tier"]) for r in got] == [(1, "excluded"), (3, "deliberate")]


def test_words_of_slices_end_where_texts_do():
    texts = pa.array(["skip", "Ab'c Ünï-x", "", "x", "xx É", "ʀ1ab"]).slice(1)
    codes, owner, kinds = scan.latin_words(texts)
    assert [(int(i), kinds[c]) for i, c in zip(owner, codes, strict=True)] == [(0, "ab'c"), (0, "ünï"), (0, "x"), (2, "x"), (3, "xx"), (3, "é"), (4, "ab")]
    assert np.array_equal(scan.latin_words(pa.array(["", "1"]))[0], []) and scan.latin_words(pa.array([], pa.string()))[2] == []


def test_words_of_grams_begin_with_a_letter():
    from textloom.operators import gram_counts

    codes, owner, kinds = gram_counts._words(pa.array(["''It’s 'A", "'", "", "b'", "'c d1e"]))
    assert [(int(i), kinds[c]) for i, c in zip(owner, codes, strict=True)] == [(0, "it's"), (0, "a"), (3, "b'"), (4, "c"), (4, "d"), (4, "e")]


@pytest.mark.parametrize("name", ["document_measures"])
def test_plan_goes_over_slices(spark, name):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES[name](spark, SF).explain("extended")
    assert "lambda" not in plan.getvalue() and "MapInArrow" in plan.getvalue()


def test_measures_of_odd_texts(spark):
    from textloom.operators.document_measures import measures

    texts = ["One two. Was given. \n \t\nThe it's.' Ünï ended!\r\nWhy?\u0085", "'.' 1", "?", "", None, "a\n\nb\n\nc\n\n" + "d " * 497, "x" + "\n\n" * 3 + "y"]
    got = {r["doc_id"]: r for r in measures(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert sorted(got) == [0, 1, 5, 6]  # a text of words without a sentence, or the other way round, has no row
    first = got[0].asDict()
    # 10 words, the quote among them; sentences: One two / Was given / The it's ' Ünï ended / Why, whose last character is no space
    assert [first[k] for k in ("question_rate", "exclaim_rate", "passive_rate", "range_sent_len", "n_paragraphs", "mean_para_words", "the_opener_rate", "distinct_opener_ratio", "max_opener_repeat")] == [0.0, 0.25, 0.25, 4.0, 2.0, 5.0, 0.25, 1.0, 0.25]
    assert (got[5]["n_paragraphs"], got[5]["tail_paragraphs"], got[5]["even_paragraphs"], got[5]["ttr_400"]) == (4.0, 1.0, 0.0, 0.01)
    assert (got[6]["n_paragraphs"], got[6]["word_entropy"], got[6]["cv_para_words"], got[6]["autocorr_1"]) == (2.0, 1.0, 0.0, 0.0)


def test_tallies_are_the_same_by_sorting_and_by_counting():
    owner, codes = np.array([2, 0, 2, 2, 5]), np.array([1, 0, 1, 0, 1])
    want = [(0, 0, 1), (2, 0, 1), (2, 1, 2), (5, 1, 1)]
    for n, kinds in ((6, 2), (600, 200)):
        assert list(zip(*(x.tolist() for x in scan.tallies(owner, codes, n, kinds)), strict=True)) == want
    assert [len(x) for x in scan.tallies(owner[:0], codes[:0], 0, 0)] == [0, 0, 0]


@pytest.mark.parametrize("name", ["document_outline", "text_blocks"])
def test_plan_of_blocks_goes_over_slices(spark, name):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES[name](spark, SF).explain("extended")
    assert "lambda" not in plan.getvalue() and "MapInArrow" in plan.getvalue()


def test_blocks_of_odd_texts():
    from textloom.operators import markdown

    texts = ["", " \n\n", "# A\rb\n**B:**\n**c.**\n\n \f\n  - x\ny\n2) z\n \x0b\n", "####### no\n\n- one\n\n**`D` [e](f)** \n**G**:", "\nlast"]
    owner, kinds, content = markdown.blocks(pa.array(["skip", *texts]).slice(1))
    got = [(i, markdown.NAMES[k].as_py(), c) for i, k, c in zip(owner.tolist(), kinds.tolist(), content.to_pylist(), strict=True)]
    # a vertical tab is no white space, a carriage return ends no line
    assert got == [
        (2, "heading", "A\rb"), (2, "heading", "B:"), (2, "para", "c."), (2, "bullets", "  - x\ny\n2) z\n \x0b"),
        (3, "heading", "####### no"), (3, "para", "- one"), (3, "heading", "D e"), (3, "heading", "G"), (4, "heading", "last"),
    ]
    empty = markdown.blocks(pa.array([], pa.string()))
    assert [len(x) for x in empty] == [0, 0, 0] and [len(x) for x in markdown._outlined(pa.array([], pa.string()))[1]] == [0] * 7


def test_outline_of_odd_texts(spark):
    from textloom.operators.markdown import outline

    texts = ["# The cats of Rome\n\nHere are cats of Rome.", "# The of cats\n\nthe of cats", "In summary: x, y.\n\nFinal words", "Two cats sit.\n\n- a\n- b", None, "x\n\nConclusion\n\ny. \n\nz."]
    got = {r["doc_id"]: tuple(r)[1:] for r in outline(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {
        0: ("The cats of Rome", 1, 1, 1, 0, False, True), 1: ("The of cats", 2, 0, 0, 0, False, False), 2: ("In summary: x, y.", 1, 0, 1, 0, True, True),
        3: ("Two cats sit.", 0, 0, 1, 1, False, True), 5: ("x", 2, 1, 2, 0, True, False),
    }
