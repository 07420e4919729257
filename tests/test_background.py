"""Surprisal of words: no row per word and document of frequent words, and the same results however many words are frequent."""

from __future__ import annotations

import contextlib
import io
import math

import pytest

from textloom.operators import background
from textloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
TEXTS = [(1, "A a b"), (2, "b c'd É é\u0085x " + "z" * 300), (2, "a"), (3, None), (4, "12 ."), (5, "a"), (None, "b a")]


def test_words_are_counted_in_slices(spark):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        QUERIES["word_surprisal"](spark, SF).explain("extended")
    assert "explode" not in plan.getvalue() and "Join" not in plan.getvalue() and "MapInArrow" in plan.getvalue()


def plain(rows):
    words = {}
    for i, t in rows:
        words.setdefault(i, []).extend("".join(c if c.isalpha() or c == "'" else " " for c in (t or "").lower()).split())
    n = {}
    for ws in words.values():
        for w in ws:
            n[w] = n.get(w, 0) + 1
    rank = {w: i + 1 for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w)))}
    bits = {w: math.log2((sum(n.values()) + len(n) + 1) / (k + 1)) for w, k in n.items()}
    out = {}
    for i, ws in words.items():
        if ws:
            mean = sum(bits[w] for w in ws) / len(ws)
            sd = math.sqrt(max(0.0, sum(bits[w] ** 2 for w in ws) / len(ws) - mean * mean))
            out[i] = (len(ws), mean, sd, sum(bits[w] > 3.2 for w in ws) / len(ws), *[sum(rank[w] <= r for w in ws) / len(ws) for r in (1, 3)])
    return out


@pytest.mark.parametrize(("frequent", "longest"), [(65_536, 100), (3, 100), (5, 1), (65_536, 1_000)])
def test_surprisal_whatever_is_frequent(spark, monkeypatch, frequent, longest):
    monkeypatch.setattr(background, "FREQUENT", frequent)
    monkeypatch.setattr(background, "LONGEST", longest)
    monkeypatch.setattr(background, "RANKS", (1, 3))
    monkeypatch.setattr(background, "RARE_BITS", 3.2)
    got = {r["doc_id"]: tuple(r)[1:] for r in background.surprisal(spark.createDataFrame(TEXTS, DOCS)).collect()}
    want = plain(TEXTS)
    assert got.keys() == want.keys() == {1, 2, 5, None}
    for i, row in got.items():
        assert row == pytest.approx(want[i], abs=1e-4), i


def test_no_word_no_row(spark):
    assert background.surprisal(spark.createDataFrame(TEXTS[3:5], DOCS)).count() == 0
    assert background.surprisal(spark.createDataFrame([], DOCS)).count() == 0
