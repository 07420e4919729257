"""Subword pieces, token-bounded segments, two-pass counts, operating points, against plain versions."""

from __future__ import annotations

import itertools
import random

import pytest

from textloom.functions import operating_points as op
from textloom.operators import gram_counts, wordpiece


def test_pieces_equal_the_public_library():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    signs = list("abcdefghijklmnopqrstuvwxyz0123456789.,!?'-_#$é中")
    vocabulary = [wordpiece.UNKNOWN, *signs, *[f"##{c}" for c in signs if c not in "é.,"], "the", "then", "##ing", "walk", "##s", "$", "##th"]
    vocabulary = list(dict.fromkeys(vocabulary))
    mine = wordpiece.WordPieces(vocabulary)
    other = Tokenizer(models.WordPiece({t: i for i, t in enumerate(vocabulary)}, unk_token=wordpiece.UNKNOWN, max_input_chars_per_word=100))
    other.normalizer, other.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    rng = random.Random(2)
    parts = ["The", "then", "walking", "walks", " ", " ", "é", "É", "中", "$5", "don't", " ", "\t", "x" * 101, "ß", "​", "ﬁ", ".", "w.w", "Ω"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert mine(text) == other.encode(text).ids, text


def test_segments_cover_and_fit():
    count = lambda s: sum(1 + s_.count("-") for s_ in s.split())
    assert wordpiece.segments("", count) == [(0, 0, 0, 2)] and wordpiece.segments(" a b ", count) == [(0, 5, 2, 4)]
    rng = random.Random(1)
    for n in (510, 511, 1020, 1021, 3000):
        text = " ".join("w" + "-" * rng.randrange(3) for _ in range(n)) + "  "
        got = wordpiece.segments(text, count)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert sum(g[2] for g in got) == n and all(g[3] <= 512 and g[3] == count(text[g[0] : g[1]]) + 2 for g in got)
        least = -(-count(text) // 510)
        assert least <= len(got) <= least + 1
    long = "a b " + "x-" * 600 + " c"
    got = wordpiece.segments(long, count)
    assert "".join(long[a:b] for a, b, _, _ in got) == long and [g[2] for g in got] == [2, 1, 0, 0, 1]


def test_two_passes_lose_no_gram(spark, monkeypatch):
    monkeypatch.setattr(gram_counts, "BITS", 3)  # nearly all share a bucket
    rng = random.Random(7)
    texts = [(" ".join(rng.choice(["red", "fox", "the", "of", "Fox’s"]) for _ in range(8)), rng.random() < 0.6) for _ in range(60)] + [(None, True), ("", False)]
    got = {r["gram"]: (r["n_target"], r["n_other"]) for r in gram_counts.frequent(spark.createDataFrame(texts, "text string, target boolean"), 4).collect()}
    want: dict = {}
    for text, target in texts:
        ws = (text or "").lower().replace("’", "'").split()
        for g in {tuple(ws[i : i + n]) for n in (2, 3, 4) for i in range(len(ws) - n + 1)}:
            if not all(w in gram_counts.STOPWORDS for w in g):
                want.setdefault(" ".join(g), [0, 0])[not target] += 1
    assert got == {g: tuple(n) for g, n in want.items() if n[0] >= 4} and len(got) > 20


@pytest.mark.parametrize("seed", range(4))
def test_best_cuts_equal_every_parting(spark, seed):
    rng = random.Random(seed)
    rows = [(c, float(rng.randrange(12) + 3 * i)) for i, c in enumerate("abc") for _ in range(rng.randrange(1, 30))] + [("x", 1.0), ("a", None)]
    got = op.best_cuts(spark.createDataFrame(rows, "label string, score double"), list("abc")).first()
    good = [(c, s) for c, s in rows if c in "abc" and s is not None]
    edges = [None, *sorted({s for _, s in good})]
    n = {c: sum(x == c for x, _ in good) for c in "abc"}
    best = 0.0
    for lo, hi in itertools.combinations_with_replacement(range(len(edges)), 2):
        below = lambda s, k: k > 0 and s <= edges[k]
        right = {c: sum(1 for x, s in good if x == c and {"a": below(s, lo), "b": not below(s, lo) and below(s, hi), "c": not below(s, hi)}[c]) for c in "abc"}
        best = max(best, sum(right[c] / n[c] for c in "abc") / 3)
    assert abs(got["balanced_accuracy"] - best) < 1e-8
    assert op.best_cuts(spark.createDataFrame([], "label string, score double"), ["a", "b"]).count() == 0


def test_joint_threshold_and_gap_equal_a_search(spark):
    rng = random.Random(9)
    rows = [("r" if i % 2 else "s", round(rng.random(), 6), None if i % 9 == 0 else round(rng.random() * 0.9, 6)) for i in range(80)]
    rows = [(r, max(a, b or 0), None if b is None else min(a, b)) for r, a, b in rows]
    got = op.joint_threshold(spark.createDataFrame(rows, "route string, first double, second double"), {"r": 5, "s": 3}).first()
    keys = sorted({round(max(a, (b or 0) / op.RATIO), 6) for _, a, b in rows})
    flagged = lambda p, route: sum(r == route and (a >= p or (b or 0) >= round(p * op.RATIO, 6)) for r, a, b in rows)
    want = next(p for p in [*keys, keys[-1] + 1e-6] if flagged(p, "r") <= 5 and flagged(p, "s") <= 3)
    assert abs(got["primary"] - want) < 1e-9 and abs(got["secondary"] - round(want * op.RATIO, 6)) < 1e-9
    margins = [(i % 2, a * 5 - 2, None if b is None else b * 4 - 2) for i, (_, a, b) in enumerate(rows)]
    fit = op.fitted_gap(spark.createDataFrame(margins, "side int, first double, second double"), 2).first()
    best = (-1,)
    for gap in range(0, 2_000_001, 20_000):
        micro = lambda x: int(x * 1e6 // 1) if x is not None else -(10**12)
        scored = [(side, max(int((round(a * 1e6, 3)) // 1), -(10**12) if b is None else int(round(b * 1e6, 3) // 1) + gap)) for side, a, b in margins]
        for t in {k for _, k in scored}:
            false = sum(s == 0 and k >= t for s, k in scored)
            if false <= 2:
                best = max(best, (sum(s == 1 and k >= t for s, k in scored), gap))
    assert (fit["n_found"], fit["gap"]) == best and fit["n_false"] <= 2


def test_pieces_are_remembered_by_what_stands_between_white_space():
    from textloom.operators.wordpiece import UNKNOWN, WordPieces, plain_words

    mine = WordPieces([UNKNOWN, "a", "b", "##b", "é", ",", "漢"])
    seen: list[str] = []
    of_word = mine.of_word
    mine.of_word = lambda word: seen.append(word) or of_word(word)
    text = "Ab,\x00b áb漢b a\x0bB Ab,\x00b x�​ Ab,\x00b"
    assert mine(text) == [x for w in plain_words(text) for x in of_word(w)] and mine.count(text) == len(mine(text))
    # each stretch is taken apart once, however often it comes
    assert len(seen) == len([w for chunk in dict.fromkeys(["Ab,\x00b", "áb漢b", "a", "B", "x�​"]) for w in plain_words(chunk)])
