"""Watermark scores, bootstraps and operating points against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import resampling
from textloom.operators import watermark

WRAP = (1 << 64) - 1


def plain_counts(tokens, key):
    """Windows, windows that count, set bits per key; written with Python's integers."""

    def fold(h, v):
        return ((h + v) * watermark.MULTIPLIER + 1) & WRAP

    history, n, counts, bits = [0] * key.history, 0, 0, [0] * len(key.keys)
    end = tokens.index(key.end_token) if key.end_token in tokens else len(tokens)
    for i in range(len(tokens) - key.window + 1):
        h = key.start
        for t in tokens[i : i + key.window - 1]:
            h = fold(h, t)
        new, history = h not in history, [*history[1:], h]
        n += 1
        if not new or i + key.window - 1 >= end:
            continue
        counts += 1
        h = fold(h, tokens[i + key.window - 1])
        for j, k in enumerate(key.keys):
            x = fold(h, k)
            for _ in range(12):
                x = fold(x, 1)
                x = ((x - (1 << 64) if x >> 63 else x) >> 5) & WRAP
            bits[j] += x >> 30 & 1
    return n, counts, bits


@pytest.mark.parametrize("history", [3, 1024])
def test_watermark_counts_equal_plain_integers(history):
    key = watermark.Key(watermark.DEMO_KEYS["beta"], history=history, end_token=9)
    rng = random.Random(history)
    texts = [[], [1, 2], [1, 2, 3, 4, 5], *[[rng.randrange(rng.choice([2, 9, 10, 50_000])) for _ in range(rng.randrange(80))] for _ in range(60)]]
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    n, counts, bits = watermark.counted(np.array([x for t in texts for x in t], np.int64), first, key)
    assert [(a, b, c) for a, b, c in zip(n.tolist(), counts.tolist(), bits.tolist())] == [plain_counts(t, key) for t in texts]


def test_watermark_scores(spark):
    key = watermark.Key((5,))
    rows = spark.createDataFrame([(1, list(range(100, 400))), (1, [1, 2]), (2, None)], "doc_id bigint, tokens array<bigint>")
    got = {(r["doc_id"], r["n_windows"]): r for r in watermark.scores(rows, key).collect()}
    n, counts, bits = plain_counts(list(range(100, 400)), key)
    r = got[1, 296]
    assert (r["n_counted"], r["mean"], r["weighted_mean"]) == (counts, round(bits[0] / counts, 6), round(bits[0] / counts, 6))
    assert abs(r["z"] - (bits[0] / counts - 0.5) / (0.25 / counts) ** 0.5) < 1e-5 and 0 < r["p"] < 1
    assert got[1, 0]["mean"] is None and got[2, 0]["p"] is None
    tails = spark.createDataFrame([(0.0,), (1.644854,), (-3.0,)], "z double").select(watermark.p_value(F.col("z"))).collect()
    assert [round(t[0], 5) for t in tails] == [0.5, 0.05, 0.99865]


def mulberry(seed):
    while True:
        seed = (seed + resampling.STEP) & 0xFFFFFFFF
        t = (seed ^ seed >> 15) * (seed | 1) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield (t ^ t >> 14) & 0xFFFFFFFF


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_paired_bootstrap_draws_as_one_generator_would(spark, monkeypatch, limit):
    monkeypatch.setattr(resampling, "MAX_BROADCAST_PAIRS", limit)
    rng = random.Random(3)
    pairs = [(f"k{i:03}", float(rng.randrange(5)), float(rng.randrange(4))) for i in range(37)]
    got = resampling.paired_bootstrap(spark.createDataFrame(pairs, "k string, a double, b double"), "k", iterations=200, seed=11).first()
    draws, d = mulberry(11), [a - b for _, a, b in pairs]
    means = sorted(sum(d[next(draws) * 37 // (1 << 32)] for _ in range(37)) / 37 for _ in range(200))
    at = lambda q: np.quantile(means, q)
    assert got["n"] == 37 and abs(got["estimate"] - sum(d) / 37) < 1e-12
    assert abs(got["lower"] - at(0.025)) < 1e-8 and abs(got["upper"] - at(0.975)) < 1e-8
    assert resampling.paired_bootstrap(spark.createDataFrame([], "k string, a double, b double"), "k").count() == 0


def test_cluster_bootstrap_is_reproducible_and_covers(spark):
    rng = random.Random(4)
    rows = [("g", f"c{c}", float(rng.random() < 0.3 + 0.4 * (c % 2))) for c in range(80) for _ in range(rng.randrange(1, 9))] + [(None, "only", 1.0)]
    df = spark.createDataFrame(rows, "g string, c string, v double")
    one, two = ({r["g"]: tuple(r) for r in resampling.cluster_bootstrap(x, "g", "c", "v").collect()} for x in (df, df.repartition(7)))
    assert one == two and one[None][1:] == (1, 1, 1.0, 1.0, 1.0)
    mean = np.mean([v for g, _, v in rows if g])
    by = {}
    for g, c, v in rows:
        if g:
            by.setdefault(c, []).append(v)
    keys = sorted(by)
    draws = [np.mean([v for c in rng.choices(keys, k=len(keys)) for v in by[c]]) for _ in range(2000)]
    low, high = np.quantile(draws, [0.025, 0.975])
    assert one["g"][4] < mean < one["g"][5] and abs(one["g"][4] - low) < 0.03 and abs(one["g"][5] - high) < 0.03
