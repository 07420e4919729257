"""Scores of a keyed text watermark: 64-bit hash chains over token windows, masks, means and p-values.

A window of tokens is folded into a hash that starts from the keys' digest; each key
then gives one bit per window.  Windows whose context stood there among the last
``history`` contexts do not count, nor do those from the end mark on.  In a text
without the watermark half of the bits are set.  Windows are computed for many
texts at once; 64-bit words wrap around as the scheme asks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.stylometry import documents

# Generator, rounds and shift of the hash, the bit read, window and history, and three public demonstration keys.
MULTIPLIER, INCREMENT, ROUNDS, SHIFT, BIT = 6364136223846793005, 1, 12, 5, 30
DEMO_KEYS = {"alpha": (2101, 4229, 6317, 8443, 10501, 12611), "beta": (3313, 5449, 7523, 9601, 11731, 13807), "gamma": (4421, 6521, 8623, 10709, 12821, 14923)}
END_TOKEN = 50256
# Fixed coefficients of the error function's approximation, highest power first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


@dataclass(frozen=True)
class Key:
    keys: tuple[int, ...]
    window: int = 5
    history: int = 1024
    end_token: int = END_TOKEN

    @property
    def start(self) -> int:
        """Digest of the keys as little-endian 64-bit numbers, below 2^63 - 1."""
        raw = b"".join(k.to_bytes(8, "little", signed=True) for k in self.keys)
        return int.from_bytes(hashlib.sha256(raw).digest(), "big") % ((1 << 63) - 1)

    @property
    def weights(self) -> list[float]:
        """Falling from 10 to 1 over the keys, as many in sum as there are keys."""
        n = len(self.keys)
        ramp = [10 - 9 * i / (n - 1) for i in range(n)] if n > 1 else [1.0]
        return [w * n / sum(ramp) for w in ramp]


#: Tokens that are counted at a time, unless one text is longer.
PIECE_TOKENS = 1 << 18


def folded(h: np.ndarray, value: np.ndarray | np.uint64) -> np.ndarray:
    return (h + value) * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)


def key_bits(h: np.ndarray, key: int) -> np.ndarray:
    """A bit per window hash."""
    x = folded(h, np.uint64(key))
    for _ in range(ROUNDS):
        x = (folded(x, np.uint64(1)).view(np.int64) >> SHIFT).view(np.uint64)
    return (x >> np.uint64(BIT)) & np.uint64(1)


def counted(tokens: np.ndarray, first: np.ndarray, key: Key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: windows, windows that count, and set bits of each key among those.  first: a text's first token, and the end."""
    n_texts, n, size = len(first) - 1, len(tokens), key.window
    text = np.repeat(np.arange(n_texts), np.diff(first))
    at = np.flatnonzero(text[: max(0, n - size + 1)] == text[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    home = text[at]
    h = np.full(len(at), key.start, np.uint64)
    for i in range(size - 1):
        h = folded(h, tokens[at + i].astype(np.uint64))
    # a context that stood there within the history; the history begins with zeros
    order = np.lexsort((at, h, home))
    again = (h == 0) & (at - first[home] < key.history)
    near = np.flatnonzero((home[order][1:] == home[order][:-1]) & (h[order][1:] == h[order][:-1]) & (at[order][1:] - at[order][:-1] <= key.history))
    again[order[near + 1]] = True
    ends = np.flatnonzero(tokens == key.end_token)
    last = np.full(n_texts, n, np.int64)
    np.minimum.at(last, text[ends], ends)
    counts = ~again & (at + size - 1 < last[home])
    h = folded(h[counts], tokens[at[counts] + size - 1].astype(np.uint64))
    bits = [np.bincount(home[counts], weights=key_bits(h, k), minlength=n_texts).astype(np.int64) for k in key.keys]
    return np.bincount(home, minlength=n_texts), np.bincount(home[counts], minlength=n_texts), np.stack(bits, axis=1)


def pieces(batch: pa.RecordBatch, tokens: int = PIECE_TOKENS) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece holds about so many tokens, or one longer text: counting takes some hundred bytes a token."""
    ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + tokens, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def p_value(z: Column) -> Column:
    """One-sided tail of the normal distribution."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    sum_ = F.lit(ERFC[0])
    for c in ERFC[1:]:
        sum_ = sum_ * t + F.lit(c)
    tail = t * F.exp(-x * x + sum_)
    return F.when(z >= 0, tail).otherwise(2 - tail) / 2


def scores(rows: DataFrame, key: Key, tokens: str = "tokens") -> DataFrame:
    """(doc_id, n_windows, n_counted, mean, weighted_mean, z, p) of rows (doc_id, array of token ids).

    Texts with no window that counts have null scores.  Row by row: no shuffle, and
    rows that repeat a doc_id stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in pieces(batch)):
            lists = part.column(1)
            first = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            n_windows, n_counted, bits = counted(lists.flatten().to_numpy(zero_copy_only=False), first, key)
            values = pa.array(bits.reshape(-1), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_windows, pa.int64()), pa.array(n_counted, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * len(key.keys), pa.int32()), values)], names=["doc_id", "n_windows", "n_counted", "bits"])

    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens).mapInArrow(run, "doc_id bigint, n_windows bigint, n_counted bigint, bits array<bigint>")
    depth = len(key.keys)
    whole = F.try_divide(sum((F.col("bits")[i] for i in range(depth)), F.lit(0)), F.col("n_counted") * depth)
    weighted = F.try_divide(sum((F.col("bits")[i] * F.lit(w) for i, w in enumerate(key.weights)), F.lit(0.0)), F.col("n_counted") * depth)
    out = got.select("doc_id", "n_windows", "n_counted", whole.alias("mean"), weighted.alias("weighted_mean"))
    z = F.when(F.col("n_counted") > 0, (F.col("mean") - 0.5) * 2 * F.sqrt(F.col("n_counted") * F.lit(float(depth))))
    return out.withColumn("z", z).select("doc_id", "n_windows", "n_counted", F.round("mean", 6).alias("mean"), F.round("weighted_mean", 6).alias("weighted_mean"), F.round("z", 6).alias("z"), F.round(p_value(F.col("z")), 6).alias("p"))


def word_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): a number below END_TOKEN + 1 for each word, by its digest."""
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % (END_TOKEN + 1)
    return docs.where("text is not null").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)), number).alias("tokens"))


def _sql(key: Key) -> str:
    depth, wrap = len(key.keys), f"{(1 << 64) - 1}::UHUGEINT"
    fold = lambda h, v: f"((((({h} + {v}) & {wrap}) * {MULTIPLIER}::UHUGEINT) + {INCREMENT}) & {wrap})"
    chain = lambda n: f"list_reduce([{key.start}::UHUGEINT] || list_transform(t[i:i + {n - 1}], lambda x: x::UHUGEINT), lambda a, x: {fold('a', 'x')})"
    fill = (1 << 64) - (1 << (64 - SHIFT))
    shifted = lambda x: f"({x} >> {SHIFT}) + CASE WHEN {x} >= {1 << 63}::UHUGEINT THEN {fill}::UHUGEINT ELSE 0::UHUGEINT END"
    rounds = ", ".join(f"x{i + 1} AS (SELECT id, k, {shifted('y')} AS x FROM (SELECT id, k, {fold('x', '1::UHUGEINT')} AS y FROM x{i}))" for i in range(ROUNDS))
    keys = ", ".join(f"({i}, {k})" for i, k in enumerate(key.keys))
    x = "abs(z) / sqrt(2.0)"
    poly = f"{ERFC[0]}::DOUBLE"
    for c in ERFC[1:]:
        poly = f"({poly} * t + {c}::DOUBLE)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, list_transform(regexp_extract_all(text, '[^ \\t\\n\\r]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {END_TOKEN + 1}) AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT id, t, i, list_position(t, {key.end_token}) AS e FROM (SELECT id, t, unnest(range(1, len(t) - {key.window - 2})) AS i FROM d)),
c AS (SELECT *, {chain(key.window - 1)} AS c FROM w),
l AS (SELECT *, i - lag(i) OVER (PARTITION BY id, c ORDER BY i) AS gap FROM c),
m AS (SELECT *, coalesce(gap > {key.history}, true) AND NOT (c = 0 AND i <= {key.history}) AND (e IS NULL OR e = 0 OR i + {key.window - 1} < e) AS ok FROM l),
h AS MATERIALIZED (SELECT id, {fold('c', f't[i + {key.window - 1}]::UHUGEINT')} AS h FROM m WHERE ok),
x0 AS (SELECT id, k, {fold("h", "v::UHUGEINT")} AS x FROM h, (VALUES {keys}) AS t(k, v)), {rounds},
b AS (SELECT id, count(*) FILTER (k = 0) AS n, {", ".join(f"(sum(((x >> {BIT}) & 1::UHUGEINT)::BIGINT) FILTER (k = {i}))::BIGINT AS b{i}" for i in range(depth))} FROM x{ROUNDS} GROUP BY id),
n AS (SELECT id, count(*) AS n_windows FROM w GROUP BY id),
s AS (SELECT doc_id, coalesce(n_windows, 0)::BIGINT AS n_windows, coalesce(n, 0)::BIGINT AS n_counted, ({" + ".join(f"b{i}" for i in range(depth))}) / (n * {depth}) AS mean, ({" + ".join(f"b{i} * {v}::DOUBLE" for i, v in enumerate(key.weights))}) / (n * {depth}) AS weighted_mean FROM d LEFT JOIN n USING (id) LEFT JOIN b USING (id)),
z AS (SELECT *, (mean - 0.5::DOUBLE) * 2 * sqrt(n_counted * {depth}.0::DOUBLE) AS z FROM s), y AS (SELECT *, 1 / (1 + {x} / 2) AS t FROM z), p AS (SELECT *, t * exp(-({x}) * ({x}) + {poly}) AS tail FROM y)
SELECT doc_id, n_windows, n_counted, round(mean, 6) AS mean, round(weighted_mean, 6) AS weighted_mean, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN tail ELSE 2 - tail END / 2, 6) AS p FROM p
"""


QUERIES = {"watermark_scores": lambda s, d: scores(word_tokens(documents(s, d)), Key(DEMO_KEYS["alpha"]))}
ORACLE_SQL = {"watermark_scores": _sql(Key(DEMO_KEYS["alpha"]))}
