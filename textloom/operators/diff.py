"""Differences of two texts: longest common subsequence of tokens in linear space, with places in both.

Tokens are runs of white space or of anything else.  Of all longest subsequences the
one is taken whose path, row by row of the source, lies at the earliest places of the
candidate.  A row of the table of common lengths is one addition of long whole numbers,
since within a row lengths only grow, by one at most.  Rows are made in blocks of
candidate tokens; of a long table only some are kept, and those between are made again
when the path comes to them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.operators.corpora import conversations
from textloom.operators.forensics import probed, rewritten
from textloom.operators.stylometry import documents

# Fixed value: white space of a token edge.
SPACE = "\\f\\n\\r\\t\\v \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TOKEN = re.compile(f"[{SPACE}]+|[^{SPACE}]+")
# How the table is made, without effect on results: candidate tokens of a block, and rows kept at once (so many bits in all, or so many rows if that is more).
BLOCK, KEPT_BITS, KEPT_ROWS = 8_192, 1 << 28, 512


def _masks(block: np.ndarray, wanted: set[int]) -> dict[int, int]:
    """wanted token: a whole number with a bit for each of its places in the block."""
    order = np.argsort(block, kind="stable")
    by_token = block[order]
    starts = np.flatnonzero(np.append(True, by_token[1:] != by_token[:-1]))
    kinds, bounds, places = by_token[starts].tolist(), [*starts.tolist(), len(block)], order.tolist()
    out = {}
    for x, lo, hi in zip(kinds, bounds, bounds[1:]):
        if x not in wanted:
            continue
        if hi - lo > 12:
            out[x] = int.from_bytes(np.packbits(block == x, bitorder="little").tobytes(), "little")
            continue
        bits = 0
        for r in places[lo:hi]:
            bits |= 1 << r
        out[x] = bits
    return out


def _block_rows(rows: list[int], block: np.ndarray, flat: int, carries: bytearray, step: int) -> list[int]:
    """Rows 0, step, 2 * step ... of the table over a block of b from its end, made from below; ``flat`` is the row below all.

    A row has a bit for each place where the common length of the rests of a and b does
    not rise.  ``carries`` says for each row whether the length rises from the row below at the
    block's begin, and then at its end.
    """
    find, full, kept = _masks(block, set(rows)).get, (1 << len(block)) - 1, []
    for i in range(len(rows) - 1, -1, -1):
        at, carry = find(rows[i], 0), carries[i]
        if at or carry:
            met = flat & at
            up = flat + met + carry
            if up > full:
                carries[i] = 1
                up &= full
            else:
                carries[i] = 0
            flat = up | (flat - met)
        if step == 1 or i % step == 0:
            kept.append(flat)
    return kept[::-1]


def _embedded(part: list[int], whole: list[int]) -> Sequence[int] | None:
    """The earliest places of all of part in whole, in order; None if it is no subsequence."""
    if whole[: len(part)] == part:
        return np.arange(len(part))
    out, at = [], -1
    for x in part:
        try:
            at = whole.index(x, at + 1)
        except ValueError:
            return None
        out.append(at)
    return out


def _path(a: list[int], b: list[int], block: int = BLOCK, kept_bits: int = KEPT_BITS, kept_rows: int = KEPT_ROWS) -> tuple[Sequence[int], Sequence[int]]:
    """Places in a and places in b of one longest common subsequence, ascending."""
    n, m = len(a), len(b)
    # a side that is a subsequence has one such path, with no table
    if n <= m and (found := _embedded(a, b)) is not None:
        return np.arange(n), found
    if m <= n and (found := _embedded(b[::-1], a[::-1])) is not None:
        return n - 1 - np.array(found, np.int64)[::-1], np.arange(m)
    most = max(kept_rows, kept_bits // m)
    back = np.array(b, np.int64)[::-1]
    left, right = [], []
    todo = [(0, n, [(1 << min(block, m - k)) - 1 for k in range(0, m, block)])]
    j = 0
    while todo and j < m:
        lo, hi, below = todo.pop()
        step = 1 if hi - lo <= most else ceil((hi - lo) / min(most, ceil((hi - lo) / most)))
        carries, begins, kept = bytearray(hi - lo), [], []
        # places before j are behind the path
        for k in range((m - j - 1) // block + 1):
            begins.append(bytes(carries))
            kept.append(_block_rows(a[lo:hi], back[k * block : (k + 1) * block], below[k], carries, step))
        if step > 1:
            for i in range((hi - lo - 1) // step, -1, -1):
                end = lo + (i + 1) * step
                todo.append((lo + i * step, min(end, hi), [rows[i + 1] for rows in kept] if end < hi else below))
            continue
        for rows, under in zip(kept, below):
            rows.append(under)
        k, part = divmod(m - j - 1, block)
        rows, begun = kept[k], begins[k]
        for i in range(hi - lo):
            x = a[lo + i]
            # is the subsequence of the rest shorter without this token of a? Mostly one bit tells
            if x == b[j]:
                if not rows[i + 1] >> part & 1:
                    continue
                q = j
            else:
                if not rows[i] >> part & 1:
                    continue
                mask = (2 << part) - 1
                if begun[i] + (rows[i + 1] & mask).bit_count() <= (rows[i] & mask).bit_count():
                    continue
                q = b.index(x, j)
            left.append(lo + i)
            right.append(q)
            part -= q + 1 - j
            j = q + 1
            if part < 0:
                if j == m:
                    break
                k, part = divmod(m - j - 1, block)
                rows, begun = kept[k], begins[k]
    return left, right


def common(a: Sequence[int], b: Sequence[int], **made: int) -> list[tuple[int, int]]:
    """Places (in a, in b) of one longest common subsequence, ascending."""
    return [(int(p), int(q)) for p, q in zip(*_path([*map(int, a)], [*map(int, b)], **made))]


OPS = ("equal", "insert", "delete")


def _segments(source: str, candidate: str, max_cells: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ``OPS``, and rows of places and tokens: what ``segments`` tells."""
    a = TOKEN.findall(source)
    if source == candidate:
        rows = [(0, 0, len(source), 0, len(source), len(a))] if source else []
        found = np.array(rows, np.int64).reshape(-1, 6)
        return found[:, 0], found[:, 1:]
    b = TOKEN.findall(candidate)
    n, m = len(a), len(b)
    if max_cells is not None and n * m > max_cells:
        rows = [(2, 0, len(source), 0, 0, n), (1, len(source), len(source), 0, len(candidate), m)]
        found = np.array([x for x in rows if x[5]], np.int64)
        return found[:, 0], found[:, 1:]
    number = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    p, q = (np.asarray(x, np.int64) for x in _path([*map(number.__getitem__, a)], [*map(number.__getitem__, b)]))
    sa, sb = (np.cumsum([0, *map(len, side)], dtype=np.int64) for side in (a, b))
    # stretches without a pair: before each pair, and behind all
    i0, i1, j0, j1 = np.append(0, p + 1), np.append(p, n), np.append(0, q + 1), np.append(q, m)
    put, left = np.flatnonzero(j1 > j0), np.flatnonzero(i1 > i0)
    apart = (j1 > j0) | (i1 > i0)
    apart[[0, -1]] = True
    edges = np.flatnonzero(apart) if len(p) else np.zeros(0, np.int64)
    first, last = edges[:-1], edges[1:] - 1
    order = np.argsort(np.concatenate((3 * first + 2, 3 * put, 3 * left + 1)), kind="stable")
    ops = np.repeat(np.arange(3), (len(first), len(put), len(left)))
    columns = (
        (sa[p[first]], sa[i0[put]], sa[i0[left]]),
        (sa[p[last] + 1], sa[i0[put]], sa[i1[left]]),
        (sb[q[first]], sb[j0[put]], sb[j1[left]]),
        (sb[q[last] + 1], sb[j1[put]], sb[j1[left]]),
        (last - first + 1, (j1 - j0)[put], (i1 - i0)[left]),
    )
    return ops[order], np.stack([np.concatenate(x)[order] for x in columns], axis=1)


def segments(source: str, candidate: str, max_cells: int | None = None) -> list[tuple[str, int, int, int, int, int]]:
    """(op, source start and end, candidate start and end, tokens): equal, insert and delete segments in order; insertions come first.

    Pairs of any size are compared token by token.  Only a caller that gives ``max_cells`` (no query
    does) has pairs with more cells in their table told as one deletion and one insertion.
    """
    ops, places = _segments(source, candidate, max_cells)
    return [(OPS[op], *row) for op, row in zip(ops.tolist(), places.tolist())]


_PLACES = ("source_start", "source_end", "candidate_start", "candidate_end", "n_tokens")
SEGMENTS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *[T.StructField(x, T.LongType()) for x in _PLACES]]))


def _text_diff(source: pa.Array, candidate: pa.Array) -> pa.Array:
    # numbers are kept as such: a dictionary for each segment of a batch takes some hundred bytes, and a row has hundreds
    ops, places, sizes = array("b"), array("q"), np.zeros(len(source) + 1, np.int32)
    for i in range(len(source)):
        op, rows = _segments(source[i].as_py() or "", candidate[i].as_py() or "")
        sizes[i + 1] = len(op)
        ops.frombytes(op.astype(np.int8).tobytes())
        places.frombytes(rows.tobytes())
    columns = np.frombuffer(places, np.int64).reshape(-1, len(_PLACES)) if places else np.zeros((0, len(_PLACES)), np.int64)
    names = pa.DictionaryArray.from_arrays(pa.array(np.array(ops, np.int8)), list(OPS)).cast(pa.string())
    rows = pa.StructArray.from_arrays([names, *[pa.array(np.ascontiguousarray(columns[:, k])) for k in range(len(_PLACES))]], ["op", *_PLACES])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), rows)


def text_diff(source: str, candidate: str) -> Column:
    """Segments of each pair; a null text is empty."""
    return F.arrow_udf(_text_diff, SEGMENTS)(source, candidate)


def diff_rows(pairs: DataFrame, *keys: str) -> DataFrame:
    """One row per segment of (source, candidate), with the key columns and its place; places are code points.

    Pairs are independent: no shuffle, and rows that repeat a key stay apart.  Equal
    empty texts have no row.
    """
    return pairs.select(*keys, F.posexplode(text_diff("source", "candidate")).alias("place", "s")).select(*keys, F.col("place").cast("bigint").alias("place"), "s.*")


TOLD = T.StructType([*[T.StructField(f"n_{x}", T.LongType()) for x in OPS], T.StructField("rebuilt", T.BooleanType())])


def _told(source: pa.Array, candidate: pa.Array) -> pa.Array:
    """Tokens of each kind of segment, and whether the segments' pieces make up both texts; a null text is empty."""
    counts, rebuilt = np.zeros((len(source), len(OPS)), np.int64), []
    for i in range(len(source)):
        s, c = source[i].as_py() or "", candidate[i].as_py() or ""
        left, right = [], []
        for op, s0, s1, c0, c1, n in segments(s, c):
            counts[i, OPS.index(op)] += n
            if op != "insert":
                left.append(s[s0:s1])
            if op != "delete":
                right.append(c[c0:c1])
        rebuilt.append("".join(left) == s and "".join(right) == c)
    return pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(x)) for x in counts.T], pa.array(rebuilt, pa.bool_())], TOLD.names)


def turn_diffs(turns: DataFrame) -> DataFrame:
    """Each turn against the one before it: tokens kept, put in and left out, and whether the segments rebuild both texts."""
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("candidate")).join(before, ["conv_id", "turn"])
    # a substring of the engine counts a text's characters from its begin, once for each of thousands of segments
    return pairs.select("conv_id", "turn", F.arrow_udf(_told, TOLD)("source", "candidate").alias("d")).select("conv_id", "turn", "d.*")


_RANGES = r"\f\n\r\t\v \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_TOKENS = lambda x: f"regexp_extract_all(coalesce({x}, ''), '[{_RANGES}]+|[^{_RANGES}]+')"
TURN_DIFFS_SQL = f"""
WITH RECURSIVE p AS (SELECT y.conv_id, y.turn, {_TOKENS("x.text")} AS a, {_TOKENS("y.text")} AS b FROM conversations y JOIN conversations x ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn),
r AS (SELECT row_number() OVER () AS id, * FROM p),
t AS (SELECT id, 0 AS i, list_transform(range(len(b) + 1), lambda z: 0::BIGINT) AS w FROM r
  UNION ALL SELECT t.id, t.i + 1, list_reduce(list_transform(range(1, len(r.b) + 1), lambda j: [j]), lambda acc, e: list_append(acc, greatest(acc[len(acc)], t.w[e[1] + 1], CASE WHEN r.a[t.i + 1] = r.b[e[1]] THEN t.w[e[1]] + 1 ELSE 0 END)), [0::BIGINT])
  FROM t JOIN r ON r.id = t.id WHERE t.i < len(r.a)),
f AS (SELECT id, w[len(w)] AS n FROM t JOIN r USING (id) WHERE i = len(r.a))
SELECT conv_id, turn, n::BIGINT AS n_equal, (len(b) - n)::BIGINT AS n_insert, (len(a) - n)::BIGINT AS n_delete, true AS rebuilt FROM f JOIN r USING (id)
"""
QUERIES = {
    "turn_diffs": lambda s, d: turn_diffs(conversations(s, d)),
    "rewrite_diff": lambda s, d: diff_rows(rewritten(probed(documents(s, d))), "doc_id"),
}
ORACLE_SQL = {"turn_diffs": TURN_DIFFS_SQL}
