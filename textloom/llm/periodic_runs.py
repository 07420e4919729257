"""Runs of repeated word sequences, by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one by one.  The path from the new
prefix's state to the root holds its suffixes; a splay tree per path segment keeps
the end of the segment's latest occurrence as its colour.  Access to the new state
walks the segments and recolours them: if a segment was last met p words before
and its longest suffix has p words or more, a square of period p ends here, and
that suffix reaches back to where the repetition began.  Squares of one start and
period are one run.  The latest earlier occurrence of a square's root lies one
period back only if the root is no power itself, so every period is the smallest.

Words that no run can hold never reach the automaton: in a run each sequence of
GRAM words occurs again within one period, and a run is at least ``times`` periods
long.  Stretches of a document that fail this, as all plain prose does, are passed
over; stretches that remain hold every run as a whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import WORD, row_chunks, span_codes, strings, word_spans


@dataclass(frozen=True)
class RunRule:
    least: int = 6  # words of a run
    times: int = 4  # periods of a run, 2 or more

    @property
    def gram(self) -> int:
        """Longest sequence that every run holds twice at least at each of its places."""
        return max(1, min(max(self.least, self.times * q) - 2 * q + 1 for q in range(1, self.least + 1)))


class PathForest:
    """Suffix automaton whose link tree is kept as coloured paths in splay trees."""

    def __init__(self, n: int) -> None:
        size = 2 * n + 2
        self.length, self.link = array("i", bytes(4 * size)), array("i", [-1]) * size
        # most states have one transition; the further ones of others are in ``more``
        self.word, self.to, self.more = array("i", [-1]) * size, array("i", bytes(4 * size)), {}
        # splay trees: ``up`` of a tree's root is the path's parent state; ``end`` is the colour, valid at roots
        self.up, self.left, self.right, self.end = array("i", [-1]) * size, array("i", [-1]) * size, array("i", [-1]) * size, array("i", bytes(4 * size))
        self.states, self.last = 1, 0

    def extend(self, c: int) -> int:
        """Append word c; returns the state of the whole prefix."""
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        new = self.states
        self.states += 1
        length[new] = length[self.last] + 1
        p = self.last
        q = -1
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    q = others[c]
                    break
                else:
                    others[c] = new
            p = link[p]
        if q < 0:
            link[new] = 0
        elif length[p] + 1 == length[q]:
            link[new] = q
        else:
            link[new] = self._split(p, q, c)
        self.up[new] = link[new]
        self.last = new
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        """Part the short strings of state q off into a state above it, on the same path."""
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        half = self.states
        self.states += 1
        length[half], link[half], word[half], to[half] = length[p] + 1, link[q], word[q], to[q]
        if q in more:
            more[half] = dict(more[q])
        while p >= 0:
            if word[p] == c:
                if to[p] != q:
                    break
                to[p] = half
            else:
                others = more.get(p)
                if others is None or others.get(c) != q:
                    break
                others[c] = half
            p = link[p]
        link[q] = half
        self._splay(q)
        above = self.left[q]
        self.left[q], self.up[half], self.left[half] = half, q, above
        if above >= 0:
            self.up[above] = half
        return half

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if g >= 0 and left[g] == p:
            left[g] = x
        elif g >= 0 and right[g] == p:
            right[g] = x
        else:
            self.end[x] = self.end[p]  # p was the root
        if left[p] == x:
            mid = left[p] = right[x]
            right[x] = p
        else:
            mid = right[p] = left[x]
            left[x] = p
        if mid >= 0:
            up[mid] = p
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, new: int, i: int) -> list[tuple[int, int]]:
        """Make the path to state ``new`` one segment of colour i; returns (colour, longest suffix) of those it was."""
        up, right, end, length = self.up, self.right, self.end, self.length
        met, below, at = [], new, up[new]
        while at >= 0:
            self._splay(at)
            met.append((end[at], length[at]))
            off = right[at]
            if off >= 0:
                end[off] = end[at]
            right[at], up[below] = below, at
            below, at = at, up[at]
        end[below] = i
        self._splay(new)
        return met


def squares_to_runs(words: list[int], rule: RunRule) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    forest, until = PathForest(len(words)), {}
    for i, c in enumerate(words):
        for e, longest in forest.access(forest.extend(c), i):
            if longest and i - e <= longest:
                until[e - longest + 1, i - e] = i
    found = ((start, last - start + 1, p) for (start, p), last in until.items())
    return sorted((s, n, p) for s, n, p in found if n >= max(rule.least, rule.times * p))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number below their count per pair of numbers, equal for equal pairs only."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1]


def stretches(codes: np.ndarray, first: np.ndarray, rule: RunRule) -> list[tuple[int, int]]:
    """Word ranges, each within one document, outside which there is no run.

    codes: a number per word below the count of words; first: per document the index of its first word.
    """
    n, k = len(codes), rule.gram
    if n < max(k, rule.least):
        return []
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    gram = codes[at]
    for step in range(1, k):
        gram = _pairs(gram, codes[at + step])
    order = np.lexsort((at, gram, doc[at]))
    ranked, key, home = at[order], gram[order], doc[at[order]]
    near = np.full(n, n + 1, np.int64)
    same = np.flatnonzero((key[1:] == key[:-1]) & (home[1:] == home[:-1]))
    gap = ranked[same + 1] - ranked[same]
    near[ranked[same]] = gap
    np.minimum.at(near, ranked[same + 1], gap)
    word = near.copy()  # the nearest return of a sequence that covers the word
    for step in range(1, k):
        word[step:] = np.minimum(word[step:], near[:-step])
    alive = word <= n
    for _ in range(12):  # further rounds would only cut more
        lo, hi = _ranges(alive, first)
        room = np.zeros(n, np.int64)
        room[alive] = np.repeat(hi - lo, hi - lo)
        keep = alive & (rule.times * word <= room) & (room >= rule.least)
        if (keep == alive).all():
            break
        alive = keep
    lo, hi = _ranges(alive, first)
    return list(zip(lo.tolist(), hi.tolist()))


def _ranges(alive: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True, cut at document edges."""
    edge = np.zeros(len(alive) + 1, bool)
    edge[first] = True
    begins, ends = alive.copy(), alive.copy()
    begins[1:] &= ~alive[:-1] | edge[1:-1]
    ends[:-1] &= ~alive[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, rule: RunRule = RunRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the runs (by start, then period) and the text with each run collapsed to one period, for every row; no shuffle.

    A run keeps its first period; its further words go, even where another run
    begins with them.  The words left are joined by one blank.  Null and empty
    texts have no words, no runs and an empty collapsed text.  Repeated rows give
    equal rows.  A long text is one text: a task holds the words of about 2 MB of
    texts, or of one longer one, and an automaton of about 80 bytes per word of
    one stretch.  Columns besides id and text are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in row_chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = word_spans(part, at)
                codes = span_codes(part, starts, ends)[0].astype(np.int64) if len(starts) else starts
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for a, b in stretches(codes, first, rule):
                    doc = int(np.searchsorted(first, a, side="right")) - 1
                    shift = a - int(first[doc])
                    found = [(s + shift, n, p) for s, n, p in squares_to_runs(codes[a:b].tolist(), rule)]
                    if found:
                        runs.setdefault(doc, []).extend(found)
                raw, texts = part.tobytes(), []
                for i in range(hi - lo):
                    words = raw[at[i] : at[i + 1]].split()
                    if i in runs:
                        keep = np.ones(len(words), bool)
                        for s, n, p in runs[i]:
                            keep[s + p : s + n] = False
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    texts.append(b" ".join(words))
                every = [r for i in range(hi - lo) for r in runs.get(i, ())]
                edges = np.concatenate(([0], np.cumsum([len(runs.get(i, ())) for i in range(hi - lo)])))
                fields = [pa.array([r[j] for r in every], pa.int64()) for j in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with periodic tails planted by the id's hash, as the query's contract asks."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).cast("bigint").alias("g"))

    def periodic(w):
        n = F.size(w).cast("bigint")
        a = F.pmod("g", n)
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    tail = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)))[0]
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, tail).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    done = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listing = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(listing, F.lit("\n"))).otherwise("")
    top = done.select("*", longest.alias("top"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.col3")
    return top.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.col2")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
