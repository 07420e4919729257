"""Fill-in-the-middle transformation over content-defined chunks.

A rolling hash over the last WINDOW bytes cuts texts into chunks, so equal
passages give equal chunks wherever they stand.  A chunk's summary (lines and
code points in it, markers, its edges) is kept under the chunk's own bytes, which
verifies a hit; texts that share chunks share the work.  A document is the sum of
its chunks: running line counts name the chunk that holds a cut, and only that
chunk is searched for the line's end.

A document of n lines is cut at two of its n + 1 line edges, by a hash of its id,
and written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import row_chunks, strings

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: A chunk ends where the top CUT_BITS bits of the hash of the last WINDOW bytes are 0, or after LONGEST bytes.
WINDOW, CUT_BITS, LONGEST = 32, 10, 1 << 16
#: Bytes of chunks whose summaries a worker keeps; beyond them it starts anew.
MEMO_BYTES = 32 << 20
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Fim:
    seed: int = 7
    percent: int = 100  # documents that are transformed
    spm_percent: int = 50  # of these, in spm form


def _gear() -> np.ndarray:
    """A fixed pseudo-random number per byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunk_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte edges of all chunks; text edges are among them.  No chunk depends on another text."""
    h, step = GEAR[data], 1
    while step < WINDOW:  # hash of the last 2 * step bytes from two of step bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    text = np.searchsorted(offsets, ends - 1, side="right") - 1
    edges = np.unique(np.concatenate((ends[ends - offsets[text] >= WINDOW], offsets)))
    wide = np.flatnonzero(np.diff(edges) > LONGEST)
    more = [np.arange(edges[i] + LONGEST, edges[i + 1], LONGEST) for i in wide]
    return np.unique(np.concatenate((edges, *more))) if more else edges


@dataclass(frozen=True, slots=True)
class Summary:
    lines: int  # line ends in the chunk
    points: int  # code points that begin in the chunk
    marked: bool
    head: bytes  # first and last bytes, for markers across an edge
    tail: bytes


class Memo:
    """Summaries by the chunk's bytes."""

    def __init__(self) -> None:
        self.known: dict[bytes, Summary] = {}
        self.size = 0
        self.hits = 0

    def __call__(self, chunk: bytes) -> Summary:
        got = self.known.get(chunk)
        if got is None:
            got = Summary(chunk.count(b"\n"), points(chunk), any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:])
            self.size += len(chunk)
            if self.size > MEMO_BYTES:
                self.known.clear()
                self.size = len(chunk)
            self.known[chunk] = got
        else:
            self.hits += 1
        return got


def points(part: bytes) -> int:
    """Code points whose first byte lies in ``part``."""
    return len(part.translate(None, _CONTINUATION))


class Lines:
    """Line edges of one text, found by way of its chunks."""

    def __init__(self, text: bytes, edges: list[int], memo: Memo) -> None:
        self.text, self.edges = text, edges
        self.marked, carry = False, b""
        self.lines, self.points = [0], [0]
        for lo, hi in zip(edges, edges[1:]):
            s = memo(text[lo:hi])
            joint = carry + s.head
            self.marked = self.marked or s.marked or any(m in joint for m in MARKERS)
            carry = (carry + s.tail)[-2:] if hi - lo < 2 else s.tail
            self.lines.append(self.lines[-1] + s.lines)
            self.points.append(self.points[-1] + s.points)
        self.n = self.lines[-1] + (bool(text) and not text.endswith(b"\n"))

    def edge(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which line k begins; the text's end for k = n."""
        if k == self.n:
            return len(self.text), self.points[-1]
        if not k:
            return 0, 0
        at = int(np.searchsorted(self.lines, k)) - 1  # the chunk that holds the k-th line end
        lo, hi = self.edges[at], self.edges[at + 1]
        ends = np.flatnonzero(np.frombuffer(self.text, np.uint8, hi - lo, lo) == 0x0A)
        stop = lo + int(ends[k - self.lines[at] - 1]) + 1
        return stop, self.points[at] + points(self.text[lo:stop])


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from the digest of seed and id (null: the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, spec: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (code points) and the output text of every row; no shuffle.

    Null texts are empty; these, and texts that hold a marker, are plain: output
    as they are, with null lengths.  A null id draws as the empty text does.
    Repeated rows are cut alike.  A long text is one text: a task holds about
    2 MB of texts, or one longer one, at a time.  Columns besides id and text are
    not read, whatever their names.  No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            data, offsets = strings(batch.column(1))
            draws = np.stack([batch.column(i).to_numpy() for i in range(2, 6)], axis=1)
            for lo, hi in row_chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                edges, raw = chunk_edges(part, at), part.tobytes()
                first = np.searchsorted(edges, at)
                out: dict[str, list] = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
                for i in range(hi - lo):
                    text = raw[at[i] : at[i + 1]]
                    cut = Lines(text, (edges[first[i] : first[i + 1] + 1] - at[i]).tolist(), memo)
                    for name, value in zip(out, transformed(cut, draws[lo + i].tolist(), spec)):
                        out[name].append(value)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["form"], pa.string()), pa.array(out["prefix_chars"], pa.int64()), pa.array(out["middle_chars"], pa.int64()), pa.array(out["output"], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *_draws(id_col, spec.seed))
    return slim.mapInArrow(run, SCHEMA)


def transformed(cut: Lines, draws: list[int], spec: Fim) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws
    if not cut.text or cut.marked or h3 % 100 >= spec.percent:
        return cut.n, "plain", None, None, cut.text
    a, b = sorted((h1 % (cut.n + 1), h2 % (cut.n + 1)))
    (lo, lo_points), (hi, hi_points) = cut.edge(a), cut.edge(b)
    prefix, middle, suffix = cut.text[:lo], cut.text[lo:hi], cut.text[hi:]
    p, s, m = MARKERS
    if h4 % 100 < spec.spm_percent:
        form, output = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, output = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return cut.n, form, lo_points, hi_points - lo_points, output


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>")
    joined = F.transform(F.array(parts), lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1])))
    return F.when(form == "plain", output).otherwise(joined[0])


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
        coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
