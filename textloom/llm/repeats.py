"""Repeated windows across a corpus: which items of which documents they cover.

The jobs, all keyed so that no task needs more than its share:

1. anchors   every document's segments (see ``windows``), packed by key bucket.
             Equal segments of one flush meet here already: one travels for
             them, the others are known as further occurrences of its leaf.
2. leaves    per key bucket: equal segments are one leaf with a list of
             occurrences.  Leaves of keys that occur more than once are *open*.
3. contexts  open leaves fetch their items from the document of their first
             occurrence.
4. orders    per key: the items right of the anchor are put in order, and those
             left of it, read backwards.  Two windows that start o items before
             their anchors are equal exactly if they lie below one node of depth
             o on the left and one of depth window - o on the right; the windows
             below such nodes that have several leaves, or a leaf with several
             occurrences, are repeats.  Each leaf's ranges follow; its further
             occurrences are repeats as a whole.
5. cover     the ranges come back to their documents.

A key with very many leaves (a passage many documents share, at whose edges the
contexts all differ) never meets in one task: the map task that finds it hot
spreads its segments and tells the key's bucket, and open leaves of hot keys go
on as blocks of windows, keyed by the items that all windows of a block contain;
equal blocks of one task travel once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import parts_of, row_chunks, strings, word_hashes, word_spans, written
from textloom.llm.windows import U64, mix, segments

Order = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Spec:
    words: bool  # items are words, else bytes
    window: int
    gram: int  # items of an anchor
    keep_first: bool  # the first occurrence stays, else every occurrence goes
    flush: int = 500_000  # segments a map task holds before it packs them
    piece: int = 2 << 20  # items of one piece of a long document
    hot_hulls: int = 256  # leaves of a key, in one flush or one bucket, beyond which it is split again
    block: int = 8  # windows of one block of such a key
    lot: int = 20_000  # rows put in order at a time

    @property
    def width(self) -> int:
        return 8 if self.words else 1


_ROW = np.dtype([("key", "<u8"), ("hull", "<u8"), ("rid", "<i8"), ("pos", "<i8"), ("before", "<i4"), ("n", "<i4"), ("state", "u1")])
#: state: an occurrence, one for several equal segments, a further occurrence of a leaf, the notice that a key is hot.
ONE, MANY, FURTHER, NOTICE = 0, 1, 2, 3
#: added to ONE and MANY of hot keys, which go by hull instead of by key
HOT = 4


def items_of(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(items, document bounds in items)."""
    if not words:
        return data, offsets
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first


def _pieces(items: np.ndarray, bounds: np.ndarray, window: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(items, bounds, first document, offset): a long document comes in overlapping pieces."""
    if len(bounds) == 2 and len(items) > size:
        for at in range(0, len(items) - window + 1, size):
            piece = items[at : at + size + window - 1]
            yield piece, np.array([0, len(piece)]), 0, at
    else:
        yield items, bounds, 0, 0


def _pack(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    by = np.where(rows["state"] == FURTHER, mix(rows["rid"].astype(U64)), np.where(rows["state"] >= HOT, mix(rows["hull"]), rows["key"]))
    where = by % U64(buckets)
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order].astype(np.int32)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1, [len(rows)]))
    if not len(rows):
        return

    def cells(name: str) -> pa.Array:
        """One value a bucket: the column's bytes, cut by offsets, so that the cost does not hang on the number of buckets."""
        edges = (cut * _ROW[name].itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(rows[name]).tobytes())])

    # column by column: row ids and positions then compress well in the shuffle
    yield pa.RecordBatch.from_arrays([pa.array(where[cut[:-1]], pa.int32()), *map(cells, _ROW.names)], names=["bucket", *_ROW.names])


_PACKED = "bucket int, " + ", ".join(f"{n} binary" for n in _ROW.names)


def _unpack(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    parts: dict[str, list[np.ndarray]] = {n: [np.zeros(0, np.uint8)] for n in _ROW.names}
    for batch in batches:
        for i, name in enumerate(_ROW.names, 1):
            parts[name].append(strings(batch.column(i))[0])
    columns = {n: np.concatenate(p).view(_ROW[n]) for n, p in parts.items()}
    rows = np.zeros(len(columns["key"]), _ROW)
    for name, column in columns.items():
        rows[name] = column
    return rows


def _equal_segments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of (segment, rid, pos); start of each segment's run; its number of occurrences."""
    rows = rows[np.lexsort((rows["pos"], rows["rid"], rows["hull"], rows["key"]))]
    head = np.flatnonzero(np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["hull"][1:] != rows["hull"][:-1])))) if len(rows) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(rows)))
    if len(head):
        count = count + np.maximum.reduceat((rows["state"] % HOT == MANY).astype(np.int64), head)
    return rows, head, count


def anchors(keyed: DataFrame, spec: Spec, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, head, count = _equal_segments(np.concatenate(held))
            several = np.repeat(count > 1, np.diff(np.append(head, len(rows))))
            first = np.zeros(len(rows), bool)
            first[head] = True
            rows["state"][several & ~first] = FURTHER
            rows["state"][several & first] = MANY
            keys, leaves = np.unique(rows["key"][head], return_counts=True)
            hot = keys[leaves > spec.hot_hulls]
            if len(hot):
                rows["state"][first & np.isin(rows["key"], hot)] += HOT
                notice = np.zeros(len(hot), _ROW)
                notice["key"], notice["state"] = hot, NOTICE
                rows = np.concatenate((rows, notice))
            yield from _pack(rows, buckets)

        for batch in batches:
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = strings(batch.column(1))
            for lo, hi in row_chunks(offsets):
                items, bounds = items_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], spec.words)
                for piece, edges, doc0, at in _pieces(items, bounds, spec.window, spec.piece):
                    found = segments(piece, edges, spec.window, spec.gram)
                    if not len(found.anchor):
                        continue
                    doc = np.searchsorted(edges, found.first, side="right") - 1
                    rows = np.zeros(len(doc), _ROW)
                    rows["key"], rows["hull"], rows["rid"] = found.key, found.hull, rids[lo + doc0 + doc]
                    rows["pos"] = found.anchor - edges[doc] + at
                    rows["before"], rows["n"] = found.anchor - found.first, found.last - found.first + 1
                    held.append(rows)
                    size += len(rows)
                    if size >= spec.flush:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    return keyed.select("rid", "text").mapInArrow(run, _PACKED)


_CLASSED = "rid bigint, start bigint, stop bigint, key bigint, pos bigint, before int, n int, several boolean, hot boolean"


def leaves(packed: DataFrame, spec: Spec) -> DataFrame:
    """Ranges of further occurrences (key null), and open leaves, by their first occurrence."""

    def emit(rows: np.ndarray, several: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
        further = several is None
        start = rows["pos"] - rows["before"]
        none, unsaid = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.bool_())
        return pa.RecordBatch.from_pydict({
            "rid": rows["rid"], "start": start if further else none, "stop": start + rows["n"] - 1 + spec.window if further else none,
            "key": none if further else rows["key"].astype(np.int64), "pos": none if further else rows["pos"], "before": rows["before"], "n": rows["n"],
            "several": unsaid if further else pa.array(several), "hot": unsaid if further else pa.array(hot),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpack(batches)
        if (done := rows["state"] == FURTHER).any():
            yield emit(rows[done])
        told = np.unique(rows["key"][rows["state"] == NOTICE])
        rows, head, count = _equal_segments(rows[~done & (rows["state"] != NOTICE)])
        if not len(rows):
            return
        further = np.ones(len(rows), bool)
        further[head] = False
        if further.any():
            yield emit(rows[further])
        leaf, several = rows[head], count > 1
        _, inverse, per_key = np.unique(leaf["key"], return_inverse=True, return_counts=True)
        hot = (leaf["state"] >= HOT) | np.isin(leaf["key"], told) | (per_key[inverse] > spec.hot_hulls)
        shared = several | hot | (per_key[inverse] > 1)
        if shared.any():
            yield emit(leaf[shared], several[shared], hot[shared])

    return packed.mapInArrow(run, _CLASSED)


_CONTEXT = "key bigint, rid bigint, pos bigint, before int, n int, several boolean, items binary"


def contexts(keyed: DataFrame, open_rows: DataFrame, spec: Spec) -> DataFrame:
    """Open leaves with the items of their hulls; hot keys in blocks with keys of their own.

    Blocks that equal an earlier one of the batch come without items, under a key
    that spreads them: their windows are repeats as a whole.
    """
    wanted = open_rows.groupBy("rid").agg(F.collect_list(F.struct("key", "pos", "before", "n", "several", "hot")).alias("want"))
    joined = keyed.select("rid", "text").join(wanted, "rid").select("rid", "text", "want")
    width, window, size = spec.width, spec.window, spec.block

    def blocks(at: int, before: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(block, first item of its core, windows' largest distance to the anchor, windows)."""
        for block in range((before - n + 1) // size, before // size + 1):
            far, near = min(before, block * size + size - 1), max(before - n + 1, block * size)
            yield block, at - block * size, far, far - near + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_pylist()
            data, offsets = strings(batch.column(1))
            lists = batch.column(2)
            edges = np.asarray(lists.offsets)
            flat = lists.values
            key, pos, before, n, several, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            for lo, hi in row_chunks(offsets):
                items, bounds = items_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], spec.words)
                raw = items.tobytes()
                out: list[list] = []  # key, rid, pos, before, n, several, items
                of_block: dict[tuple[int, bytes], list[int]] = {}
                for doc in range(lo, hi):
                    base, rid = int(bounds[doc - lo]), rids[doc]
                    for i in range(edges[doc], edges[doc + 1]):
                        at, b, m = int(pos[i]), int(before[i]), int(n[i])
                        cut = lambda far, count: raw[(base + at - far) * width : (base + at - far + count - 1 + window) * width]  # noqa: B023, E731
                        if not hot[i]:
                            out.append([int(key[i]), rid, at, b, m, bool(several[i]), cut(b, m)])
                            continue
                        for block, core, far, count in blocks(base + at, b, m):
                            k = xxhash.xxh64_intdigest(raw[core * width : (core - size + 1 + window) * width], block) - (1 << 63)
                            of_block.setdefault((k, cut(far, count)), []).append(len(out))
                            out.append([k, rid, at, far, count, bool(several[i]), cut(far, count)])
                for same in of_block.values():
                    if len(same) > 1:
                        same.sort(key=lambda j: (out[j][1], out[j][2]))
                        out[same[0]][5] = True
                        for j in same[1:]:
                            out[j][0], out[j][6] = out[j][1], None
                if out:
                    columns = zip(*out, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _CONTEXT.split(", ")])

    return joined.mapInArrow(run, _CONTEXT)


def shared_windows(items: list[bytes], rid: np.ndarray, pos: np.ndarray, before: np.ndarray, n: np.ndarray, several: np.ndarray, spec: Spec, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (rid, start, stop) of these leaves' windows that occur in several leaves, or in one that occurs several times."""
    width, window = spec.width, spec.window
    if spec.keep_first:  # rows in order of occurrence: the first of equals is the earliest
        earliest = np.lexsort((pos, rid))
        items, rid, pos, before, n = [items[i] for i in earliest], rid[earliest], pos[earliest], before[earliest], n[earliest]
        several = np.zeros(len(rid), bool)  # a leaf's own later occurrences do not touch its first
    cut = (before * width).tolist()
    right, right_lcp = order([x[c:] for x, c in zip(items, cut, strict=True)])
    if width == 1:
        left, left_lcp = order([x[:c][::-1] for x, c in zip(items, cut, strict=True)])
    else:
        left, left_lcp = order([np.frombuffer(x[:c], "<u8")[::-1].tobytes() for x, c in zip(items, cut, strict=True)])
    size = len(items)
    right_rank, left_rank = np.empty(size, np.int64), np.empty(size, np.int64)
    right_rank[right], left_rank[left] = np.arange(size), np.arange(size)
    rows, starts = [], []
    for o in range(int((before - n + 1).min()), int(before.max()) + 1):
        here = np.flatnonzero((before >= o) & (before - n < o))
        if not len(here):
            continue
        left_class = np.cumsum(left_lcp < o)[left_rank[here]]
        right_class = np.cumsum(right_lcp < window - o)[right_rank[here]]
        both = left_class * size + right_class
        by = np.argsort(both, kind="stable")
        ranked = both[by]
        same = ranked[1:] == ranked[:-1]
        hit = several[here]
        hit[by[1:]] |= same
        if not spec.keep_first:
            hit[by[:-1]] |= same
        rows.append(here[hit])
        starts.append(pos[here[hit]] - o)
    row, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts))
    if not len(row):
        return row, start, start
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))))
    tail = np.append(head[1:], len(row)) - 1
    return rid[row[head]], start[head], start[tail] + window


_RANGE = "rid bigint, start bigint, stop bigint"


def orders(found: DataFrame, spec: Spec, order: Order, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.column(6).is_null()
            held.append(batch.filter(pc.invert(known)))
            done = batch.filter(known)
            if done.num_rows:
                pos, before, n = (done.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
                yield pa.RecordBatch.from_pydict({"rid": done.column(1), "start": pos - before, "stop": pos - before + n - 1 + spec.window})
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).sort_by("key")
        key = table.column("key").to_numpy()
        # keys stay whole; about ``lot`` rows are put in order at a time
        cut, edges = [0], np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        for e in edges.tolist():
            if e - cut[-1] >= spec.lot or e == len(key):
                cut.append(e)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part = table.slice(lo, hi - lo)
            rid, pos, before, n = (part.column(c).to_numpy().astype(np.int64) for c in ("rid", "pos", "before", "n"))
            several = part.column("several").to_numpy().astype(bool)
            r, start, stop = shared_windows(part.column("items").to_pylist(), rid, pos, before, n, several, spec, order)
            yield pa.RecordBatch.from_pydict({"rid": r, "start": start, "stop": stop})

    return found.repartition(parts, F.col("key")).mapInArrow(run, _RANGE)


def covered(keyed: DataFrame, spec: Spec, order: Order) -> DataFrame:
    """(rid, text, ranges): every row, with the item ranges that repeated windows cover (null: none)."""
    parts = parts_of(keyed)
    packed = anchors(keyed, spec, 4 * parts).repartition(parts, F.col("bucket"))
    classed = written(leaves(packed, spec))
    late = orders(contexts(keyed, classed.where("key is not null"), spec), spec, order, parts)
    ranges = classed.where("key is null").select("rid", "start", "stop").unionByName(late)
    per_doc = ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return keyed.select("rid", "text").join(per_doc, "rid", "left").select("rid", "text", "ranges")


def removal(edges: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: int, size: int) -> np.ndarray | None:
    """Mask of the items of one document to remove, or None."""
    lo, hi = int(edges[doc]), int(edges[doc + 1])
    if lo == hi:
        return None
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, start[lo:hi], 1)
    np.add.at(step, np.minimum(stop[lo:hi], size), -1)
    return np.cumsum(step[:-1]) > 0


def range_columns(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row edges, starts, stops) of a nullable list<struct<start, stop>> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    edges = np.asarray(column.offsets)
    flat = column.values
    return edges, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
