"""Suffix-array dedup over bytes with deep-shallow sorting.

Suffixes are sorted to a shallow depth by a multikey quicksort whose characters
are 8-byte words (groups of equal suffixes are split by the next word until
they are single or SHALLOW bytes deep); each group that still shares a long
prefix is then put in order by a blind trie, which looks at branching bytes
only and compares with one suffix per insertion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import named, rowed, strings
from textloom.llm.repeats import Spec, covered, range_columns, removal
from textloom.llm.substring_dedup import common_prefix

SHALLOW = 32


def blind_trie(suffixes: list[bytes], chosen: list[int]) -> tuple[list[int], list[int]]:
    """Suffixes in byte order (a prefix first), and common prefix with the one before."""
    # an inner node is [depth, {byte: node or leaf}]; byte -1 stands for the end
    first = chosen[0]
    root: list | int = first
    equal: dict[int, list[int]] = {first: [first]}
    same = {suffixes[first]: first}
    for i in chosen[1:]:
        new = suffixes[i]
        twin = same.get(new)
        if twin is not None:
            equal[twin].append(i)
            continue
        same[new] = i
        equal[i] = [i]
        node = root
        while not isinstance(node, int):  # blind: follow branching bytes, any kid if there is none
            depth, kids = node
            node = kids.get(new[depth] if depth < len(new) else -1)
            if node is None:
                node = next(iter(kids.values()))
        other = suffixes[node]
        agree = common_prefix(new, other)
        parent, node = None, root
        while not isinstance(node, int) and node[0] < agree:
            parent, node = node, node[1][new[node[0]]]
        mine = new[agree] if agree < len(new) else -1
        if not isinstance(node, int) and node[0] == agree:
            node[1][mine] = i
        else:
            inner = [agree, {mine: i, (other[agree] if agree < len(other) else -1): node}]
            if parent is None:
                root = inner
            else:
                parent[1][new[parent[0]]] = inner
    order: list[int] = []
    joined: list[int] = []
    stack: list[tuple[list | int, int]] = [(root, 0)]
    while stack:
        node, met = stack.pop()
        if isinstance(node, int):
            for i in equal[node]:
                order.append(i)
                joined.append(met)
                met = len(suffixes[i])
        else:
            depth, kids = node
            heads = sorted(kids)
            stack.extend((kids[h], depth if j else met) for j, h in reversed(list(enumerate(heads))))
    return order, joined


def deep_shallow(suffixes: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte strings and the common prefix of each with the one before."""
    size = len(suffixes)
    # words of the first ``shallow`` bytes; strings that end early sort before their extensions
    head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in suffixes), ">u8").reshape(size, shallow // 8)
    length = np.minimum(np.fromiter(map(len, suffixes), np.int64, size), shallow)
    order, group = np.arange(size), np.zeros(size, np.int64)
    open_ = np.ones(size, bool)
    for level in range(shallow // 8 + 1):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        mine = order[at]
        word = head[mine, level].astype(np.uint64) if level < shallow // 8 else length[mine].astype(np.uint64)
        by = np.lexsort((word, group[at]))
        order[at] = mine[by]
        word, old = word[by], group[at]
        fresh = np.concatenate(([True], (word[1:] != word[:-1]) | (old[1:] != old[:-1])))
        group[at] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        open_[at] = np.bincount(group[at], minlength=size)[group[at]] > 1
    result: list[int] = []
    joined: list[int] = []
    edge = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), size).tolist() if size else [0]
    ranked = order.tolist()
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        leaves, depths = ([ranked[lo]], [0]) if hi - lo == 1 else blind_trie(suffixes, ranked[lo:hi])
        if result:
            depths[0] = common_prefix(suffixes[result[-1]], suffixes[leaves[0]])
        result += leaves
        joined += depths
    return np.array(result, np.int64), np.array(joined, np.int64)


SPEC = Spec(words=False, window=200, gram=100, keep_first=False, block=32)
SCHEMA = "rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def suffix_array_dedup(docs: DataFrame, spec: Spec = SPEC, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes kept.

    Every byte covered by a window that also starts anywhere else goes, the
    first occurrence too; windows lie within one document and are judged on the
    input.  Null and empty texts have no bytes.  Rows that repeat or lack a
    doc_id are documents of their own, so equal rows repeat each other.  Columns besides doc_id and text are not read, whatever their names.  A long
    text is one document; a task holds about 2 MB of texts, or one longer text, at a time.
    """
    keyed, plain = rowed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            edges, start, stop = range_columns(batch.column(2))
            size, gone, spans, sha, raw = [], [], [], [], []
            for doc in range(batch.num_rows):
                text = data[offsets[doc] : offsets[doc + 1]]
                drop = removal(edges, start, stop, doc, len(text))
                kept = (text if drop is None else text[~drop]).tobytes()
                size.append(len(text))
                gone.append(len(text) - len(kept))
                spans.append(0 if drop is None else int(drop[0]) + int(np.count_nonzero(drop[1:] & ~drop[:-1])))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    raw.append(kept)
            out = {"rid": batch.column(0), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict({**out, "kept": pa.array(raw, pa.binary())} if with_text else out)

    result = covered(keyed, spec, deep_shallow).mapInArrow(run, SCHEMA + (", kept binary" if with_text else ""))
    return named(result, keyed, plain)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
