"""Substring dedup over words with prefix-partitioned suffix trees.

Suffixes start at content-chosen anchors.  Their keys are prefixes: the
anchor's first words say which task a suffix goes to, longer ones where a
prefix is too frequent; inside a task, suffixes are split further by
variable-length prefixes into groups of bounded size, and a compact suffix tree
is built for each.  Inner nodes of depth >= the window are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import named, rowed, strings
from textloom.llm.repeats import Spec, covered, range_columns, removal

#: Suffixes of one tree; prefixes grow by a word until their group fits.
TREE_SIZE = 4_096
UNIT = 8  # bytes of a word's hash


def common_prefix(a: bytes, b: bytes, unit: int = 1) -> int:
    """Leading bytes that agree, in whole units."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // unit * unit
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // unit * unit


class _Node:
    __slots__ = ("depth", "ends", "kids", "path")

    def __init__(self, depth: int, path: bytes) -> None:
        self.depth, self.path = depth, path
        self.kids: dict[bytes, _Node] = {}
        self.ends: list[int] = []


def suffix_tree(suffixes: list[bytes], chosen: list[int], unit: int = UNIT) -> tuple[list[int], list[int]]:
    """Leaves in tree order, and the depth of the inner node that joins each to the one before."""
    root = _Node(0, b"")
    for i in chosen:
        new, node = suffixes[i], root
        while True:
            at = node.depth
            if at == len(new):
                node.ends.append(i)
                break
            head = new[at : at + unit]
            kid = node.kids.get(head)
            if kid is None:
                leaf = _Node(len(new), new)
                leaf.ends.append(i)
                node.kids[head] = leaf
                break
            agree = at + common_prefix(new[at : kid.depth], kid.path[at : kid.depth], unit)
            if agree < kid.depth:  # split the edge
                middle = _Node(agree, new)
                middle.kids[kid.path[agree : agree + unit]] = kid
                node.kids[head] = middle
                kid = middle
            node = kid
    order: list[int] = []
    joined: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, met = stack.pop()
        for i in node.ends:
            order.append(i)
            joined.append(met)
            met = node.depth
        heads = sorted(node.kids)
        below = [(node.kids[h], node.depth) for h in heads]
        if below and not node.ends:
            below[0] = (below[0][0], met)
        stack.extend(reversed(below))
    return order, joined


def prefix_groups(suffixes: list[bytes], limit: int = TREE_SIZE, unit: int = UNIT) -> Iterator[list[int]]:
    """Groups of at most ``limit`` suffixes that share a prefix as short as that allows.

    Suffixes that end within their prefix, or are equal, may form larger groups:
    those hold few distinct strings.
    """
    stack = [(list(range(len(suffixes))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= limit:
            yield group
            continue
        split: dict[bytes, list[int]] = {}
        for i in group:
            split.setdefault(suffixes[i][depth : depth + unit], []).append(i)
        if len(split) == 1 and b"" in split:
            yield group
            continue
        stack.extend((split[h], depth + unit) if h else (split[h], len(suffixes[split[h][0]])) for h in sorted(split, reverse=True))


def tree_order(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order of their trees; common prefix with the one before, in words."""
    order: list[int] = []
    joined: list[int] = []
    for group in prefix_groups(suffixes):
        leaves, depths = suffix_tree(suffixes, group)
        if order:
            depths[0] = common_prefix(suffixes[order[-1]], suffixes[leaves[0]], UNIT)
        order += leaves
        joined += depths
    return np.array(order, np.int64), np.array(joined, np.int64) // UNIT


SPEC = Spec(words=True, window=20, gram=8, keep_first=True)
SCHEMA = "rid bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def substring_dedup(docs: DataFrame, spec: Spec = SPEC, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, the text kept.

    A window that also starts earlier (smaller doc_id, or same document and
    earlier) gives up its words; windows are judged on the input.  Null and
    empty texts have no words.  Rows that repeat or lack a doc_id are documents
    of their own, in (doc_id, text) order, nulls first.  Columns besides doc_id and text are not read, whatever their names.  A long
    text is one document; a task holds about 2 MB of texts, or one longer text, at a time.
    """
    keyed, plain = rowed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            edges, start, stop = range_columns(batch.column(2))
            n, gone, sha, texts = [], [], [], []
            for doc in range(batch.num_rows):
                words = data[offsets[doc] : offsets[doc + 1]].tobytes().split()  # ASCII white space, as in WORD
                drop = removal(edges, start, stop, doc, len(words))
                kept = b" ".join(words if drop is None else [w for w, d in zip(words, drop.tolist(), strict=True) if not d])
                n.append(len(words))
                gone.append(0 if drop is None else int(drop.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            out = {"rid": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict({**out, "kept_text": pa.array(texts, pa.string())} if with_text else out)

    result = covered(keyed, spec, tree_order).mapInArrow(run, SCHEMA + (", kept_text string" if with_text else ""))
    return named(result, keyed, plain)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(words, i, i + 19), ' ') ORDER BY doc_id, i) AS nth FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM h WHERE nth > 1),
g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g.n IS NULL THEN array_to_string(words, ' ')
              ELSE array_to_string(list_filter(words, lambda x, j: NOT list_contains(g.ks, j)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
