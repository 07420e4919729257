"""Arrow batches are worked on in pieces of bounded size, whatever rows they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from textloom.functions import scan
from textloom.operators import watermark


def test_pieces_of_token_lists_hold_few_tokens_and_every_row():
    sizes = [3, 0, 5, 9, None, 2, 2, 2, 12, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else [1] * n for n in sizes], pa.list_(pa.int64()))], names=["doc_id", "tokens"])
    got = list(watermark.pieces(batch, 8))
    assert [x for p in got for x in p.column(0).to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 8 for p in got) and len(got) > 3
    assert not list(watermark.pieces(batch.slice(0, 0), 8))


def test_slices_of_texts_hold_few_bytes_and_every_row():
    texts = pa.array(["x" * n for n in (10, 0, scan.SLICE_BYTES, 5, scan.SLICE_BYTES + 7, 1)] + [None]).slice(1)
    got = list(scan.slices(texts))
    assert pa.concat_arrays(got).equals(texts)
    assert all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= scan.SLICE_BYTES for p in got) and len(got) > 2
    assert [len(p) for p in scan.slices(texts.slice(0, 0))] == [0]


def test_marks_and_counts_hold_in_the_whole_text():
    texts = pa.array(["isis is are", "", "12.34 5", "a﷐b"])
    # the start of a rest is no edge of a word
    assert scan.count(texts, r"(?:^|[^\w.])\d[\d.]*").tolist() == [0, 0, 2, 0] and scan.count(texts, r"\b(?:is|are)\b").tolist() == [2, 0, 0, 0]
    assert scan.marks(texts, 2) == ["﷑", "﷒"] and scan.words(texts).tolist() == [3, 0, 2, 1]
    assert scan.found(texts, r"i(s) ?", group=True) == (["s", "s", "s"], [1, 3, 6], [0, 0, 0])
    assert np.array_equal(scan.pieces(texts, " ")[1], [0, 0, 0, 1, 2, 2, 3])
