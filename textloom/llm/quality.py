"""Line-first quality rules.

Each line is judged on its own (navigation separators, symbol noise, shouting,
missing end punctuation on fragments, boilerplate phrases, repeats of an
earlier line); failing lines go, and a document is rejected if it loses more
than ``max_lost`` of its words, or fails the base rules on the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import row_chunks, span_codes, strings, word_spans

#: Phrases that mark a line as boilerplate; compared in lower case (ASCII).
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "javascript is disabled", "enable javascript", "lorem ipsum", "subscribe to our newsletter",
    "click here", "licensed under", "spdx-license-identifier",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    nav_percent: int = 15  # separator-only words among a line's words
    symbol_percent: int = 50  # symbol characters per 100 words
    shout_percent: int = 50  # words that end in "!!"
    upper_percent: int = 80  # ASCII capitals among ASCII letters, lines of 5 words and more
    fragment_words: int = 3  # shorter lines need end punctuation
    max_lost: int = 50  # percent of the document's words


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in "|>/-"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\"')"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_words_kept bigint"


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per pair of numbers, equal for equal pairs only."""
    if not len(a):
        return a.astype(np.int64)
    width = int(b.max()) + 1
    if (int(a.max()) + 1) * width >= 1 << 63:
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * width + b


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur again, and did it occur before (in order)?"""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    often, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return often, later


def judge(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns per document, and (start, end, kept) per non-empty line."""
    n_docs, size = len(offsets) - 1, len(data)
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    doc_of_word = np.repeat(np.arange(n_docs), n_words)
    chars = _sums((data & 0xC0) != 0x80)
    letters = _sums(chars[ends] - chars[starts])
    symbols = _sums(_SYMBOL[data])
    words = span_codes(data, starts, ends)[0].astype(np.int64) if len(starts) else starts

    # 3-word windows that occur again in their document
    repeat_words = np.zeros(n_docs, np.int64)
    if len(words) >= 3:
        inside = np.flatnonzero(doc_of_word[:-2] == doc_of_word[2:])
        grams = doc_of_word[inside]
        for step in range(3):
            grams = _together(grams, words[inside + step])
        often, _ = _repeats(grams)
        hit = np.zeros(len(words), bool)
        for step in range(3):
            hit[inside[often] + step] = True
        total = _sums(hit)
        repeat_words = total[first[1:]] - total[first[:-1]]

    # lines: those without a word never count and hold no text worth keeping
    newline = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate((offsets[:-1], newline + 1)))
    line_start = line_start[line_start < size]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    stop = np.append(newline, size)[np.searchsorted(newline, line_start)]
    line_end = np.minimum(stop, offsets[line_doc + 1])
    word_lo, word_hi = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    some = word_hi > word_lo
    line_start, line_end, line_doc, word_lo, word_hi = (x[some] for x in (line_start, line_end, line_doc, word_lo, word_hi))
    count = word_hi - word_lo
    lines = span_codes(data, line_start, line_end)[0] if len(line_start) else line_start
    _, again = _repeats(_together(line_doc, lines))

    of = lambda sums: sums[line_end] - sums[line_start]
    last = data[ends - 1] if len(ends) else data[:0]
    before = data[np.maximum(ends - 2, 0)] if len(ends) else data[:0]
    shout = _sums((last == 0x21) & (before == 0x21) & (ends - starts >= 2))
    other = _sums(~_SEPARATOR[data])
    separators = _sums(other[ends] == other[starts])
    upper, lower = _sums((data >= 0x41) & (data <= 0x5A)), _sums((data >= 0x61) & (data <= 0x7A))
    bad = again.copy()
    bad |= 100 * (separators[word_hi] - separators[word_lo]) >= rules.nav_percent * count
    bad |= 100 * of(symbols) >= rules.symbol_percent * count
    bad |= 100 * (shout[word_hi] - shout[word_lo]) >= rules.shout_percent * count
    bad |= (count >= 5) & (100 * of(upper) >= rules.upper_percent * (of(upper) + of(lower))) & (of(upper) > 0)
    bad |= (count < rules.fragment_words) & ~_END[last[word_hi - 1]]
    folded = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8).tobytes()
    for phrase in BOILERPLATE:
        raw, at = phrase.encode(), -1
        while (at := folded.find(raw, at + 1)) >= 0:
            line = int(np.searchsorted(line_start, at, side="right")) - 1
            if line >= 0 and at + len(raw) <= line_end[line]:
                bad[line] = True

    kept_words = np.bincount(line_doc, weights=np.where(bad, 0, count), minlength=n_docs).astype(np.int64)
    dup_lines = np.bincount(line_doc, weights=again, minlength=n_docs).astype(np.int64)
    failed = (n_words < rules.min_words) | (100 * repeat_words > rules.max_repeat_percent * n_words)
    columns = {
        "n_words": n_words,
        "word_chars": letters[first[1:]] - letters[first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & (100 * (n_words - kept_words) <= rules.max_lost * n_words),
        "n_words_kept": kept_words,
    }
    return columns, line_start, line_end, bad


def clean(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the measures, the verdict and, if asked, ``clean_text``.

    Null and empty texts have no words: base_failed, not kept.  Repeated rows
    are judged alike.  Long texts are one document whatever their length; a
    task holds one chunk of about 2 MB of text, or one longer text, at a time.
    No shuffle: documents are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in row_chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                columns, start, end, bad = judge(part, at, rules)
                out = {"doc_id": batch.column(0).slice(lo, hi - lo), **columns}
                if with_text:
                    doc, raw = np.searchsorted(at, start, side="right") - 1, part.tobytes()
                    texts: list[list[str]] = [[] for _ in range(hi - lo)]
                    for i in np.flatnonzero(~bad):
                        texts[doc[i]].append(raw[start[i] : end[i]].decode("utf-8", "replace"))
                    out["clean_text"] = ["\n".join(x) for x in texts]
                yield pa.RecordBatch.from_pydict(out)

    slim = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return slim.mapInArrow(run, SCHEMA + (", clean_text string" if with_text else ""))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))
