"""Regular expressions over Arrow strings of a task: counts, splits and places of matches.

Arrow's engine takes linear time and reads patterns as SQL engines do.  Matches are
told by marks that no text of the batch holds, put in by one replacement over the
whole text: Arrow's own counting and splitting by pattern forget what stands before
the rest of a text, so that ``\\b`` and ``^`` hold there where they should not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at a time, unless one text is longer.
SLICE_BYTES = 1 << 22
SPACES = " \t\n\f\r"
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The array cut so that a piece holds about SLICE_BYTES, or one longer text; at least one piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    lo = 0
    while True:
        hi = max(lo + 1, int(np.searchsorted(offsets, int(offsets[lo]) + SLICE_BYTES, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi
        if lo >= len(texts):
            return


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte offsets from 0) of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def rows(docs: DataFrame, schema: str, work: Callable[[pa.Array], tuple[np.ndarray, list]]) -> DataFrame:
    """(doc_id, schema): what ``work`` makes of the texts that are not null, a slice at a time: (the place of each row's text, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                owner, columns = work(texts)
                ids = batch.column(0).slice(at, len(texts)).take(pa.array(owner, pa.int64()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])

    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def _latin() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x27]] = True
    return ok


_LATIN = _latin()


def latin_spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as they stand, their first bytes, the places of their texts) of ``[A-Za-zÀ-ɏ']+``."""
    data, offsets = raw(texts)
    after = np.append(data[1:], np.uint8(0))
    lead = ((data >= 0xC3) & (data <= 0xC8)) | ((data == 0xC9) & (after[: len(data)] <= 0x8F))
    word = _LATIN[data] | lead
    word[1:] |= lead[:-1]
    first, last = word.copy(), word.copy()
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # words end where texts do
    inner = np.ones(len(data), bool)
    inner[edge] = False
    first[1:] &= ~(word[:-1] & inner[1:])
    last[:-1] &= ~(word[1:] & inner[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    packed = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[word]))
    return packed, starts, np.searchsorted(offsets, starts, "right") - 1


def lower_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the different words), lower case."""
    met = words.dictionary_encode()
    low = pc.utf8_lower(met.dictionary).dictionary_encode()
    codes = low.indices.to_numpy(zero_copy_only=False).astype(np.int64)[met.indices.to_numpy(zero_copy_only=False)]
    return codes, low.dictionary


def latin_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each word, the place of its text, the different words) of ``[A-Za-zÀ-ɏ']+``, lower case."""
    packed, _, owner = latin_spans(texts)
    codes, kinds = lower_codes(packed)
    return codes, owner, kinds.to_pylist()


def tallies(owner: np.ndarray, codes: np.ndarray, n: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, how often) of each different pair, in order; owners are below n, codes below kinds."""
    key = owner.astype(np.int64) * kinds + codes
    if n * kinds <= 4 * len(key):
        often = np.bincount(key, minlength=1)
        pairs = np.flatnonzero(often)
        often = often[pairs]
    else:
        pairs, often = np.unique(key, return_counts=True)
    return pairs // max(kinds, 1), pairs % max(kinds, 1), often


def marks(texts: pa.Array, n: int = 1) -> list[str]:
    """n characters that no text holds."""
    held = raw(texts)[0].tobytes()
    if b"\xef" not in held:  # their first byte
        return [chr(0xFDD0 + i) for i in range(n)]
    out: list[str] = []
    for code in [*range(0xFDD0, 0xFDF0), *range(0xF0000, 0x10FFFE)]:
        if chr(code).encode() not in held:
            out.append(chr(code))
            if len(out) == n:
                return out
    raise ValueError("the texts hold every private character")


def matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(texts, pattern), bool)


def count(texts: pa.Array, pattern: str) -> np.ndarray:
    """Matches of the pattern in each text."""
    out = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(matches(texts, pattern))
    if len(at):
        some = texts.take(pa.array(at))
        mark = marks(some)[0]
        out[at] = np.asarray(pc.count_substring(pc.replace_substring_regex(some, pattern, mark), mark))
    return out


def words(texts: pa.Array) -> np.ndarray:
    """Runs of characters that are no white space, in each text."""
    data, offsets = raw(texts)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = solid[edges]
    total = np.concatenate(([0], np.cumsum(first)))
    return total[offsets[1:]] - total[offsets[:-1]]


def pieces(texts: pa.Array, pattern: str, literal: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(all parts between matches, the place of each part's text)."""
    if literal:
        cut = pc.split_pattern(texts, pattern)
    else:
        mark = marks(texts)[0]
        cut = pc.split_pattern(pc.replace_substring_regex(texts, pattern, mark), mark)
    return cut.flatten(), np.asarray(pc.list_parent_indices(cut), np.int64)


def found(texts: pa.Array, pattern: str, group: bool = False) -> tuple[list[str], list[int], list[int]]:
    """(match, or its group 1, its place in code points, the place of its text) of all matches, text by text.

    A group's place is that of its first occurrence in the match.
    """
    out: tuple[list[str], list[int], list[int]] = ([], [], [])
    at = np.flatnonzero(matches(texts, pattern))
    if not len(at):
        return out
    some = texts.take(pa.array(at))
    a, b, c = marks(some, 3)
    for i, text in zip(at.tolist(), pc.replace_substring_regex(some, pattern, rf"{a}\0{c}\1{b}" if group else rf"{a}\0{b}").to_pylist()):
        parts = text.split(a)
        place = len(parts[0])
        for part in parts[1:]:
            held, rest = part.split(b, 1)
            whole, mine = held.split(c, 1) if group else (held, held)
            out[0].append(mine)
            out[1].append(place + (whole.find(mine) if group else 0))
            out[2].append(i)
            place += len(whole) + len(rest)
    return out


def lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    """Values, in order of their owners, as one list for each of n owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


class Literals:
    """Which texts may hold one of the strings that a pattern needs: by their first 3 to 8 bytes, for all patterns at once."""

    def __init__(self, needed: list[list[str]]) -> None:
        keys: dict[bytes, set[int]] = {}
        short = lambda some: not some or min(len(x.encode()) for x in some) < 3
        self.always = [i for i, some in enumerate(needed) if short(some)]
        for i, some in enumerate(needed):
            if not short(some):
                for x in some:
                    keys.setdefault(x.encode()[:8], set()).add(i)
        self.first = np.zeros(1 << 24, bool)
        self.by_size: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for key in keys:
            self.first[int.from_bytes(key[:3], "little")] = True
        for size in range(3, 9):
            some = sorted((int.from_bytes(k, "little"), sorted(v)) for k, v in keys.items() if len(k) == size)
            if some:
                self.by_size[size] = np.array([k for k, _ in some], np.uint64), [v for _, v in some]

    def texts(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """pattern: places of the texts that may hold what it needs; patterns that need nothing are left out."""
        # as patterns that do not tell cases do, a long s is an s
        low = pc.replace_substring(pc.utf8_lower(texts), "ſ", "s")
        data, offsets = raw(low)
        if len(data) < 3:
            return {}
        wide = data.astype(np.int32)
        at = np.flatnonzero(self.first[wide[:-2] | (wide[1:-1] << 8) | (wide[2:] << 16)])
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        word = np.zeros(len(at), np.uint64)
        for k in range(8):
            word |= padded[at + k].astype(np.uint64) << np.uint64(8 * k)
        doc = np.searchsorted(offsets, at, "right") - 1
        out: dict[int, list[np.ndarray]] = {}
        for size, (keys, patterns) in self.by_size.items():
            mine = word & np.uint64((1 << (8 * size)) - 1)
            i = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[i] == mine
            pairs = np.unique(i[hit].astype(np.int64) * len(texts) + doc[hit])
            key, where = pairs // len(texts), pairs % len(texts)
            cut = np.searchsorted(key, np.arange(len(keys) + 1))
            for j in np.unique(key).tolist():
                for p in patterns[j]:
                    out.setdefault(p, []).append(where[cut[j] : cut[j + 1]])
        return {p: np.unique(np.concatenate(v)) for p, v in out.items()}
