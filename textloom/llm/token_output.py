"""Token ids in patched frame-of-reference blocks.

File format (Parquet as the container, so any store Spark writes to will do;
one row per chunk of consecutive documents, rows ascending by (part, chunk)):

    part, chunk       place of the chunk: range partition, number within it
    start             ids of the part's earlier chunks
    n_ids             ids in the chunk
    docs              int64 little-endian row keys of the chunk's documents
    lengths           uint32 little-endian ids per document, end id included
    offsets           uint32 little-endian byte start of every block in payload
    payload           the blocks, back to back

A block holds BLOCK ids (the last one fewer): u32 minimum, u8 width, u16 number
of exceptions, u16 ids; then (id - minimum) packed at ``width`` bits, least
significant bit first; then the exceptions: u16 positions, then u32 remaining
high bits.  The width is the least that holds PERCENTILE percent of a block.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import named, parts_of, row_chunks, rowed, shared_dir, span_codes, strings, word_spans

BLOCK, PERCENTILE, CHUNK_IDS = 256, 95, 1 << 16
END_ID = 2
#: Words one Python worker remembers the ids of; beyond it, those met once are dropped.
CACHE_WORDS = 400_000
_HEAD = np.dtype([("min", "<u4"), ("width", "u1"), ("n_exc", "<u2"), ("n", "<u2")])
CHUNK_SCHEMA = "part int, chunk int, start bigint, n_ids bigint, docs binary, lengths binary, offsets binary, payload binary"
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:"]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


# --- codec -------------------------------------------------------------------


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, byte start of each block) of an id sequence."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, "<u4")
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(rows, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    typical = np.partition(rest, at, axis=1)[:, at].astype(np.uint64)
    width = np.zeros(rows, np.uint8)
    for bit in range(32):
        width[typical >= (1 << bit)] = bit + 1
    parts: list[bytes] = [b""] * rows
    sizes = np.full(rows, BLOCK, np.int64)
    sizes[-1] = n - (rows - 1) * BLOCK
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        values = rest[mine].astype("<u4")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
        packed = np.packbits(bits.reshape(len(mine), BLOCK * int(w)), axis=1, bitorder="little")
        high = (values.astype(np.uint64) >> np.uint64(w)).astype("<u4")
        row, where = np.nonzero(high)
        cut = np.searchsorted(row, np.arange(len(mine) + 1))
        over, where = high[row, where], where.astype("<u2")
        for j, i in enumerate(mine.tolist()):
            size, lo = int(sizes[i]), int(cut[j])
            hi = lo + int(np.count_nonzero(where[lo : cut[j + 1]] < size))
            head = struct.pack("<IBHH", low[i], w, hi - lo, size)
            parts[i] = head + packed[j, : (size * int(w) + 7) // 8].tobytes() + where[lo:hi].tobytes() + over[lo:hi].tobytes()
    lengths = np.fromiter(map(len, parts), np.int64, rows)
    return b"".join(parts), (np.cumsum(lengths) - lengths).astype("<u4")


def decode_blocks(payload: bytes, offsets: np.ndarray) -> np.ndarray:
    """The id sequence of all blocks; any sub-range of ``offsets`` works alone."""
    raw = np.frombuffer(payload, np.uint8)
    rows = len(offsets)
    if not rows:
        return np.zeros(0, np.uint32)
    at = offsets.astype(np.int64)
    head = raw[at[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD).reshape(rows)
    out = np.zeros((rows, BLOCK), np.uint32)
    body = at + _HEAD.itemsize
    for w in np.unique(head["width"]):
        mine = np.flatnonzero(head["width"] == w)
        if w:
            full = BLOCK * int(w) // 8
            index = np.minimum(body[mine][:, None] + np.arange(full), len(raw) - 1)
            bits = np.zeros((len(mine) * BLOCK, 32), np.uint8)
            bits[:, :w] = np.unpackbits(raw[index], axis=1, bitorder="little").reshape(-1, int(w))
            out[mine] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(len(mine), BLOCK)
    tail = body + (head["n"].astype(np.int64) * head["width"] + 7) // 8
    for i in np.flatnonzero(head["n_exc"]):
        m, p = int(head["n_exc"][i]), int(tail[i])
        where = np.frombuffer(payload, "<u2", m, p)
        out[i, where] |= np.frombuffer(payload, "<u4", m, p + 2 * m) << np.uint32(head["width"][i])
    out += head["min"][:, None]
    keep = np.arange(BLOCK) < head["n"][:, None]
    return out[keep]


# --- tokens ------------------------------------------------------------------


class WordEncoder:
    """Ids of whole texts by way of their words.

    The tokenizer drops white space and never merges across it, nor between a
    letter and punctuation, so a text's ids are its words' ids in order; each
    distinct word is encoded once per worker and its ids are kept in one array.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.codes: dict[bytes, int] = {}
        self.pool, self.start, self.length, self.times = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Runs of letters go many to a text: each gives one run of ids up to a word-end token."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if _LETTERS(w)]
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        other = [i for i, w in enumerate(words) if not _LETTERS(w)]
        for group, ids in zip(groups, self._encode([" ".join([words[i] for i in g]) for g in groups]), strict=True):
            cut = 4 * (np.flatnonzero(self.ends[np.frombuffer(ids, np.uint32)]) + 1)
            if len(cut) == len(group) and cut[-1] == len(ids):
                lo = 0
                for i, hi in zip(group, cut.tolist(), strict=True):
                    out[i] = ids[lo:hi]
                    lo = hi
            else:
                other += group
        for i, ids in zip(other, self._encode([words[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def _learn(self, words: list[bytes]) -> None:
        """New words take the next codes in order."""
        found = self._encode_words([w.decode("utf-8", "replace") for w in words])
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.codes.update(zip(words, range(len(self.codes), len(self.codes) + len(words)), strict=True))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.times = np.concatenate((self.times, np.zeros(len(found), np.int64)))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(found), np.uint32)))

    def _shrink(self) -> None:
        """Drop the words met only once since the last time."""
        keep = np.flatnonzero(self.times > 1)
        length = self.length[keep]
        ends = np.cumsum(length)
        self.pool = self.pool[np.repeat(self.start[keep] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
        self.start, self.length = ends - length, length
        words = list(self.codes)
        self.codes = {words[i]: j for j, i in enumerate(keep.tolist())}
        self.times = np.zeros(len(keep), np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts back to back, where each text's ids start and end)."""
        if len(self.codes) > CACHE_WORDS:
            self._shrink()
        raw = data.tobytes()
        if b"<|" not in raw:  # special tokens are told from their upper-case look-alikes
            data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
            raw = data.tobytes()
        starts, ends, first = word_spans(data, offsets)
        # one end mark after an ASCII letter is a word of its own
        cut = np.flatnonzero((ends - starts > 1) & _MARK[data[ends - 1]] & _ASCII_LETTER[data[ends - 2]]) if len(ends) else np.zeros(0, np.int64)
        first = first + np.searchsorted(cut, first)
        starts, ends = np.insert(starts, cut + 1, ends[cut] - 1), np.insert(ends, cut, ends[cut] - 1)
        if not len(starts):
            return np.zeros(0, np.uint32), first
        at, distinct = span_codes(data, starts, ends)
        words = distinct.to_pylist()
        self._learn([w for w in words if w not in self.codes])
        codes = np.fromiter((self.codes[w] for w in words), np.int64, len(words))[at]
        self.times += np.bincount(codes, minlength=len(self.times))
        length = self.length[codes]
        stop = np.cumsum(length)
        ids = self.pool[np.repeat(self.start[codes] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.concatenate(([0], stop))[first]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# --- jobs --------------------------------------------------------------------


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text and write the files; returns their folder.

    Documents are dealt by ranges of their key and sorted within, so parts and
    chunks ascend.  Only the text crosses the shuffle; ids are made after it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(tokenizer_path)
        held: list[np.ndarray] = []
        keys: list[int] = []
        counts: list[int] = []
        size, end = 0, np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal chunk, start, size
            ids = np.concatenate(held)
            payload, offsets = encode_blocks(ids)
            row = {"part": [part], "chunk": [chunk], "start": [start], "n_ids": [len(ids)], "docs": [np.array(keys, "<i8").tobytes()], "lengths": [np.array(counts, "<u4").tobytes()], "offsets": [offsets.tobytes()], "payload": [payload]}
            chunk, start, size = chunk + 1, start + len(ids), 0
            held.clear()
            keys.clear()
            counts.clear()
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = strings(batch.column(1))
            for lo, hi in row_chunks(offsets, 1 << 20):
                ids, cut = encoder(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i in range(hi - lo):
                    mine = ids[cut[i] : cut[i + 1]]
                    held += (mine, end)
                    keys.append(names[lo + i])
                    counts.append(len(mine) + 1)
                    size += len(mine) + 1
                    if size >= CHUNK_IDS:
                        yield flush()
        if held:
            yield flush()

    dealt = docs.select("rid", "text").repartitionByRange(parts_of(docs), "rid").sortWithinPartitions("rid")
    spark = docs.sparkSession
    at = f"{shared_dir(spark)}/textloom-ids-{uuid.uuid4().hex}"
    dealt.mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(at)
    return at


_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("offsets", pa.binary()), ("payload", pa.binary())])


def read_ids(spark, at: str, with_ids: bool = False) -> DataFrame:
    """Decode the files: one row per document with its place, and its ids if asked."""
    files = spark.read.schema(CHUNK_SCHEMA).parquet(at)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("part_ids").over(order), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, docs, lengths, offsets, payload = (batch.column(i)[row].as_py() for i in range(5))
                ids = decode_blocks(payload, np.frombuffer(offsets, "<u4")).astype("<u4")
                counts = np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = {"rid": np.frombuffer(docs, "<i8"), "start": start + ends - counts, "n_tokens": counts, "ids_crc32": np.array(crcs, np.int64)}
                if with_ids:
                    out["ids"] = pa.array([ids[e - c : e].astype(np.int32) for e, c in zip(ends, counts, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    placed = files.join(F.broadcast(base), F.col("part") == F.col("_part"))  # a row per file part
    return placed.select((F.col("start") + F.col("base")).alias("start"), "docs", "lengths", "offsets", "payload").mapInArrow(decode, "rid bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files.

    Null and empty texts hold the end id alone.  Repeated or null doc_ids get
    rows of their own, in (doc_id, text) order, nulls first.  An empty table
    gives no files' rows and an empty result.  Columns besides doc_id and text are not read, whatever their names.  A long
    text is one document; a task holds about 2 MB of texts, or one longer text, at a time.
    """
    keyed, plain = rowed(docs)
    return named(read_ids(docs.sparkSession, write_ids(keyed, tokenizer_path, end_id)), keyed, plain)


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
