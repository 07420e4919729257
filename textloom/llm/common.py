"""Shared pieces of the training-data operators: keys, shared storage, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one numpy pass holds; keeps a Python worker near 100 MB.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, if that is unset, one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, partitions: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor cannot take these rows with it, and both consumers of a
    forked plan read the same rows.
    """
    at = f"{shared_dir(df.sparkSession)}/textloom-{uuid.uuid4().hex}"
    out = df.write
    if partitions:
        out = out.partitionBy(*partitions)
    out.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """((rid, doc_id, text), whether rid is doc_id): ``rid`` is a unique bigint that orders rows as doc_id does.

    Where doc_id is unique and not null (checked on that column alone), rid is
    doc_id.  Otherwise rows are ordered by (doc_id, text), nulls first, and
    numbered, so that repeated rows become documents of their own.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = slim.select("doc_id")
    clash = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1)
    if not clash.take(1):
        return slim.select(F.col("doc_id").alias("rid"), "doc_id", "text"), True
    ordered = slim.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return written(ordered.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")), False


def named(result: DataFrame, keyed: DataFrame, plain: bool) -> DataFrame:
    """``result`` (with rid) under doc_id again."""
    if plain:
        return result.withColumnRenamed("rid", "doc_id")
    back = result.join(keyed.select("rid", "doc_id"), "rid")
    return back.select("doc_id", *[c for c in result.columns if c != "rid"])


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = pc.fill_null(column, "" if "string" in str(column.type) else b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per document the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # words end where documents do
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of every span, distinct spans): spans have one code exactly if their bytes are equal.

    Spans ascend, hold a byte at least and do not overlap.
    """
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    packed = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    kind, width = (pa.binary(), np.int32) if len(packed) < 1 << 31 else (pa.large_binary(), np.int64)
    found = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds.astype(width)), pa.py_buffer(packed)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of every word, taken once per distinct word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes, words = span_codes(data, starts, ends)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))[codes]


def parts_of(df: DataFrame, each: int = 32 << 20) -> int:
    """Tasks for a shuffle of the texts of ``df``: by the size of the files it scans, at least as many as the session asks for."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)  # a source that cannot tell its size names the largest number
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // each)
