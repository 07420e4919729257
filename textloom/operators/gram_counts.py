"""Document frequencies of word sequences in two passes: counts by hash bucket, then exact counts of what is left.

The first pass counts documents per bucket of BITS bits, so its shuffle is bounded
whatever the number of different sequences.  A sequence stands in no more documents
than its bucket, so buckets below the threshold drop only sequences that would fail
it; the second pass counts the others by their words, exactly.  Both number words and
sequences per Arrow slice, and send sums of a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.functions import scan
from textloom.operators.markdown import STOPWORDS
from textloom.operators.stylometry import documents

BITS, SIZES = 24, (2, 3, 4)


_STOP = frozenset(STOPWORDS)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each word, the place of its text, the different words) of ``[a-z][a-z']*`` in the lower-case texts."""
    low = pc.utf8_lower(texts)
    for quote in "’‘":
        low = pc.replace_substring(low, quote, "'")
    data, offsets = scan.raw(low)
    letter = (data >= 0x61) & (data <= 0x7A)
    word = letter | (data == 0x27)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where texts do
    # a run's quotes before its first letter are no part of a word
    fresh = word.copy()
    fresh[1:] &= ~word[:-1] | edge[1:-1]
    run = np.cumsum(fresh)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
    seen = np.concatenate(([0], np.cumsum(letter)))
    inside = word & (seen[1:] > seen[lead])
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (run[1:] != run[:-1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(np.cumsum(inside)[starts] - 1, inside.sum()))
    packed = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(np.append(data[inside], np.uint8(0)))).dictionary_encode()
    return packed.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1, packed.dictionary.to_pylist()


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For each size: (place of the text, number of the sequence) of its different sequences that are not all stop words; the words' codes of each number; the words."""
    codes, owner, vocabulary = _words(texts)
    kinds = max(len(vocabulary), 1)
    topic = np.array([w not in _STOP for w in vocabulary], bool)
    number = codes
    for n in SIZES:
        m = max(len(codes) - n + 1, 0)
        # numbers that are equal exactly if the words are
        _, at, number = np.unique(number[:m] * kinds + codes[n - 1 :][:m], return_index=True, return_inverse=True)
        held = codes[at[:, None] + np.arange(n)]
        good = owner[:m] == owner[n - 1 :][:m]
        good &= topic[held].any(axis=1)[number] if len(held) else False
        pairs = np.unique(owner[:m][good] * (len(held) + 1) + number[good])
        yield pairs // (len(held) + 1), pairs % (len(held) + 1), held, vocabulary


def _mixed(held: np.ndarray, vocabulary: list[str], bits: int) -> np.ndarray:
    """Bucket of each sequence, by digests of its words."""
    digest = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in vocabulary), np.uint64, len(vocabulary))
    out = np.full(len(held), held.shape[1], np.uint64)
    for k in range(held.shape[1]):
        out = (out ^ digest[held[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """(gram, n_target, n_other) of rows (text, target): documents of either side that hold a sequence, where ``least`` of the target do."""
    marked, wide = rows.where("text is not null").select("target", "text"), BITS

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in scan.slices(batch.column(0)):
                # a text counts once for a bucket, whatever sizes meet there
                found = [owner << wide | _mixed(held, words, wide)[number] for owner, number, held, words in grams(texts) if len(number)]
                bucket, n = np.unique(np.unique(np.concatenate(found)) & ((1 << wide) - 1), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    sketch = marked.where("target").select("text").mapInArrow(buckets, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # as bits, a few MB whatever the number of buckets
    part, bits = F.shiftright("bucket", 12), F.collect_list(F.expr("cast(bucket & 4095 as smallint)"))
    kept = np.zeros(1 << wide, bool)
    for r in sketch.groupBy(part.alias("part")).agg(bits.alias("at")).toLocalIterator():
        kept[(r["part"] << 12) + np.array(r["at"], np.int64)] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(kept))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            at, target = 0, np.asarray(batch.column(0).fill_null(False))
            known = np.asarray(batch.column(0).is_valid())
            for texts in scan.slices(batch.column(1)):
                mine, valid = target[at : at + len(texts)], known[at : at + len(texts)]
                at += len(texts)
                for owner, number, held, words in grams(texts):
                    some = kept[_mixed(held, words, wide)] if len(held) else np.zeros(0, bool)
                    good = some[number] if len(held) else np.zeros(0, bool)
                    owner, number = owner[good], number[good]
                    ours = np.bincount(number[mine[owner]], minlength=len(held))
                    others = np.bincount(number[valid[owner] & ~mine[owner]], minlength=len(held))
                    left = np.flatnonzero(ours + others)
                    names = np.array(words, object)
                    text = names[held[left, 0]] if len(left) else np.zeros(0, object)
                    for k in range(1, held.shape[1]):
                        text = text + " " + names[held[left, k]] if len(left) else text
                    yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(ours[left]), pa.array(others[left])], ["gram", "n_target", "n_other"])

    counts = marked.mapInArrow(counted, "gram string, n_target bigint, n_other bigint").groupBy("gram").agg(F.sum("n_target").alias("n_target"), F.sum("n_other").alias("n_other"))
    return counts.where(F.col("n_target") >= least)


def labelled(spark, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return documents(spark, sf_dir).join(good, "doc_id").select("text", (F.col("quality") == 0).alias("target"))


_GRAMS = "list_concat(" + ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in SIZES) + ")"
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
FREQUENT_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[’‘]', '''', 'g'), '[a-z][a-z'']*') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_distinct({_GRAMS})) AS gram FROM w),
l AS (SELECT doc_id, max(quality) = 0 AS target FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)
SELECT gram, count(*) FILTER (target) AS n_target, count(*) FILTER (NOT target) AS n_other FROM g JOIN l USING (doc_id)
WHERE len(list_filter(string_split(gram, ' '), lambda x: x NOT IN ({_STOP_SQL}))) > 0 GROUP BY gram HAVING count(*) FILTER (target) >= 3
"""
QUERIES = {"frequent_grams": lambda s, d: frequent(labelled(s, d), 3)}
ORACLE_SQL = {"frequent_grams": FREQUENT_SQL}
