"""Sharding by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by its own permutation
(offset + j * skip mod size, from two hashes of its name); shards take turns
claiming their best slot that is still free.  A document's slot is its hash
modulo the table size, so placement is one look-up, shares are even to within
a slot, and adding or removing a shard moves few documents.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

#: A prime; the table's size is fixed, whatever the number of documents.
TABLE_SIZE = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Shard index of each slot.  Every shard gets floor or ceil of size / n slots."""
    if not 0 < len(shards) <= size:
        raise ValueError("need between 1 shard and as many as the table has slots")
    offset = [zlib.crc32(f"offset:{s}".encode()) % size for s in shards]
    skip = [zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1 for s in shards]
    table, tried, filled = [-1] * size, [0] * len(shards), 0
    while filled < size:
        for i in range(len(shards)):
            while True:
                slot = (offset[i] + tried[i] * skip[i]) % size
                tried[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            filled += 1
            if filled == size:
                break
    return table


def shard(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` added; same-named columns are replaced.

    The table goes along as a literal array (size is a constant, 64 KB here), so
    there is neither a join nor a shuffle.  Rows with equal ids share a shard;
    a null id is hashed as the empty text.
    """
    # constant folding turns each split into one literal array
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    names = F.split(F.lit("\n".join(shards)), "\n")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(size)).cast("int")
    return docs.withColumn("slot", slot).withColumn("shard", F.element_at(names, F.element_at(table, F.col("slot") + 1) + 1))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, with the load its own shard carries.

    The load sums whole texts: partial sums by shard come before the shuffle.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")))
    load = placed.groupBy("shard").agg(F.count("*").alias("shard_docs"), F.sum("n_bytes").alias("shard_bytes"))
    return placed.join(F.broadcast(load), "shard").select("doc_id", "slot", "shard", "n_bytes", "shard_docs", "shard_bytes")
