"""Mixing sources to target weights with hash-threshold histograms (native).

Targets are a capped proportional split (water-filling): sources in code-point
order (null last) weigh 3, 1, 2, repeating; together they get ``share`` of all
words; no source gets more than ``cap`` times its own size, and what a cap
frees is shared again by weight.

Documents are chosen by threshold, not by sorting: sizes are summed by source
and hash bucket, the bucket in which a source's budget runs out is found from
the running sums, and only that bucket is split by the next bits of the hash.
After ``LEVELS`` rounds a threshold per source remains and the documents are
filtered by comparing their own hash with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textloom.llm.common import WORD, written

#: Hex digits of the key that one histogram level adds, and the number of levels.
#: A key is KEY digits of the hash of id and text, then digits of the row's own number, which part rows that are alike.
DIGITS, LEVELS, KEY = 3, 8, 15
#: More sources than this are joined by shuffle instead.
MAX_BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same plus weight and target, one row per source.

    With sources ordered by cap * size / weight, the first i are capped if the
    rest, at the common rate they would then get, exceed the i-th ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.withColumn("weight", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), ((F.row_number().over(order) - 1) % 3 + 1).cast("int")))
    limit = weighed.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    rate = (
        limit.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("rate", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    # rates are of use from the first source that its own cap does not bind
    free = rate.withColumn("free_rate", F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "rate"))).over(every)["rate"])
    target = F.when(F.col("rate") > F.col("ratio"), F.col("limit")).otherwise(F.least(F.col("limit"), F.coalesce("free_rate", "rate") * F.col("weight")))
    return free.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is size times the whole repeats that its source's target implies,
    plus once more if the document's hash lies under the source's threshold.
    Null and empty texts have size 0 and take 0; a null source is a source.
    Rows are taken one by one, whether they repeat a doc_id, have none or are
    equal in all columns: a row's key is the hash of its id and text, and of rows
    alike in both it is arbitrary which are taken, not how many.  A long text is
    one row.  Columns besides id, text and source are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    alike = F.md5(F.concat_ws("|", filled(id_col), filled(text_col)).cast("binary"))
    # written before anything is chosen: the number of a row stays what it is
    own = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    slim = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            size.cast("bigint").alias("size"),
            F.concat(F.substring(alike, 1, KEY), F.substring(own, 1, DIGITS * LEVELS - KEY)).alias("h"),
        )
    )
    want = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap)
    want = want.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(0))
    want = written(want.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")))
    # source-level rows go to every executor only while there are few of them
    small = F.broadcast if want.count() <= MAX_BROADCAST_SOURCES else (lambda df: df)
    edge = want.select("source", F.lit("").alias("prefix"), F.col("left").cast("double").alias("rest"))
    for level in range(LEVELS):
        edge = written(_refine(slim, edge, level, small))  # a row a source; keeps plans, and the driver, small
    below = edge.select(F.col("source").alias("_e"), F.col("prefix").alias("threshold"), "rest", "edge_sum")
    per_source = want.select(F.col("source").alias("_s"), "source_size", "target", "whole").join(below, F.col("_s").eqNullSafe(F.col("_e")))
    out = slim.join(small(per_source), slim["source"].eqNullSafe(F.col("_s")))
    # the row on the threshold itself is taken if that comes nearer to the target
    extra = (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & (F.col("edge_sum") <= 2 * F.col("rest")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.when(extra, 1).otherwise(0))).cast("bigint").alias("taken"))


def _refine(slim: DataFrame, edge: DataFrame, level: int, small) -> DataFrame:
    """The boundary bucket of each source, split by the next digits of the hash.

    edge: (source, prefix, rest): budget left when the buckets before prefix are
    taken.  Returns the same one level deeper, with the boundary bucket's sum.
    A budget that is never used up ends behind the last bucket.
    """
    inside = slim.join(small(edge.select(F.col("source").alias("_s"), "prefix", "rest")), slim["source"].eqNullSafe(F.col("_s")) & F.col("h").startswith(F.col("prefix")))
    bucket = F.substring("h", 1, DIGITS * (level + 1)).alias("bucket")
    sums = inside.groupBy("source", bucket).agg(F.sum("size").alias("bucket_sum"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = sums.withColumn("cum", F.sum("bucket_sum").over(running))
    # boundary: first bucket whose running sum exceeds the budget, else the last
    place = F.conv(F.substring("bucket", -DIGITS, DIGITS), 16, 10).cast("bigint")  # a source's buckets share the digits before
    key = F.struct(F.when(F.col("cum") > F.col("rest"), 0).otherwise(1), F.when(F.col("cum") > F.col("rest"), place).otherwise(-place))
    return cum.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("cum") + F.col("bucket_sum")).alias("rest"), F.col("bucket_sum").cast("double").alias("edge_sum")), key).alias("b")).select("source", F.col("b.bucket").alias("prefix"), F.col("b.rest").alias("rest"), F.col("b.edge_sum").alias("edge_sum"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {KEY}) AS h, row_number() OVER () AS rn
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
p AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM r),
f AS (SELECT *, first_value(CASE WHEN rate <= ratio THEN rate END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS free_rate FROM p),
t AS (SELECT source, source_size, CASE WHEN rate > ratio THEN cap ELSE least(cap, coalesce(free_rate, rate) * weight) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT d.doc_id, d.source, d.size, d.h, d.rn, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM x),
e AS (SELECT *, min(CASE WHEN cum > rest THEN cum END) OVER (PARTITION BY source) AS edge FROM c)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN cum <= rest OR (cum = edge AND size <= 2 * (rest - cum + size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e
"""
