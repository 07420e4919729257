"""Bootstrap intervals without copies of rows: paired draws from a counter-based generator, cluster draws as weights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.corpus import ranked

# Increments of the 32-bit generator.
STEP = 0x6D2B79F5
SEED, ITERATIONS = 20260826, 4_000
LEVELS = (0.025, 0.975)
#: More pairs than this meet their draws in a join; the result is the same.
MAX_BROADCAST_PAIRS = 1_000_000


def interpolated(ordered: Column, q: float) -> Column:
    """The quantile of an ascending array, between its neighbours."""
    place = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def _product32(a: Column, b: Column) -> Column:
    """a * b of unsigned 32-bit numbers, modulo 2^32, within 64 bits."""
    low = a * (b.bitwiseAND(0xFFFF))
    high = (a * F.shiftright(b, 16)).bitwiseAND(0xFFFF)
    return (low + high * 65536).bitwiseAND(0xFFFFFFFF)


def draw(k: Column, seed: int) -> Column:
    """The k-th number (from 1) of the generator: unsigned 32 bits; any of them without those before."""
    t = (F.lit(seed) + _product32(k.bitwiseAND(0xFFFFFFFF), F.lit(STEP).cast("bigint"))).bitwiseAND(0xFFFFFFFF)
    t = _product32(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(1))
    t = t.bitwiseXOR((t + _product32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(0xFFFFFFFF))
    return t.bitwiseXOR(F.shiftright(t, 14))


def paired_bootstrap(pairs: DataFrame, order: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """(n, estimate, lower, upper) of the mean of a - b over rows (order, a, b): ``iterations`` resamples of all pairs.

    Pairs are numbered by ``order`` (unique, text); replicate r draws number
    floor(u * n) for its i-th pair with the generator's number r * n + i + 1, so the
    result hangs on the seed only.  Replicates are spread over tasks, to which up to
    MAX_BROADCAST_PAIRS differences are sent; beyond, draws are rows that meet the
    pairs in a join and are summed by replicate map-side.  An empty table has no row.
    """
    differences = pairs.select(F.lit(0).alias("_all"), order, (F.col("a") - F.col("b")).alias("d"))
    numbered = ranked(differences, ["_all"], order).select(F.col("before").alias("place"), "d")
    n = numbered.count()
    if not n:
        return pairs.groupBy().agg(F.count("*").alias("n"), *[F.lit(None).cast("double").alias(x) for x in ("estimate", "lower", "upper")]).where("n > 0")
    spark = pairs.sparkSession
    if n <= MAX_BROADCAST_PAIRS:
        means = _means(numbered, n, iterations, seed)
    else:
        k = F.col("id")
        place = F.floor(draw(k + 1, seed) * F.lit(float(n)) / F.lit(4294967296.0)).cast("bigint")
        drawn = spark.range(iterations * n).select(F.floor(k / n).alias("replicate"), place.alias("place"))
        means = drawn.join(numbered, "place").groupBy("replicate").agg((F.sum("d") / n).alias("v"))
    estimate = numbered.groupBy().agg(F.count("*").alias("n"), F.avg("d").alias("estimate"))
    return estimate.crossJoin(means.groupBy().agg(*_interval()))  # one row each


def _means(numbered: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """(replicate, v): the mean of each resample of differences that fit a task."""
    spark = numbered.sparkSession
    sent = spark.sparkContext.broadcast(np.array([r["d"] for r in sorted(numbered.collect(), key=lambda r: r["place"])], float))  # MAX_BROADCAST_PAIRS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = sent.value
        for batch in batches:
            values = [float(d[(draws(int(r) * n, n, seed) * np.uint64(n)) >> np.uint64(32)].sum()) / n for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["replicate", "v"])

    return spark.range(iterations).withColumnRenamed("id", "replicate").mapInArrow(run, "replicate bigint, v double")


def draws(first: int, count: int, seed: int) -> np.ndarray:
    """The generator's numbers first + 1 to first + count."""
    mask, u = np.uint64(0xFFFFFFFF), np.uint64
    k = np.arange(first + 1, first + count + 1, dtype=np.uint64) & mask
    t = (u(seed) + k * u(STEP)) & mask
    t = ((t ^ (t >> u(15))) * (t | u(1))) & mask
    t ^= (t + (((t ^ (t >> u(7))) * (t | u(61))) & mask)) & mask
    return t ^ (t >> u(14))


def _interval() -> list[Column]:
    values = F.array_sort(F.collect_list("v"))  # one value a replicate
    return [F.round(interpolated(values, q), 9).alias(name) for q, name in zip(LEVELS, ("lower", "upper"))]


def _weight(u: Column) -> Column:
    """A draw from the Poisson distribution of mean 1, from a uniform number below 1."""
    steps, total, term = [], 0.0, math.exp(-1)
    for i in range(10):
        total += term
        term /= i + 1
        steps.append((u >= total).cast("int"))
    return sum(steps[1:], steps[0])


def cluster_bootstrap(rows: DataFrame, group: str, cluster: str, value: str, iterations: int = 400, seed: int = SEED) -> DataFrame:
    """(group, n_clusters, n_rows, estimate, lower, upper) of the mean of ``value``, clusters drawn as wholes.

    Rows are summed by cluster first.  A cluster's weight in a replicate is a
    Poisson draw from the digest of seed, cluster and replicate, so no row is copied
    or shuffled, tasks agree without talking, and reruns agree.  Replicates that draw
    no cluster of a group do not count.
    """
    sums = rows.groupBy(group, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    replicates = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(cluster).cast("string"), F.lit("")), F.col("replicate").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    weighed = replicates.withColumn("w", _weight(u))
    means = weighed.groupBy(group, "replicate").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("n")).alias("n")).where("n > 0").select(F.col(group).alias("_g"), (F.col("s") / F.col("n")).alias("v"))
    intervals = means.groupBy("_g").agg(*_interval())
    whole = sums.groupBy(group).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"), F.round(F.sum("s") / F.sum("n"), 9).alias("estimate"))
    return whole.join(intervals, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _labelled(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null and toxic is not null")
    return labels.select(F.lpad(F.col("doc_id").cast("string"), 18, "0").alias("key"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))


def _by_source(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    lineage = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 7).cast("string")).alias("lineage")
    return docs.join(labels, "doc_id").select(F.coalesce("lang", F.lit("")).alias("lang"), lineage, F.col("quality").cast("double").alias("quality"))


_M = "4294967296"


def _draw_sql(k: str, seed: int) -> list[str]:
    """Columns t0 to t3 that lead to a draw, each named in the next."""
    return [
        f"({seed} + {k} * {STEP}) % {_M} AS t0",
        f"(xor(t0, t0 // 32768)::HUGEINT * (t0 | 1)) % {_M} AS t1",
        f"xor(t1::BIGINT, ((t1 + (xor(t1::BIGINT, t1::BIGINT // 128)::HUGEINT * (t1::BIGINT | 61)) % {_M}) % {_M})::BIGINT) AS t2",
        "xor(t2, t2 // 16384) AS t3",
    ]


_T = _draw_sql("(k + 1)", SEED)
_QUANTILES = "round(quantile_cont(v, 0.025), 9) AS lower, round(quantile_cont(v, 0.975), 9) AS upper"
PAIRED_SQL = f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lpad(doc_id::VARCHAR, 18, '0')) - 1 AS place, quality - toxic AS d FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
c AS (SELECT count(*) AS n FROM p), k AS (SELECT unnest(range(0, {ITERATIONS} * n)) AS k, n FROM c),
a AS (SELECT *, {_T[0]} FROM k), b AS (SELECT *, {_T[1]} FROM a), e AS (SELECT *, {_T[2]} FROM b), f AS (SELECT *, {_T[3]} FROM e),
m AS (SELECT k // n AS r, sum(d) / any_value(n) AS v FROM f JOIN p ON place = floor(t3 * n / {_M}.0::DOUBLE)::BIGINT GROUP BY 1)
SELECT (SELECT n FROM c) AS n, (SELECT avg(d) FROM p) AS estimate, {_QUANTILES} FROM m
"""


def _weight_sql(u: str) -> str:
    out, total, term = [], 0.0, math.exp(-1)
    for i in range(10):
        total += term
        term /= i + 1
        out.append(f"({u} >= {total!r}::DOUBLE)::INT")
    return " + ".join(out)


CLUSTER_SQL = f"""
WITH j AS (SELECT coalesce(lang, '') AS lang, concat_ws('/', source, (doc_id // 7)::VARCHAR) AS lineage, quality::DOUBLE AS quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
s AS (SELECT lang, lineage, sum(quality) AS s, count(*) AS n FROM j GROUP BY ALL),
r AS (SELECT *, unnest(range(0, 400)) AS replicate FROM s),
u AS (SELECT *, ('0x' || substr(md5(concat_ws(':', '{SEED}', lineage, replicate::VARCHAR)), 1, 8))::BIGINT / {_M}.0::DOUBLE AS u FROM r),
w AS (SELECT *, {_weight_sql('u')} AS w FROM u), m AS (SELECT lang, replicate, sum(w * s) / sum(w * n) AS v FROM w GROUP BY ALL HAVING sum(w * n) > 0),
i AS (SELECT lang, {_QUANTILES} FROM m GROUP BY lang)
SELECT lang, count(*) AS n_clusters, sum(n)::BIGINT AS n_rows, round(sum(s) / sum(n), 9) AS estimate, any_value(lower) AS lower, any_value(upper) AS upper FROM s JOIN i USING (lang) GROUP BY lang
"""
QUERIES = {
    "paired_bootstrap": lambda s, d: paired_bootstrap(_labelled(s, d), "key"),
    "cluster_bootstrap": lambda s, d: cluster_bootstrap(_by_source(s, d), "lang", "lineage", "quality"),
}
ORACLE_SQL = {"paired_bootstrap": PAIRED_SQL, "cluster_bootstrap": CLUSTER_SQL}
