"""Statistics over grouped counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for an empty total."""
    p, zz = successes / total, F.lit(z * z)
    centre = (p + zz / (2 * total)) / (1 + zz / total)
    half = F.lit(z) * F.sqrt(p * (1 - p) / total + zz / (4 * total * total)) / (1 + zz / total)
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), centre - half), 6)), F.when(total > 0, F.round(F.least(F.lit(1.0), centre + half), 6))


def rank_statistics(values: DataFrame) -> DataFrame:
    """(feature, side 0/1, value) -> AUROC, Cliff's delta and Cohen's d of side 1 against side 0.

    Ties share their mean rank.  Equal values are counted before the window, so
    it sorts distinct values of a feature, not rows.
    """
    counts = values.groupBy("feature", "value").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    before = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    wins = counts.withColumn("below", F.coalesce(F.sum("b").over(before), F.lit(0)))
    u = wins.groupBy("feature").agg(F.sum(F.col("a") * F.col("below") + F.col("a") * F.col("b") / 2).alias("u"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    one = lambda s: F.when(F.col("side") == s, F.col("value"))
    spread = values.groupBy("feature").agg(F.avg(one(1)).alias("ma"), F.avg(one(0)).alias("mb"), F.var_samp(one(1)).alias("va"), F.var_samp(one(0)).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    auroc = F.col("u") / (F.col("na") * F.col("nb"))
    return u.join(spread, "feature").select("feature", "na", "nb", F.round(auroc, 6).alias("auroc"), F.round(2 * auroc - 1, 6).alias("cliffs_delta"), F.round((F.col("ma") - F.col("mb")) / pooled, 6).alias("cohens_d"))


def tpr_at_fpr(values: DataFrame, budget: float) -> DataFrame:
    """Detection of side 1 at a budget of side 0, in the better direction."""
    edges = values.where("side = 0").groupBy("feature").agg(F.expr(f"percentile(value, {1 - budget})").alias("hi"), F.expr(f"percentile(value, {budget})").alias("lo"))
    shares = values.where("side = 1").join(edges, "feature").groupBy("feature").agg(F.avg((F.col("value") > F.col("hi")).cast("int")).alias("up"), F.avg((F.col("value") < F.col("lo")).cast("int")).alias("down"))
    return shares.select("feature", F.greatest("up", "down").alias("tpr"), F.when(F.col("up") >= F.col("down"), "high").otherwise("low").alias("direction"))


def feature_values(spark, sf_dir: str) -> DataFrame:
    """Long table of three integer features of labelled documents; side 1 is label quality 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("side"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id")
    return docs.select("side", F.expr("stack(3, 'chars', cast(length(text) as double), 'words', cast(regexp_count(text, '[^ \\t\\n\\r]+') as double), 'commas', cast(length(text) - length(replace(text, ',', '')) as double)) as (feature, value)"))


_VALUES_SQL = r"""
WITH d AS (SELECT CASE WHEN quality = 0 THEN 1 ELSE 0 END AS side, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '[^ \t\n\r]+'))::DOUBLE AS words, (length(text) - length(replace(text, ',', '')))::DOUBLE AS commas FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
v AS (SELECT side, 'chars' AS feature, chars AS value FROM d UNION ALL SELECT side, 'words', words FROM d UNION ALL SELECT side, 'commas', commas FROM d)
"""
RANK_SQL = _VALUES_SQL + r"""
, r AS (SELECT feature, side, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM v),
u AS (SELECT feature, sum(side) AS na, sum(1 - side) AS nb, sum(CASE WHEN side = 1 THEN rk END) AS ra, avg(CASE WHEN side = 1 THEN value END) AS ma, avg(CASE WHEN side = 0 THEN value END) AS mb, var_samp(CASE WHEN side = 1 THEN value END) AS va, var_samp(CASE WHEN side = 0 THEN value END) AS vb FROM r GROUP BY 1)
SELECT feature, na::BIGINT AS na, nb::BIGINT AS nb, round((ra - na * (na + 1) / 2) / (na * nb), 6) AS auroc, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 6) AS cliffs_delta,
  round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d FROM u
"""
TPR_SQL = _VALUES_SQL + r"""
, q AS (SELECT feature, quantile_cont(value, 0.95) AS hi, quantile_cont(value, 0.05) AS lo FROM v WHERE side = 0 GROUP BY 1),
s AS (SELECT v.feature, avg((value > hi)::INT) AS up, avg((value < lo)::INT) AS down FROM v JOIN q ON v.feature = q.feature WHERE side = 1 GROUP BY 1)
SELECT feature, greatest(up, down) AS tpr, CASE WHEN up >= down THEN 'high' ELSE 'low' END AS direction FROM s
"""


def label_rates(spark, sf_dir: str) -> DataFrame:
    """Toxic rate with its interval, per language, per source and overall; small cells keep counts only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source").join(labels, "doc_id")
    cells = docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    big = F.col("n") >= 30
    return cells.select("lang", "source", "n", "k", F.when(big, F.round(F.col("k") / F.col("n"), 6)).alias("rate"), F.when(big, low).alias("low"), F.when(big, high).alias("high"))


RATES_SQL = r"""
WITH c AS (SELECT lang, source, count(*) AS n, sum(toxic)::BIGINT AS k FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY GROUPING SETS ((lang), (source), ())),
p AS (SELECT *, k / n AS p, 1.959963984540054 * 1.959963984540054 AS zz FROM c),
w AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS centre, 1.959963984540054 * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n) AS half FROM p)
SELECT lang, source, n, k, CASE WHEN n >= 30 THEN round(p, 6) END AS rate, CASE WHEN n >= 30 THEN round(greatest(0.0, centre - half), 6) END AS low, CASE WHEN n >= 30 THEN round(least(1.0, centre + half), 6) END AS high FROM w
"""

QUERIES = {
    "rank_statistics": lambda s, d: rank_statistics(feature_values(s, d)),
    "tpr_at_fpr": lambda s, d: tpr_at_fpr(feature_values(s, d), 0.05),
    "label_rates": label_rates,
}
ORACLE_SQL = {"rank_statistics": RANK_SQL, "tpr_at_fpr": TPR_SQL, "label_rates": RATES_SQL}
