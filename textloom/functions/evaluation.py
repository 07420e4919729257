"""Evaluation of yes/no methods and scores: confusion, exact tests, corrections, sweeps, operating curves.

Rows are counted first (map-side), so windows and exact tests only see one row
per cell, threshold or distinct score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.stylometry import documents

#: Thresholds of a sweep and false-positive budgets of an operating curve.
THRESHOLDS = tuple(range(0, 900, 50))
BUDGETS = (0.01, 0.05, 0.1, 0.2)
#: Tails of fair coins end in a 5: this much more before rounding makes them fall one way.
EDGE = 1e-9


def judged(spark, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, truth, score, a, b): two simple methods on labelled documents.

    score: words; method a: 300 words or more; method b: a comma for every 12 words or more.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("truth"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")
    commas = F.coalesce(F.regexp_count("text", F.lit(",")), F.lit(0))
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", words.alias("score"), commas.alias("commas")).join(labels, "doc_id")
    return docs.select("doc_id", "lang", "source", "truth", "score", (F.col("score") >= 300).alias("a"), (F.col("commas") * 12 >= F.col("score")).alias("b"))


_JUDGED_SQL = r"j AS MATERIALIZED (SELECT doc_id, lang, source, truth, score, score >= 300 AS a, commas * 12 >= score AS b FROM (SELECT d.doc_id, lang, source, quality = 0 AS truth, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS score, coalesce(len(regexp_extract_all(text, ',')), 0) AS commas FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL))"


def confusion(rows: DataFrame) -> DataFrame:
    """Confusion counts and rates of each method, overall and by language."""
    long = rows.select("lang", "truth", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("said")) for m in ("a", "b")])).alias("m")).select("lang", "truth", "m.*")
    n = lambda said, truth: F.count_if((F.col("said") == said) & (F.col("truth") == truth))
    cells = long.groupingSets([["method"], ["method", "lang"]], "method", "lang").agg(F.grouping_id().alias("level"), n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return cells.select("method", "lang", "level", "tp", "fp", "fn", "tn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("fp", "tn").alias("fpr"))


CONFUSION_SQL = f"""
WITH {_JUDGED_SQL}, l AS (SELECT lang, truth, 'a' AS method, a AS said FROM j UNION ALL SELECT lang, truth, 'b', b FROM j),
c AS (SELECT method, lang, grouping(method, lang)::BIGINT AS level, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM l GROUP BY GROUPING SETS ((method), (method, lang)))
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c
"""


def exact_tail(low: Column, n: Column) -> Column:
    """P(X <= low) for n fair coins, summed in logarithms so that large n do not vanish."""
    zero = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))
    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("bigint"), low.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, zero, lambda z, i: F.struct((z["term"] + F.ln((n - i + 1) / i)).alias("term"), (z["sum"] + F.exp(z["term"] + F.ln((n - i + 1) / i))).alias("sum")), lambda z: z["sum"])


def mcnemar(rows: DataFrame, by: str) -> DataFrame:
    """Exact McNemar test of method a against b in every group, with Holm and Benjamini-Hochberg adjustment over the groups."""
    right = lambda m: F.col(m) == F.col("truth")
    cells = rows.groupBy(F.coalesce(by, F.lit("")).alias("cell")).agg(F.count_if(right("a") & ~right("b")).alias("only_a"), F.count_if(right("b") & ~right("a")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    p = cells.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * exact_tail(F.least("only_a", "only_b"), n.cast("double")))))
    return adjusted(p, "p").select("cell", "only_a", "only_b", *[F.round(F.col(c) + EDGE, 6).alias(c) for c in ("p", "holm", "bh")], (F.col("bh") <= 0.05).alias("significant"))


def adjusted(tests: DataFrame, p: str) -> DataFrame:
    """``tests`` (a row per hypothesis) with step-down Holm and step-up Benjamini-Hochberg values."""
    order = Window.orderBy(p, "cell")
    m = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = tests.withColumn("_i", F.row_number().over(order)).withColumn("_m", m)
    holm = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.least(F.lit(1.0), F.col("_m") / F.col("_i") * F.col(p))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return placed.withColumn("holm", holm).withColumn("bh", bh).drop("_i", "_m")


MCNEMAR_SQL = f"""
WITH {_JUDGED_SQL}, c AS (SELECT coalesce(source, '') AS cell, count(*) FILTER (a = truth AND b <> truth) AS only_a, count(*) FILTER (b = truth AND a <> truth) AS only_b FROM j GROUP BY 1),
p AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0::DOUBLE))))) END AS p FROM c),
i AS (SELECT *, row_number() OVER (ORDER BY p, cell) AS i, count(*) OVER () AS m FROM p),
h AS (SELECT *, max(least(1.0::DOUBLE, (m - i + 1) * p)) OVER (ORDER BY i) AS holm, min(least(1.0::DOUBLE, m / i * p)) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bh FROM i)
SELECT cell, only_a, only_b, round(p + {EDGE}, 6) AS p, round(holm + {EDGE}, 6) AS holm, round(bh + {EDGE}, 6) AS bh, bh <= 0.05 AS significant FROM h
"""


def sweep(rows: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, truth, n, hits, rate): rows at or over every threshold, from one histogram, not one pass each."""
    band = sum(((F.col("score") >= t).cast("int") for t in thresholds), F.lit(0))
    bands = rows.groupBy("truth", band.alias("band")).agg(F.count("*").alias("k"))
    marks = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("least")) for i, t in enumerate(thresholds)]))
    per = bands.select("truth", "band", "k", marks.alias("m"))
    out = per.groupBy("truth", F.col("m.threshold").alias("threshold")).agg(F.sum("k").alias("n"), F.sum(F.when(F.col("band") >= F.col("m.least"), F.col("k")).otherwise(0)).alias("hits"))
    return out.select("threshold", "truth", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"))


SWEEP_SQL = f"WITH {_JUDGED_SQL}, t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold) SELECT threshold, truth, count(*) AS n, count(*) FILTER (score >= threshold) AS hits, round(count(*) FILTER (score >= threshold) / count(*), 6) AS rate FROM j, t GROUP BY ALL"


def operating_curve(rows: DataFrame, budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """(budget, threshold, fpr, tpr): the lowest score whose rows at or over it keep the false positives within budget.

    One row per distinct score is counted before the window.
    """
    counts = rows.groupBy("score").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    curve = counts.select("score", (F.sum("neg").over(down) / F.sum("neg").over(whole)).alias("fpr"), (F.sum("pos").over(down) / F.sum("pos").over(whole)).alias("tpr"))
    marked = curve.select("*", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")).where("fpr <= budget")
    return marked.groupBy("budget").agg(F.min("score").alias("threshold"), F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr")).select("budget", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


CURVE_SQL = f"""
WITH {_JUDGED_SQL}, c AS (SELECT score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM j GROUP BY 1),
v AS (SELECT score, sum(neg) OVER (ORDER BY score DESC) / sum(neg) OVER () AS fpr, sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER () AS tpr FROM c),
b AS (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BUDGETS)}]) AS budget)
SELECT budget, min(score) AS threshold, round(max(fpr), 6) AS fpr, round(max(tpr), 6) AS tpr FROM v JOIN b ON fpr <= budget GROUP BY budget
"""


def balanced_rates(rows: DataFrame) -> DataFrame:
    """Mean over languages of each method's smoothed rate, its largest one, and how much of all rates that is."""
    long = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("said")) for m in ("a", "b")])).alias("m")).select("lang", "m.*")
    per = long.groupBy("method", "lang").agg(((F.count_if("said") + 0.5) / (F.count("*") + 1.0)).alias("rate"))
    return per.groupBy("method").agg(F.round(F.avg("rate"), 6).alias("balanced"), F.round(F.max("rate"), 6).alias("largest"), F.round(F.max("rate") / F.sum("rate"), 6).alias("concentration"), F.max_by("lang", F.struct("rate", "lang")).alias("largest_in"))


BALANCED_SQL = f"""
WITH {_JUDGED_SQL}, l AS (SELECT coalesce(lang, '') AS lang, 'a' AS method, a AS said FROM j UNION ALL SELECT coalesce(lang, ''), 'b', b FROM j),
p AS (SELECT method, lang, (count(*) FILTER (said) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE) AS rate FROM l GROUP BY ALL)
SELECT method, round(avg(rate), 6) AS balanced, round(max(rate), 6) AS largest, round(max(rate) / sum(rate), 6) AS concentration, arg_max(lang, (rate, lang)) AS largest_in FROM p GROUP BY 1
"""


def union_coverage(rows: DataFrame) -> DataFrame:
    """Per truth: rows that method a, b, either, both and only one of them find; precision and lift of each."""
    every = F.sum(F.count("*")).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.groupBy("truth").agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") | F.col("b")).alias("n_either"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") != F.col("b")).alias("n_one"), every.alias("n_all"))


COVERAGE_SQL = f"WITH {_JUDGED_SQL} SELECT truth, count(*) AS n, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a OR b) AS n_either, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a <> b) AS n_one, (sum(count(*)) OVER ())::BIGINT AS n_all FROM j GROUP BY truth"


def percentile_ranks(rows: DataFrame) -> DataFrame:
    """Per document of truth 1: the share of truth-0 scores that are not above its own, by cumulated counts of distinct scores."""
    counts = rows.groupBy("score").agg(F.count_if(~F.col("truth")).alias("ref"))
    up = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = counts.select("score", F.round(F.try_divide(F.sum("ref").over(up), F.sum("ref").over(whole)), 6).alias("percentile"))
    return rows.where("truth").join(share, "score").select("doc_id", "score", "percentile")


PERCENTILE_SQL = f"WITH {_JUDGED_SQL} SELECT x.doc_id, x.score, round((SELECT count(*) FILTER (y.score <= x.score) / count(*) FROM j y WHERE NOT y.truth), 6) AS percentile FROM j x WHERE x.truth"


def length_bands(rows: DataFrame) -> DataFrame:
    """Score levels by fixed bounds, and how both methods do in each."""
    level = F.when(F.col("score") < 50, "very short").when(F.col("score") < 200, "short").when(F.col("score") < 800, "medium").otherwise("long")
    agree = F.count_if(F.col("a") == F.col("b"))
    return rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), agree.alias("n_agree"), F.round(F.avg((F.col("a") == F.col("truth")).cast("int")), 6).alias("accuracy_a"), F.round(F.avg((F.col("b") == F.col("truth")).cast("int")), 6).alias("accuracy_b"))


BANDS_SQL = f"WITH {_JUDGED_SQL} SELECT CASE WHEN score < 50 THEN 'very short' WHEN score < 200 THEN 'short' WHEN score < 800 THEN 'medium' ELSE 'long' END AS level, count(*) AS n, count(*) FILTER (a = b) AS n_agree, round(avg((a = truth)::INT), 6) AS accuracy_a, round(avg((b = truth)::INT), 6) AS accuracy_b FROM j GROUP BY 1"

QUERIES = {
    "confusion": lambda s, d: confusion(judged(s, d)),
    "mcnemar": lambda s, d: mcnemar(judged(s, d), "source"),
    "threshold_sweep": lambda s, d: sweep(judged(s, d)),
    "budget_curve": lambda s, d: operating_curve(judged(s, d)),
    "balanced_rates": lambda s, d: balanced_rates(judged(s, d)),
    "union_coverage": lambda s, d: union_coverage(judged(s, d)),
    "percentile_ranks": lambda s, d: percentile_ranks(judged(s, d)),
    "length_bands": lambda s, d: length_bands(judged(s, d)),
}
ORACLE_SQL = {
    "confusion": CONFUSION_SQL,
    "mcnemar": MCNEMAR_SQL,
    "threshold_sweep": SWEEP_SQL,
    "budget_curve": CURVE_SQL,
    "balanced_rates": BALANCED_SQL,
    "union_coverage": COVERAGE_SQL,
    "percentile_ranks": PERCENTILE_SQL,
    "length_bands": BANDS_SQL,
}
