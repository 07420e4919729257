"""Phrase mining: document frequencies of n-grams by side and half, ratios with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions.text import hash_bucket, ngrams
from textloom.operators.stylometry import documents

#: Outer characters that are not part of a token.
OUTER = '"“”‘’()[]{}«»'
N, MIN_DF, SMOOTH = 3, 5, 0.5


def rows(spark, sf_dir: str) -> DataFrame:
    """(doc_id, side, half, register, tokens) of labelled documents; side 1 is label quality 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 1).otherwise(0).alias("side"))
    tok = F.filter(F.transform(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: F.btrim(w, F.lit(OUTER))), lambda w: w != "")
    return documents(spark, sf_dir).join(labels, "doc_id").select("doc_id", "side", (hash_bucket(F.col("doc_id").cast("string"), 2) == 0).alias("mine"), F.col("lang").alias("register"), tok.alias("tok"))


def frequencies(marked: DataFrame, n: int = N, min_df: int = MIN_DF) -> DataFrame:
    """Grams that enough documents of both sides hold in the mining half.

    One row per document and distinct gram is counted map-side before the shuffle.
    """
    grams = marked.select("side", "mine", "register", F.explode(F.array_distinct(ngrams(F.col("tok"), n))).alias("g"))
    cell = lambda side, mine: F.sum(((F.col("side") == side) & (F.col("mine") == mine)).cast("int"))
    per = grams.groupBy("g").agg(cell(1, True).alias("a_mine"), cell(0, True).alias("b_mine"), cell(1, False).alias("a_test"), cell(0, False).alias("b_test"), F.countDistinct("register").alias("n_registers"))
    return per.where((F.col("a_mine") >= min_df) & (F.col("b_mine") >= min_df))


def with_ratio(df: DataFrame, a: str, na: str, b: str, nb: str) -> DataFrame:
    """Smoothed rate ratio of a / na to b / nb with its 95 % log interval."""
    k = F.lit(SMOOTH)
    rr = ((F.col(a) + k) / (F.col(na) + 2 * k)) / ((F.col(b) + k) / (F.col(nb) + 2 * k))
    se = F.sqrt(F.greatest(F.lit(0.0), 1 / (F.col(a) + k) - 1 / (F.col(na) + 2 * k) + 1 / (F.col(b) + k) - 1 / (F.col(nb) + 2 * k)))
    return df.withColumn("ratio", F.round(rr, 6)).withColumn("low", F.round(rr * F.exp(-1.96 * se), 6)).withColumn("high", F.round(rr * F.exp(1.96 * se), 6))


def phrase_table(spark, sf_dir: str) -> DataFrame:
    marked = rows(spark, sf_dir)
    totals = marked.where("mine").agg(F.sum("side").alias("na"), F.sum(1 - F.col("side")).alias("nb"))
    found = frequencies(marked).crossJoin(F.broadcast(totals))  # one row of totals
    return with_ratio(found, "a_mine", "na", "b_mine", "nb").select("g", "a_mine", "b_mine", "a_test", "b_test", "n_registers", "ratio", "low", "high")


PHRASE_SQL = r"""
WITH t AS (SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS side, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 AS mine, lang,
  list_filter(list_transform(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: trim(x, '"“”‘’()[]{}«»')), lambda y: y <> '') AS w
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
n AS (SELECT sum(side) AS na, sum(1 - side) AS nb FROM t WHERE mine),
g AS (SELECT DISTINCT doc_id, side, mine, lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
c AS (SELECT g, sum((side = 1 AND mine)::INT)::BIGINT AS a_mine, sum((side = 0 AND mine)::INT)::BIGINT AS b_mine, sum((side = 1 AND NOT mine)::INT)::BIGINT AS a_test, sum((side = 0 AND NOT mine)::INT)::BIGINT AS b_test, count(DISTINCT lang) AS n_registers FROM g GROUP BY g HAVING a_mine >= 5 AND b_mine >= 5),
r AS (SELECT *, ((a_mine + 0.5) / (na + 1.0)) / ((b_mine + 0.5) / (nb + 1.0)) AS rr, sqrt(greatest(0.0, 1 / (a_mine + 0.5::DOUBLE) - 1 / (na + 1.0::DOUBLE) + 1 / (b_mine + 0.5::DOUBLE) - 1 / (nb + 1.0::DOUBLE))) AS se FROM c, n)
SELECT g, a_mine, b_mine, a_test, b_test, n_registers, round(rr::DOUBLE, 6) AS ratio, round(rr::DOUBLE * exp(-1.96 * se), 6) AS low, round(rr::DOUBLE * exp(1.96 * se), 6) AS high FROM r
"""

QUERIES = {"phrase_table": phrase_table}
ORACLE_SQL = {"phrase_table": PHRASE_SQL}
