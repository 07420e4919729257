"""Corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's docs; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm import decontamination, language_id, mixing, ngram_join, sharding
from textloom.llm.common import load, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of the predicted language for a document to stay.
MIN_LANGUAGE_SCORE = 0.35


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a unique bigint that orders rows as doc_id does, nulls last.

    Where doc_id is unique and not null (checked on that column alone), _row is
    doc_id.  Otherwise rows are ordered by all columns and numbered.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return docs.withColumn("_row", F.col("doc_id").cast("bigint"))
    rest = [F.col(c) for c in COLUMNS[1:] if c in docs.columns]
    return written(docs.orderBy(F.col("doc_id").asc_nulls_last(), *rest).withColumn("_row", F.monotonically_increasing_id()))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is a guess, go."""
    model = language_id.learned(docs)
    good = language_id.verdicts(docs, model, MIN_LANGUAGE_SCORE)
    return _columns(good)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: the one of smallest doc_id.

    The stage's word shingles are of five words, similarity 0.8 or more.  Rows that
    repeat a doc_id, or have none, are documents of their own; those without one
    stay only where no other of their group has one.
    """
    keyed = _keyed(docs)
    groups = ngram_join.ngram_join(keyed, ngram_join.Link(percent=80, shingle=5), id_col="_row")
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return _columns(keyed.join(keep, "_row", "left_semi"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go; each row by its own text."""
    keyed = _keyed(docs)
    leaks = decontamination.find(keyed, load(spark, sf_dir, "benchmark"), id_col="_row", rare_first=False).select(F.col("doc_id").alias("_row")).distinct()
    return _columns(keyed.join(written(leaks), "_row", "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: up to twice; those it does not take go.

    Targets are those of the mixing operator: sources weigh 3, 1, 2, repeating,
    and share 150 % of all words.  Rows that repeat a doc_id, or have none, are
    chosen one by one.
    """
    keyed = _keyed(docs)
    taken = mixing.mix(keyed, id_col="_row").where("taken > 0").select(F.col("doc_id").alias("_row"), F.expr("cast(taken div size as int)").alias("_times"))
    repeated = keyed.join(written(taken), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return _columns(repeated)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return sharding.shard(docs)


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned weights and the slot table are not to be had in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
