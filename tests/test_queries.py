"""Every registered query of the text-forensics part equals its SQL."""

from __future__ import annotations

import pytest

from tests.compare import database, differences
from textloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    mine, theirs, apart, example = differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name])
    assert (mine, apart) == (theirs, 0), example


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_a_row_per_text_at_least(spark, name):
    rows = QUERIES[name](spark, SF).select("doc_id")
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id")
    assert texts.join(rows, "doc_id", "left_anti").count() == 0


def test_streaming_quota_equals_batch(spark, tmp_path):
    from textloom.streaming import quota

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = quota.hourly_quota(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("hours")) == key(quota.hourly_quota(events))


def test_streaming_ledger_equals_batch(spark, tmp_path):
    from textloom.streaming import quota

    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = quota.single_use(stream).writeStream.outputMode("append").format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r["user_id"], r["event_type"]) for r in df.collect())
    assert spark.table("firsts").columns == quota.single_use(events).columns and key(spark.table("firsts")) == key(quota.single_use(events))


def test_hard_guard_stops_at_a_leak(spark):
    from textloom.operators import corpora

    docs = spark.createDataFrame([(1, "A  text"), (2, "another"), (3, None)], "doc_id bigint, text string")
    assert corpora.without_leaks(docs, docs.where("doc_id = 3")).count() == 3
    with pytest.raises(ValueError, match=r"\[1\]"):
        corpora.without_leaks(docs, spark.createDataFrame([("a text ",)], "text string"))


def test_ranked_equals_one_window(spark):
    from pyspark.sql import Window, functions as F

    from textloom.operators.corpus import ranked

    rows = spark.range(500).select("id", (F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    rows = rows.withColumn("k", F.when(F.col("k") > 0, F.col("k")))  # a null stratum too
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("h")) - 1)
    got = ranked(want, ["k"], "h")
    assert got.where("before != want").count() == 0 and got.count() == 500


def test_entry_without_llm(tmp_path):
    """The rest imports and lists its queries when the optional parts are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
