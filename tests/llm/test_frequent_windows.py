"""Items whose windows very many other items hold are found like all others."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import decontamination

SAME = "read the text below and say which of the following answers is the best one for it"


def _tables(spark, at):
    items = [(i, f"{SAME} zebra{i} quilt{i}") for i in range(decontamination.MAX_HOLDERS + 4)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    # the words that only one item holds are gone
    docs = [(1, f"At noon they had to {SAME} and then went home."), (2, "Nothing of it stands in this one, which of the two is it.")]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    return len(items)


def test_windows_that_many_items_hold_find_them_all(spark, tmp_path):
    n = _tables(spark, str(tmp_path))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.op9_decontamination(spark, str(tmp_path)).collect())
    assert got == [(1, i) for i in range(n)]
    kept = corpus_pipeline.benchmark_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [r["doc_id"] for r in kept.collect()] == [2]
