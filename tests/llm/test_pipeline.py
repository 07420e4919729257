"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from textloom.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], SF)))
    assert all(x.columns == names for x in seen[:-1])
    rows = [sorted((r["doc_id"], r["text"]) for r in x.collect()) for x in seen]

    # language: nothing that has letters and a clear language goes
    assert len(rows[1]) >= 0.98 * len(rows[0])
    # near copies: the smallest doc_id of every group of 5-word shingle sets at 0.8
    groups = brute.ngram_join(rows[1], 80, 5)
    assert [d for d, _ in rows[2]] == sorted({c for _, c in groups.values()})
    # leaks: every document with a whole benchmark passage goes, and few others
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in rows[2] if any(q in t for q in items)}
    left = {d for d, _ in rows[3]}
    assert not leaks & left and len(rows[2]) - len(left) <= len(leaks) + 1
    # mix: as often as taken
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(seen[3]).where("size > 0").collect()}
    assert Counter(d for d, _ in rows[4]) == Counter({d: n for d, n in taken.items() if n})
    # shards
    table = sharding.lookup_table()
    assert all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in seen[5].collect()) and len(rows[5]) == len(rows[4])


def test_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def odd_rows(spark, texts):
    """Rows (doc_id, text, source) as a documents table."""
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def contents(docs):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())


def prose(name):
    return " ".join(f"{name}{i}" for i in range(30))


def test_language_keeps_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.withColumn("doc_id", F.when(docs.doc_id % 3 == 0, None).otherwise(docs.doc_id % 5))
    whole, odd = (Counter(r["text"] for r in corpus_pipeline.language_stage(spark, x, SF).collect()) for x in (docs, some))
    assert sum(odd.values()) >= 0.98 * docs.count() and sum(whole.values()) >= 0.98 * docs.count()


def test_near_copies_with_null_and_repeated_ids(spark):
    a, b, c = prose("a"), prose("b"), prose("c")
    docs = odd_rows(spark, [(7, a, "x"), (7, a, "x"), (7, b, "x"), (None, b, "y"), (None, c, "y"), (None, c, "y")])
    assert contents(corpus_pipeline.near_copy_stage(spark, docs, SF)) == Counter([(7, a, "x"), (7, b, "x"), (None, c, "y")])


def test_leaks_with_null_and_repeated_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(7, prose("a"), "x"), (7, f"x {item}", "x"), (None, prose("b"), "y"), (None, f"y {item}", "y")]
    assert contents(corpus_pipeline.benchmark_stage(spark, odd_rows(spark, rows), SF)) == Counter([rows[0], rows[2]])


def test_mix_with_null_and_repeated_ids(spark):
    rows = [(i, prose(f"{s}{i}n{j}"), s) for s in "xyz" for i in (7, None) for j in range(20)]
    got = contents(corpus_pipeline.mixing_stage(spark, odd_rows(spark, rows), SF))
    assert set(got) <= set(rows) and max(got.values()) <= 2
    assert abs(sum(got.values()) - 1.5 * len(rows)) <= 3 and any(r[0] is None for r in got)


def test_language_model_is_fitted_in_a_task(spark, monkeypatch):
    from textloom.llm import language_id

    docs = spark.createDataFrame([(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3 + str(i), "en" if i % 2 else "de") for i in range(60)], "doc_id bigint, text string, lang string")
    want = language_id.train(docs)
    # what the driver would fit itself never runs there
    seen = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda *a, **k: seen.append(1) or fit(*a, **k))
    got = language_id.train(docs)
    assert not seen and got.languages == want.languages == ["de", "en"] and (got.weight == want.weight).all() and len(got.feature) == len(got.weight)
