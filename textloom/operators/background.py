"""A background model of words, and how surprising the words of each document are under it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from textloom.functions import scan
from textloom.operators.stylometry import documents

#: Words that go to every task, the most frequent ones; the rows of all other words meet in a shuffle.
FREQUENT = 65_536
#: Ranks that shares are told of; words of them go to every task whatever their length, others up to LONGEST bytes.
RANKS, LONGEST = (10, 100, 1000), 100
RARE_BITS = 14.0


def counts(docs: DataFrame) -> DataFrame:
    """(tok, n) of every word of the corpus; a task sends a word once for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in scan.slices(batch.column(0)):
                codes, kinds = scan.lower_codes(scan.latin_spans(texts)[0])
                yield pa.RecordBatch.from_arrays([kinds, pa.array(np.bincount(codes, minlength=len(kinds)))], ["tok", "n"])

    return docs.select("text").where("text is not null").mapInArrow(run, "tok string, n bigint").groupBy("tok").agg(F.sum("n").alias("n"))


def model(docs: DataFrame) -> tuple[list, float]:
    """(tok, n, rank) of the FREQUENT most frequent words, ties by word; and the number of words, of different ones and one, together.

    A word that stands n times has log2 of that number by n + 1 bits (add-one smoothing).
    """
    known = counts(docs)
    whole = known.agg((F.sum("n") + F.count("*") + 1).alias("smoothed"))
    top = known.orderBy(F.desc("n"), "tok").limit(FREQUENT)
    ranked = top.select("tok", "n", F.row_number().over(Window.orderBy(F.desc("n"), "tok")).alias("rank")).where((F.col("rank") <= max(RANKS)) | (F.octet_length("tok") <= LONGEST))
    rows = ranked.unionByName(whole.select(F.lit(None).cast("string").alias("tok"), F.col("smoothed").alias("n"), F.lit(0).alias("rank"))).collect()  # FREQUENT rows and one of totals
    smoothed = float(next(r["n"] for r in rows if r["rank"] == 0) or 1)
    return [(r["tok"], r["n"], r["rank"]) for r in rows if r["rank"] > 0], smoothed


def surprisal(docs: DataFrame) -> DataFrame:
    """Per document: mean, deviation and share of rare words (over 14 bits), and shares of words by rank.

    Words are counted within the document first.  Frequent words, whose rows would
    all meet in one task, are summed up where the document is; of the others, a row
    for each document meets those of the same word, whose sum is the word's count.
    """
    top, smoothed = model(docs)
    words, often, ranks = zip(*top) if top else ((), (), ())
    sent = docs.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), np.log2(smoothed / (np.array(often, np.float64) + 1)), np.array(ranks, np.int64)))
    sums = ["n", "sum", "squares", "rare", *[f"top_{r}" for r in RANKS]]

    def told(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """(place of the text, word, sums): a row without a word holds the sums of a text's frequent words, the others are its other words."""
        packed, _, owner = scan.latin_spans(texts)
        codes, kinds = scan.lower_codes(packed)
        words, bits, rank = sent.value
        at = np.asarray(pc.fill_null(pc.index_in(kinds, value_set=words), -1))[codes]
        mine, place = owner[at >= 0], at[at >= 0]
        bits, rank = bits[place], rank[place]
        total = [np.bincount(mine, x, len(texts)) for x in (np.ones(len(place)), bits, bits * bits, bits > RARE_BITS, *[rank <= r for r in RANKS])]
        kept = np.flatnonzero(total[0])
        owner, codes, k = scan.tallies(owner[at < 0], codes[at < 0], len(texts), len(kinds))
        tok = pa.concat_arrays([pa.nulls(len(kept), pa.string()), kinds.take(pa.array(codes))])
        rest = [k.astype(np.float64), *[np.zeros(len(k))] * (len(total) - 1)]
        return np.concatenate((kept, owner)), [tok, *[pa.array(np.concatenate((x[kept], y))) for x, y in zip(total, rest, strict=True)]]

    seldom, n = F.col("tok").isNotNull(), F.col("n")
    # rows without a word stay apart, each document's with itself
    alone = F.when(~seldom, F.col("doc_id"))
    rows = scan.rows(docs, "tok string, " + ", ".join(f"{x} double" for x in sums), told)
    rows = rows.withColumn("bits", F.when(seldom, F.log2(F.lit(smoothed) / (F.sum("n").over(Window.partitionBy("tok", alone)) + 1))))
    b = F.col("bits")
    both = rows.select("doc_id", "n", F.when(seldom, n * b).otherwise(F.col("sum")).alias("sum"), F.when(seldom, n * b * b).otherwise(F.col("squares")).alias("squares"), F.when(seldom & (b > RARE_BITS), n).otherwise(F.col("rare")).alias("rare"), *sums[4:])
    whole = both.groupBy("doc_id").agg(*[F.sum(x).alias(x) for x in sums])
    mean = F.col("sum") / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - mean * mean))
    share = lambda x: F.round(F.col(x) / n, 6)
    return whole.select("doc_id", n.cast("bigint").alias("n_words"), F.round(mean, 5).alias("mean_bits"), F.round(spread, 4).alias("sd_bits"), share("rare").alias("rare_rate"), *[share(f"top_{r}").alias(f"share_top_{r}") for r in RANKS])


SURPRISAL_SQL = r"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏ'']+'))) AS tok FROM documents),
c AS (SELECT tok, count(*) AS n FROM t GROUP BY 1), b AS (SELECT tok, n, log2((sum(n) OVER () + count(*) OVER () + 1) / (n + 1)) AS bits, row_number() OVER (ORDER BY n DESC, tok) AS rank FROM c)
SELECT doc_id, count(*) AS n_words, round(avg(bits), 5) AS mean_bits, round(stddev_pop(bits), 4) AS sd_bits, round(avg((bits > 14.0)::INT), 6) AS rare_rate, round(avg((rank <= 10)::INT), 6) AS share_top_10, round(avg((rank <= 100)::INT), 6) AS share_top_100, round(avg((rank <= 1000)::INT), 6) AS share_top_1000
FROM t JOIN b USING (tok) GROUP BY doc_id
"""


def capped(docs: DataFrame, cap: int = 20) -> DataFrame:
    """At most ``cap`` documents of each (language, source), the first in order of the id's hash."""
    from textloom.operators.corpus import ranked

    rows = docs.select("doc_id", "lang", "source", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("h"))
    return ranked(rows, ["lang", "source"], "h").where(F.col("before") < cap).select("doc_id", "lang", "source")


CAPPED_SQL = "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR)) AS n FROM documents) WHERE n <= 20"


def checks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Assertions on a built corpus, one row each with the number of rows that violate it."""
    keyed = docs.select("doc_id", "lang", "text", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))).cast("binary"), 256).alias("h"), (F.pmod("doc_id", F.lit(10)) < 8).alias("train"))
    straddling = keyed.groupBy("h").agg(F.count_if("train").alias("a"), F.count_if(~F.col("train")).alias("b")).where("a > 0 and b > 0").agg(F.count("*").alias("n"))
    missing = labels.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n"))
    empty = docs.agg(F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("n"))
    one_sided = keyed.groupBy("lang").agg(F.countDistinct("train").alias("k")).where("k < 2").agg(F.count("*").alias("n"))
    parts = [("texts in both splits", straddling), ("labels without a document", missing), ("documents without text", empty), ("repeated ids", repeated), ("languages in one split only", one_sided)]
    out = None
    for name, rows in parts:
        row = rows.select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("holds"))
        out = row if out is None else out.unionByName(row)
    return out


CHECKS_SQL = r"""
WITH k AS (SELECT doc_id, lang, sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS h, doc_id % 10 < 8 AS train FROM documents),
c AS (SELECT 'texts in both splits' AS "check", count(*) AS n FROM (SELECT h FROM k GROUP BY h HAVING bool_or(train) AND bool_or(NOT train))
UNION ALL SELECT 'labels without a document', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'documents without text', count(*) FROM documents WHERE coalesce(length(text), 0) = 0
UNION ALL SELECT 'repeated ids', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'languages in one split only', count(*) FROM (SELECT lang FROM k GROUP BY 1 HAVING count(DISTINCT train) < 2))
SELECT "check", n, n = 0 AS holds FROM c
"""

QUERIES = {"word_surprisal": lambda s, d: surprisal(documents(s, d)), "capped_buckets": lambda s, d: capped(documents(s, d)), "corpus_checks": lambda s, d: checks(documents(s, d), s.read.parquet(f"{d}/labels.parquet"))}
ORACLE_SQL = {"word_surprisal": SURPRISAL_SQL, "capped_buckets": CAPPED_SQL, "corpus_checks": CHECKS_SQL}
