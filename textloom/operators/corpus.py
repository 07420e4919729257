"""Corpus engineering: keys, exact dedup, containment, splits, balancing, capped draws.

Ranks and running sums within a stratum never put a whole stratum in one task:
rows are ordered by a hash, so a histogram over the hash's first digits gives
every digit group its offset, and windows run within digit groups only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.text import hash_bucket, ngrams, norm_key
from textloom.operators.stylometry import documents

#: Hex digits that part a stratum; 16 ** DIGITS groups.
DIGITS = 2


def ranked(df: DataFrame, strata: list[str], h: str, weight: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """``df`` with ``before``: the sum of weights (1) of rows earlier in the stratum by hash, and ``total``."""
    w = F.lit(1) if weight is None else weight
    part = df.withColumn("_w", w.cast("bigint")).withColumn("_d", F.substring(h, 1, digits))
    sums = part.groupBy(*strata, "_d").agg(F.sum("_w").alias("_s"))
    order = Window.partitionBy(*strata).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*strata)
    offset = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(strata)], F.col("_d").alias("_kd"), F.coalesce(F.sum("_s").over(order), F.lit(0)).alias("_o"), F.sum("_s").over(whole).alias("total"))
    inner = Window.partitionBy(*strata, "_d").orderBy(h).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_l", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    same = local["_d"] == offset["_kd"]
    for i, c in enumerate(strata):
        same &= local[c].eqNullSafe(offset[f"_k{i}"])
    out = local.join(offset, same).withColumn("before", F.col("_o") + F.col("_l"))
    return out.drop("_w", "_d", "_l", "_o", "_kd", *[f"_k{i}" for i in range(len(strata))])


def text_keys(docs: DataFrame) -> DataFrame:
    """Normal-form hash, alternate normal form, slug, mine/test half, split bucket of every document."""
    alt = F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)
    group = F.col("doc_id").cast("string")
    bucket = hash_bucket(group, 100)
    return docs.select(
        "doc_id",
        norm_key(F.col("text")).alias("norm_key"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"),
        F.sha2(alt.cast("binary"), 256).alias("alt_key"),
        slug.alias("slug"),
        F.when(hash_bucket(group, 2) == 0, "mine").otherwise("test").alias("half"),
        F.when(bucket < 85, "train").otherwise("cal").alias("split"),
    )


TEXT_KEYS_SQL = r"""
SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS norm_key, 'sha256:' || sha256(text) AS content_hash,
  sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS alt_key,
  substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug,
  CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 THEN 'mine' ELSE 'test' END AS half,
  CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 85 THEN 'train' ELSE 'cal' END AS split
FROM documents
"""


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The first document (smallest id) of each normal form, and how many share it."""
    return docs.groupBy(norm_key(F.col("text")).alias("norm_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


EXACT_DEDUP_SQL = r"SELECT sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS norm_key, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1"


def containment(docs: DataFrame, reference: DataFrame, n: int = 8, least: float = 0.10) -> DataFrame:
    """Documents of whose distinct n-grams more than ``least`` stand in the reference texts."""
    def grams(df: DataFrame, *keep: str) -> DataFrame:
        tok = df.select(*keep, F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "").alias("tok"))  # once per row, not per gram
        return tok.select(*keep, F.explode(F.array_distinct(ngrams(F.col("tok"), n))).alias("g"))

    mine = grams(docs, "doc_id")
    known = grams(reference).distinct().withColumn("hit", F.lit(1))
    out = mine.join(known, "g", "left").groupBy("doc_id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_shared"))
    return out.where(F.col("n_shared") > F.col("n_grams") * least).withColumn("share", F.col("n_shared") / F.col("n_grams"))


CONTAINMENT_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
k AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM q WHERE len(w) >= 8)),
c AS (SELECT doc_id, count(*) AS n_grams, count(k.g) AS n_shared FROM g LEFT JOIN k ON g.g = k.g GROUP BY 1)
SELECT doc_id, n_grams, n_shared, n_shared / n_grams AS share FROM c WHERE n_shared > n_grams * 0.10
"""


def assign_splits(docs: DataFrame, strata: list[str]) -> DataFrame:
    """70 / 15 / 15 by group-hash order within strata; a group (normal form) never straddles.

    A group's stratum is that of its first document; strata of three groups and
    more have all three splits.
    """
    keyed = docs.select("doc_id", *strata, norm_key(F.col("text")).alias("group"))
    groups = keyed.groupBy("group").agg(F.min_by(F.struct(*strata), "doc_id").alias("s")).select("group", *[F.col(f"s.{c}").alias(c) for c in strata], F.sha2(F.col("group").cast("binary"), 256).alias("h"))
    place = ranked(groups, strata, "h")
    n = F.col("total")
    a, b = F.floor(n * F.lit(0.7)), F.floor(n * F.lit(0.85))
    b3 = F.least(F.greatest(b, F.lit(2)), n - 1)
    a3 = F.least(F.greatest(a, F.lit(1)), b3 - 1)
    cut_a, cut_b = F.when(n >= 3, a3).otherwise(a), F.when(n >= 3, b3).otherwise(b)
    split = F.when(F.col("before") < cut_a, "train").when(F.col("before") < cut_b, "cal").otherwise("test")
    return keyed.select("doc_id", "group").join(place.select("group", split.alias("split")), "group").select("doc_id", "split")


SPLITS_SQL = r"""
WITH k AS (SELECT doc_id, lang, source, sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS grp FROM documents),
g AS (SELECT grp, arg_min({'l': lang, 's': source}, doc_id) AS s FROM k GROUP BY 1),
r AS (SELECT grp, row_number() OVER (PARTITION BY s ORDER BY sha256(grp)) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM g),
b AS (SELECT *, floor(n * 0.7::DOUBLE)::BIGINT AS a0, floor(n * 0.85::DOUBLE)::BIGINT AS b0 FROM r),
c AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(b0, 2), n - 1) ELSE b0 END AS b1 FROM b),
d AS (SELECT *, CASE WHEN n >= 3 THEN least(greatest(a0, 1), b1 - 1) ELSE a0 END AS a1 FROM c)
SELECT k.doc_id, CASE WHEN i < a1 THEN 'train' WHEN i < b1 THEN 'cal' ELSE 'test' END AS split FROM k JOIN d ON k.grp = d.grp
"""


def balance(rows: DataFrame, register: str, side: str, group: str, targets: int) -> DataFrame:
    """Whole groups, in hash order, until each (register, side) has min(target, either side's rows)."""
    avail = rows.groupBy(register).agg(*[F.sum((F.col(side) == s).cast("int")).alias(f"n{s}") for s in (0, 1)])
    want = avail.select(F.col(register).alias("_r"), F.least(F.lit(targets), "n0", "n1").alias("target"))
    groups = rows.groupBy(register, side, group).agg(F.count("*").alias("size")).withColumn("h", F.sha2(F.concat_ws("|", register, side, group).cast("binary"), 256))
    place = ranked(groups, [register, side], "h", F.col("size"))
    kept = place.join(want, place[register].eqNullSafe(F.col("_r"))).where(F.col("before") < F.col("target"))
    return kept.groupBy(register, side).agg(F.sum("size").alias("kept"), F.count("*").alias("groups"), F.first("target").alias("target"))


def _labelled(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    return documents(spark, sf_dir).join(labels, "doc_id").select("doc_id", "lang", "source", "quality", norm_key(F.col("text")).alias("grp"))


BALANCE_SQL = r"""
WITH x AS (SELECT lang, quality, sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))) AS grp FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT lang, least(200, sum((quality = 0)::INT), sum((quality = 1)::INT)) AS target FROM x GROUP BY 1),
g AS (SELECT lang, quality, grp, count(*) AS size FROM x GROUP BY ALL),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY lang, quality ORDER BY sha256(concat_ws('|', lang, quality, grp)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT r.lang, quality, sum(size)::BIGINT AS kept, count(*) AS groups, any_value(target)::BIGINT AS target FROM r JOIN t ON r.lang = t.lang WHERE before < target GROUP BY 1, 2
"""


def round_robin(docs: DataFrame, stratum: str, cap: int) -> DataFrame:
    """At most ``cap`` rows spread evenly over strata, by content-hash order within each.

    Strata take turns, so those of rank r in every stratum come before any of
    rank r + 1; the last turn goes in order of the stratum's name.
    """
    rows = docs.select("doc_id", stratum, F.sha2(F.concat_ws("|", "text", "doc_id").cast("binary"), 256).alias("h"))
    place = ranked(rows, [stratum], "h").where(F.col("before") < cap)
    return place.orderBy("before", stratum).limit(cap).select("doc_id", stratum, (F.col("before") + 1).alias("turn"))


ROUND_ROBIN_SQL = r"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', text, doc_id))) AS turn FROM documents)
SELECT doc_id, source, turn FROM r ORDER BY turn, source LIMIT 300
"""

QUERIES = {
    "text_keys": lambda s, d: text_keys(documents(s, d)),
    "exact_dedup": lambda s, d: exact_dedup(documents(s, d)),
    "containment": lambda s, d: containment(documents(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
    "assign_splits": lambda s, d: assign_splits(documents(s, d), ["lang", "source"]),
    "balance_registers": lambda s, d: balance(_labelled(s, d), "lang", "quality", "grp", 200),
    "round_robin_cap": lambda s, d: round_robin(documents(s, d), "source", 300),
}
ORACLE_SQL = {"text_keys": TEXT_KEYS_SQL, "exact_dedup": EXACT_DEDUP_SQL, "containment": CONTAINMENT_SQL, "assign_splits": SPLITS_SQL, "balance_registers": BALANCE_SQL, "round_robin_cap": ROUND_ROBIN_SQL}
