"""Sections of marked-up texts, their shapes, overlapping windows, and the rhythm of sentence lengths; all row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.text import WORD, sentences, words
from textloom.operators import measured_rules as mr
from textloom.operators.stylometry import documents
from textloom.operators.writing_rules import _bound

HEADING = r"(?m)^#{1,6}[ \t]+"
DEPTH = r"(?m)^(#{1,6})[ \t]+"
ITEM = r"(?m)^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]+"
PARAGRAPH = r"\n[ \t\r\n]*\n"
TOKEN = r"[^ \t\r\n]+"


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, depth, heading, n_words, n_items, n_paragraphs): what stands before the first heading is section 0."""
    parts = docs.where("text is not null").select("doc_id", F.split("text", HEADING, -1).alias("p"), F.regexp_extract_all("text", F.lit(DEPTH), F.lit(1)).alias("d"))
    rows = parts.select("doc_id", "d", F.posexplode("p").alias("section", "part"))
    head, body = F.substring_index("part", "\n", 1), F.when(F.col("section") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*", ""))
    cut = rows.select("doc_id", F.col("section").cast("bigint").alias("section"), F.when(F.col("section") > 0, F.length(F.get("d", F.col("section") - 1))).otherwise(0).cast("bigint").alias("depth"), F.when(F.col("section") > 0, head).alias("heading"), body.alias("b"))
    return cut.select("doc_id", "section", "depth", "heading", F.regexp_count("b", F.lit(TOKEN)).cast("bigint").alias("n_words"), F.regexp_count("b", F.lit(ITEM)).cast("bigint").alias("n_items"), F.size(F.filter(F.split("b", PARAGRAPH), lambda x: x.rlike(TOKEN))).cast("bigint").alias("n_paragraphs"))


_SECTIONS_SQL = rf"""
s0 AS (SELECT doc_id, string_split_regex(text, '{HEADING}') AS p, regexp_extract_all(text, '{DEPTH}', 1) AS d FROM ({mr.probed_sql()}) WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, d, unnest(range(0, len(p))) AS section, unnest(p) AS part FROM s0),
s2 AS (SELECT doc_id, section, CASE WHEN section > 0 THEN length(d[section]) ELSE 0 END::BIGINT AS depth, CASE WHEN section > 0 THEN string_split(part, chr(10))[1] END AS heading, CASE WHEN section = 0 THEN part ELSE regexp_replace(part, '^[^\n]*', '') END AS b FROM s1),
sections AS MATERIALIZED (SELECT doc_id, section, depth, heading, len(regexp_extract_all(b, '{TOKEN}'))::BIGINT AS n_words, len(regexp_extract_all(b, '{ITEM}'))::BIGINT AS n_items, len(list_filter(string_split_regex(b, '{PARAGRAPH}'), lambda x: regexp_matches(x, '{TOKEN}')))::BIGINT AS n_paragraphs FROM s2)
"""


def shapes(parts: DataFrame) -> DataFrame:
    """Per document with a headed section: their number, deepest level, evenness, and whether they share one shape."""
    headed = parts.where("section > 0")
    shape = F.concat_ws("/", F.col("n_paragraphs"), (F.col("n_items") > 0).cast("int"))
    per = headed.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.max("depth").alias("deepest"), F.count_if(F.col("depth") == 2).alias("n_second_level"), F.median("n_words").alias("median_words"), F.collect_list("n_words").alias("w"), F.countDistinct(shape).alias("n_shapes"), F.sum("n_items").alias("n_items"))
    within = F.size(F.filter("w", lambda x: F.abs(x - F.col("median_words")) <= F.col("median_words") * 0.15)) / F.col("n_sections")
    return per.select("doc_id", "n_sections", "deepest", "n_second_level", F.round("median_words", 6).alias("median_words"), F.round(within, 6).alias("share_within"), ((F.col("n_sections") >= 3) & (within >= 0.9)).alias("even"), ((F.col("n_sections") >= 3) & (F.col("n_shapes") == 1)).alias("one_shape"), "n_items")


SHAPES_SQL = f"""
WITH {_SECTIONS_SQL}, p AS (SELECT doc_id, count(*) AS n_sections, max(depth) AS deepest, count(*) FILTER (depth = 2) AS n_second_level, median(n_words) AS med, list(n_words) AS w, count(DISTINCT n_paragraphs::VARCHAR || '/' || (n_items > 0)::INT::VARCHAR) AS n_shapes, sum(n_items)::BIGINT AS n_items FROM sections WHERE section > 0 GROUP BY 1),
q AS (SELECT *, len(list_filter(w, lambda x: abs(x - med) <= med * 0.15::DOUBLE)) / n_sections AS within FROM p)
SELECT doc_id, n_sections, deepest, n_second_level, round(med, 6) AS median_words, round(within, 6) AS share_within, n_sections >= 3 AND within >= 0.9 AS even, n_sections >= 3 AND n_shapes = 1 AS one_shape, n_items FROM q
"""


def windows(docs: DataFrame, size: int = 120, stride: int = 60, most: int = 12) -> DataFrame:
    """Overlapping windows of words, the first ``most`` of a text: largest, mean and 90th index quantile of their share of different words."""
    w = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.slice(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)), F.lit(stride)), 1, most)
    share = F.array_sort(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("w", i, size))) / F.size(F.slice("w", i, size))))
    out = w.select("doc_id", share.alias("v"))
    return out.select("doc_id", F.size("v").cast("bigint").alias("n_windows"), F.round(F.element_at("v", -1), 6).alias("largest"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 6).alias("mean"), F.round(F.get("v", F.floor(F.size("v") * 0.9).cast("int")), 6).alias("p90"))


_W = WORD.replace("'", "''")
WINDOWS_SQL = rf"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x)) AS w FROM documents),
v AS (SELECT doc_id, list_sort(list_transform((range(1, greatest(len(w) - 119, 1) + 1, 60))[1:12], lambda i: len(list_distinct(w[i:i + 119])) / len(w[i:i + 119]))) AS v FROM t WHERE len(w) > 0)
SELECT doc_id, len(v) AS n_windows, round(v[len(v)], 6) AS largest, round(list_sum(v) / len(v), 6) AS mean, round(v[floor(len(v) * 0.9::DOUBLE)::INT + 1], 6) AS p90 FROM v
"""


def spectrum(docs: DataFrame, size: int = 12, flat_below: float = 0.28) -> DataFrame:
    """Spectral flatness of sentence lengths in consecutive windows of ``size`` sentences, its mean, and whether it is low over two or more.

    Flatness is the geometric over the arithmetic mean of the power of all frequencies but 0; 1 is no rhythm at all.
    """
    count = lambda s: F.regexp_count(s, F.lit(WORD)).cast("double")
    lens = docs.select("doc_id", F.filter(F.transform(sentences(F.col("text")), count), lambda x: x > 0).alias("l")).where(F.size("l") >= size)
    whole = F.transform(F.sequence(F.lit(0), F.floor(F.size("l") / size).cast("int") - 1), lambda i: F.slice("l", i * size + 1, size))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda n, x: n + x)

    def flatness(y: Column) -> Column:
        part = lambda k, wave: total(F.transform(y, lambda x, t: x * wave(F.lit(6.283185307179586) * k * t / size)))
        power = F.array(*[part(k, F.cos) * part(k, F.cos) + part(k, F.sin) * part(k, F.sin) + 1e-9 for k in range(1, size // 2 + 1)])
        return _bound(power, lambda p: F.exp(total(F.transform(p, F.ln)) / F.size(p)) / (total(p) / F.size(p)))

    centred = lambda y: _bound(F.struct(y.alias("y"), (total(y) / size).alias("m")), lambda z: F.transform(z["y"], lambda x: x - z["m"]))
    out = lens.select("doc_id", F.transform(whole, lambda y: _bound(centred(y), flatness)).alias("f"))
    mean = total(F.col("f")) / F.size("f")
    return out.select("doc_id", F.size("f").cast("bigint").alias("n_windows"), F.round(mean + 1e-9, 4).alias("flatness"), ((F.size("f") >= 2) & (mean < flat_below)).alias("rhythmic"))


_WAVE = lambda f, k: f"pow(list_sum(list_transform(y, lambda x, t: x * {f}(6.283185307179586::DOUBLE * {k} * (t - 1) / 12))), 2)"
SPECTRUM_SQL = rf"""
WITH m AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])["''”’)\]]*[ \t\r\f]+(["''“‘(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]') AS s FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(s, lambda x: len(regexp_extract_all(x, '{_W}'))::DOUBLE), lambda x: x > 0) AS l FROM m),
w AS (SELECT doc_id, l[i * 12 + 1:i * 12 + 12] AS l FROM (SELECT doc_id, l, unnest(range(0, len(l) // 12)) AS i FROM l)),
y AS (SELECT doc_id, list_transform(l, lambda x: x - list_avg(l)) AS y FROM w),
p AS (SELECT doc_id, [{", ".join(f"{_WAVE('cos', k)} + {_WAVE('sin', k)} + 1e-9" for k in range(1, 7))}] AS p FROM y)
SELECT doc_id, count(*) AS n_windows, round(avg(exp(list_avg(list_transform(p, lambda x: ln(x)))) / list_avg(p)) + 1e-9, 4) AS flatness, count(*) >= 2 AND avg(exp(list_avg(list_transform(p, lambda x: ln(x)))) / list_avg(p)) < 0.28 AS rhythmic FROM p GROUP BY doc_id
"""

QUERIES = {
    "sections": lambda s, d: sections(mr.probed(documents(s, d))),
    "section_shapes": lambda s, d: shapes(sections(mr.probed(documents(s, d)))),
    "word_windows": lambda s, d: windows(documents(s, d)),
    "sentence_spectrum": lambda s, d: spectrum(documents(s, d)),
}
ORACLE_SQL = {"sections": f"WITH {_SECTIONS_SQL} SELECT * FROM sections", "section_shapes": SHAPES_SQL, "word_windows": WINDOWS_SQL, "sentence_spectrum": SPECTRUM_SQL}
