"""Writing rules of the base pack, a prose filter, and visible text of HTML.

Findings are rows (doc_id, rule_id, matched, n): adding a rule adds rows, not columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.stylometry import documents

# Fixed values of the pack.
STOCK_PHRASES = ("in today's rapidly evolving landscape", "game-changer", "in conclusion", "it is important to note", "delve into")
TRANSITIONS = ("moreover", "furthermore", "additionally", "consequently", "therefore", "however")
OPENING_WORDS, MIN_OPENINGS = 3, 3
DENSITY, DENSITY_WORDS = 0.04, 40
# Elements whose content is never visible, elements that end a line, named entities.
HIDDEN = ("script", "style", "template", "noscript")
BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
#: One pattern for all that is not shown, one for every kind of tag, one for character references.
UNSEEN = "(?is)<!--.*?-->|" + "|".join(rf"<{x}\b[^>]*>.*?</{x}[ \t\n]*>" for x in HIDDEN)
LINE_TAG, TAG = rf"(?i)</?(?:{BLOCK})\b[^>]*>", r"</?[A-Za-z!][^>]*>"
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|" + "|".join(ENTITIES) + ");"


def overused_phrases(docs: DataFrame) -> DataFrame:
    low = docs.select("doc_id", F.lower("text").alias("t"))
    counts = F.array(*[F.struct(F.lit(p).alias("matched"), ((F.length("t") - F.length(F.replace(F.col("t"), F.lit(p), F.lit("")))) / len(p)).cast("bigint").alias("n")) for p in STOCK_PHRASES])
    hits = low.select("doc_id", F.explode(F.filter(counts, lambda x: x["n"] > 0)).alias("x"))
    return hits.select("doc_id", F.lit("style.overused_phrase").alias("rule_id"), "x.matched", "x.n")


def repeated_openings(docs: DataFrame) -> DataFrame:
    """The first three words that open three sentences or more of a document."""
    sentence = F.explode(F.split(F.regexp_replace("text", r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001"))
    opening = docs.select("doc_id", sentence.alias("s")).select("doc_id", F.filter(F.split(F.lower("s"), r"[ \t\n\r]+"), lambda w: w != "").alias("w"))
    first = opening.where(F.size("w") >= 2).select("doc_id", F.array_join(F.slice("w", 1, OPENING_WORDS), " ").alias("matched"))
    return first.groupBy("doc_id", "matched").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_OPENINGS).select("doc_id", F.lit("style.repeated_opening").alias("rule_id"), "matched", "n")


def transition_density(docs: DataFrame) -> DataFrame:
    tok = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    found = F.filter(tok, lambda w: w.isin(*TRANSITIONS))
    n_words = F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))
    hit = docs.select("doc_id", found.alias("f"), n_words.alias("w")).where((F.col("w") >= DENSITY_WORDS) & (F.size("f") > F.col("w") * DENSITY))
    return hit.select("doc_id", F.lit("style.transition_density").alias("rule_id"), F.element_at("f", 1).alias("matched"), F.size("f").cast("bigint").alias("n"))


def findings(docs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (rule(docs) for rule in (overused_phrases, repeated_openings, transition_density)))


def _q(text: str) -> str:
    return text.replace("'", "''")


FINDINGS_SQL = (
    r"WITH s AS (SELECT doc_id, list_filter(string_split_regex(lower(unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)))), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents), "
    "o AS (SELECT doc_id, array_to_string(w[1:3], ' ') AS matched, count(*) AS n FROM s WHERE len(w) >= 2 GROUP BY 1, 2 HAVING count(*) >= 3), "
    r"t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x IN (" + ", ".join(f"'{w}'" for w in TRANSITIONS) + r")) AS f, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS w FROM documents), "
    "p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{_q(p)}' AS matched, (length(lower(text)) - length(replace(lower(text), '{_q(p)}', ''))) // {len(p)} AS n FROM documents" for p in STOCK_PHRASES) + ") "
    "SELECT doc_id, 'style.overused_phrase' AS rule_id, matched, n::BIGINT AS n FROM p WHERE n > 0 UNION ALL SELECT doc_id, 'style.repeated_opening', matched, n FROM o "
    "UNION ALL SELECT doc_id, 'style.transition_density', f[1], len(f) FROM t WHERE w >= 40 AND len(f) > w * 0.04"
)


def prose_filter(docs: DataFrame) -> DataFrame:
    """Why a text is not prose (the first reason in a fixed order), or ``ok``."""
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    count = lambda rx: F.regexp_count(t, F.lit(rx))
    base = docs.select("doc_id", lines.alias("lines"), count(r"\p{L}").alias("letters"), F.length(t).alias("size"), count(r"https?://|www\.").alias("urls"), count(r"""[.!?][ \t\n\r"')\]]""").alias("ends"), count(r"[\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{0600}-\x{06FF}\x{0900}-\x{097F}]").alias("script"))
    short = F.size(F.filter("lines", lambda x: F.regexp_count(x, F.lit(r"[^ \t\r]+")) < 6))
    reason = (
        F.when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("script") > 0, "script").when(F.col("letters") < F.col("size") * 0.55, "letters")
        .when(F.size("lines") == 0, "empty").when((F.size("lines") >= 6) & (short > F.size("lines") * 0.6), "lists").when(F.col("urls") > 6, "urls").when(F.col("ends") < 3, "sentences").otherwise("ok")
    )
    return base.select("doc_id", reason.alias("reason"))


PROSE_SQL = r"""
WITH b AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines, len(regexp_extract_all(text, '\p{L}')) AS letters, length(text) AS size,
  len(regexp_extract_all(text, 'https?://|www\.')) AS urls, len(regexp_extract_all(text, '[.!?][ \t\n\r"'')\]]')) AS ends, len(regexp_extract_all(text, '[\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{0600}-\x{06FF}\x{0900}-\x{097F}]')) AS script FROM documents),
s AS (SELECT *, len(list_filter(lines, lambda x: len(regexp_extract_all(x, '[^ \t\r]+')) < 6)) AS short FROM b)
SELECT doc_id, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN script > 0 THEN 'script' WHEN letters < size * 0.55::DOUBLE THEN 'letters' WHEN len(lines) = 0 THEN 'empty'
  WHEN len(lines) >= 6 AND short > len(lines) * 0.6::DOUBLE THEN 'lists' WHEN urls > 6 THEN 'urls' WHEN ends < 3 THEN 'sentences' ELSE 'ok' END AS reason FROM s
"""


def _decoded(reference: Column) -> Column:
    """The character of a reference; one that names no character stays as it is."""
    named = F.coalesce(*[F.when(reference == f"&{k};", F.lit(c)) for k, c in ENTITIES.items()])
    hexed = F.conv(F.regexp_extract(reference, "^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10)
    point = F.when(reference.rlike("^&#[xX]"), hexed).when(reference.startswith("&#"), F.regexp_extract(reference, "^&#([0-9]+);$", 1)).cast("int")
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.coalesce(named, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")), reference)


def visible_text(pages: DataFrame) -> DataFrame:
    """Text of HTML pages: what is not shown goes, block elements end lines, other tags vanish, references are decoded once.

    Text and references are taken apart and put together again, so that a decoded
    ampersand never begins a reference.
    """
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", UNSEEN, ""), LINE_TAG, "\n"), TAG, "")
    cut = pages.where("html is not null").select("page_id", shown.alias("t"))
    references = F.transform(F.regexp_extract_all("t", F.lit(REFERENCE), F.lit(0)), _decoded)
    joined = F.array_join(F.zip_with(F.split("t", REFERENCE, -1), references, lambda x, c: F.concat(x, F.coalesce(c, F.lit("")))), "")
    return cut.select("page_id", F.btrim(F.regexp_replace(F.regexp_replace(joined, r"[ \t\r\x{A0}]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n")).alias("visible"))


def _decoded_sql() -> str:
    """What reference r stands for."""
    point = "(CASE WHEN r[3] IN ('x', 'X') THEN ('0x' || r[4:len(r) - 1])::BIGINT WHEN r[2] = '#' THEN r[3:len(r) - 1]::BIGINT END)"
    named = " ".join(f"WHEN r = '&{k};' THEN '{_q(c)}'" for k, c in ENTITIES.items())
    return f"(CASE {named} WHEN {point} BETWEEN 1 AND 1114111 AND NOT {point} BETWEEN 55296 AND 57343 THEN chr({point}::INT) ELSE r END)"


def _visible_sql() -> str:
    shown = "html"
    for pattern, by in ((UNSEEN, "''"), (LINE_TAG, "chr(10)"), (TAG, "''")):
        shown = f"regexp_replace({shown}, '{_q(pattern)}', {by}, 'g')"
    return rf"""
WITH s AS (SELECT page_id, {shown} AS t FROM pages WHERE html IS NOT NULL),
c AS (SELECT page_id, string_split_regex(t, '{REFERENCE}') AS x, list_transform(regexp_extract_all(t, '{REFERENCE}'), lambda r: {_decoded_sql()}) AS r FROM s),
j AS (SELECT page_id, array_to_string(list_transform(range(1, len(x) + 1), lambda i: x[i] || coalesce(r[i], '')), '') AS t FROM c)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r\x{{A0}}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS visible FROM j
"""


QUERIES = {
    "rule_findings": lambda s, d: findings(documents(s, d)),
    "prose_filter": lambda s, d: prose_filter(documents(s, d)),
    "visible_text": lambda s, d: visible_text(s.read.parquet(f"{d}/pages.parquet")),
}
ORACLE_SQL = {"rule_findings": FINDINGS_SQL, "prose_filter": PROSE_SQL, "visible_text": _visible_sql()}
