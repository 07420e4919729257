"""Stylometric features of documents.

All come from array expressions of one row, so nothing shuffles and rows that
repeat a doc_id stay apart; counts of words are run lengths of the sorted array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import scan
from textloom.functions.text import rate, sentences, words

# Fixed word lists.
FIRST_SINGULAR = ("i", "me", "my", "mine", "myself")
FIRST_PLURAL = ("we", "us", "our", "ours", "ourselves")
SECOND_PERSON = ("you", "your", "yours", "yourself", "yourselves")
THIRD_PERSON = ("he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs")
COMMON = ("the", "of", "and", "to", "a", "that", "is", "it")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the session has cores is dealt anew; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def frequencies(a: Column) -> Column:
    """struct<n, kinds, once, twice, squares> of an array of strings: how often its values occur."""
    names = ("run", "n", "kinds", "once", "twice", "squares")
    zero = F.struct(F.lit(None).cast("string").alias("last"), *[F.lit(0).cast("bigint").alias(k) for k in names])

    def closed(z: Column) -> dict[str, Column]:
        """The totals with the run at hand."""
        return {"once": z["once"] + (z["run"] == 1).cast("bigint"), "twice": z["twice"] + (z["run"] == 2).cast("bigint"), "squares": z["squares"] + z["run"] * z["run"]}

    one = F.lit(1).cast("bigint")
    again = lambda z, x: F.struct(x.alias("last"), (z["run"] + 1).alias("run"), (z["n"] + 1).alias("n"), *[z[k].alias(k) for k in names[2:]])
    fresh = lambda z, x: F.struct(x.alias("last"), one.alias("run"), (z["n"] + 1).alias("n"), (z["kinds"] + 1).alias("kinds"), *[c.alias(k) for k, c in closed(z).items()])
    finish = lambda z: F.struct(z["n"].alias("n"), z["kinds"].alias("kinds"), *[c.alias(k) for k, c in closed(z).items()])
    return F.aggregate(F.array_sort(a), zero, lambda z, x: F.when(z["last"].eqNullSafe(x), again(z, x)).otherwise(fresh(z, x)), finish)


def lexical(docs: DataFrame) -> DataFrame:
    """Vocabulary richness and word-class rates; documents without a word have no row."""
    w = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    f = w.select("doc_id", "w", frequencies(F.col("w")).alias("f"))
    n, types = F.col("f.n"), F.col("f.kinds")
    of = lambda test: F.size(F.filter("w", test))
    listed = lambda group: of(lambda x: x.isin(*group)) * 1000.0 / n
    return f.select(
        "doc_id",
        n.alias("n_words"),
        types.alias("n_types"),
        (F.col("f.once") / types).alias("hapax_rate"),
        (F.col("f.twice") / types).alias("dis_rate"),
        (F.lit(10000.0) * (F.col("f.squares") - n) / (n * n)).alias("yule_k"),
        (F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) / n).alias("mean_word_len"),
        (of(lambda x: F.length(x) >= 8) / n).alias("long_word_rate"),
        (of(lambda x: F.length(x) <= 3) / n).alias("short_word_rate"),
        *[listed((w,)).alias(f"{w}_rate") for w in COMMON],
        listed(FIRST_SINGULAR).alias("first_singular_rate"),
        listed(FIRST_PLURAL).alias("first_plural_rate"),
        listed(SECOND_PERSON).alias("second_person_rate"),
        listed(THIRD_PERSON).alias("third_person_rate"),
    )


def _sql_list(listed: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in listed)


LEXICAL_SQL = rf"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏ'']+'))) AS tok FROM documents),
c AS (SELECT doc_id, tok, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS n_words, count(*) AS n_types,
  sum((n = 1)::INT) / count(*) AS hapax_rate, sum((n = 2)::INT) / count(*) AS dis_rate,
  10000.0::DOUBLE * (sum(n * n) - sum(n)) / (sum(n) * sum(n)) AS yule_k,
  sum(length(tok) * n) / sum(n) AS mean_word_len,
  sum(CASE WHEN length(tok) >= 8 THEN n ELSE 0 END) / sum(n) AS long_word_rate,
  sum(CASE WHEN length(tok) <= 3 THEN n ELSE 0 END) / sum(n) AS short_word_rate,
  {", ".join(f"sum(CASE WHEN tok = '{w}' THEN n ELSE 0 END) * 1000.0::DOUBLE / sum(n) AS {w}_rate" for w in COMMON)},
  sum(CASE WHEN tok IN ({_sql_list(FIRST_SINGULAR)}) THEN n ELSE 0 END) * 1000.0::DOUBLE / sum(n) AS first_singular_rate,
  sum(CASE WHEN tok IN ({_sql_list(FIRST_PLURAL)}) THEN n ELSE 0 END) * 1000.0::DOUBLE / sum(n) AS first_plural_rate,
  sum(CASE WHEN tok IN ({_sql_list(SECOND_PERSON)}) THEN n ELSE 0 END) * 1000.0::DOUBLE / sum(n) AS second_person_rate,
  sum(CASE WHEN tok IN ({_sql_list(THIRD_PERSON)}) THEN n ELSE 0 END) * 1000.0::DOUBLE / sum(n) AS third_person_rate
FROM c GROUP BY doc_id
"""


def _repeats(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Per text of two words or more: its number of 2-grams, 3-grams, and different ones of each."""
    codes, owner, vocabulary = scan.latin_words(texts)
    kinds = max(len(vocabulary), 1)
    size = np.bincount(owner, minlength=len(texts))

    def different(ids: np.ndarray, mine: np.ndarray) -> np.ndarray:
        many = int(ids.max(initial=0)) + 1
        return np.bincount(np.unique(mine * many + ids) // many, minlength=len(texts))

    # numbers that are equal exactly if the words are
    two, three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    pair = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)[1]
    triple = np.unique(pair[:-1] * kinds + codes[2:], return_inverse=True)[1]
    some = np.flatnonzero(size >= 2)
    return some, [pa.array(x[some]) for x in (size - 1, np.maximum(size - 2, 0), different(pair[two], owner[:-1][two]), different(triple[three], owner[:-2][three]))]


def repetition(docs: DataFrame) -> DataFrame:
    """Distinct 2- and 3-gram shares and repeated trigrams, of documents of two words or more."""
    f = scan.rows(docs, "n2 bigint, n3 bigint, kinds2 bigint, kinds3 bigint", _repeats)
    share = lambda part: F.coalesce(F.try_divide(part, F.col("n3")), F.lit(0.0))
    return f.select("doc_id", (F.col("kinds2") / F.col("n2")).alias("distinct2"), share(F.col("kinds3")).alias("distinct3"), share(F.col("n3") - F.col("kinds3")).alias("repeat_trigram_rate"))


REPETITION_SQL = r"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-zÀ-ɏ'']+'), lambda x: lower(x)) AS w FROM documents),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t WHERE len(w) >= 2),
c AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 3),
x AS (SELECT doc_id, count(DISTINCT g) AS d2, count(*) AS t2 FROM b GROUP BY 1),
y AS (SELECT doc_id, count(DISTINCT g) AS d3, count(*) AS t3 FROM c GROUP BY 1)
SELECT x.doc_id, d2 / t2 AS distinct2, coalesce(d3 / t3, 0.0::DOUBLE) AS distinct3, coalesce((t3 - d3) / t3, 0.0::DOUBLE) AS repeat_trigram_rate
FROM x LEFT JOIN y ON x.doc_id = y.doc_id
"""


def sentence_length(docs: DataFrame) -> DataFrame:
    """Sentence lengths in words, of sentences that hold one; array expressions only."""
    count = F.transform(sentences(F.col("text")), lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[A-Za-zÀ-ɏ']+"), F.lit(0))))
    lens = docs.select("doc_id", F.array_sort(F.filter(count, lambda x: x > 0)).alias("l")).where(F.size("l") > 0)
    total = lambda f: F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + f(x).cast("bigint"))
    part = lens.select("doc_id", "l", F.size("l").alias("n"), total(lambda x: x).alias("s"), total(lambda x: x * x).alias("q"))
    at = lambda share: F.element_at("l", (F.floor(F.lit(share) * (F.col("n") - 1)) + 1).cast("int"))
    return part.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_sentences"),
        (F.col("s") / F.col("n")).alias("mean_sent_len"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")))), 6).alias("sd_sent_len"),
        (at(0.75) - at(0.25)).cast("bigint").alias("iqr_sent_len"),
        (total(lambda x: (x < 10).cast("int")) / F.col("n")).alias("pct_short_sent"),
        (total(lambda x: (x > 30).cast("int")) / F.col("n")).alias("pct_long_sent"),
        F.array_max("l").cast("bigint").alias("max_sent_len"),
        F.array_min("l").cast("bigint").alias("min_sent_len"),
    )


SENTENCE_SQL = r"""
WITH m AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])["''”’)\]]*[ \t\r\f]+(["''“‘(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]')) AS s FROM documents),
l AS (SELECT doc_id, len(regexp_extract_all(s, '[A-Za-zÀ-ɏ'']+')) AS x FROM m),
a AS (SELECT doc_id, list(x ORDER BY x) AS v, count(*) AS n, sum(x) AS s, sum(x * x) AS q, sum((x < 10)::INT) AS sh, sum((x > 30)::INT) AS lo, max(x) AS mx, min(x) AS mn FROM l WHERE x > 0 GROUP BY 1)
SELECT doc_id, n AS n_sentences, s / n AS mean_sent_len, round(sqrt(greatest(0.0, q / n - (s / n) * (s / n))), 6) AS sd_sent_len,
  (v[floor(0.75 * (n - 1))::INT + 1] - v[floor(0.25 * (n - 1))::INT + 1])::BIGINT AS iqr_sent_len,
  sh / n AS pct_short_sent, lo / n AS pct_long_sent, mx::BIGINT AS max_sent_len, mn::BIGINT AS min_sent_len FROM a
"""

#: Characters counted per 1,000 of the text, with the names of their rates.
MARKS = {"comma": ",", "period": ".", "semicolon": ";", "colon": ":", "question": "?", "exclaim": "!", "paren": "(", "quote": '"', "apostrophe": "'", "hyphen": "-", "en_dash": "–", "em_dash": "—", "ellipsis": "…", "slash": "/", "ampersand": "&", "percent": "%", "asterisk": "*", "hash": "#"}


def punctuation(docs: DataFrame) -> DataFrame:
    size = F.greatest(F.length("text"), F.lit(1))
    return docs.where("text is not null").select("doc_id", *[((F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))) * 1000.0 / size).alias(f"{k}_rate") for k, c in MARKS.items()])


def _quoted(c: str) -> str:
    return c.replace("'", "''")


PUNCTUATION_SQL = "SELECT doc_id, " + ", ".join(f"(length(text) - length(replace(text, '{_quoted(c)}', ''))) * 1000.0::DOUBLE / greatest(length(text), 1) AS {k}_rate" for k, c in MARKS.items()) + " FROM documents WHERE text IS NOT NULL"


def moving_ttr(docs: DataFrame, window: int = 100, stride: int = 10) -> DataFrame:
    """Mean type-token ratio of windows of ``window`` words; shorter texts count as one window."""
    w = docs.select("doc_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.when(F.size("w") >= window, F.sequence(F.lit(1), F.size("w") - window + 1, F.lit(stride))).otherwise(F.array(F.lit(1)))
    kinds = w.select("doc_id", F.size("w").alias("n"), F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("w", i, window)))).alias("k"))
    total = F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return kinds.select("doc_id", (total / (F.size("k") * F.least(F.col("n"), F.lit(window)))).alias("mattr"))


MATTR_SQL = r"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-zÀ-ɏ'']+'), lambda x: lower(x)) AS w FROM documents),
k AS (SELECT doc_id, len(w) AS n, list_transform(CASE WHEN len(w) >= 100 THEN range(1, len(w) - 98, 10) ELSE [1] END, lambda i: len(list_distinct(w[i:i + 99]))) AS k FROM t WHERE len(w) > 0)
SELECT doc_id, list_sum(k) / (len(k) * least(n, 100)) AS mattr FROM k
"""


def cohesion(docs: DataFrame) -> DataFrame:
    """Mean word-set overlap (intersection over union) of neighbouring sentences."""
    sets = docs.select("doc_id", F.filter(F.transform(sentences(F.col("text")), lambda s: F.array_distinct(words(s))), lambda x: F.size(x) > 0).alias("s")).where(F.size("s") >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.size(F.array_intersect(F.element_at("s", i), F.element_at("s", i + 1))) / F.size(F.array_union(F.element_at("s", i), F.element_at("s", i + 1))))
    return sets.select("doc_id", (F.size("s") - 1).cast("bigint").alias("n_pairs"), F.round(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (F.size("s") - 1), 6).alias("cohesion"))


COHESION_SQL = r"""
WITH m AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])["''”’)\]]*[ \t\r\f]+(["''“‘(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]') AS s FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(s, lambda x: list_distinct(list_transform(regexp_extract_all(x, '[A-Za-zÀ-ɏ'']+'), lambda y: lower(y)))), lambda z: len(z) > 0) AS s FROM m),
p AS (SELECT doc_id, len(s) - 1 AS n, list_transform(range(1, len(s)), lambda i: len(list_intersect(s[i], s[i + 1])) / len(list_distinct(list_concat(s[i], s[i + 1])))) AS v FROM w WHERE len(s) >= 2)
SELECT doc_id, n::BIGINT AS n_pairs, round(list_sum(v) / n, 6) AS cohesion FROM p
"""


def formatting(docs: DataFrame) -> DataFrame:
    """Layout of the lines of a text: headings, bullets, numbering, blanks, capitals."""
    lines = F.split("text", "\n")
    some = lambda rx: F.size(F.filter("lines", lambda x: x.rlike(rx)))
    out = docs.where("text is not null").select("doc_id", F.col("text"), lines.alias("lines"))
    n = F.size("lines")
    return out.select("doc_id", n.cast("bigint").alias("n_lines"), (some(r"^#{1,6} ") / n).alias("heading_rate"), (some(r"^[ \t]*[-*+] ") / n).alias("bullet_rate"), (some(r"^[ \t]*[0-9]+[.)] ") / n).alias("numbered_rate"), (some(r"^[ \t\r]*$") / n).alias("blank_rate"), rate(F.length("text"), n).alias("mean_line_len"), F.regexp_count("text", F.lit(r"https?://")).cast("bigint").alias("n_urls"), F.regexp_count("text", F.lit(r"(?:^|[ \n])[A-Z]{2,}")).cast("bigint").alias("n_all_caps"))


FORMATTING_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(v)::BIGINT AS n_lines,
  len(list_filter(v, lambda x: regexp_matches(x, '^#{1,6} '))) / len(v) AS heading_rate,
  len(list_filter(v, lambda x: regexp_matches(x, '^[ \t]*[-*+] '))) / len(v) AS bullet_rate,
  len(list_filter(v, lambda x: regexp_matches(x, '^[ \t]*[0-9]+[.)] '))) / len(v) AS numbered_rate,
  len(list_filter(v, lambda x: regexp_matches(x, '^[ \t\r]*$'))) / len(v) AS blank_rate,
  length(text) * 1.0::DOUBLE / len(v) AS mean_line_len,
  len(regexp_extract_all(text, 'https?://'))::BIGINT AS n_urls, len(regexp_extract_all(text, '(?:^|[ \n])[A-Z]{2,}'))::BIGINT AS n_all_caps
FROM l
"""

QUERIES = {
    "stylometry": lambda s, d: lexical(documents(s, d)),
    "ngram_repetition": lambda s, d: repetition(documents(s, d)),
    "sentence_length": lambda s, d: sentence_length(documents(s, d)),
    "punctuation_rates": lambda s, d: punctuation(documents(s, d)),
    "moving_ttr": lambda s, d: moving_ttr(documents(s, d)),
    "adjacent_cohesion": lambda s, d: cohesion(documents(s, d)),
    "formatting": lambda s, d: formatting(documents(s, d)),
}
ORACLE_SQL = {"stylometry": LEXICAL_SQL, "ngram_repetition": REPETITION_SQL, "sentence_length": SENTENCE_SQL, "punctuation_rates": PUNCTUATION_SQL, "moving_ttr": MATTR_SQL, "adjacent_cohesion": COHESION_SQL, "formatting": FORMATTING_SQL}
