"""Row-local measures of a document: syntax proxies, rhythm, information, openings, paragraphs; and views of its text.

Everything comes from one row; no measure shuffles.  Measures number words, sentences
and paragraphs of all texts of an Arrow slice at once; views are expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.functions import scan
from textloom.functions.text import SENTENCE_END, WORD
from textloom.operators.measured_rules import FUNCTION_WORDS
from textloom.operators.stylometry import documents

# Word lists.
BE_FORMS = ("is", "are", "was", "were", "be", "been", "being", "am", "get", "gets", "got")
IRREGULAR = (
    "been", "done", "gone", "seen", "taken", "given", "made", "found", "held", "kept", "left", "led", "met", "paid", "put", "read", "said", "sent", "set", "shown", "sold", "told",
    "thought", "written", "known", "built", "brought", "bought", "caught", "chosen", "driven", "drawn", "eaten", "fallen", "felt", "grown", "heard", "lost", "meant", "run", "spent",
    "understood", "won", "worn",
)
SUBORDINATORS = ("which", "that", "because", "although", "though", "while", "whereas", "since", "unless", "whether", "if", "when", "where", "who", "whom", "whose")
COORDINATORS = ("and", "but", "so", "yet", "or", "nor", "for")
CONTRACTION = r"(?i)\b\w+['’](?:t|s|re|ve|ll|d|m)\b"


MEASURES = (
    "ttr_400", "function_word_rate", "contraction_rate", "cv_sent_len", "range_sent_len", "comma_per_sent", "subordinator_rate", "coord_opener_rate", "the_opener_rate",
    "distinct_opener_ratio", "max_opener_repeat", "question_rate", "exclaim_rate", "passive_rate", "burstiness", "autocorr_1", "autocorr_2", "masd_norm", "sent_len_entropy",
    "short_windows_rate", "n_paragraphs", "mean_para_words", "cv_para_words", "tail_paragraphs", "even_paragraphs", "word_entropy", "word_entropy_norm", "char_entropy",
)


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(the place of each character's text, its code, how many codes there are)."""
    points = np.frombuffer(scan.raw(texts)[0].tobytes().decode().encode("utf-32-le"), np.uint32)
    met = np.zeros(0x110000, bool)
    met[points] = True
    codes = np.cumsum(met, dtype=np.int32) - 1
    return np.repeat(np.arange(len(texts)), np.asarray(pc.utf8_length(texts))), codes[points], int(codes[-1]) + 1


def _entropy(owner: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    """Bits of each owner's frequencies."""
    whole = np.bincount(owner, often, n)
    return np.log2(whole) - np.bincount(owner, often * np.log2(often), n) / whole


def _spread(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation of the population) of each owner's values."""
    size = np.bincount(owner, minlength=n)
    mean = np.bincount(owner, values, n) / size
    return mean, np.sqrt(np.bincount(owner, (values - mean[owner]) ** 2, n) / size)


def _followed(owner: np.ndarray, k: int) -> np.ndarray:
    """Places whose k-th next place has the same owner."""
    return np.flatnonzero(owner[: max(len(owner) - k, 0)] == owner[k:])


def _measured(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(the place of each text that has a word and a sentence, its MEASURES)."""
    n_texts = len(texts)
    count = lambda owner: np.bincount(owner, minlength=n_texts)
    fresh = lambda *keys: np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(keys[0]) else np.zeros(0, bool)
    data, offsets = scan.raw(texts)

    packed, starts, owner = scan.latin_spans(texts)
    codes, kinds = scan.lower_codes(packed)
    listed = lambda group: np.asarray(pc.is_in(kinds, pa.array(group)), bool)[codes]
    n = count(owner)
    opening = np.arange(len(owner)) - np.searchsorted(owner, owner) < 400
    early = scan.tallies(owner[opening], codes[opening], n_texts, len(kinds))[0]
    word_owner, _, word_often = scan.tallies(owner, codes, n_texts, len(kinds))
    word_kinds = count(word_owner)
    ends = np.asarray(pc.ends_with(kinds, "ed"), bool)[codes] | listed(IRREGULAR)
    behind = np.zeros(len(owner), bool)
    for k in (1, 2):
        at = _followed(owner, k)
        behind[at] |= ends[at + k]
    passive = count(owner[listed(BE_FORMS) & behind])

    # paragraphs end where nothing but white space stands between two line breaks
    breaks = np.flatnonzero(data == 0x0A)
    solid = np.cumsum(~np.isin(data, np.frombuffer(b" \t\r\n", np.uint8)))
    text_of = np.searchsorted(offsets, breaks, "right")
    bare = np.flatnonzero((solid[breaks[1:]] == solid[breaks[:-1]]) & (text_of[1:] == text_of[:-1])) + 1
    part = np.searchsorted(breaks[bare], starts)
    new = fresh(owner, part)
    p_owner = owner[new]
    p_words = np.bincount(np.cumsum(new) - 1, minlength=len(p_owner)).astype(np.float64)
    n_paras = count(p_owner)
    p_mean, p_sd = _spread(p_words, p_owner, n_texts)
    upto = np.cumsum(p_words)
    before = np.concatenate(([0.0], upto))[np.searchsorted(p_owner, np.arange(n_texts))]
    tail = count(p_owner[(upto - before[p_owner]) * 10 > n[p_owner] * 8])

    # sentences, whose marks take the place of closers and blanks, so that words are told anew
    marked = pc.replace_substring_regex(texts, SENTENCE_END, "\\1\x01\\2")
    m_data, m_offsets = scan.raw(marked)
    m_packed, m_starts, m_owner = scan.latin_spans(marked)
    cut = (m_data == 0x01) | (m_data == 0x0A)
    new = fresh(m_owner, np.cumsum(cut)[m_starts])
    first = np.flatnonzero(new)
    s_owner = m_owner[first]
    length = np.bincount(np.cumsum(new) - 1, minlength=len(first)).astype(np.float64)
    ns = count(s_owner)
    cuts = np.append(np.flatnonzero(cut), len(m_data))
    stop = np.minimum(cuts[np.searchsorted(cuts, m_starts[first])], m_offsets[s_owner + 1])
    inked = np.flatnonzero(~np.isin(m_data, np.frombuffer(b" \t\r\n", np.uint8)))
    final = m_data[inked[np.searchsorted(inked, stop) - 1]] if len(first) else np.zeros(0, np.uint8)
    o_codes, openers = scan.lower_codes(m_packed.take(pa.array(first)))
    opens = lambda group: count(s_owner[np.asarray(pc.is_in(openers, pa.array(group)), bool)[o_codes]])
    o_owner, _, o_often = scan.tallies(s_owner, o_codes, n_texts, len(openers))
    top = np.zeros(n_texts)
    np.maximum.at(top, o_owner, o_often)
    low, high = np.full(n_texts, np.inf), np.full(n_texts, -np.inf)
    np.minimum.at(low, s_owner, length)
    np.maximum.at(high, s_owner, length)
    l_owner, _, l_often = scan.tallies(s_owner, np.minimum(length // 5, 12).astype(np.int64), n_texts, 13)
    mean, sd = _spread(length, s_owner, n_texts)
    power = sd * sd * ns
    off = length - mean[s_owner]

    def autocorr(k: int) -> np.ndarray:
        at = _followed(s_owner, k)
        return np.where((ns > k + 2) & (power > 1e-9), np.bincount(s_owner[at], off[at] * off[at + k], n_texts) / power, 0.0)

    at = _followed(s_owner, 1)
    steps = np.bincount(s_owner[at], np.abs(length[at + 1] - length[at]), n_texts)
    at = _followed(s_owner, 2)
    windows = count(s_owner[at[length[at] + length[at + 1] + length[at + 2] <= 45]])

    c_owner, c_codes, n_codes = _characters(texts)
    char_owner, _, char_often = scan.tallies(c_owner, c_codes, n_texts, n_codes)
    word_entropy = _entropy(word_owner, word_often, n_texts)
    out = {
        "ttr_400": count(early) / np.minimum(n, 400),
        "function_word_rate": count(owner[listed(FUNCTION_WORDS)]) / n,
        "contraction_rate": scan.count(texts, CONTRACTION) * 1000.0 / n,
        "cv_sent_len": sd / mean,
        "range_sent_len": high - low,
        "comma_per_sent": np.asarray(pc.count_substring(texts, ",")) / ns,
        "subordinator_rate": count(owner[listed(SUBORDINATORS)]) * 1000.0 / n,
        "coord_opener_rate": opens(COORDINATORS) / ns,
        "the_opener_rate": opens(("the",)) / ns,
        "distinct_opener_ratio": count(o_owner) / ns,
        "max_opener_repeat": top / ns,
        "question_rate": count(s_owner[final == 0x3F]) / ns,
        "exclaim_rate": count(s_owner[final == 0x21]) / ns,
        "passive_rate": passive / ns,
        "burstiness": (sd - mean) / (sd + mean),
        "autocorr_1": autocorr(1),
        "autocorr_2": autocorr(2),
        "masd_norm": steps / np.maximum(ns - 1, 1) / mean,
        "sent_len_entropy": _entropy(l_owner, l_often, n_texts) / np.log2(13.0),
        "short_windows_rate": windows * 1000.0 / n,
        "n_paragraphs": n_paras,
        "mean_para_words": p_mean,
        "cv_para_words": p_sd / p_mean,
        "tail_paragraphs": tail,
        "even_paragraphs": (n_paras >= 4) & (p_sd / p_mean <= 0.2) & (n >= 500),
        "word_entropy": word_entropy,
        "word_entropy_norm": np.where(word_kinds > 1, word_entropy / np.log2(np.maximum(word_kinds, 2)), word_entropy),
        "char_entropy": _entropy(char_owner, char_often, n_texts),
    }
    kept = np.flatnonzero((n > 0) & (ns > 0))
    return kept, [pa.array(out[k][kept].astype(np.float64)) for k in MEASURES]


def _quiet(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    with np.errstate(divide="ignore", invalid="ignore"):  # of texts that have no row
        return _measured(texts)


def measures(docs: DataFrame) -> DataFrame:
    """One row per document that has a word and a sentence."""
    known = scan.rows(docs, ", ".join(f"{k} double" for k in MEASURES), _quiet)
    return known.select("doc_id", *[F.round(F.col(k) + 1e-9, 5).alias(k) for k in MEASURES])


def _in(listed: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in listed)


_W = WORD.replace("'", "''")
MEASURES_SQL = rf"""
WITH c AS MATERIALIZED (SELECT doc_id, text, list_transform(regexp_extract_all(text, '{_W}'), lambda x: lower(x)) AS w,
  list_filter(string_split_regex(regexp_replace(text, '([.!?])["''”’)\]]*[ \t\r\f]+(["''“‘(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]'), lambda x: regexp_matches(x, '{_W}')) AS s,
  list_filter(string_split_regex(text, '\n[ \t\r\n]*\n'), lambda x: regexp_matches(x, '{_W}')) AS p FROM documents),
z AS MATERIALIZED (SELECT *, len(w) AS n, len(s) AS ns, list_transform(s, lambda x: len(regexp_extract_all(x, '{_W}'))::DOUBLE) AS l, list_transform(p, lambda x: len(regexp_extract_all(x, '{_W}'))::DOUBLE) AS pw, list_transform(s, lambda x: lower(regexp_extract(x, '{_W}'))) AS o FROM c WHERE len(w) > 0 AND len(s) > 0),
ew AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e, count(*) AS kinds FROM (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, unnest(w) AS v FROM z) GROUP BY ALL) GROUP BY 1),
ec AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS v FROM z) GROUP BY ALL) GROUP BY 1),
el AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS e FROM (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(l, lambda x: least(floor(x / 5), 12))) AS v FROM z) GROUP BY ALL) GROUP BY 1),
eo AS (SELECT doc_id, count(*) AS kinds, max(k) AS top FROM (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, unnest(o) AS v FROM z) GROUP BY ALL) GROUP BY 1),
m AS (SELECT *, list_avg(l) AS mean, list_stddev_pop(l) AS sd, list_stddev_pop(l) * list_stddev_pop(l) * ns AS power FROM z),
v AS (SELECT m.doc_id,
  len(list_distinct(w[1:400])) / least(n, 400) AS ttr_400, len(list_filter(w, lambda x: x IN ({_in(FUNCTION_WORDS)}))) / n AS function_word_rate, len(regexp_extract_all(text, '{CONTRACTION.replace("'", "''")}')) * 1000.0::DOUBLE / n AS contraction_rate,
  CASE WHEN mean > 0 THEN sd / mean ELSE 0 END AS cv_sent_len, list_max(l) - list_min(l) AS range_sent_len, len(regexp_extract_all(text, ',')) / ns AS comma_per_sent, len(list_filter(w, lambda x: x IN ({_in(SUBORDINATORS)}))) * 1000.0::DOUBLE / n AS subordinator_rate,
  len(list_filter(o, lambda x: x IN ({_in(COORDINATORS)}))) / ns AS coord_opener_rate, len(list_filter(o, lambda x: x = 'the')) / ns AS the_opener_rate, eo.kinds / ns AS distinct_opener_ratio, eo.top / ns AS max_opener_repeat,
  len(list_filter(s, lambda x: regexp_matches(x, '\?[ \t\r\n]*$'))) / ns AS question_rate, len(list_filter(s, lambda x: regexp_matches(x, '![ \t\r\n]*$'))) / ns AS exclaim_rate,
  len(list_filter(range(1, n + 1), lambda i: w[i] IN ({_in(BE_FORMS)}) AND (coalesce(w[i + 1] LIKE '%ed' OR w[i + 1] IN ({_in(IRREGULAR)}), false) OR coalesce(w[i + 2] LIKE '%ed' OR w[i + 2] IN ({_in(IRREGULAR)}), false)))) / ns AS passive_rate,
  (sd - mean) / (sd + mean) AS burstiness,
  CASE WHEN ns > 3 AND power > 1e-9 THEN list_sum(list_transform(range(1, ns), lambda i: (l[i] - mean) * (l[i + 1] - mean))) / power ELSE 0 END AS autocorr_1,
  CASE WHEN ns > 4 AND power > 1e-9 THEN list_sum(list_transform(range(1, ns - 1), lambda i: (l[i] - mean) * (l[i + 2] - mean))) / power ELSE 0 END AS autocorr_2,
  coalesce(list_sum(list_transform(range(1, ns), lambda i: abs(l[i + 1] - l[i]))), 0) / greatest(ns - 1, 1) / mean AS masd_norm, el.e / log2(13.0::DOUBLE) AS sent_len_entropy,
  len(list_filter(range(1, ns - 1), lambda i: l[i] + l[i + 1] + l[i + 2] <= 45)) * 1000.0::DOUBLE / n AS short_windows_rate, len(p)::DOUBLE AS n_paragraphs, coalesce(list_avg(pw), 0) AS mean_para_words,
  CASE WHEN list_avg(pw) > 0 THEN list_stddev_pop(pw) / list_avg(pw) ELSE 0 END AS cv_para_words, len(list_filter(range(1, greatest(len(pw), 1) + 1), lambda i: coalesce(list_sum(pw[1:i]), 0) * 10 > coalesce(list_sum(pw), 0) * 8))::DOUBLE AS tail_paragraphs,
  (len(p) >= 4 AND list_stddev_pop(pw) / list_avg(pw) <= 0.2 AND n >= 500)::INT::DOUBLE AS even_paragraphs, ew.e AS word_entropy, CASE WHEN ew.kinds > 1 THEN ew.e / log2(ew.kinds) ELSE ew.e END AS word_entropy_norm, ec.e AS char_entropy
  FROM m JOIN ew ON m.doc_id = ew.doc_id JOIN ec ON m.doc_id = ec.doc_id JOIN el ON m.doc_id = el.doc_id JOIN eo ON m.doc_id = eo.doc_id)
SELECT doc_id, round(COLUMNS(* EXCLUDE doc_id)::DOUBLE + 1e-9, 5) FROM v
"""


# --- views of the text -----------------------------------------------------------------

LINK = r"\[([^\]\n]+)\]\([^)\n]*\)"
BULLET = r"^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]+"


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, ...): Markdown as plain text, lists as prose, splits, offsets and layout counts of every text."""
    t = F.col("text")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, LINK, "$1"), r"(?:\*\*|__)([^*_\n]+)(?:\*\*|__)", "$1"), r"(?m)^#{1,6}[ \t]+", "")
    lines = F.split(t, "\n")
    item = F.filter(lines, lambda x: x.rlike(BULLET))
    flat = F.array_join(F.transform(F.filter(lines, lambda x: x.rlike(r"[^ \t\r]")), lambda x: F.when(x.rlike(BULLET), F.concat(F.regexp_replace(F.regexp_replace(x, BULLET, ""), r"[.;, \t\r]+$", ""), F.lit("."))).otherwise(x)), " ")
    heading = F.filter(lines, lambda x: x.rlike(r"[A-Za-z]") & ~x.rlike(r"[.!?,;][ \t\r]*$") & ~x.rlike(BULLET) & (F.length(F.btrim(x, F.lit(" \t\r"))) <= 90) & (F.regexp_count(x, F.lit(r"[^ \t\r]+")) <= 12))
    digest = F.sha2(t.cast("binary"), 256)
    held = F.aggregate(F.split(digest, ""), F.lit(0), lambda n, x: F.when(x == "", n).otherwise(((n * 16 + F.conv(x, 16, 10).cast("int")) % 100)))
    first = F.split(t, r"\n[ \t\r\n]*\n")
    tok = F.regexp_extract_all(F.lower(t), F.lit(r"[a-z]+"), F.lit(0))
    stem = F.transform(tok, lambda x: F.when((F.length(x) > 4) & x.endswith("s") & ~x.endswith("ss"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return docs.where("text is not null").select(
        "doc_id",
        F.sha2(plain.cast("binary"), 256).alias("plain_sha256"),
        F.sha2(flat.cast("binary"), 256).alias("flat_sha256"),
        F.size(item).cast("bigint").alias("n_items"),
        F.size(heading).cast("bigint").alias("n_heading_like"),
        (F.length(t) + F.regexp_count(t, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("bigint").alias("utf16_units"),
        F.size(F.filter(first, lambda p: p.rlike(r"[^ \t\r\n]"))).cast("bigint").alias("n_paragraphs"),
        F.length(F.get(first, F.lit(0))).cast("bigint").alias("first_paragraph_end"),
        F.size(F.filter(F.split(t, "[.!?]+"), lambda x: F.length(F.btrim(x, F.lit(" \t\r\n"))) > 5)).cast("bigint").alias("n_sentences_a"),
        F.size(F.filter(F.split(F.regexp_replace(t, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001"), lambda x: x.rlike(r"[^ \t\r\n]"))).cast("bigint").alias("n_sentences_b"),
        F.regexp_count(t, F.lit(r"\*\*[^*\n]+\*\*")).cast("bigint").alias("n_bold"),
        F.regexp_count(t, F.lit(r"(?m)^\|[^\n]*\|")).cast("bigint").alias("n_table_rows"),
        F.regexp_count(t, F.lit(r"`[^`\n]+`")).cast("bigint").alias("n_code"),
        F.size(F.array_distinct(stem)).cast("bigint").alias("n_stems"),
        (held < 10).alias("held_out"),
    )


VIEWS_SQL = rf"""
WITH b AS (SELECT doc_id, text AS t, string_split(text, chr(10)) AS lines, string_split_regex(text, '\n[ \t\r\n]*\n') AS p, regexp_extract_all(lower(text), '[a-z]+') AS tok, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id,
  sha256(regexp_replace(regexp_replace(regexp_replace(t, '{LINK}', '\1', 'g'), '(?:\*\*|__)([^*_\n]+)(?:\*\*|__)', '\1', 'g'), '(?m)^#{{1,6}}[ \t]+', '', 'g')) AS plain_sha256,
  sha256(coalesce(array_to_string(list_transform(list_filter(lines, lambda x: regexp_matches(x, '[^ \t\r]')), lambda x: CASE WHEN regexp_matches(x, '{BULLET}') THEN regexp_replace(regexp_replace(x, '{BULLET}', ''), '[.;, \t\r]+$', '') || '.' ELSE x END), ' '), '')) AS flat_sha256,
  len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}')))::BIGINT AS n_items,
  len(list_filter(lines, lambda x: regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '[.!?,;][ \t\r]*$') AND NOT regexp_matches(x, '{BULLET}') AND length(trim(x, ' ' || chr(9) || chr(13))) <= 90 AND len(regexp_extract_all(x, '[^ \t\r]+')) <= 12))::BIGINT AS n_heading_like,
  (length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')))::BIGINT AS utf16_units, len(list_filter(p, lambda x: regexp_matches(x, '[^ \t\r\n]')))::BIGINT AS n_paragraphs, length(p[1])::BIGINT AS first_paragraph_end,
  len(list_filter(string_split_regex(t, '[.!?]+'), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13))) > 5))::BIGINT AS n_sentences_a,
  len(list_filter(string_split(regexp_replace(t, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^ \t\r\n]')))::BIGINT AS n_sentences_b,
  len(regexp_extract_all(t, '\*\*[^*\n]+\*\*'))::BIGINT AS n_bold, len(regexp_extract_all(t, '(?m)^\|[^\n]*\|'))::BIGINT AS n_table_rows, len(regexp_extract_all(t, '`[^`\n]+`'))::BIGINT AS n_code,
  len(list_distinct(list_transform(tok, lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[1:length(x) - 1] ELSE x END)))::BIGINT AS n_stems,
  list_reduce(list_transform(string_split(h, ''), lambda x: (strpos('0123456789abcdef', x) - 1)::INT), lambda n, x: (n * 16 + x) % 100) < 10 AS held_out
FROM b
"""


def prose_reasons(docs: DataFrame, least: int = 150, most: int = 20_000) -> DataFrame:
    """Why a text is no long-form prose: the first of its reasons in a fixed order, else ``ok``; and whether its length is accepted."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\r]"))
    n = F.regexp_count(t, F.lit(r"[^ \t\r\n]+"))
    long_ = F.size(F.filter(F.split(F.regexp_replace(t, r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001"), lambda x: F.regexp_count(x, F.lit(r"[^ \t\r\n]+")) >= 5))
    items = F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]")))
    loose = F.size(F.filter("lines", lambda x: ~x.rlike(r"""[.!?:;”"')\]][ \t\r]*$""")))
    base = docs.select("doc_id", t.alias("t"), lines.alias("lines"), n.alias("n"), long_.alias("long"))
    reason = (
        F.when(F.col("n") < least, "short").when(F.size("lines") == 0, "empty").when(items > F.size("lines") * 0.4, "list").when(F.col("long") < 8, "sentences")
        .when((loose > F.size("lines") * 0.7) & (F.col("n") < F.size("lines") * 10), "fragments").when(F.regexp_count("t", F.lit(r"\p{L}")) < 0.6 * F.greatest(F.lit(1), F.length(F.replace(F.col("t"), F.lit(" "), F.lit("")))), "letters").otherwise("ok")
    )
    return base.select("doc_id", reason.alias("reason"), F.col("n").between(least, most).alias("length_ok"), (F.size("lines") >= 3).alias("blocks_ok"))


REASONS_SQL = r"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')) AS lines, len(regexp_extract_all(t, '[^ \t\r\n]+')) AS n,
  len(list_filter(string_split(regexp_replace(t, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+')) >= 5)) AS long FROM b)
SELECT doc_id, CASE WHEN n < 150 THEN 'short' WHEN len(lines) = 0 THEN 'empty' WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]'))) > len(lines) * 0.4::DOUBLE THEN 'list' WHEN long < 8 THEN 'sentences'
  WHEN len(list_filter(lines, lambda x: NOT regexp_matches(x, '[.!?:;”"'')\]][ \t\r]*$'))) > len(lines) * 0.7::DOUBLE AND n < len(lines) * 10 THEN 'fragments'
  WHEN len(regexp_extract_all(t, '\p{L}')) < 0.6::DOUBLE * greatest(1, length(replace(t, ' ', ''))) THEN 'letters' ELSE 'ok' END AS reason, n BETWEEN 150 AND 20000 AS length_ok, len(lines) >= 3 AS blocks_ok FROM c
"""

QUERIES = {
    "document_measures": lambda s, d: measures(documents(s, d)),
    "text_views": lambda s, d: views(documents(s, d)),
    "prose_reasons": lambda s, d: prose_reasons(documents(s, d)),
}
ORACLE_SQL = {"document_measures": MEASURES_SQL, "text_views": VIEWS_SQL, "prose_reasons": REASONS_SQL}
