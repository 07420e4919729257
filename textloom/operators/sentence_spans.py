"""Sentences as places in the text, with guards for abbreviations, initials and acronyms; row-local.

Candidate edges are found in one pass over a text; one behind a guarded full stop
is no end.  Words are told for all texts of an Arrow slice at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import scan
from textloom.operators.stylometry import documents

# White space, ends, closers and openers of a sentence, and tokens whose full stop ends none.
SPACE = r"[\f\n\r\t\x0B\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
END, CLOSERS, OPENERS = r"[.!?…]", r"""["'”’)\]}»]*""", r"""["'“‘(\[{«]*"""
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st rev hon gen col lt sgt capt cmdr adm maj supt insp no nos vol vols ed eds op cit et al "
    "etc eg ie cf viz vs approx est fig figs inc ltd plc co corp dept univ assn bros jan feb mar apr jun jul aug sep sept oct "
    "nov dec mon tue tues wed thu thur thurs fri sat sun am pm ca circa pp p ch chap sec para u.s u.k e.g i.e a.m p.m ph.d d.c"
).split()
CADENCE_ABBREVIATIONS = r"(?i)(?:^|\W)(?:e\.g|i\.e|etc|vs|Dr|Mr|Mrs|Ms|Prof|Fig|No|St|Jr|Sr|approx|cf|al)\.$"
MIN_WORDS = 5

EDGE = rf"({END}+{CLOSERS}{SPACE}+)({OPENERS}[A-Z0-9“\"'(\[])"
LAST = rf"([A-Za-z][A-Za-z.]*)\.{CLOSERS}{SPACE}+$"
NON_SPACE = SPACE.replace("[", "[^", 1)
MARK, OTHER = "\u0001", "\u0002"


def _python(pattern: str) -> str:
    """The pattern with its code points as Python writes them."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern)


_EDGE, _SPACE, _ENDS = re.compile(_python(EDGE)), re.compile(_python(SPACE)), ".!?…"
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.")
_KNOWN = frozenset(ABBREVIATIONS)
_BLANK = np.zeros(0x10000, bool)
_BLANK[[i for i in range(0x10000) if _SPACE.match(chr(i))]] = True


def _guarded(text: str, low: int, stop: int) -> bool:
    """Is the full stop at ``stop``, alone, part of the token before it, which starts at ``low`` or later?"""
    if text[stop] != "." or text[stop + 1] in _ENDS:
        return False
    at = stop
    while at > low and text[at - 1] in _TOKEN:
        at -= 1
    token = text[at:stop].lstrip(".").lower()
    return token != "" and not token.endswith(".") and (len(token) == 1 or "." in token or token in _KNOWN)


def _cuts(text: str) -> list[int]:
    """Places where sentences end, but the last."""
    low, out = 0, []
    for m in _EDGE.finditer(text):
        if not _guarded(text, low, m.start()):
            out.append(m.end(1))
        low = m.end(1)
    return out


def spans(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(the place of each sentence's text, its number, start, end, words, scorable); places are code points, end exclusive."""
    held = texts.to_pylist()
    begins = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int64)
    edges, owner = [], []
    for i, text in enumerate(held):
        if text:
            edges.append(np.array([0, *_cuts(text)], np.int64) + begins[i])
            owner.append(np.full(len(edges[-1]), i, np.int64))
    if not edges:
        return np.zeros(0, np.int64), [pa.array([], t) for t in (*[pa.int64()] * 4, pa.bool_())]
    low, owner = np.concatenate(edges), np.concatenate(owner)
    high = np.append(low[1:], begins[-1])
    points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
    solid = np.append(~_BLANK[np.minimum(points, 0xFFFF)], False)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    text_starts = begins[:-1][begins[:-1] < begins[1:]]
    first[text_starts] = solid[text_starts]
    stop = np.append(solid[:-1] & (~solid[1:] | first[1:]), False)
    starts, ends = np.flatnonzero(first), np.flatnonzero(stop) + 1
    a, b = np.searchsorted(starts, low), np.searchsorted(starts, high)
    some = a < b
    a, b, owner = a[some], b[some], owner[some]
    n = b - a
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    base = begins[owner]
    return owner, [pa.array(x) for x in (number, starts[a] - base, ends[b - 1] - base, n.astype(np.int64), n >= MIN_WORDS)]


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, start, end, words, scorable): one row per sentence; text[start:end] is the sentence."""
    return scan.rows(docs, "sentence bigint, start bigint, end bigint, words bigint, scorable boolean", spans)


def cadence_sentences(text: Column) -> Column:
    """array<string> of sentences split behind end marks, with pieces behind an abbreviation joined again by a blank; those without a letter go."""
    blank = r"[ \t\n\r\f\x0B]"
    trimmed = lambda x: F.regexp_replace(x, f"^{blank}+|{blank}+$", "")
    marked = F.regexp_replace(F.translate(trimmed(text), MARK, OTHER), rf"""([.!?])["')\]]*{blank}+""", f"$1{MARK}")
    pieces = F.filter(F.transform(F.split(marked, MARK, -1), trimmed), lambda x: x != "")
    joined = F.array_join(F.transform(pieces, lambda x: F.concat(x, F.when(x.rlike(CADENCE_ABBREVIATIONS), " ").otherwise(MARK))), "")
    return F.filter(F.split(trimmed(F.regexp_replace(joined, f"{MARK}$", "")), MARK, -1), lambda x: x.rlike("[A-Za-z]"))


def cadence_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_words, longest): sentences for cadence measures and their words."""
    words = lambda x: F.regexp_count(x, F.lit("[A-Za-z][A-Za-z'’-]*"))
    counts = docs.where("text is not null").select("doc_id", F.transform(cadence_sentences(F.col("text")), words).alias("n"))
    return counts.select("doc_id", F.size("n").cast("bigint").alias("n_sentences"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_words"), F.coalesce(F.array_max("n"), F.lit(0)).cast("bigint").alias("longest"))


#: Texts with stops that end no sentence, put behind every second document.
PROBES = (
    "Dr. Smith met J. R. Jones at 3.5 p.m. in the U.S. embassy. \"Was it late?\" He asked... Then they left! See Fig. 4 and vol. 2, etc. The end.",
    "It cost 2.50 (approx. Three pounds). “Quoted.” ‘Next’ one… And so on.\n\nNew line starts here. Also this.　One more? Yes!! No",
    "  Leading space. lower case goes on. e.g. This stays. i.e. That stays. A. B. Clark wrote it.'' Mr. ",
)


def probed(docs: DataFrame) -> DataFrame:
    probe = F.element_at(F.array(*[F.lit(p) for p in PROBES]), (F.pmod("doc_id", F.lit(2 * len(PROBES))) / 2 + 1).cast("int"))
    return docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" "), probe)).otherwise(F.col("text")).alias("text"))


def _q(text: str) -> str:
    return text.replace("'", "''")


_PROBED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || ' ' || ([" + ", ".join(f"'{_q(p)}'" for p in PROBES) + f"])[(doc_id % {2 * len(PROBES)} // 2)::INT + 1] ELSE text END AS text FROM documents"
SPANS_SQL = f"""
WITH d AS (SELECT doc_id, text AS t, string_split(regexp_replace(translate(text, chr(1), chr(2)), '{_q(EDGE)}', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM ({_PROBED}) WHERE text <> ''),
e AS (SELECT doc_id, t, p, list_transform(p, lambda x: lower(regexp_extract(x, '{_q(LAST)}', 1))) AS k FROM d),
c AS (SELECT doc_id, t, list_distinct(list_prepend(0, list_append(list_transform(list_filter(range(1, len(p) + 1), lambda i: NOT (k[i] <> '' AND NOT ends_with(k[i], '.') AND (length(k[i]) = 1 OR contains(k[i], '.') OR k[i] IN ({", ".join(f"'{x}'" for x in ABBREVIATIONS)})))), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT), length(t)))) AS cuts FROM e),
s AS (SELECT doc_id, t, list_sort(cuts) AS cuts FROM c),
r AS (SELECT doc_id, unnest(range(1, len(cuts))) AS i, cuts, t FROM s),
x AS (SELECT doc_id, i, cuts[i] AS a, cuts[i + 1] AS b, substr(t, cuts[i] + 1, cuts[i + 1] - cuts[i]) AS x FROM r),
y AS (SELECT doc_id, i, a + length(x) - length(regexp_replace(x, '^{SPACE}+', '')) AS start, b - (length(x) - length(regexp_replace(x, '{SPACE}+$', ''))) AS "end", len(regexp_extract_all(x, '{NON_SPACE}+'))::BIGINT AS words FROM x)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence, start::BIGINT AS start, "end"::BIGINT AS "end", words, words >= {MIN_WORDS} AS scorable FROM y WHERE words > 0
"""
_B = r"[ \t\n\r\f\x0B]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"
CADENCE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(translate({_TRIM('text')}, chr(1), chr(2)), '([.!?])["'')\\]]*{_B}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM('x')}), lambda x: x <> '') AS p FROM ({_PROBED}) WHERE text IS NOT NULL),
j AS (SELECT doc_id, list_transform(list_filter(string_split(array_to_string(list_transform(p, lambda x: x || CASE WHEN regexp_matches(x, '{_q(CADENCE_ABBREVIATIONS)}') THEN ' ' ELSE chr(1) END), ''), chr(1)), lambda x: regexp_matches(x, '[A-Za-z]')), lambda x: len(regexp_extract_all(x, '[A-Za-z][A-Za-z''’-]*'))::BIGINT) AS n FROM d)
SELECT doc_id, len(n)::BIGINT AS n_sentences, coalesce(list_sum(n), 0)::BIGINT AS n_words, coalesce(list_max(n), 0)::BIGINT AS longest FROM j
"""
QUERIES = {"sentence_spans": lambda s, d: sentence_spans(probed(documents(s, d))), "cadence_lengths": lambda s, d: cadence_lengths(probed(documents(s, d)))}
ORACLE_SQL = {"sentence_spans": SPANS_SQL, "cadence_lengths": CADENCE_SQL}
