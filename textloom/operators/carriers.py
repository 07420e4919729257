"""Invisible and deceptive characters: findings with their context, look-alike letters, tiers, status, safe fixes.

A text without a carrier costs one class match and no row.  Of others, only the
carriers are looked at; what one means is read off the character and its neighbours.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from textloom.functions import scan
from textloom.operators.stylometry import documents

# Fixed table of carriers: first and last code point, severity, fix.
CARRIERS = (
    (0x00A0, 0x00A0, "note", "space"),
    (0x00AD, 0x00AD, "low", "remove"),
    (0x034F, 0x034F, "medium", "remove"),
    (0x061C, 0x061C, "medium", "review"),
    (0x070F, 0x070F, "medium", "review"),
    (0x0890, 0x0891, "medium", "review"),
    (0x08E2, 0x08E2, "medium", "review"),
    (0x1680, 0x1680, "low", "space"),
    (0x180B, 0x180F, "medium", "remove"),
    (0x2000, 0x2008, "low", "space"),
    (0x2009, 0x2009, "note", "space"),
    (0x200A, 0x200A, "low", "space"),
    (0x200B, 0x200D, "medium", "remove"),
    (0x200E, 0x200F, "medium", "review"),
    (0x2028, 0x2029, "low", "review"),
    (0x202A, 0x202E, "medium", "review"),
    (0x202F, 0x202F, "note", "space"),
    (0x205F, 0x205F, "note", "space"),
    (0x2060, 0x2064, "medium", "remove"),
    (0x2066, 0x2069, "medium", "review"),
    (0x206A, 0x206F, "medium", "review"),
    (0x3000, 0x3000, "note", "space"),
    (0xE000, 0xF8FF, "medium", "review"),
    (0xFE00, 0xFE0F, "medium", "remove"),
    (0xFEFF, 0xFEFF, "low", "remove"),
    (0xFFF9, 0xFFFB, "medium", "review"),
    (0xFFFD, 0xFFFD, "high", "review"),
    (0x110BD, 0x110BD, "medium", "review"),
    (0x110CD, 0x110CD, "medium", "review"),
    (0xE0001, 0xE0001, "high", "remove"),
    (0xE0020, 0xE007F, "high", "remove"),
    (0xE0100, 0xE01EF, "medium", "review"),
    (0xF0000, 0xFFFFD, "medium", "review"),
    (0x100000, 0x10FFFD, "medium", "review"),
)
# Fixed ranges of neighbours that make a joiner or selector ordinary, and of the tiers.
EMOJI = ((0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x21AA), (0x231A, 0x23FF), (0x24C2, 0x24C2), (0x25AA, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0xFE0F, 0xFE0F), (0x1F000, 0x1FAFF))
JOINING = ((0x0600, 0x074F), (0x0750, 0x077F), (0x07C0, 0x07FF), (0x08A0, 0x0DFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x1800, 0x18AF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC))
GLYPH_BASE = ((0x1800, 0x18AF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
SELECTORS = ((0x180B, 0x180D), (0x180F, 0x180F), (0xFE00, 0xFE0F))
SELECTORS_MORE = ((0xE0100, 0xE01EF),)
DELIBERATE = ((0x200B, 0x200D), (0x2060, 0x2060), (0x206A, 0x206F), (0xFE00, 0xFE0F), (0xE0001, 0xE0001), (0xE0100, 0xE01EF))
TAGS = ((0xE0020, 0xE007F),)
SUPPORTING = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x180B, 0x180F), (0x2061, 0x2064), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB))
PRIVATE = ((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
# Letters that look Latin.
LOOKALIKES = "авекмнорстухѕіјѡѵһԁԛԝЅІЈАВЕКМНОРСТУХԀαικνορυϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
SEVERITIES = ("note", "low", "medium", "high")
FLAG = 0x1F3F4


def _class(ranges, negate: bool = False) -> str:
    """A character class that Java and RE2 read alike."""
    return ("[^" if negate else "[") + "".join(rf"\x{{{r[0]:X}}}-\x{{{r[1]:X}}}" for r in ranges) + "]"


ANY = _class(CARRIERS)
MIXED = r"[\p{L}\p{N}_-]+"


def _of(ranges) -> re.Pattern:
    """The ranges as a class of one character."""
    return re.compile("[" + "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[1]))}" for r in ranges) + "]")


_ANY, _EMOJI, _JOINING, _GLYPH_BASE = _of(CARRIERS), _of(EMOJI), _of(JOINING), _of(GLYPH_BASE)
_FLAGGED = re.compile(chr(FLAG) + _of(TAGS).pattern + r"*\Z")


@cache
def _kind(char: str) -> tuple[bool, bool, str, str, str]:
    """(selector, selector of glyphs, code without context, severity, fix) of a carrier."""
    point = ord(char)
    within = lambda ranges: any(r[0] <= point <= r[1] for r in ranges)
    plain = "t" if within(TAGS) else "d" if within(DELIBERATE) else "s" if within(SUPPORTING) else "p" if within(PRIVATE) else "x"
    row = next(r for r in CARRIERS if r[0] <= point <= r[1])
    return within(SELECTORS), within(SELECTORS) or within(SELECTORS_MORE), plain, row[2], row[3]


def coded(text: str) -> list[tuple[int, str, str, str, str]]:
    """(place, character, code, severity, fix) of every carrier.

    Codes: deliberate, tag, supporting, private, excluded, and n or e where the neighbours explain it.
    """
    out = []
    for m in _ANY.finditer(text):
        at, x = m.start(), m[0]
        selects, glyph, code, severity, fix = _kind(x)
        before, after = text[at - 1] if at else "", text[at + 1 : at + 2]
        joins = x == "\u200d" and _EMOJI.match(before) and _EMOJI.match(after) or x in "\u200c\u200d" and _JOINING.match(before) and _JOINING.match(after)
        if joins or selects and _EMOJI.match(before):
            code = "e"
        elif glyph and _GLYPH_BASE.match(before):
            code, severity, fix = "n", "note", "review"
        elif code == "t" and _FLAGGED.search(text[max(0, at - 32) : at]):
            code = "x"  # tags after a black flag, up to the one at hand, are a flag
        out.append((at, x, code, severity, fix))
    return out


def _holders(texts: pa.Array, pattern: str = ANY) -> tuple[list[int], list[str]]:
    """(places, texts) of those the pattern finds something in; one class match for others."""
    at = np.flatnonzero(scan.matches(texts, pattern))
    return at.tolist(), texts.take(pa.array(at, pa.int64())).to_pylist()


def _columns(rows: list[tuple], types: list[pa.DataType]) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows of (place, values) as scan.rows takes them."""
    place, *columns = zip(*rows, strict=True) if rows else [()] * (len(types) + 1)
    return np.array(place, np.int64), [pa.array(c, t) for c, t in zip(columns, types, strict=True)]


TIERS = {"d": "deliberate", "t": "deliberate", "s": "supporting", "p": "supporting", "x": "excluded", "n": "excluded"}


def carrier_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, code_point, severity, fix, tier) of every carrier that its context does not explain."""

    def work(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        rows = [(i, at, ord(x), severity, fix, TIERS[code]) for i, text in zip(*_holders(texts), strict=True) for at, x, code, severity, fix in coded(text) if code != "e"]
        return _columns(rows, [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()])

    return scan.rows(docs, "start bigint, code_point int, severity string, fix string, tier string", work)


def _suspects(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(place of the text, word, look-alike letters, those between Latin letters) of words of mixed scripts with look-alike letters."""
    found, _, owner = scan.found(texts, r"[\p{L}\p{N}_-]*[" + LOOKALIKES + r"][\p{L}\p{N}_-]*")
    words = pa.array(found, pa.string())
    mixed = pa.array(scan.matches(words, r"\p{Latin}") & scan.matches(words, r"[\p{Cyrillic}\p{Greek}]"), pa.bool_())
    words, owner = words.filter(mixed), np.array(owner, np.int64)[np.asarray(mixed)]
    doubled = pc.replace_substring_regex(words, r"(\p{Latin})", r"\1\1")
    return owner, words, scan.count(words, f"[{LOOKALIKES}]"), scan.count(doubled, rf"\p{{Latin}}[{LOOKALIKES}]\p{{Latin}}")


def lookalikes(docs: DataFrame) -> DataFrame:
    """(doc_id, token, n, n_inside): words of mixed scripts with look-alike letters, and those between Latin letters."""

    def work(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        owner, words, n, inside = _suspects(texts)
        return owner, [words, pa.array(n), pa.array(inside)]

    return scan.rows(docs, "token string, n bigint, n_inside bigint", work)


def integrity(docs: DataFrame) -> DataFrame:
    """Counts per severity and tier, the longest run of invisible carriers, and a status for every row whose text is not null.

    manipulated: a run of three, two tags outside a flag, or eight deliberate ones (look-alike
    letters inside a word count); attention: one deliberate one, or two private-use characters.
    All is read off the row's own text: rows that repeat a doc_id, or have none, stay apart.
    """
    names = [*(f"n_{s}" for s in SEVERITIES), "n_deliberate", "n_private", "longest_run", "n_tags"]

    def work(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        counts = np.zeros((len(names), len(texts)), np.int64)
        owner, _, _, inside = _suspects(texts)
        np.add.at(counts[4], owner, inside)
        for i, text in zip(*_holders(texts), strict=True):
            run, last = 0, -2
            for at, _, code, severity, _ in coded(text):
                if code == "e":
                    continue
                counts[SEVERITIES.index(severity), i] += 1
                counts[4, i] += code in "dt"
                counts[5, i] += code == "p"
                counts[7, i] += code == "t"
                if code in "dts":
                    run, last = run + 1 if at == last + 1 else 1, at
                    counts[6, i] = max(counts[6, i], run)
        return np.arange(len(texts)), [pa.array(c) for c in counts]

    counted = scan.rows(docs, ", ".join(f"{n} bigint" for n in names), work)
    status = F.when((F.col("longest_run") >= 3) | (F.col("n_tags") >= 2) | (F.col("n_deliberate") >= 8), "manipulated").when((F.col("n_deliberate") >= 1) | (F.col("n_private") >= 2), "attention").otherwise("clean")
    return counted.select("doc_id", *names[:-1], status.alias("status"))


def _fixed(text: str) -> tuple[int, str]:
    """(characters changed, sha256 of the text with removable carriers removed and odd spaces made plain)."""
    parts, low, n = [], 0, 0
    for at, _, code, _, fix in coded(text):
        if code not in "en" and fix in ("remove", "space"):
            parts.append(text[low:at] + (" " if fix == "space" else ""))
            low, n = at + 1, n + 1
    return n, hashlib.sha256("".join([*parts, text[low:]]).encode()).hexdigest()


def safe_fixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_fixed, fixed_sha256): removable carriers removed and odd spaces made plain, where their context does not explain them."""

    def work(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        return _columns([(i, *_fixed(text)) for i, text in zip(*_holders(texts), strict=True)], [pa.int64(), pa.string()])

    return scan.rows(docs, "n_fixed bigint, fixed_sha256 string", work)


#: Texts with carriers, put behind every third document by its id.
PROBES = (
    "zero​width and soft­hyphen and no break",
    "family \U0001f468‍\U0001f469 heart ❤️ fine م‌م x‍y",
    "tags \U000e0041\U000e0042 flag \U0001f3f4\U000e0067\U000e0062\U000e007f end",
    "run a​‌​b and  and \U000e0100 after 一\U000e0101",
    "pаsswоrd α-helix rеаd",
    "w⁠a⁠b⁠c⁠d⁠e⁠f⁠g⁠h bom﻿ �   ‮",
)


def probed(docs: DataFrame) -> DataFrame:
    probe = F.element_at(F.array(*[F.lit(p) for p in PROBES]), (F.pmod(F.col("doc_id"), F.lit(3 * len(PROBES))) / 3 + 1).cast("int"))
    return docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" "), probe)).otherwise(F.col("text")).alias("text"))


def _probed_sql() -> str:
    quoted = ", ".join(f"'{p}'" for p in PROBES)
    return f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' ' || ([{quoted}])[(doc_id % {3 * len(PROBES)} // 3)::INT + 1] ELSE text END AS text FROM documents"


def _coded_sql() -> str:
    is_ = lambda x, ranges: f"coalesce(regexp_matches({x}, '^{_class(ranges)}$'), false)"
    x, b, a = "c[i]", "(CASE WHEN i > 1 THEN c[i - 1] END)", "c[i + 1]"
    flag = rf"regexp_matches(array_to_string(c[greatest(1, i - 32):i - 1], ''), '\x{{{FLAG:X}}}{_class(TAGS)}*$')"
    case = (
        f"CASE WHEN NOT regexp_matches({x}, '{ANY}') THEN '.' WHEN ({x} = chr(8205) AND {is_(b, EMOJI)} AND {is_(a, EMOJI)}) OR ({x} IN (chr(8204), chr(8205)) AND {is_(b, JOINING)} AND {is_(a, JOINING)}) OR ({is_(x, SELECTORS)} AND {is_(b, EMOJI)}) THEN 'e' "
        f"WHEN ({is_(x, SELECTORS)} OR {is_(x, SELECTORS_MORE)}) AND {is_(b, GLYPH_BASE)} THEN 'n' WHEN {is_(x, TAGS)} THEN CASE WHEN {flag} THEN 'x' ELSE 't' END WHEN {is_(x, DELIBERATE)} THEN 'd' WHEN {is_(x, SUPPORTING)} THEN 's' WHEN {is_(x, PRIVATE)} THEN 'p' ELSE 'x' END"
    )
    return f"src AS MATERIALIZED ({_probed_sql()}), ch AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM src WHERE regexp_matches(text, '{ANY}')), k AS MATERIALIZED (SELECT doc_id, c, list_transform(range(1, len(c) + 1), lambda i: {case}) AS code FROM ch)"


def _pick_sql(place: int) -> str:
    return "CASE " + " ".join(f"WHEN p BETWEEN {r[0]} AND {r[1]} THEN '{r[place]}'" for r in CARRIERS) + " END"


_FOUND_SQL = f"f AS (SELECT doc_id, (i - 1)::BIGINT AS start, unicode(c[i])::INT AS p, code[i] AS l FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM k) WHERE code[i] NOT IN ('.', 'e')), g AS (SELECT doc_id, start, p AS code_point, CASE WHEN l = 'n' THEN 'note' ELSE {_pick_sql(2)} END AS severity, CASE WHEN l = 'n' THEN 'review' ELSE {_pick_sql(3)} END AS fix, CASE WHEN l IN ('d', 't') THEN 'deliberate' WHEN l IN ('s', 'p') THEN 'supporting' ELSE 'excluded' END AS tier FROM f)"
_LOOK_SQL = rf"lk AS (SELECT doc_id, token, len(regexp_extract_all(token, '[{LOOKALIKES}]'))::BIGINT AS n, len(regexp_extract_all(regexp_replace(token, '(\p{{Latin}})', '\1\1', 'g'), '\p{{Latin}}[{LOOKALIKES}]\p{{Latin}}'))::BIGINT AS n_inside FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{MIXED}')) AS token FROM src WHERE regexp_matches(text, '[{LOOKALIKES}]')) WHERE regexp_matches(token, '\p{{Latin}}') AND regexp_matches(token, '[\p{{Cyrillic}}\p{{Greek}}]') AND regexp_matches(token, '[{LOOKALIKES}]'))"
_N = lambda letters: f"coalesce(len(regexp_extract_all(ks, '[{letters}]')), 0)"
INTEGRITY_SQL = f"""
WITH {_coded_sql()}, {_FOUND_SQL}, {_LOOK_SQL},
ci AS (SELECT doc_id, sum(n_inside) AS inside FROM lk GROUP BY 1), s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (severity = '{v}') AS n_{v}" for v in SEVERITIES)} FROM g GROUP BY 1),
j AS (SELECT src.doc_id, array_to_string(code, '') AS ks, {", ".join(f"coalesce(n_{v}, 0)::BIGINT AS n_{v}" for v in SEVERITIES)}, coalesce(inside, 0) AS inside FROM src LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN ci USING (doc_id) WHERE text IS NOT NULL),
v AS (SELECT *, ({_N('dt')} + inside)::BIGINT AS n_deliberate, {_N('p')}::BIGINT AS n_private, coalesce(list_max(list_transform(regexp_extract_all(ks, '[dts]+'), lambda x: length(x))), 0)::BIGINT AS longest_run FROM j)
SELECT doc_id, {", ".join(f"n_{v}" for v in SEVERITIES)}, n_deliberate, n_private, longest_run, CASE WHEN longest_run >= 3 OR {_N('t')} >= 2 OR n_deliberate >= 8 THEN 'manipulated' WHEN n_deliberate >= 1 OR n_private >= 2 THEN 'attention' ELSE 'clean' END AS status FROM v
"""
_REMOVE, _SPACE = (_class([r for r in CARRIERS if r[3] == fix]) for fix in ("remove", "space"))
_NEW = f"(CASE WHEN code[i] IN ('.', 'e', 'n') THEN c[i] WHEN regexp_matches(c[i], '{_REMOVE}') THEN '' WHEN regexp_matches(c[i], '{_SPACE}') THEN ' ' ELSE c[i] END)"
QUERIES = {
    "carrier_findings": lambda s, d: carrier_findings(probed(documents(s, d))),
    "lookalike_words": lambda s, d: lookalikes(probed(documents(s, d))),
    "integrity_status": lambda s, d: integrity(probed(documents(s, d))),
    "safe_fixes": lambda s, d: safe_fixes(probed(documents(s, d))),
}
ORACLE_SQL = {
    "carrier_findings": f"WITH {_coded_sql()}, {_FOUND_SQL} SELECT * FROM g",
    "lookalike_words": f"WITH src AS ({_probed_sql()}), {_LOOK_SQL} SELECT * FROM lk",
    "integrity_status": INTEGRITY_SQL,
    "safe_fixes": f"WITH {_coded_sql()} SELECT doc_id, len(list_filter(range(1, len(c) + 1), lambda i: {_NEW} <> c[i]))::BIGINT AS n_fixed, sha256(array_to_string(list_transform(range(1, len(c) + 1), lambda i: {_NEW}), '')) AS fixed_sha256 FROM k",
}
