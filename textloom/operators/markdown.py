"""Marked-up texts: fenced code, code masks, text without mark-up, blocks and outline.

Fences are found by a fold over lines, masks keep every place; stripping to a fixed
point, blocks and outline go over texts in Arrow slices.
"""

from __future__ import annotations

import html
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import scan
from textloom.operators.stylometry import documents
from textloom.operators.writing_rules import _bound

# --- fences and masks ------------------------------------------------------------------

FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})([^\n]*)$"
#: Inline code: a run of ticks, text without such a run, the run again.
TICKS = r"(`+)(?:(?!\1)[^\n])+\1"


def fence_ranges(text: Column) -> Column:
    """array<struct<start, end>> of fenced code, code points; an open fence reaches to the text's end.

    A fence closes at a line of the same mark, as long at least, with nothing behind it.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(x).alias("n"), F.regexp_extract(x, FENCE, 1).alias("mark"), F.regexp_extract(x, FENCE, 2).rlike(r"^[ \t]*\r?$").alias("bare")))
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("mark"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(z: Column, x: Column) -> Column:
        opens = (z["mark"] == "") & (x["mark"] != "")
        closes = (z["mark"] != "") & (F.substring(x["mark"], 1, 1) == F.substring(z["mark"], 1, 1)) & (F.length(x["mark"]) >= F.length(z["mark"])) & x["bare"]
        return F.struct(
            (z["at"] + x["n"] + 1).alias("at"),
            F.when(opens, x["mark"]).when(closes, "").otherwise(z["mark"]).alias("mark"),
            F.when(opens, z["at"]).otherwise(z["start"]).alias("start"),
            F.when(closes, F.concat(z["out"], span(z["start"], z["at"] + x["n"]))).otherwise(z["out"]).alias("out"),
        )

    return F.aggregate(lines, zero, step, lambda z: F.when(z["mark"] != "", F.concat(z["out"], span(z["start"], z["at"] - 1))).otherwise(z["out"]))


def masked_code(text: Column) -> Column:
    """The text with fenced and inline code as blanks; line ends and all places stay."""
    blank = lambda x: F.regexp_replace(x, r"[^\n]", " ")
    piece = lambda t, a, b: F.substring(t, a + 1, b - a)

    def fenced(ranges: Column) -> Column:
        parts = F.transform(ranges, lambda r, i: F.concat(piece(text, F.when(i > 0, F.get(ranges, i - 1)["end"]).otherwise(0), r["start"]), blank(piece(text, r["start"], r["end"]))))
        rest = F.when(F.size(ranges) > 0, F.get(ranges, F.size(ranges) - 1)["end"]).otherwise(0)
        return F.concat(F.array_join(parts, ""), piece(text, rest, F.length(text)))

    def inline(t: Column) -> Column:
        whole, between = F.regexp_extract_all(t, F.lit(TICKS), F.lit(0)), F.split(t, TICKS, -1)
        return F.array_join(F.zip_with(between, whole, lambda x, y: F.concat(x, F.coalesce(blank(y), F.lit("")))), "")

    return F.when(text.contains("`") | text.contains("~~~"), _bound(_bound(fence_ranges(text), fenced), inline)).otherwise(text)


def fences(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): one row per fenced range."""
    rows = docs.where(F.col("text").rlike("(?m)" + FENCE)).select("doc_id", F.explode(fence_ranges(F.col("text"))).alias("r"))
    return rows.select("doc_id", F.col("r.start").cast("bigint").alias("start"), F.col("r.end").cast("bigint").alias("end"))


# --- text without mark-up ----------------------------------------------------------------

# Fixed patterns of lines and of what stands within a line, in the order they are applied.
_FENCE_LINE = re.compile(r"\s*(?:```+|~~~+)\s*[\w+-]*\s*")
_RULE = re.compile(r"\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})")
_QUOTE = re.compile(r"\s{0,3}(?:>\s?)+")
_HEAD = re.compile(r"\s{0,3}#{1,6}\s+(.*?)\s*#*\s*")
_UNDERLINE = re.compile(r"\s{0,3}(?:=+|-{2,})\s*")
_ROW, _ROW_EDGE = re.compile(r"\s*\|.*\|\s*"), re.compile(r"\s*\|?[\s:|-]*\|[\s:|-]*")
_ITEMS = (re.compile(r"^(\s*)[-*+•‣◦⁃]\s+"), re.compile(r"^(\s*)\d{1,3}[.)]\s+"))
_WITHIN = (
    (re.compile(r"\[\^[^\]]*\]"), ""),
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), ""),
    (re.compile(r"\[([^\]]*)\]\(\s*<?[^)\s]*>?(?:\s+\"[^\"]*\")?\s*\)"), r"\1"),
    (re.compile(r"\[([^\]]*)\]\[[^\]]*\]"), r"\1"),
    (re.compile(r"<((?:https?|ftp|mailto):[^>\s]+)>"), r"\1"),
    (re.compile(r"`+([^`\n]+?)`+"), r"\1"),
    (re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>"), ""),
)
_STRUCK = re.compile(r"~~(?!\s)(.+?)(?<!\s)~~", re.S)
_EMPHASIS = (re.compile(r"(\*{1,3})(?!\s)(.+?)(?<!\s)\1", re.S), re.compile(r"(?<![A-Za-z0-9_])(_{1,3})(?!\s)(.+?)(?<!\s)\1(?![A-Za-z0-9_])", re.S))
_BREAK, _ESCAPED = re.compile(r"[ \t]*\\$"), re.compile(r"\\([\\`*_{}\[\]()#+\-.!~>|])")
PASSES = 4


def _bare_words(part: str) -> str:
    """A line's visible text."""
    for pattern, kept in _WITHIN:
        part = pattern.sub(kept, part)
    part = _STRUCK.sub(r"\1", html.unescape(part))
    while True:
        inner = part
        for pattern in _EMPHASIS:
            inner = pattern.sub(r"\2", inner)
        if inner == part:
            return _BREAK.sub("", part)
        part = inner


def _bare_lines(text: str) -> list[str]:
    """Lines without the marks of headings, lists, quotes, tables, rules and fences."""
    out: list[str] = []
    fenced = False
    for line in text.split("\n"):
        if _FENCE_LINE.fullmatch(line):
            fenced = not fenced
        elif fenced:
            out.append(line.rstrip())
        elif not _RULE.fullmatch(line):
            quote = _QUOTE.match(line)
            line = line[quote.end() :] if quote else line
            head = _HEAD.fullmatch(line)
            if head:
                out.append(_bare_words(head[1]).strip())
            elif _UNDERLINE.fullmatch(line) and out and out[-1].strip():
                continue
            elif _ROW.fullmatch(line):
                if not _ROW_EDGE.fullmatch(line):
                    cells = (_bare_words(c.strip()).strip() for c in line.strip().strip("|").split("|"))
                    out.append(", ".join(c for c in cells if c))
            else:
                for item in _ITEMS:
                    line = item.sub("", line)
                out.append(_bare_words(line).rstrip())
    return out


def without_markup(text: str) -> str:
    """What a reader sees of a marked-up text, as plain lines.

    Removing one mark may lay another bare, so passes repeat until nothing changes,
    PASSES at most.  Escaped marks are set aside first and come back last, so that
    they stay what they are.
    """
    aside: list[str] = []

    def put_aside(m: re.Match) -> str:
        aside.append(m[1])
        return f"\x00{len(aside) - 1}\x00"

    out = _ESCAPED.sub(put_aside, text)
    for _ in range(PASSES):
        tidy: list[str] = []
        for line in _bare_lines(out.replace("\r\n", "\n").replace("\r", "\n")):
            line = re.sub(r"[ \t]{2,}", " ", line).rstrip()
            if line.strip() or not tidy or tidy[-1]:
                tidy.append(line if line.strip() else "")
        before, out = out, "\n".join(tidy).strip()
        if out == before:
            break
    return re.sub("\x00(\\d+)\x00", lambda m: aside[int(m[1])] if int(m[1]) < len(aside) else m[0], out)


def stripped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts without mark-up; null stays null, rows stay apart, no shuffle."""

    @F.arrow_udf("string")
    def bare(texts: pa.Array) -> pa.Array:
        # texts as objects only for a slice, not for a batch
        return pa.concat_arrays([pa.array([None if t is None else without_markup(t) for t in part.to_pylist()], pa.string()) for part in scan.slices(texts)])

    return docs.select("doc_id", bare("text").alias("text"))


# --- blocks and outline ---------------------------------------------------------------------

# Lines of headings and lists, closing words, words that carry no topic.
HASHED, BOLD, ITEM = r"^(#{1,6})\s+(.*)$", r"^\*\*(.+)\*\*:?\s*$", r"^\s*([-*+•]|[0-9]+[.)])\s+"
CLOSER = r"(?i)^(final (thoughts|words|takeaways?)|conclusion|in conclusion|in summary|to sum(marise| up)?|wrapping (it )?up|wrap[- ]?up|key takeaways?|the bottom line|closing thoughts|summing up|takeaways?)(?:\W|$)"
STOPWORDS = (
    "a an the and or but if then than so of to in on at for from by with about into over after before between out against during without within along across behind beyond up down off above under "
    "is are was were be been being am do does did have has had having will would can could may might must shall should this that these those it its it's i you he she we they them his her their our your my me him us "
    "as not no nor too very just also only more most other some such own same s t don now what which who whom how when where why all any both each few once here there again further"
).split()
_STRIP = r"^\s+|\s+$"
_MARKS = ((r"\*\*(.+?)\*\*", 1), (r"\*(.+?)\*", 1), (r"`(.+?)`", 1), (r"\[(.+?)\]\([^)]*\)", 1))
HEADING, BULLETS, PARA = range(3)
NAMES = pa.array(["heading", "bullets", "para"])
_STEM, _STOP = re.compile("[a-z][a-z'-]*"), frozenset(STOPWORDS)


def _trim(x: pa.Array) -> pa.Array:
    return pc.utf8_trim(x, characters=scan.SPACES)


def _plain(x: pa.Array) -> pa.Array:
    for pattern, _ in _MARKS:
        x = pc.replace_substring_regex(x, pattern, r"\1")
    return _trim(x)


def _heading_like(x: pa.Array) -> np.ndarray:
    """Short, no list item, no end mark, with a letter."""
    s = _trim(x)
    n = scan.words(s)
    return np.asarray(pc.less_equal(pc.utf8_length(s), 90), bool) & ~scan.matches(s, ITEM) & ~scan.matches(s, r"[.!?,;]$") & (n >= 1) & (n <= 12) & scan.matches(s, "[A-Za-z]")


def _headings(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(places of the lines marked as heading, their texts)."""
    s = _trim(lines)
    hashed = np.flatnonzero(scan.matches(s, HASHED))
    bold = np.flatnonzero(scan.matches(s, BOLD))
    inner = _plain(pc.replace_substring_regex(s.take(pa.array(bold)), BOLD, r"\1"))
    like = _heading_like(inner)
    places = np.concatenate((hashed, bold[like]))
    held = pa.concat_arrays([_plain(pc.replace_substring_regex(s.take(pa.array(hashed)), HASHED, r"\2")), inner.filter(pa.array(like))])
    order = np.argsort(places)
    return places[order], held.take(pa.array(order))


def blocks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(the place of each block's text, its kind, its content), in order.

    Blocks stand between blank lines; heading lines at a block's head are blocks of
    their own; two list items that are half of the lines make a list; a line alone
    that looks like one is a heading.
    """
    cut = pc.split_pattern(texts, "\n")
    lines, owner = cut.flatten(), np.asarray(pc.list_parent_indices(cut), np.int64)
    inked = np.flatnonzero(scan.matches(lines, r"\S"))
    lines, owner = lines.take(pa.array(inked)), owner[inked]
    new = np.ones(len(inked), bool)
    new[1:] = (inked[1:] != inked[:-1] + 1) | (owner[1:] != owner[:-1])
    block = np.cumsum(new) - 1

    marked, held = _headings(lines)
    other = np.ones(len(inked), bool)
    other[marked] = False
    seen = np.cumsum(other)
    start = np.flatnonzero(new)
    rest = seen > (seen - other)[start][block]  # behind the headings at a block's head
    peeled = ~rest[marked]
    at = np.flatnonzero(rest)
    first = np.flatnonzero(np.concatenate(([True], block[at][1:] != block[at][:-1]))) if len(at) else at
    group = np.searchsorted(first, np.arange(len(at)), "right") - 1
    size = np.bincount(group, minlength=len(first))
    item = scan.matches(lines, ITEM)
    items = np.bincount(group, item[at], len(first))
    alone, several = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
    single = at[first[alone]]
    bare = _plain(lines.take(pa.array(single)))
    many = size[group] > 1
    joined = pc.binary_join(scan.lists(lines.take(pa.array(at[many])), np.searchsorted(several, group[many]), len(several)), "\n")

    places = np.concatenate((marked[peeled], single, at[first[several]]))
    kinds = np.concatenate((np.full(int(peeled.sum()), HEADING), np.where(_heading_like(bare) & ~item[single], HEADING, PARA), np.where((items >= 2) & (items * 2 >= size), BULLETS, PARA)[several]))
    order = np.argsort(places)
    return owner[places[order]], kinds[order], pa.concat_arrays([held.filter(pa.array(peeled)), bare, joined]).take(pa.array(order))


def _numbers(owner: np.ndarray) -> np.ndarray:
    """Each place's number within its owner."""
    return np.arange(len(owner)) - np.searchsorted(owner, owner)


def block_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, content)."""

    def work(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        owner, kinds, content = blocks(texts)
        return owner, [pa.array(_numbers(owner)), NAMES.take(pa.array(kinds)), content]

    return scan.rows(docs, "block bigint, kind string, content string", work)


def _stems(lowered: str, most: int | None = None) -> list[str]:
    found = (m[0] for m in islice(_STEM.finditer(lowered), most))
    return [t[:-1] if len(t) > 4 and t[-1] == "s" and t[-2] != "s" else t for t in found]


def _repeated(title: str, last: str) -> bool:
    """Do two to four words of the title, two of them with a topic, stand in the last paragraph?"""
    stems = _stems(title, 25)
    topics = [t not in _STOP for t in stems]
    if sum(topics) < 2:
        return False
    behind = f" {' '.join(_stems(last))} "
    return any(sum(topics[i : i + n]) >= 2 and f" {' '.join(stems[i : i + n])} " in behind for n in (2, 3, 4) for i in range(len(stems) - n + 1))


def _outlined(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(the place of every text, the columns of ``outline``)."""
    n = len(texts)
    owner, kinds, content = blocks(texts)
    count = lambda some: np.bincount(owner[some], minlength=n)
    heads, paras = kinds == HEADING, kinds == PARA
    size, n_paras = np.bincount(owner, minlength=n), count(paras)
    section = np.flatnonzero(heads[:-1] & ~heads[1:] & (owner[1:] == owner[:-1]))
    ending = np.flatnonzero(heads | (_numbers(owner) >= size[owner] - 2))
    closing = ending[scan.matches(_trim(content.take(pa.array(ending))), CLOSER)]
    at = np.flatnonzero(paras)
    low, high = (np.searchsorted(owner[at], np.arange(n), side) for side in ("left", "right"))
    start = np.searchsorted(owner, np.arange(n))
    none = np.full(n, len(content))  # an empty text stands behind the blocks'
    first, last = none.copy(), none.copy()
    some = np.flatnonzero(n_paras)
    first[some], last[some] = at[low[some]], at[high[some] - 1]
    begun = np.flatnonzero(size)
    begun = begun[heads[start[begun]]]
    first[begun] = start[begun]
    held = pa.concat_arrays([content, pa.array([""])])
    title, final = held.take(pa.array(first)), held.take(pa.array(last))
    pairs = zip(pc.utf8_lower(title).to_pylist(), pc.utf8_lower(final).to_pylist(), strict=True)
    again = np.fromiter((_repeated(a, b) for a, b in pairs), bool, n)
    return np.arange(n), [title, *[pa.array(x.astype(np.int64)) for x in (count(heads), np.bincount(owner[section], minlength=n), n_paras, count(kinds == BULLETS))], pa.array(count(closing) > 0), pa.array(again & (n_paras > 0))]


def outline(docs: DataFrame) -> DataFrame:
    """Title, counts of blocks and sections, whether a closing phrase stands at the end, and whether the last paragraph repeats the title.

    The title is the first heading if the text begins with it, else the first
    paragraph.  It is repeated if two to four words of it, two of them with a topic,
    stand in the last paragraph, plurals alike.
    """
    return scan.rows(docs, "title string, n_headings bigint, n_sections bigint, n_paras bigint, n_bullets bigint, closer boolean, title_repeated boolean", _outlined)


#: Marked-up texts, put behind every second document.
PROBES = (
    "\n\n# Sea birds of the north coast\n\nSome words on sea birds.\n\n```python\n# no heading\n``` not closed\n````\n\n**Where they nest**\n- on cliffs\n- on *steep* rocks\n- inland\n\nA `short` one.\n\nIn summary, the sea birds of the north coast do well.",
    "\n\n~~~\ncode\n```\n~~\n~~~~  \n\nPlain Title Line\n\nText with [a link](http://x.y) and ``two ` ticks``.\n\n## Final thoughts\n1. one\n\n   ```\nopen to the end",
    "\n\n**Bold lead:** text goes on here.\n\n### A\n### B\nText under both.\n\n* x\ny\n\nKey takeaways\n\nplain end",
)


def probed(docs: DataFrame) -> DataFrame:
    probe = F.element_at(F.array(*[F.lit(p) for p in PROBES]), (F.pmod("doc_id", F.lit(2 * len(PROBES))) / 2 + 1).cast("int"))
    return docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.coalesce("text", F.lit("")), probe)).otherwise(F.col("text")).alias("text"))


def _q(text: str) -> str:
    return text.replace("'", "''")


_PROBED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || ([" + ", ".join(f"'{_q(p)}'" for p in PROBES) + f"])[(doc_id % {2 * len(PROBES)} // 2)::INT + 1] ELSE text END AS text FROM documents"
FENCES_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, text AS t, string_split(text, chr(10)) AS l FROM ({_PROBED}) WHERE regexp_matches(text, '(?m){FENCE}')),
x AS (SELECT id, i, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda y: length(y) + 1)), 0)::BIGINT AS at FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM d) WHERE regexp_matches(l[i], '{FENCE}')),
m AS (SELECT *, regexp_extract(line, '{FENCE}', 1) AS mark, regexp_matches(regexp_extract(line, '{FENCE}', 2), '^[ \\t]*\\r?$') AS bare, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM x),
s AS (SELECT id, 0 AS k, '' AS mark, 0::BIGINT AS start, NULL::BIGINT AS a, NULL::BIGINT AS b FROM d
  UNION ALL SELECT s.id, m.k, CASE WHEN s.mark = '' THEN m.mark WHEN m.mark[1] = s.mark[1] AND length(m.mark) >= length(s.mark) AND m.bare THEN '' ELSE s.mark END, CASE WHEN s.mark = '' THEN m.at ELSE s.start END,
    CASE WHEN s.mark <> '' AND m.mark[1] = s.mark[1] AND length(m.mark) >= length(s.mark) AND m.bare THEN s.start END, CASE WHEN s.mark <> '' AND m.mark[1] = s.mark[1] AND length(m.mark) >= length(s.mark) AND m.bare THEN m.at + length(m.line) END
  FROM s JOIN m ON m.id = s.id AND m.k = s.k + 1)
SELECT doc_id, a AS start, b AS "end" FROM s JOIN d USING (id) WHERE a IS NOT NULL
UNION ALL SELECT doc_id, start, length(t) FROM s JOIN d USING (id) WHERE mark <> '' AND k = (SELECT count(*) FROM m WHERE m.id = s.id)
"""


def _plain_sql(x: str) -> str:
    for pattern, _ in _MARKS:
        x = f"regexp_replace({x}, '{pattern}', '\\1', 'g')"
    return f"regexp_replace({x}, '{_STRIP}', '', 'g')"


def _like_sql(x: str) -> str:
    s = f"regexp_replace({x}, '{_STRIP}', '', 'g')"
    return f"(length({s}) <= 90 AND NOT regexp_matches({s}, '{ITEM}') AND NOT regexp_matches({s}, '[.!?,;]$') AND len(regexp_extract_all({s}, '\\S+')) BETWEEN 1 AND 12 AND regexp_matches({s}, '[A-Za-z]'))"


_S = f"regexp_replace(x, '{_STRIP}', '', 'g')"
_BOLD = _plain_sql(f"regexp_extract({_S}, '{BOLD}', 1)")
_BLOCKS_SQL = f"""
raw AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda b: list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '\\S'))), lambda ls: len(ls) > 0)) AS l, generate_subscripts(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda b: list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '\\S'))), lambda ls: len(ls) > 0), 1) AS n FROM ({_PROBED}) WHERE text IS NOT NULL),
hd AS (SELECT *, list_transform(l, lambda x: CASE WHEN regexp_matches({_S}, '{HASHED}') THEN {_plain_sql(f"regexp_extract({_S}, '{HASHED}', 2)")} WHEN regexp_matches({_S}, '{BOLD}') AND {_like_sql(_BOLD)} THEN {_BOLD} END) AS h FROM raw),
pl AS (SELECT *, coalesce(list_min(list_filter(range(1, len(l) + 1), lambda i: h[i] IS NULL)), len(l) + 1) - 1 AS k FROM hd),
bd AS (SELECT *, l[k + 1:] AS r, len(list_filter(l[k + 1:], lambda x: regexp_matches(x, '{ITEM}'))) AS items FROM pl),
kd AS (SELECT *, CASE WHEN items >= 2 AND items * 2 >= len(r) THEN 'bullets' WHEN len(r) = 1 AND {_like_sql(_plain_sql("r[1]"))} AND NOT regexp_matches(r[1], '{ITEM}') THEN 'heading' ELSE 'para' END AS kind FROM bd),
b AS (SELECT doc_id, n, unnest(range(1, k::INT + 1)) AS j, 'heading' AS kind, unnest(h[1:k]) AS content FROM kd WHERE k > 0
  UNION ALL SELECT doc_id, n, k + 1, kind, CASE WHEN len(r) = 1 AND kind <> 'bullets' THEN {_plain_sql("r[1]")} ELSE array_to_string(r, chr(10)) END FROM kd WHERE len(r) > 0),
blocks AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, j) - 1 AS block, kind, content FROM b)
"""
_STEM_SQL = lambda x: f"list_transform(regexp_extract_all(lower({x}), '[a-z][a-z''-]*'), lambda t: CASE WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN t[:-2] ELSE t END)"
_GRAMS_SQL = lambda a: "list_concat(" + ", ".join(f"list_transform(range(1, len({a}) - {n - 2}), lambda i: array_to_string({a}[i:i + {n - 1}], ' '))" for n in (2, 3, 4)) + ")"
OUTLINE_SQL = f"""
WITH {_BLOCKS_SQL},
g AS (SELECT doc_id, list(kind ORDER BY block) AS k, list(content ORDER BY block) AS c, coalesce(list(content ORDER BY block) FILTER (kind = 'para'), []) AS p, coalesce(list(content ORDER BY block) FILTER (kind = 'heading'), []) AS h FROM blocks GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(k, []) AS k, coalesce(c, []) AS c, coalesce(p, []) AS p, coalesce(h, []) AS h FROM (SELECT doc_id FROM ({_PROBED}) WHERE text IS NOT NULL) d LEFT JOIN g USING (doc_id)),
t AS (SELECT *, CASE WHEN k[1] = 'heading' THEN c[1] ELSE coalesce(p[1], '') END AS title FROM e),
u AS (SELECT *, ({_STEM_SQL("title")})[1:25] AS ts, {_STEM_SQL("coalesce(p[-1], '')")} AS ls FROM t)
SELECT doc_id, title, len(h)::BIGINT AS n_headings, len(list_filter(range(1, len(k)), lambda i: k[i] = 'heading' AND k[i + 1] <> 'heading'))::BIGINT AS n_sections, len(p)::BIGINT AS n_paras, len(list_filter(k, lambda x: x = 'bullets'))::BIGINT AS n_bullets,
  len(list_filter(h, lambda x: regexp_matches(regexp_replace(x, '{_STRIP}', '', 'g'), '{CLOSER}'))) > 0 OR len(list_filter(range(greatest(1, len(k) - 1), len(k) + 1), lambda i: k[i] <> 'heading' AND regexp_matches(regexp_replace(c[i], '{_STRIP}', '', 'g'), '{CLOSER}'))) > 0 AS closer,
  len(p) > 0 AND list_has_any(list_filter({_GRAMS_SQL("ts")}, lambda x: len(list_filter(string_split(x, ' '), lambda w: w NOT IN ({", ".join(f"'{_q(w)}'" for w in STOPWORDS)}))) >= 2), {_GRAMS_SQL("ls")}) AS title_repeated
FROM u
"""
QUERIES = {
    "fence_ranges": lambda s, d: fences(probed(documents(s, d))),
    "masked_code": lambda s, d: probed(documents(s, d)).select("doc_id", masked_code(F.col("text")).alias("text")).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.regexp_count("text", F.lit("`")).cast("bigint").alias("n_ticks")),
    "without_markup": lambda s, d: stripped(probed(documents(s, d))).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")),
    "text_blocks": lambda s, d: block_rows(probed(documents(s, d))).select("doc_id", "block", "kind", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256")),
    "document_outline": lambda s, d: outline(probed(documents(s, d))),
}
ORACLE_SQL = {
    "fence_ranges": FENCES_SQL,
    "text_blocks": f"WITH {_BLOCKS_SQL} SELECT doc_id, block, kind, sha256(content) AS content_sha256 FROM blocks",
    "document_outline": OUTLINE_SQL,
}
