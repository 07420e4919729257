"""Weighted writing rules that measure: rhythm, uniformity, density, layout; and the score over all rules.

Every rule is a condition on counts and arrays of one document (its paragraphs,
sentences, tokens, lines), computed once per row over Arrow batches of texts; nothing
shuffles.  Runs of lines are found by writing one letter per line and matching the letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions import scan
from textloom.operators import writing_rules as wr
from textloom.operators.stylometry import documents

# Patterns and words of the rules.
HEADING = r"(?im)^(?:#{1,6}[ \t]+\S[^\n]*|<h[1-6][^>]*>[^\n]*)"
LABEL_DASH = r"(?m)^\s*(?:[-*+]|\d+[.)])\s+(?:\*\*[^*\n]+\*\*|\[[^\]\n]+\]\([^)\n]*\))(?:[ \t]*(?:\([^)\n]*\)|`[^`\n]+`))?[ \t]*—"
VERSION_DASH = r"(?m)^#{1,6}[ \t]+\[?v?\d+\.\d+\.\d+[^\]\n]*\]?[ \t]*—[ \t]*\d{4}-\d{2}-\d{2}"
DASHES = ("—", r"(?m)(?:^|\s)--(?:\s|$)", r"\S (?:-|–) ")
MISSING_MARK = r"(?i)\b(?:dont|wont|cant|isnt|wasnt|shouldnt|wouldnt|couldnt|youre|theyre|its\s+a\s+\w+ing)\b"
COPULA = r"(?i)\b(?:serves?|stands?|functions?|operates?)\s+as\s+(?:a|an|the)\b"
PASSIVE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:is|are|was|were|been|being|be)\s+(?:\w+ly\s+)?\w{3,}(?:ed|en|wn|lt)(?:[^\p{L}\p{N}_]|$)"
OPENER = r"(?i)^\s*(?:Additionally|Moreover|Furthermore|Subsequently|In\s+addition|What['’]s\s+more)\b"
VERB = r"(?i)\b(?:is|are|was|were|has|have|had|will|would|should|must|do|does|did|can|could|may|might|am|been|being)\b"
BOLD_LABEL = r"^\s*[-*+•]\s*\*\*[^*\n]{2,40}\*\*[:.]?\s"
TITLE_LINE = r"^(?:#{1,6}[ \t]+)?[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|and|or|of|the|in|for|to|a|an))+\s+[A-Z][a-z]+\s*$"
TITLE_WORD = r"\S\s+(?:\S+\s+)*(?:And|Or|Of|The|In|For|To|A|An)\b"
FENCE = r"(?m)^[ \t]*(?:```|~~~)[^\n]*\n(?:[^\n]*\n)*?[ \t]*(?:```|~~~)[^\n]*"
DIRECTIVE = "include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line"
ITEM = r"^\s*(?:[-*+•]|\d+[.)])\s+(\S[^\n]*)$"
BULLET = r"^\s*(?:\*|-|•|\+)\s+([^\n]+)$"
ISBN = r"\bISBN(?:-1[03])?:?\s*((?:97[89][- ]?)?(?:\d[- ]?){9,12}[\dXx])\b"
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is", "was", "are", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "this", "that", "these", "those", "it", "its",
    "they", "them", "their", "there", "here", "we", "our", "us", "i", "you", "your", "he", "she", "his", "her", "him", "not", "no", "so", "if", "then", "than",
    "when", "where", "which", "who", "what", "how", "why", "because",
)
#: Rules whose weights together count no more than the others' do, or STYLE_FLOOR.
STYLE = (
    "punct-distribution", "cross-para-burstiness", "fnword-trigram-entropy", "sentence-flatline", "uniformity", "uniform-sections", "uniform-list-items", "low-ttr",
    "smart-punct-signature", "em-dash-density", "setup-expansion-cadence", "passive-ratio", "low-specificity", "adjacent-lemma-repeat", "copula-avoidance",
    "tricolon-density", "staccato-fragments", "transition-stacking", "heading-inflation",
)
STYLE_FLOOR = 12


def _stat(a: Column) -> Column:
    """struct<n, mean, sd, cv, low, high> of an array of doubles in one pass; sd is that of the population."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    step = lambda z, x: F.struct((z["n"] + 1).alias("n"), (z["s"] + x).alias("s"), (z["q"] + x * x).alias("q"), F.least(z["low"], x).alias("low"), F.greatest(z["high"], x).alias("high"))

    def finish(z: Column) -> Column:
        mean = F.try_divide(z["s"], z["n"])
        sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(z["q"], z["n"]) - mean * mean))
        return F.struct(z["n"].alias("n"), mean.alias("mean"), sd.alias("sd"), F.when(mean > 0, sd / mean).otherwise(0.0).alias("cv"), z["low"].alias("low"), z["high"].alias("high"))

    return F.aggregate(a, zero, step, finish)


def _numbers(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _pairs(a: Column, test) -> Column:
    """Neighbours that pass ``test``."""
    places = F.when(F.size(a) >= 2, F.sequence(F.lit(0), F.size(a) - 2)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: test(F.get(a, i), F.get(a, i + 1))))


def _sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(sentences of more than five characters, the place of each one's text)."""
    parts, owner = scan.pieces(texts, "[.!?]+")
    kept = np.asarray(pc.greater(pc.utf8_length(pc.utf8_trim(parts, characters=scan.SPACES)), 5), bool)
    return parts.filter(pa.array(kept)), owner[kept]


def _doubles(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    return scan.lists(pa.array(values.astype(np.float64)), owner, n)


def _per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Rows, or the sum of their whole weights, of each owner."""
    return np.bincount(owner, weights, n).astype(np.int64)


def _three(holds: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Owners with three neighbouring rows that hold."""
    out = np.zeros(n, bool)
    at = np.flatnonzero(holds[2:] & holds[1:-1] & holds[:-2] & (owner[2:] == owner[:-2]))
    out[owner[at]] = True
    return out


def _entropy(tok: pa.Array, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total, kinds, entropy) of trigrams of function words, other words as one blank between them."""
    kind = np.asarray(pc.fill_null(pc.index_in(tok, pa.array(FUNCTION_WORDS)), len(FUNCTION_WORDS)), np.int64)
    other = kind == len(FUNCTION_WORDS)
    # a blank after a blank goes; a text's first word stays only if it is a function word
    first = np.ones(len(kind), bool)
    first[1:] = owner[1:] != owner[:-1]
    after = first.copy()
    after[1:] |= other[:-1]
    kept = ~(other & after)
    kind, owner, k = kind[kept], owner[kept], len(FUNCTION_WORDS) + 1
    grams = ((owner[:-2] * k + kind[:-2]) * k + kind[1:-1]) * k + kind[2:]
    grams, c = np.unique(grams[owner[2:] == owner[:-2]], return_counts=True)
    mine = grams // k**3
    total, kinds = _per(mine, n, c), _per(mine, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return total, kinds, np.log2(total) - np.bincount(mine, c * np.log2(c), n) / total


def _repeats(sents: pa.Array, owner: np.ndarray, n: int) -> np.ndarray:
    """Neighbouring sentences that share a word of six plain letters or more; of texts of ten sentences or more."""
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(_per(owner, n)[owner] >= 10)
    last, before = -1, set()
    for i, sentence in zip(owner[at].tolist(), pc.utf8_lower(sents.take(pa.array(at))).to_pylist()):
        words = {x for x in _LONG_WORD.findall(sentence) if x.isascii() and x.isalpha()}
        out[i] += i == last and not words.isdisjoint(before)
        last, before = i, words
    return out


def _codes(letters: np.ndarray, owner: np.ndarray, n: int, letter: str, least: int) -> pa.Array:
    """The letters of each owner as one string; empty for those with fewer than ``least`` of one letter."""
    out = [""] * n
    cut = np.searchsorted(owner, np.arange(n + 1))
    for i in np.flatnonzero(_per(owner[letters == letter], n) >= least).tolist():
        out[i] = "".join(letters[cut[i] : cut[i + 1]].tolist())
    return pa.array(out, pa.string())


def _extracted(texts: pa.Array, pattern: str) -> pa.Array:
    """Group 1 of texts that match from end to end."""
    return pc.replace_substring_regex(texts, pattern, r"\1")


_LONG_WORD = re.compile(r"\w{6,}")
COUNTS = {
    "heads": HEADING, "alts": COPULA, "copulas": r"(?i)\b(?:is|are)\b", "curly": "[“”]", "straight": '"', "em_dashes": "—", "gaps": r"[^.!?]  +",
    "numbers": r"(?:^|[^\w.])[£$€]?\d[\d,.]*%?", "names": r"[a-z,;]\s[A-Z][a-z]{2,}",
    "bold": r"\*\*[^*\n]{1,120}\*\*", "md_heads": r"(?m)^#{1,6}[ \t]+\S", "bullets": r"(?m)^[^\S\n]*[-*•]\s+",
}
TESTS = {"curled": "[“”‘’]", "tricolon": r"\b\w+,\s+\w+,\s+and\s+\w+", "marks_missing": MISSING_MARK}
_FLOATS = ("slens", "per_para", "density", "rhythms", "sections")
_WHOLE = ("w", "n_tok", "distinct", "n_paras", "n_sents", *COUNTS, "labels", "dashes", "openers", "shorts", "passive", "repeats", "gram_total", "gram_kinds", "tags", "width", "swaps", "stage")
_FLAGS = (*TESTS, "openers_in_row", "cut_off")
_CODES = ("bold_code", "item_code", "noun_code")
_SEEN = "array<struct<matched:string,start:int>>"
BASES = ",".join([*[f"{x}:bigint" for x in _WHOLE], *[f"{x}:boolean" for x in _FLAGS], "entropy:double", *[f"{x}:array<double>" for x in _FLOATS], *[f"{x}:string" for x in _CODES], "tier2:array<array<string>>", "tier3:array<bigint>", "phrases:array<struct<matched:string,n:bigint>>", "titles:array<string>", "isbns:array<string>", f"focal:{_SEEN}"])


def _bases(texts: pa.Array) -> pa.StructArray:
    """What the rules look at, of raw texts without nulls."""
    t, n = wr._normal(texts), len(texts)
    w = scan.words(t)
    out: dict = {"w": w} | {k: scan.count(t, p) for k, p in COUNTS.items()} | {k: scan.matches(t, p) for k, p in TESTS.items()}
    out["labels"] = scan.count(t, LABEL_DASH) + scan.count(t, VERSION_DASH)
    out["dashes"] = sum(scan.count(t, p) for p in DASHES) - out["labels"]
    out["width"], out["swaps"] = scan.count(texts, f"[{wr.ZERO_WIDTH}]"), scan.count(texts, f"[{wr.LOOKALIKES[0]}]")
    latin = {ord(a): b for a, b in zip(*wr.LOOKALIKES, strict=True)}
    swapped = out["swaps"] > 0
    stage = pc.replace_with_mask(texts, pa.array(swapped), pa.array([x.translate(latin) for x in texts.filter(pa.array(swapped)).to_pylist()], pa.string())) if swapped.any() else texts
    out["stage"] = scan.count(stage, rf"(?i)(?:^|[^*])\*(?:{wr.STAGE_VERBS})\b[^*\n]{{0,73}}\*")

    # words: all others are runs of what is no part of a word
    tok, owner = scan.pieces(pc.utf8_lower(t), r"[^\w'-]+")
    some = np.asarray(pc.not_equal(tok, ""), bool)
    tok, owner = tok.filter(pa.array(some)), owner[some]
    named = tok.dictionary_encode()
    kinds = len(named.dictionary)
    code = np.asarray(named.indices, np.int64)
    out["n_tok"], out["distinct"] = _per(owner, n), _per(np.unique(owner * kinds + code) // max(kinds, 1), n)
    out["gram_total"], out["gram_kinds"], out["entropy"] = _entropy(tok, owner, n)
    tier3 = np.zeros((n, len(wr.TIER3)), np.int64)
    for j, x in enumerate(wr.TIER3):
        mine = np.asarray(pc.is_in(named.dictionary, pa.array([x, x.replace("-", "")])), bool)
        if mine.any():
            tier3[:, j] = _per(owner[mine[code]], n)
    out["tier3"] = pa.FixedSizeListArray.from_arrays(pa.array(tier3.ravel()), len(wr.TIER3)).cast(pa.list_(pa.int64()))

    sents, of = _sentences(t)
    lens = scan.words(sents)
    out["n_sents"], out["slens"] = _per(of, n), _doubles(lens, of, n)
    out["passive"] = _per(of[scan.matches(sents, PASSIVE)], n)
    out["repeats"] = _repeats(sents, of, n)

    paras, of = scan.pieces(t, r"\n\s*\n")
    some = scan.matches(paras, r"\S")
    paras, of = paras.filter(pa.array(some)), of[some]
    m, size = len(paras), scan.words(paras)
    out["n_paras"] = _per(of, n)
    own, inside = _sentences(paras)
    in_para = _per(inside, m)
    out["per_para"] = _doubles(in_para, of, n)
    some = size >= 5
    out["density"] = _doubles(scan.count(paras, "[,;:—()]")[some] / size[some], of[some], n)
    lens = scan.words(own).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(inside, lens, m) / in_para
        sd = np.sqrt(np.maximum(0.0, np.bincount(inside, lens * lens, m) / in_para - mean * mean))
        cv = np.where(mean > 0, sd / mean, 0.0)
    some = in_para >= 3
    out["rhythms"] = _doubles(cv[some], of[some], n)
    opens = scan.matches(paras, OPENER)
    out["openers"], out["openers_in_row"] = _per(of[opens], n), _three(opens, of, n)
    parts, inside = scan.pieces(pc.replace_substring_regex(paras, r"([.!?])\s+", "\\1\x01"), "\x01", literal=True)
    size4 = scan.words(parts)
    out["shorts"] = _per(of[_three((size4 >= 1) & (size4 <= 4) & scan.matches(parts, r"[.!?]\s*$"), inside, m)], n)
    found2: list[list[str]] = [[] for _ in range(m)]
    for x, i in zip(*(scan.found(paras, "(?i)" + wr._any(wr.TIER2))[k] for k in (0, 2))):
        found2[i].append(x.lower())
    clusters: list[list[list[str]]] = [[] for _ in range(n)]
    deeply = scan.matches(paras, "(?i)" + wr.TIER2_DEEPLY)
    for i in np.flatnonzero(deeply | np.array([len(x) > 0 for x in found2], bool)).tolist():
        held = [*dict.fromkeys(found2[i]), *(["deeply"] if deeply[i] else [])]
        if len(held) >= 2:
            clusters[of[i]].append(held)
    out["tier2"] = pa.array(clusters, pa.list_(pa.list_(pa.string())))

    # sections: behind each heading if there are two, else the paragraphs
    headed = np.flatnonzero(out["heads"] >= 2)
    parts, inside = scan.pieces(t.take(pa.array(headed)), HEADING)
    later = np.ones(len(inside), bool)
    later[0:1] = False
    later[1:] = inside[1:] == inside[:-1]
    by_para = ~(out["heads"] >= 2)[of]
    sizes = np.concatenate((scan.words(parts)[later], size[by_para]))
    whose = np.concatenate((headed[inside[later]], of[by_para]))
    order = np.argsort(whose, kind="stable")
    order = order[sizes[order] >= 20]
    out["sections"] = _doubles(sizes[order], whose[order], n)

    trimmed = pc.utf8_rtrim(t, characters=scan.SPACES)
    last = pc.replace_substring_regex(trimmed, r"(?s)^.*\n", "")
    out["cut_off"] = scan.matches(trimmed, "[a-z,;]$") & ~scan.matches(last, r"^\s*(?:#{1,6}[ \t]|[-*+•]\s|\d+[.)]\s|\||```|~~~)") & (scan.words(last) >= 5)

    lines, of = scan.pieces(t, r"\r?\n")
    blank, size = ~scan.matches(lines, r"\S"), scan.words(lines)
    out["bold_code"] = _codes(np.where(scan.matches(lines, BOLD_LABEL), "b", np.where(blank, "_", "x")), of, n, "b", 3)
    items = np.flatnonzero(scan.matches(lines, ITEM))
    held = np.where(blank, "", "|").astype(object)
    held[items] = [f"{k}," for k in scan.words(_extracted(lines.take(pa.array(items)), ITEM)).tolist()]
    cut = np.searchsorted(of, np.arange(n + 1))
    codes = [""] * n
    for i in np.flatnonzero(_per(of[items], n) >= 4).tolist():
        codes[i] = "".join(held[cut[i] : cut[i + 1]].tolist())
    out["item_code"] = pa.array(codes, pa.string())

    fenced = scan.matches(t, FENCE)
    plain = pc.replace_substring_regex(t, FENCE, "x") if fenced.any() else t
    lines, of = scan.pieces(plain, r"\r?\n")
    listed = scan.matches(lines, BULLET)
    letters = np.where(listed, "B", np.where(scan.matches(lines, r"\S"), "x", "_"))
    at = np.flatnonzero(listed)
    inner = _extracted(lines.take(pa.array(at)), BULLET)
    size = scan.words(inner)
    letters[at[(size <= 6) & (size > 0) & ~scan.matches(inner, VERB)]] = "n"
    out["noun_code"] = _codes(letters, of, n, "n", 5)
    lines, of = scan.pieces(plain, "\n", literal=True)
    at = np.flatnonzero(scan.matches(lines, TITLE_LINE))
    titled = lines.take(pa.array(at))
    bare = pc.replace_substring_regex(titled, r"^#{1,6}[ \t]+", "")
    kept = (scan.words(bare) >= 4) & scan.matches(bare, TITLE_WORD)
    out["titles"] = scan.lists(titled.filter(pa.array(kept)), of[at[kept]], n)
    tags, _, of = scan.found(pc.replace_substring_regex(plain, r"`[^`\n]+`", " "), r"(?:^|\W)#(\w[\w-]*)", group=True)
    tags = pa.array(tags, pa.string())
    no_tag = scan.matches(tags, r"^\d+$") | (scan.matches(tags, "(?i)^(?:[0-9a-f]{6}|[0-9a-f]{8})$") & scan.matches(tags, r"\d")) | scan.matches(tags, f"^(?:{DIRECTIVE})$")
    out["tags"] = _per(np.array(of, np.int64)[~no_tag], n)

    found, _, of = scan.found(t, ISBN)
    out["isbns"] = scan.lists(pa.array(found, pa.string()), np.array(of, np.int64), n)
    found, starts, of = scan.found(t, "(?i)" + wr.FOCAL)
    out["focal"] = scan.lists(pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.int32())], ["matched", "start"]), np.array(of, np.int64), n)
    phrases: list[list[dict]] = [[] for _ in range(n)]
    for j, p in enumerate(wr.TIER3_PHRASES):
        seen: dict[int, list] = {}
        for x, i in zip(*(scan.found(t, "(?i)" + p)[k] for k in (0, 2))):
            seen.setdefault(i, [x, 0])[1] += 1
        # the earlier phrase has that
        less = scan.count(t, r"(?i)\bdesigned\s+for\s+long-?term\s+sustainability\b") if seen and j == len(wr.TIER3_PHRASES) - 1 else np.zeros(n, np.int64)
        for i, (x, k) in seen.items():
            phrases[i].append({"matched": x, "n": k - int(less[i])})
    out["phrases"] = pa.array(phrases, pa.list_(pa.struct([("matched", pa.string()), ("n", pa.int64())])))
    names = [x.split(":")[0] for x in (*_WHOLE, *_FLAGS, "entropy", *_FLOATS, *_CODES, "tier2", "tier3", "phrases", "titles", "isbns", "focal")]
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)], names)


def _looked_at(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_bases(part) for part in scan.slices(pc.fill_null(texts, ""))])


def bases(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of MIN_WORDS words or more, the columns to keep beside them, with the counts, lengths and letter codes that the rules look at, each computed once."""
    # as if it were not deterministic, so that the filter on its words does not run it a second time
    looked = F.arrow_udf(_looked_at, f"struct<{BASES}>").asNondeterministic()
    seen = docs.where("text is not null").select("doc_id", *keep, looked("text").alias("b")).select("doc_id", *keep, "b.*").where(F.col("w") >= wr.MIN_WORDS)
    stats = {"st_sent": "slens", "st_para": "per_para", "st_density": "density", "st_rhythm": "rhythms", "st_section": "sections"}
    return seen.select("*", *[_stat(F.col(a)).alias(name) for name, a in stats.items()])


@dataclass(frozen=True)
class Measure:
    name: str
    weight: int
    severity: str | Column
    holds: Column
    n: Column
    matched: Column | None = None  # null: the finding is the document's


def _isbn_fails(found: Column) -> Column:
    d = F.regexp_replace(found, "[- ]", "")
    digit = lambda i: F.when(F.upper(F.substring(d, i, 1)) == "X", 10).otherwise(F.substring(d, i, 1).try_cast("int"))
    ten = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0)) % 11 != 0
    thirteen = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0)) % 10 != 0
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 13, thirteen).otherwise(False)


def measures() -> list[Measure]:
    col = F.col
    w, sent, para, section, density, rhythm = (col(c) for c in ("w", "st_sent", "st_para", "st_section", "st_density", "st_rhythm"))
    n_sents, n_paras, dashes, distinct, alts, copulas, heads, tags, shorts = (col(c) for c in ("n_sents", "n_paras", "dashes", "distinct", "alts", "copulas", "heads", "tags", "shorts"))
    curly, straight, passive, repeats, bold, md_heads, bullets, width, swaps = (col(c) for c in ("curly", "straight", "passive", "repeats", "bold", "md_heads", "bullets", "width", "swaps"))
    cadence = _pairs(col("slens"), lambda a, b: ((a > 0) & (a <= 6) & (b >= 3 * a) & (b >= 12)) | ((b > 0) & (b <= 6) & (a >= 3 * b) & (a >= 12)))
    specific, openers = col("numbers") + col("names"), col("openers")
    clean = (col("gaps") == 0) & ~col("marks_missing")
    return [
        Measure("em-dash-density", 4, "medium", (dashes >= 3) & (dashes * 1000.0 > w * 6), dashes),
        Measure("uniform-sections", 5, F.when((section["n"] >= 8) & (section["cv"] < 0.1), "high").otherwise("medium"), (section["n"] >= 4) & (section["cv"] < 0.15), section["n"]),
        Measure("sentence-flatline", 5, "medium", (n_sents >= 5) & (sent["cv"] < 0.25) & (sent["mean"] > 10), n_sents),
        Measure("uniformity", 5, "medium", (n_paras >= 4) & (para["mean"] >= 3) & (para["high"] - para["mean"] <= 1) & (para["mean"] - para["low"] <= 1), n_paras),
        Measure("smart-punct-signature", 6, "high", (w >= 80) & col("curled") & (col("em_dashes") > col("labels")) & col("tricolon") & clean, F.lit(1)),
        Measure("punct-distribution", 6, "medium", (n_paras >= 4) & (density["n"] >= 4) & (density["cv"] < 0.25) & (density["mean"] >= 0.04), density["n"]),
        Measure("fnword-trigram-entropy", 5, "medium", (w >= 150) & (col("gram_total") >= 50) & ((col("gram_kinds") == 1) | (F.try_divide(col("entropy"), F.log2(col("gram_kinds"))) < 0.82)), col("gram_total")),
        Measure("cross-para-burstiness", 5, "medium", (n_paras >= 4) & (rhythm["n"] >= 4) & (rhythm["sd"] < 0.08) & (rhythm["mean"] < 0.45), rhythm["n"]),
        Measure("normalization-flag", 9, "high", (width > 0) | (swaps >= 2), width + swaps),
        Measure("low-ttr", 3, "low", (col("n_tok") >= 200) & (distinct < col("n_tok") * 0.4), distinct),
        Measure("hashtag-stuff", 12, "medium", tags >= 6, tags),
        Measure("copula-avoidance", 3, "low", (alts >= 3) & (alts > (alts + copulas) * 0.25), alts),
        Measure("heading-inflation", 3, "low", (heads >= 4) & (w >= 60) & (heads * 300.0 / w > 3), heads),
        Measure("staccato-fragments", 3, "low", shorts >= 1, shorts),
        Measure("transition-stacking", 3, "low", (n_paras >= 3) & (((n_paras >= 4) & (openers * 2 > n_paras)) | col("openers_in_row")), openers),
        Measure("quote-inconsistency", 2, "low", (curly >= 2) & (straight >= 2), curly + straight),
        Measure("token-cutoff", 2, "low", (w >= 100) & col("cut_off"), F.lit(1)),
        Measure("setup-expansion-cadence", 3, "low", (n_sents >= 8) & (cadence >= 3) & (cadence >= (n_sents - 1) * 0.2), cadence),
        Measure("passive-ratio", 3, "low", (n_sents >= 10) & (passive > n_sents * 0.4), passive),
        Measure("low-specificity", 2, "low", (w >= 300) & (specific * 1000.0 < w * 2), specific),
        Measure("adjacent-lemma-repeat", 3, "low", (n_sents >= 10) & (repeats >= (n_sents - 1) * 0.45), repeats),
        Measure("markdown-furniture", 4, "low", (bold > 0) | (md_heads > 0) | (bullets * 1000.0 > w * 10.75), bold + md_heads + bullets),
    ]


def _listed() -> list[Column]:
    """Arrays of (name, weight, severity, matched, n): rules that can find several things in one document."""
    out = lambda name, weight, severity: lambda matched, n: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"), matched.alias("matched"), n.cast("bigint").alias("n"))
    low = lambda a: F.array_distinct(F.transform(a, F.lower))
    in_clusters = F.transform(F.array_distinct(F.flatten("tier2")), lambda x: out("tier2", 3, "medium")(x, F.size(F.filter("tier2", lambda p: F.array_contains(p, x)))))
    often = F.filter(F.transform("tier3", lambda n, i: out("tier3", 2, "low")(F.get(F.array(*map(F.lit, wr.TIER3)), i), n)), lambda s: s["n"] >= F.greatest(F.lit(3), F.floor(F.col("w") * 0.03)))
    phrases = F.transform("phrases", lambda x: out("tier3-phrase", 3, "medium")(F.lower(x["matched"]), x["n"]))
    kinds = F.size(F.filter(phrases, lambda s: s["n"] >= 1))
    cluster = F.filter(F.array(out("tier3-phrase-cluster", 12, "high")(F.lit(None).cast("string"), kinds)), lambda s: s["n"] >= 3)
    bold_runs = F.filter(F.transform(F.regexp_extract_all("bold_code", F.lit("b(?:_*b)*"), F.lit(0)), lambda r: F.length(F.replace(r, F.lit("_"), F.lit("")))), lambda n: n >= 3)
    runs = F.transform(F.filter(F.split("item_code", r"\|"), lambda r: r != ""), lambda r: _stat(F.transform(F.split(F.substring(r, F.lit(1), F.length(r) - 1), ","), lambda n: n.cast("double"))))
    even = F.transform(F.filter(runs, lambda r: (r["n"] >= 4) & (r["mean"] >= 3) & (r["cv"] < 0.15)), lambda r: r["n"].cast("int"))
    bare = lambda r: F.regexp_count(r, F.lit("n"))
    nouns = F.filter(F.transform(F.regexp_extract_all("noun_code", F.lit("[nB](?:_?[nB])*"), F.lit(0)), lambda r: F.replace(r, F.lit("_"), F.lit(""))), lambda r: (bare(r) >= 5) & (bare(r) >= F.length(r) * 0.75))
    spots = lambda k: F.array_sort(F.transform(F.filter("focal", lambda h: F.lower(h["matched"]) == k), lambda h: h["start"]))
    close = F.filter(low(F.transform("focal", lambda h: h["matched"])), lambda k: F.exists(F.transform(F.array(spots(k)), lambda a: _pairs(a, lambda x, y: y - x <= 300)), lambda n: n >= 1))
    by_size = lambda name, weight, severity, sizes: F.transform(F.array_distinct(sizes), lambda n: out(name, weight, severity)(F.lit(None).cast("string"), n))
    same = lambda column: lambda x: F.size(F.filter(column, lambda y: F.lower(y) == x))
    return [
        in_clusters,
        often,
        F.filter(phrases, lambda s: s["n"] >= 2),
        cluster,
        by_size("bold-label-bullets", 3, "low", bold_runs),
        by_size("uniform-list-items", 4, "medium", even),
        by_size("bullet-np-list", 10, "high", F.transform(nouns, F.length)),
        F.transform(low("titles"), lambda x: out("title-case-header", 4, "medium")(x, same("titles")(x))),
        F.transform(low(F.filter("isbns", lambda m: _isbn_fails(F.regexp_extract(m, ISBN, 1)))), lambda x: out("invalid-isbn", 3, "low")(x, same("isbns")(x))),
        F.transform(close, lambda k: out("proximity-cluster", 2, "low")(k, F.size(spots(k)))),
        F.filter(F.array(out("normalization-flag", 9, "high")(F.lit("stage directions"), F.col("stage"))), lambda s: s["n"] >= 2),
    ]


ROW = "array<struct<rule:string,severity:string,weight:int,matched:string,n:bigint>>"


def _measured(docs: DataFrame, keep: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Rows (doc_id, w, columns to keep, columns of the bases, f0, f1, ...), and the names of those last ones: arrays of findings."""
    base = bases(docs, keep)
    single = lambda m: F.struct(F.lit(m.name).alias("rule"), (m.severity if isinstance(m.severity, Column) else F.lit(m.severity)).alias("severity"), F.lit(m.weight).alias("weight"), F.lit(None).cast("string").alias("matched"), m.n.cast("bigint").alias("n"))
    columns = [F.when(m.holds, F.array(single(m))).otherwise(F.array()).cast(ROW) for m in measures()] + [c.cast(ROW) for c in _listed()]
    names = [f"f{i}" for i in range(len(columns))]
    return base.select("doc_id", "w", *keep, *also, *[c.alias(name) for c, name in zip(columns, names)]), names


def measured_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, severity, weight, matched, n); matched is null for findings about a whole document."""
    wide, names = _measured(docs)
    return wide.select("doc_id", F.explode(F.concat(*names)).alias("f")).select("doc_id", "f.*")


def all_findings(docs: DataFrame) -> DataFrame:
    return wr.wording_findings(docs).select("doc_id", "rule", "severity", "weight", "matched", "n").unionByName(measured_findings(docs))


def findings_of_rows(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, w, f, columns of the bases): all findings of a row of MIN_WORDS words or more as one array of (rule, weight, matched)."""
    worded = docs.where("text is not null").select("doc_id", "text", wr.judged(F.col("text")).alias("worded"))
    wide, names = _measured(worded, ("worded",), also)
    slim = lambda a: F.transform(a, lambda f: F.struct(f["rule"].alias("rule"), f["weight"].alias("weight"), f["matched"].alias("matched")))
    return wide.select("doc_id", "w", *also, F.concat(slim(F.coalesce(F.col("worded"), F.array().cast(wr.JUDGED))), *[slim(F.col(x)) for x in names]).alias("f"))


def score_of(raw: Column, words: Column) -> Column:
    """The summed weights on the scale to 100: longer texts need more."""
    return F.least(F.lit(100), F.round(raw / F.greatest(F.lit(1.0), F.log2(words / 50.0)))).cast("bigint")


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_findings, n_rules, rules, raw, score): weights summed, style rules capped, scaled by length.

    One row for every row of MIN_WORDS words or more, 0 where there is no finding;
    all is read off the row's own text, so rows that repeat a doc_id, or have none,
    stay apart and nothing shuffles.
    """
    found = findings_of_rows(docs)
    weights = lambda kept: F.aggregate(F.filter("f", kept), F.lit(0).cast("bigint"), lambda n, f: n + f["weight"])
    rules = F.array_sort(F.array_distinct(F.transform("f", lambda f: f["rule"])))
    summed = found.select("doc_id", "w", F.size("f").cast("bigint").alias("n_findings"), rules.alias("r"), weights(lambda f: f["rule"].isin(*STYLE)).alias("style"), weights(lambda f: ~f["rule"].isin(*STYLE)).alias("other"))
    raw = F.col("other") + F.least("style", F.greatest("other", F.lit(STYLE_FLOOR)))
    score = score_of(raw, F.col("w"))
    return summed.select("doc_id", "n_findings", F.size("r").alias("n_rules"), F.array_join("r", ",").alias("rules"), raw.alias("raw"), score.alias("score"))


def liveness(findings: DataFrame) -> DataFrame:
    """(rule, n_docs, n_findings) of every rule that fired."""
    return findings.groupBy("rule").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_findings"))


# --- the same in SQL ----------------------------------------------------------------


def _c(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{wr._q(pattern)}'))"


def _w(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def _s(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[.!?]+'), lambda s_: length(regexp_replace(s_, '^\s+|\s+$', '', 'g')) > 5)"


def _avg(x: str) -> str:
    return f"list_avg({x})"


def _sd(x: str) -> str:
    return f"list_stddev_pop({x})"


def _v(x: str) -> str:
    return f"(CASE WHEN list_avg({x}) > 0 THEN list_stddev_pop({x}) / list_avg({x}) ELSE 0 END)"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{wr._q(pattern)}')"


def _measured_sql(source: str, then: str = "") -> str:
    """The findings; or, if given, what ``then`` selects from them (measured) and from the bases (k)."""
    q = wr._q
    dashes = " + ".join(_c("t", p) for p in DASHES) + " - labels"
    inside = ", ".join(f"'{x}'" for x in FUNCTION_WORDS)
    codes = lambda lines, case: f"array_to_string(list_transform({lines}, lambda x: CASE {case} END), '')"
    item, bullet = ITEM, BULLET
    blank = r"NOT regexp_matches(x, '\S')"
    got = f"regexp_extract(x, '{q(bullet)}', 1)"
    digit = lambda i: f"(CASE WHEN upper(d[{i}]) = 'X' THEN 10 ELSE TRY_CAST(d[{i}] AS INT) END)"
    ten = " + ".join(f"{digit(i)} * {11 - i}" for i in range(1, 11))
    thirteen = " + ".join(f"{digit(i)} * {1 if i % 2 else 3}" for i in range(1, 14))
    one = lambda name, weight, severity, holds, n: f"SELECT doc_id, '{name}' AS rule, {severity} AS severity, {weight} AS weight, NULL::VARCHAR AS matched, ({n})::BIGINT AS n FROM m WHERE {holds}"
    ctes = rf"""
t0 AS MATERIALIZED (SELECT doc_id, text AS raw, {wr.normalised_sql('text')} AS t FROM ({source}) WHERE text IS NOT NULL),
b0 AS (SELECT *, {_w('t')} AS w, list_transform(regexp_extract_all(t, '[\w''-]+'), lambda x: lower(x)) AS tok, list_filter(string_split_regex(t, '\n\s*\n'), lambda p: regexp_matches(p, '\S')) AS paras, {_s('t')} AS sents,
  string_split_regex(t, '\r?\n') AS lines, regexp_replace(t, '{q(FENCE)}', 'x', 'g') AS plain FROM t0),
b AS MATERIALIZED (SELECT *, list_transform(sents, lambda s: {_w('s')}::DOUBLE) AS slens FROM b0 WHERE w >= {wr.MIN_WORDS}),
g AS (SELECT doc_id, list_filter(kinds, lambda x, i: x <> '_' OR (i > 1 AND kinds[i - 1] <> '_')) AS seq FROM (SELECT doc_id, list_transform(tok, lambda x: CASE WHEN x IN ({inside}) THEN x ELSE '_' END) AS kinds FROM b)),
g1 AS (SELECT doc_id, unnest(list_transform(range(1, len(seq) - 1), lambda i: seq[i] || '|' || seq[i + 1] || '|' || seq[i + 2])) AS gram FROM g WHERE len(seq) >= 3),
g2 AS (SELECT doc_id, gram, count(*) AS c FROM g1 GROUP BY ALL),
g3 AS (SELECT doc_id, sum(c) AS total, count(*) AS kinds, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM g2 GROUP BY 1),
m0 AS (SELECT b.*, total, kinds, entropy, {_c('t', LABEL_DASH)} + {_c('t', VERSION_DASH)} AS labels, {_c('t', HEADING)} AS heads,
  list_transform(paras, lambda p: len({_s('p')})::DOUBLE) AS per_para,
  list_transform(list_filter(paras, lambda p: {_w('p')} >= 5), lambda p: {_c('p', '[,;:—()]')}::DOUBLE / {_w('p')}) AS density,
  list_transform(list_transform(list_filter(paras, lambda p: len({_s('p')}) >= 3), lambda p: list_transform({_s('p')}, lambda z: {_w('z')}::DOUBLE)), lambda l: {_v('l')}) AS rhythms,
  {_c('t', COPULA)} AS alts, {_c('t', r'(?i)\b(?:is|are)\b')} AS copulas, len(list_filter(paras, lambda p: {_m('p', OPENER)})) AS openers, {codes('paras', f"WHEN {_m('x', OPENER)} THEN 'o' ELSE 'x'")} AS opener_code,
  len(list_filter(paras, lambda p: contains(array_to_string(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: CASE WHEN {_w('z')} BETWEEN 1 AND 4 AND regexp_matches(z, '[.!?]\s*$') THEN 's' ELSE 'x' END), ''), 'sss'))) AS shorts,
  {_c('t', '[“”]')} AS curly, {_c('t', '"')} AS straight, regexp_replace(t, '\s+$', '') AS trimmed,
  len(list_filter(range(1, len(slens)), lambda i: (slens[i] > 0 AND slens[i] <= 6 AND slens[i + 1] >= 3 * slens[i] AND slens[i + 1] >= 12) OR (slens[i + 1] > 0 AND slens[i + 1] <= 6 AND slens[i] >= 3 * slens[i + 1] AND slens[i] >= 12))) AS cadence,
  len(list_filter(sents, lambda s: {_m('s', PASSIVE)})) AS passive,
  {_c('t', r'(?:^|[^\w.])[£$€]?\d[\d,.]*%?')} + {_c('t', r'[a-z,;]\s[A-Z][a-z]{2,}')} AS specific,
  list_transform(sents, lambda s: list_distinct(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]+'), lambda k: regexp_matches(k, '^[a-z]{{6,}}$')))) AS content,
  {_c('t', r'\*\*[^*\n]{1,120}\*\*')} AS bold, {_c('t', r'(?m)^#{1,6}[ \t]+\S')} AS md, {_c('t', r'(?m)^[^\S\n]*[-*•]\s+')} AS bullets, {_c('raw', f'[{wr.ZERO_WIDTH}]')} AS width, {_c('raw', f'[{wr.LOOKALIKES[0]}]')} AS swaps,
  list_filter(regexp_extract_all(regexp_replace(plain, '`[^`\n]+`', ' ', 'g'), '(?:^|\W)#(\w[\w-]*)', 1), lambda x: NOT (regexp_matches(x, '^\d+$') OR (regexp_matches(x, '(?i)^(?:[0-9a-f]{{6}}|[0-9a-f]{{8}})$') AND regexp_matches(x, '\d')) OR regexp_matches(x, '^(?:{DIRECTIVE})$'))) AS tags
  FROM b LEFT JOIN g3 USING (doc_id)),
m AS MATERIALIZED (SELECT *, {dashes} AS dashes, list_filter(list_transform(CASE WHEN heads >= 2 THEN (string_split_regex(t, '{q(HEADING)}'))[2:] ELSE paras END, lambda p: {_w('p')}::DOUBLE), lambda x: x >= 20) AS sections,
  regexp_extract(trimmed, '[^\n]*$') AS last, len(list_filter(range(1, len(content)), lambda i: list_has_any(content[i], content[i + 1]))) AS repeats FROM m0),
k AS MATERIALIZED (SELECT doc_id, t, w, tok, raw, list_filter(list_transform(paras, lambda p: list_concat(list_distinct(list_transform(regexp_extract_all(p, '(?i){wr._any(wr.TIER2)}'), lambda x: lower(x))), CASE WHEN {_m('p', '(?i)' + wr.TIER2_DEEPLY)} THEN ['deeply'] ELSE [] END)), lambda f: len(f) >= 2) AS tier2,
  {codes('lines', f"WHEN {_m('x', BOLD_LABEL)} THEN 'b' WHEN {blank} THEN '_' ELSE 'x'")} AS bold_code,
  string_split({codes('lines', f"WHEN {_m('x', item)} THEN {_w(f'''regexp_extract(x, '{q(item)}', 1)''')} || ',' WHEN {blank} THEN '' ELSE '|'")}, '|') AS sizes,
  {codes("string_split_regex(plain, '" + chr(92) + "r?" + chr(92) + "n')", f"WHEN {_m('x', bullet)} THEN CASE WHEN {_w(got)} <= 6 AND {_w(got)} > 0 AND NOT {_m(got, VERB)} THEN 'n' ELSE 'B' END WHEN {blank} THEN '_' ELSE 'x'")} AS noun_code,
  list_filter(string_split(plain, chr(10)), lambda x: {_m('x', TITLE_LINE)} AND {_w("regexp_replace(x, '^#{1,6}[ " + chr(92) + "t]+', '')")} >= 4 AND {_m("regexp_replace(x, '^#{1,6}[ " + chr(92) + "t]+', '')", TITLE_WORD)}) AS titles,
  regexp_extract_all(t, '{q(ISBN)}') AS isbns, {_c(f"translate(raw, '{wr.LOOKALIKES[0]}', '{wr.LOOKALIKES[1]}')", rf'(?i)(?:^|[^*])\*(?:{wr.STAGE_VERBS})\b[^*\n]{{0,73}}\*')} AS stage FROM b),
i AS (SELECT doc_id, lower(x) AS matched, string_split(regexp_replace(regexp_extract(x, '{q(ISBN)}', 1), '[- ]', '', 'g'), '') AS d FROM (SELECT doc_id, unnest(isbns) AS x FROM k)),
norm AS (SELECT doc_id, t, w FROM b),
f AS (SELECT doc_id, lower(part[j]) AS k, (list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(part[1:j - 1], lambda x: length(x))), 0))::INT AS spot FROM (SELECT doc_id, regexp_extract_all(t, '(?i){wr.FOCAL}') AS part, string_split_regex(t, '(?i){wr.FOCAL}') AS between, unnest(range(1, len(part) + 1)) AS j FROM norm)),
f1 AS (SELECT *, lead(spot) OVER (PARTITION BY doc_id, k ORDER BY spot) - spot AS gap FROM f)"""
    phrase = []
    for p in wr.TIER3_PHRASES:
        n = _c("t", "(?i)" + p) + (f" - {_c('t', '(?i)' + chr(92) + 'bdesigned' + chr(92) + 's+for' + chr(92) + 's+long-?term' + chr(92) + 's+sustainability' + chr(92) + 'b')}" if p == wr.TIER3_PHRASES[-1] else "")
        phrase.append(f"SELECT doc_id, lower(regexp_extract(t, '(?i){q(p)}')) AS matched, {n} AS n FROM k")
    tier3 = " UNION ALL ".join(f"SELECT doc_id, w, '{x}' AS matched, len(list_filter(tok, lambda y: y IN ('{x}', '{x.replace('-', '')}'))) AS n FROM k" for x in wr.TIER3)
    many = lambda name, weight, severity, source: f"SELECT doc_id, '{name}', '{severity}', {weight}, matched, n::BIGINT FROM ({source})"
    sized = lambda source: f"SELECT DISTINCT doc_id, NULL::VARCHAR AS matched, n FROM ({source})"
    selects = [
        one("em-dash-density", 4, "'medium'", "dashes >= 3 AND dashes * 1000.0::DOUBLE > w * 6", "dashes"),
        one("uniform-sections", 5, f"CASE WHEN len(sections) >= 8 AND {_v('sections')} < 0.1 THEN 'high' ELSE 'medium' END", f"len(sections) >= 4 AND {_v('sections')} < 0.15", "len(sections)"),
        one("sentence-flatline", 5, "'medium'", f"len(sents) >= 5 AND {_v('slens')} < 0.25 AND {_avg('slens')} > 10", "len(sents)"),
        one("uniformity", 5, "'medium'", "len(paras) >= 4 AND list_avg(per_para) >= 3 AND list_max(per_para) - list_avg(per_para) <= 1 AND list_avg(per_para) - list_min(per_para) <= 1", "len(paras)"),
        one("smart-punct-signature", 6, "'high'", rf"w >= 80 AND regexp_matches(t, '[“”‘’]') AND {_c('t', '—')} > labels AND regexp_matches(t, '\b\w+,\s+\w+,\s+and\s+\w+') AND {_c('t', '[^.!?]  +')} = 0 AND NOT {_m('t', MISSING_MARK)}", "1"),
        one("punct-distribution", 6, "'medium'", f"len(paras) >= 4 AND len(density) >= 4 AND {_v('density')} < 0.25 AND {_avg('density')} >= 0.04", "len(density)"),
        one("fnword-trigram-entropy", 5, "'medium'", "w >= 150 AND total >= 50 AND (kinds = 1 OR entropy / log2(kinds) < 0.82)", "total"),
        one("cross-para-burstiness", 5, "'medium'", f"len(paras) >= 4 AND len(rhythms) >= 4 AND {_sd('rhythms')} < 0.08 AND {_avg('rhythms')} < 0.45", "len(rhythms)"),
        one("normalization-flag", 9, "'high'", "width > 0 OR swaps >= 2", "width + swaps"),
        one("low-ttr", 3, "'low'", "len(tok) >= 200 AND len(list_distinct(tok)) < len(tok) * 0.4::DOUBLE", "len(list_distinct(tok))"),
        one("hashtag-stuff", 12, "'medium'", "len(tags) >= 6", "len(tags)"),
        one("copula-avoidance", 3, "'low'", "alts >= 3 AND alts > (alts + copulas) * 0.25::DOUBLE", "alts"),
        one("heading-inflation", 3, "'low'", "heads >= 4 AND w >= 60 AND heads * 300.0::DOUBLE / w > 3", "heads"),
        one("staccato-fragments", 3, "'low'", "shorts >= 1", "shorts"),
        one("transition-stacking", 3, "'low'", "len(paras) >= 3 AND ((len(paras) >= 4 AND openers * 2 > len(paras)) OR contains(opener_code, 'ooo'))", "openers"),
        one("quote-inconsistency", 2, "'low'", "curly >= 2 AND straight >= 2", "curly + straight"),
        one("token-cutoff", 2, "'low'", rf"w >= 100 AND regexp_matches(trimmed, '[a-z,;]$') AND NOT regexp_matches(last, '^\s*(?:#{{1,6}}[ \t]|[-*+•]\s|\d+[.)]\s|\||```|~~~)') AND {_w('last')} >= 5", "1"),
        one("setup-expansion-cadence", 3, "'low'", "len(sents) >= 8 AND cadence >= 3 AND cadence >= (len(sents) - 1) * 0.2::DOUBLE", "cadence"),
        one("passive-ratio", 3, "'low'", "len(sents) >= 10 AND passive > len(sents) * 0.4::DOUBLE", "passive"),
        one("low-specificity", 2, "'low'", "w >= 300 AND specific * 1000.0::DOUBLE < w * 2", "specific"),
        one("adjacent-lemma-repeat", 3, "'low'", "len(sents) >= 10 AND repeats >= (len(sents) - 1) * 0.45::DOUBLE", "repeats"),
        one("markdown-furniture", 4, "'low'", "bold > 0 OR md > 0 OR bullets * 1000.0::DOUBLE > w * 10.75", "bold + md + bullets"),
        many("tier2", 3, "medium", "SELECT doc_id, x AS matched, len(list_filter(tier2, lambda p: list_contains(p, x))) AS n FROM (SELECT doc_id, tier2, unnest(list_distinct(flatten(tier2))) AS x FROM k)"),
        many("tier3", 2, "low", f"SELECT doc_id, matched, n FROM ({tier3}) WHERE n >= greatest(3, floor(w * 0.03::DOUBLE))"),
        many("tier3-phrase", 3, "medium", f"SELECT * FROM ({' UNION ALL '.join(phrase)}) WHERE n >= 2"),
        many("tier3-phrase-cluster", 12, "high", f"SELECT doc_id, NULL::VARCHAR AS matched, count(*) AS n FROM ({' UNION ALL '.join(phrase)}) WHERE n >= 1 GROUP BY doc_id HAVING count(*) >= 3"),
        many("bold-label-bullets", 3, "low", sized("SELECT doc_id, length(replace(unnest(regexp_extract_all(bold_code, 'b(?:_*b)*')), '_', '')) AS n FROM k") + " WHERE n >= 3"),
        many("uniform-list-items", 4, "medium", sized(f"SELECT doc_id, len(r) AS n FROM (SELECT doc_id, unnest(list_transform(list_filter(sizes, lambda z: z <> ''), lambda z: list_transform(string_split(z[1:length(z) - 1], ','), lambda y: y::DOUBLE))) AS r FROM k) WHERE len(r) >= 4 AND {_avg('r')} >= 3 AND {_v('r')} < 0.15")),
        many("bullet-np-list", 10, "high", sized("SELECT doc_id, length(r) AS n FROM (SELECT doc_id, replace(unnest(regexp_extract_all(noun_code, '[nB](?:_?[nB])*')), '_', '') AS r FROM k) WHERE length(replace(r, 'B', '')) >= 5 AND length(replace(r, 'B', '')) >= length(r) * 0.75::DOUBLE")),
        many("title-case-header", 4, "medium", "SELECT doc_id, lower(x) AS matched, count(*) AS n FROM (SELECT doc_id, unnest(titles) AS x FROM k) GROUP BY ALL"),
        many("invalid-isbn", 3, "low", f"SELECT doc_id, matched, count(*) AS n FROM i WHERE (len(d) = 10 AND ({ten}) % 11 <> 0) OR (len(d) = 13 AND ({thirteen}) % 10 <> 0) GROUP BY ALL"),
        many("proximity-cluster", 2, "low", "SELECT doc_id, k AS matched, count(*) AS n FROM f1 GROUP BY ALL HAVING min(gap) <= 300"),
        many("normalization-flag", 9, "high", "SELECT doc_id, 'stage directions' AS matched, stage AS n FROM k WHERE stage >= 2"),
    ]
    found = " UNION ALL ".join(selects)
    return f"WITH {ctes}, measured AS ({found}) {then}" if then else f"WITH {ctes} {found}"


# --- documents with the layouts that rules measure ------------------------------------

#: Texts put before every second document, by its id.
PROBES = (
    "# One\nThe long grey road ran down the green hill to the old town and so on today. The tall dark man went up the long stair to the top room and sat right there.\n# Two\nThe short red bus came round the sharp bend by the big church and stopped just here. The small wet dog swam over the cold stream to the far bank and shook well.\n# Three\nThe loud brass band played on the wide stage in the park and all went home. The young wise girl read in the warm light by the fire and slept till noon.\n# Four\nThe quick brown fox leapt past the slow old hound by the barn and ran off. The kind old cook stirred in the deep black pot on the stove and hummed songs.\n\n1. one two three\n2. four five six\n3. seven eight nine\n4. ten eleven twelve\nplain line",
    "We came - we saw - we won - and then we left. He said “no” — red, green, and blue — and \"yes\" and \"maybe\" to “all” of us who were there at the time of the vote, which took a long while and more words than one would like to count in a text that is meant to be short but has to hold eighty words at least so that the rule which looks at the marks of a text as a whole can speak about it, and so it goes on and on until the end comes",
    "Moreover, the cat sat on the warm mat today. The dog ran to the old red barn then. The bird flew over the tall green tree.\n\nFurthermore, the man went to the big shop now. The boy read in the new blue book then. The girl sang to the low white moon.\n\nAdditionally, the cow ate on the wet soft field. The hen sat by the dry cold stone. The fox hid in the dim dark wood.\n\nIn addition, the bee buzzed by the wide fair bloom. The ant walked up the thin long stem. The fly slept on the thick brown leaf.",
    "# One Thing About The Other Thing\n- **Alpha:** one two three\n- **Beta:** four five six\n- **Gamma:** seven eight nine\n- **Delta:** ten eleven twelve\n\n* red apple\n* green pear\n* blue plum\n* dark cherry\n* sweet fig\n\nISBN 0-306-40615-3 and ISBN-13: 978-0-306-40615-8 but ISBN 0-306-40615-2 is good.",
    "#one #two #three #four #five #six #include #123 and `#seven` is code. The integration of user engagement and community-driven work. The integration of it all. Significant things are significant and significant again. We foster and navigate a myriad of crucial, deeply rooted plans.",
    "It was broken. They were seen. He is driven. She was hurt by this. All were built for us then. It is known here. They are taken away. We were asked again. It was written down. They were shown out. Meticulous work, meticulous care. It serves as a test, stands as the proof, functions as an aid. *nods slowly* and *smiles at all* he went.",
    "Stop. Look here. Go now. This is a sentence that runs on for many more words than those before it did. Why? It is a sentence that again runs on for many more words than any of the others. So it goes. And then another one that is very long indeed with all of its words in a row. Well now. One more that has a good number of words so that the pair is counted here too. Fine then. The last one has its many words too and so the rule can speak about it now.\n\n## A\n## B\n## C\n## D\n## E",
    "The wonderful garden opened slowly. The wonderful garden closed slowly. Another wonderful evening followed quickly. Another wonderful evening ended quickly. Garden visitors walked slowly there. Visitors walked slowly again. Wonderful visitors stayed longer. Longer visits followed quickly. Quickly everyone walked home. Everyone walked slowly again. Longer visits ended quickly. Hiddеn lеtters and zero​width too.",
)


def probed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every second document has a text of PROBES before its own."""
    probe = F.element_at(F.array(*[F.lit(p) for p in PROBES]), (F.pmod(F.col("doc_id"), F.lit(2 * len(PROBES))) / 2 + 1).cast("int"))
    own = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 1, F.concat(probe, F.lit("\n\n"), own)).otherwise(own).alias("text"))


def probed_sql() -> str:
    quoted = ", ".join(f"'{wr._q(p)}'" for p in PROBES)
    return f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN ([{quoted}])[(doc_id % {2 * len(PROBES)} // 2)::INT + 1] || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents"


_ALL_SQL = f"SELECT doc_id, rule, severity, weight, matched, n FROM ({wr.wording_sql(probed_sql())}) UNION ALL SELECT * FROM ({_measured_sql(probed_sql())})"
_STYLE_SQL = ", ".join(f"'{x}'" for x in STYLE)
SCORES_SQL = rf"""
WITH p AS (SELECT doc_id, {_w(wr.normalised_sql('text'))} AS w FROM ({probed_sql()})),
a AS (SELECT doc_id, count(*) AS n_findings, list_sort(list(DISTINCT rule)) AS rules, sum(CASE WHEN rule IN ({_STYLE_SQL}) THEN weight ELSE 0 END) AS style, sum(CASE WHEN rule IN ({_STYLE_SQL}) THEN 0 ELSE weight END) AS other FROM ({_ALL_SQL}) GROUP BY doc_id),
e AS (SELECT p.doc_id, w, coalesce(n_findings, 0) AS n_findings, rules, coalesce(other, 0) + least(coalesce(style, 0), greatest(coalesce(other, 0), {STYLE_FLOOR})) AS raw FROM p LEFT JOIN a USING (doc_id) WHERE w >= {wr.MIN_WORDS})
SELECT doc_id, n_findings, coalesce(len(rules), 0)::INT AS n_rules, coalesce(array_to_string(rules, ','), '') AS rules, raw::BIGINT AS raw, least(100, round(raw / greatest(1.0, log2(w / 50.0))))::BIGINT AS score FROM e
"""
QUERIES = {
    "measured_findings": lambda s, d: measured_findings(probed(documents(s, d))),
    "rule_scores": lambda s, d: scores(probed(documents(s, d))),
    "rule_liveness": lambda s, d: liveness(all_findings(probed(documents(s, d)))),
}
ORACLE_SQL = {
    "measured_findings": _measured_sql(probed_sql()),
    "rule_scores": SCORES_SQL,
    "rule_liveness": f"SELECT rule, count(DISTINCT doc_id) AS n_docs, count(*) AS n_findings FROM ({_ALL_SQL}) GROUP BY rule",
}
