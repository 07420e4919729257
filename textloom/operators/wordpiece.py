"""Subword pieces by longest match in a trie, and segments of a text that fit a token window.

The vocabulary is an argument; ``vocabulary`` makes one of the most frequent words
of a corpus and its characters.  Words are matched once per worker and remembered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.operators.stylometry import documents

# White space, ranges of characters that stand alone, longest word, token window and its two marks.
BLANKS = frozenset([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)])
ALONE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
LONGEST, WINDOW, MARKS = 100, 512, 2
BUDGET = WINDOW - MARKS
WORD = re.compile("[^\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
CHUNK = re.compile(f"[^{''.join(map(chr, sorted(BLANKS)))}]+")
UNKNOWN = "[UNK]"
#: Bounds of a vocabulary made from a corpus: characters and words.
MAX_CHARACTERS, MAX_WORDS = 4_000, 20_000


def plain_words(text: str) -> list[str]:
    """Lower-case words without accents and controls; punctuation and ideographs stand alone."""
    shown = []
    for c in text:
        code, kind = ord(c), unicodedata.category(c)
        if code in BLANKS:
            shown.append(" ")
        elif code and code != 0xFFFD and kind not in ("Cc", "Cf", "Co", "Cn"):
            shown.append(f" {c} " if any(a <= code <= b for a, b in ALONE) else c)
    out: list[str] = []
    for word in "".join(shown).split(" "):
        bare = (c for c in unicodedata.normalize("NFD", "".join(c.lower() for c in word)) if unicodedata.category(c) != "Mn")
        open_ = False
        for c in bare:
            if unicodedata.category(c)[0] == "P" or (c < "\x7f" and c > " " and not c.isalnum()):
                out.append(c)
                open_ = False
            elif open_:
                out[-1] += c
            else:
                out.append(c)
                open_ = True
    return out


class WordPieces:
    """Pieces of texts under one vocabulary; continuing pieces begin with ##."""

    def __init__(self, tokens: list[str]) -> None:
        self.number = {t: i for i, t in enumerate(tokens)}
        self.unknown = self.number[UNKNOWN]
        self.tries: tuple[dict, dict] = ({}, {})
        for token, i in self.number.items():
            inner = token.startswith("##") and len(token) > 2
            node = self.tries[inner]
            for c in token[2:] if inner else token:
                node = node.setdefault(c, {})
            node[""] = i
        self.known: dict[str, list[int]] = {}

    def of_word(self, word: str) -> list[int]:
        """The longest piece at each place, or one unknown mark if some place has none."""
        if len(word) > LONGEST:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            node, best, end = self.tries[at > 0], -1, at
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    best, end = node[""], i + 1
            if best < 0:
                return [self.unknown]
            out.append(best)
            at = end
        return out

    def of_chunk(self, chunk: str) -> list[int]:
        """The pieces of a stretch without white space, remembered as it stands."""
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[chunk] = [x for word in plain_words(chunk) for x in self.of_word(word)]
        return found

    def __call__(self, text: str) -> list[int]:
        return [x for chunk in CHUNK.findall(text) for x in self.of_chunk(chunk)]

    def count(self, text: str) -> int:
        return sum(len(self.of_chunk(chunk)) for chunk in CHUNK.findall(text))


def segments(text: str, count: Callable[[str], int]) -> list[tuple[int, int, int, int]]:
    """(start, end, words, tokens with marks) of the fewest near-equal parts of a text that all fit the window.

    Parts are whole words and cover every character; a word too long for the window
    is cut into slices that stand alone.  Places are code points.
    """
    units: list[tuple[int, int, int, bool, bool]] = []  # start, end, tokens, first of a word, alone
    for m in WORD.finditer(text):
        n = count(m[0])
        if n <= BUDGET:
            units.append((m.start(), m.end(), n, True, False))
        else:
            for at in range(m.start(), m.end(), BUDGET):
                stop = min(at + BUDGET, m.end())
                units.append((at, stop, count(text[at:stop]), at == m.start(), True))
    total = sum(u[2] for u in units)
    if total <= BUDGET and not any(u[4] for u in units):
        return [(0, len(text), len(units), total + MARKS)]
    upto = [0]
    for u in units:
        upto.append(upto[-1] + u[2])
    walls = {i + side for i, u in enumerate(units) if u[4] for side in (0, 1)}
    parts = max(1, -(-total // BUDGET))
    while True:
        cuts, at = set(walls), 0
        for j in range(1, parts):
            at += 1
            while at < len(units) and upto[at] * parts < j * total:
                at += 1
            at = min(at, len(units) - (parts - j))
            cuts.add(at)
        edges = [0, *sorted(c for c in cuts if 0 < c < len(units)), len(units)]
        places = [0, *[units[c - 1][1] for c in edges[1:-1]], len(text)]
        sizes = [count(text[a:b]) + MARKS for a, b in zip(places, places[1:])]
        if max(sizes) <= WINDOW or parts >= len(units):
            break
        parts += 1
    return [(places[i], places[i + 1], sum(u[3] for u in units[edges[i] : edges[i + 1]]), sizes[i]) for i in range(len(sizes))]


def vocabulary(docs: DataFrame) -> list[str]:
    """The unknown mark, the most frequent characters (also as continuations) and words of a corpus, lower case; ties by the text."""
    lower = docs.where("text is not null").select(F.lower("text").alias("t"))
    top = lambda tokens, n: [r["x"] for r in lower.select(F.explode(tokens).alias("x")).groupBy("x").count().orderBy(F.desc("count"), "x").limit(n).collect()]
    signs = top(F.regexp_extract_all("t", F.lit(r"\S"), F.lit(0)), MAX_CHARACTERS)
    words = top(F.regexp_extract_all("t", F.lit(r"\p{L}{2,}"), F.lit(0)), MAX_WORDS)
    return [UNKNOWN, *signs, *[f"##{c}" for c in signs], *words]


def token_ids(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, ids): the pieces of every whole text; null texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)  # a vocabulary, bounded by its makers
    made: list[WordPieces] = []  # one for the batches of a task

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        pieces = made[0] if made else made.append(WordPieces(sent.value)) or made[0]
        return texts.map(lambda t: pieces(t or ""))

    return docs.select("doc_id", ids("text").alias("ids"))


SEGMENT = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "end", "words", "tokens")]))


def token_segments(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, segment, start, end, words, tokens) of every text that is not null; rows stay apart, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(tokens)  # a vocabulary, bounded by its makers
    made: list[WordPieces] = []  # one for the batches of a task

    @F.pandas_udf(SEGMENT)
    def cut(texts: pd.Series) -> pd.Series:
        pieces = made[0] if made else made.append(WordPieces(sent.value)) or made[0]
        return texts.map(lambda t: [dict(zip(("start", "end", "words", "tokens"), s)) for s in segments(t, pieces.count)])

    rows = docs.where("text is not null").select("doc_id", F.posexplode(cut("text")).alias("segment", "s"))
    return rows.select("doc_id", F.col("segment").cast("bigint").alias("segment"), "s.*")


def _ids(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return token_ids(docs, vocabulary(docs)).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"))


QUERIES = {"wordpiece_tokens": _ids, "token_segments": lambda s, d: token_segments(documents(s, d), vocabulary(documents(s, d)))}
ORACLE_SQL: dict[str, str] = {}
