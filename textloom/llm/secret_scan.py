"""Secret scan by one deterministic automaton for all rules.

A rule is a head and a class of tail characters: a secret is the head and a run of
them.  The heads and tails of all rules become one nondeterministic automaton, then
by subset construction and minimisation one deterministic automaton over classes of
bytes, kept as a flat array of transitions.  Each text is read once, byte by byte;
the last states tell which rules accept at a byte.  Where a rule stops accepting
a match ends; a small reversed automaton of that rule, made the same way, reads
back from there to the leftmost start behind the rule's previous match.  Rules
match on ASCII characters only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import strings


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str  # "" for a plain run of tail characters
    tail: str  # a character class
    least: int  # tail characters of a secret; shorter matches are consumed, not reported
    fold: bool = False  # letters in either case


#: The base kinds, in the order they are listed.
BASE = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 8, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32),
)
#: Further kinds: tokens whose first letters name their issuer (code hosts, chat, payment and cloud services, signed web tokens), private keys, bearer headers.
FURTHER = (
    Rule("issued", "(?:gh[opsru]_|xox[abprs]-|[rs]k_live_|AIza|eyJ)", "[A-Za-z0-9_.-]", 20),
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\r\n]+", "[A-Za-z0-9+/=\r\n]", 32),
    Rule("bearer", "[Bb]earer\x20+", "[A-Za-z0-9._~+/=-]", 20),
)
RULES = BASE + FURTHER
#: Tail characters after which a rule without a head accepts in the combined automaton.
SOME = 6


# --- automata ----------------------------------------------------------------------


def _both_cases(found: set[int]) -> set[int]:
    return found | {c ^ 0x20 for c in found if chr(c).isalpha() and c < 0x80}


class Pieces:
    """Nondeterministic automaton: per state its empty steps and its steps on sets of bytes."""

    def __init__(self, reverse: bool) -> None:
        self.reverse = reverse
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Append what a parsed pattern matches behind state ``at``; returns the state behind it."""
        for op, arg in reversed(list(tree)) if self.reverse else tree:
            at = self._one(str(op), arg, at, fold)
        return at

    def _one(self, op: str, arg, at: int, fold: bool) -> int:
        end = self.state()
        if op == "LITERAL":
            self._step(at, {arg}, end, fold)
        elif op == "IN":
            found: set[int] = set()
            for kind, x in arg:
                found |= {x} if str(kind) == "LITERAL" else set(range(x[0], x[1] + 1))
            self._step(at, found, end, fold)
        elif op == "BRANCH":
            for way in arg[1]:
                self.empty[self.add(way, at, fold)].append(end)
        elif op == "SUBPATTERN":
            self.empty[self.add(arg[3], at, fold)].append(end)
        elif op == "MAX_REPEAT":
            least, most, tree = arg
            for _ in range(least):
                at = self.add(tree, at, fold)
            if most is parser.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(tree, loop, fold)].append(loop)
                at = loop
            else:
                for _ in range(most - least):
                    self.empty[at].append(end)
                    at = self.add(tree, at, fold)
            self.empty[at].append(end)
        else:
            raise ValueError(f"rules may not use {op}")
        return end

    def _step(self, at: int, found: set[int], end: int, fold: bool) -> None:
        self.steps[at].append((frozenset(_both_cases(found) if fold else found), end))

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """Flat transitions: state * width + class gives the next state * width; states from ``accepting`` on accept."""

    classes: bytes  # byte -> class
    width: int
    table: list[int]
    start: int
    accepting: int  # times width
    dead: int  # the state without a way out, times width; -1 if there is none
    marks: list[int]  # state -> bits of the patterns that accept


def compile_patterns(patterns: list[tuple[str, bool]], anchored: bool = False, reverse: bool = False) -> Automaton:
    """One minimal automaton; bit i of a state's marks: pattern i ends here.  Unless anchored, a match may begin at every byte."""
    net = Pieces(reverse)
    first, ends = net.state(), {}
    for i, (pattern, fold) in enumerate(patterns):
        begin = net.state()
        net.empty[first].append(begin)
        ends[net.add(parser.parse(pattern), begin, fold)] = 1 << i
    sets = sorted({s for steps in net.steps for s, _ in steps}, key=sorted)
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(number[s] for s in signature)
    example = [classes.index(i) for i in range(len(number))]

    start = net.closure([first])
    states, rows, todo = {start: 0}, [], [start]
    while todo:
        here, row = todo.pop(), []
        by_set = [(s, x) for q in here for s, x in net.steps[q]]
        for b in example:
            there = {x for s, x in by_set if b in s}
            row.append(net.closure(there | (set() if anchored else {first})))
        rows.append((states[here], row))
        for s in row:
            if s not in states:
                states[s] = len(states)
                todo.append(s)
    marks = np.zeros(len(states), np.int64)
    for s, i in states.items():
        for q in s:
            marks[i] |= ends.get(q, 0)
    table = np.zeros((len(states), len(example)), np.int64)
    for i, row in rows:
        table[i] = [states[s] for s in row]
    return _minimal(table, marks, classes)


def _minimal(table: np.ndarray, marks: np.ndarray, classes: bytes) -> Automaton:
    """Merge states that no continuation tells apart: split blocks until their rows agree.  Start is state 0."""
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    one = np.unique(block, return_index=True)[1]  # a state of each block
    order = np.argsort(marks[one] != 0, kind="stable")  # accepting blocks last
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    width = table.shape[1]
    small = place[block[table[one[order]]]]
    plain = int((marks[one] == 0).sum())
    dead = [i for i in range(plain) if (small[i] == i).all()]
    return Automaton(classes, width, (small * width).reshape(-1).tolist(), int(place[block[0]]) * width, plain * width, dead[0] * width if dead else -1, marks[one[order]].tolist())


@dataclass(frozen=True)
class Scanner:
    """The combined automaton and, per rule, the reversed one: bit 0 head and tail, bit 1 tail of the least length."""

    rules: tuple[Rule, ...]
    forward: Automaton
    back: tuple[Automaton, ...]

    def ends(self, text: bytes) -> dict[int, list[int]]:
        """Per rule, where its matches end: the one pass over the bytes."""
        a = self.forward
        table, state, accepting, width = a.table, a.start, a.accepting, a.width
        found: dict[int, list[int]] = {}
        for i, c in enumerate(text.translate(a.classes)):
            state = table[state + c]
            if state >= accepting:
                marks, rule = a.marks[state // width], 0
                while marks:
                    if marks & 1:
                        at = found.setdefault(rule, [])
                        if at and at[-1] == i:
                            at[-1] = i + 1
                        else:
                            at.append(i + 1)
                    marks >>= 1
                    rule += 1
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, ascending."""
        out = []
        for rule, ends in self.ends(text).items():
            a, bound = self.back[rule], 0
            for end in ends:
                state, start, good = a.start, -1, False
                for at in range(end - 1, bound - 1, -1):
                    state = a.table[state + a.classes[text[at]]]
                    if state >= a.accepting:
                        marks = a.marks[state // a.width]
                        if marks & 1:
                            start, good = at, marks > 1
                    elif state == a.dead:
                        break
                if start >= 0:
                    bound = end
                    if good:
                        out.append((start, rule, end))
        return sorted(out)


def compiled(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Rules without a head accept from SOME tail characters on, so that ordinary words rarely do and the states stay few."""
    weak = [(r.head + r.tail + ("+" if r.head else f"{{{min(r.least, SOME)},}}"), r.fold) for r in rules]
    strong = [(r.head + r.tail + f"{{{r.least},}}", r.fold) for r in rules]
    return Scanner(rules, compile_patterns(weak), tuple(compile_patterns([w, s], anchored=True, reverse=True) for w, s in zip(weak, strong)))


# --- operator ------------------------------------------------------------------------

SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end; code points, end exclusive) of every row; no shuffle.

    Of each kind matches are leftmost and do not overlap; spans of different kinds
    may.  They come by start, then in the order of the rules.  Null and empty texts
    have none; repeated rows have equal ones.  A long text is one text, and no task
    holds more than a batch of them.  Columns besides id and text are not read,
    whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(compiled(rules))  # the rules' size, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            data, offsets = strings(batch.column(1))
            edges, kinds, starts, ends = [0], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = scanner.spans(text)
                if spans:
                    lead = np.zeros(len(text) + 1, np.int64)
                    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=lead[1:])
                    for start, rule, end in spans:
                        kinds.append(rules[rule].kind)
                        starts.append(int(lead[start]))
                        ends.append(int(lead[end]))
                edges.append(len(kinds))
            fields = [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "spans"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = [r.kind for r in BASE]
    listing = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


def _folded(pattern: str) -> str:
    """The pattern with each letter outside brackets as a class of both cases."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            size = 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + size])
            i += size
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c)
        i += 1
    return "".join(out)


def _op13_sql() -> str:
    """Matches are marked by replacement; pieces between marks give the places."""
    parts = []
    for place, r in enumerate(RULES):
        head = (_folded(r.head) if r.fold else r.head).replace("'", "''")
        pattern = f"{head}{r.tail}" + ("+" if r.head else f"{{{r.least},}}")
        parts.append(
            f"SELECT doc_id, {place} AS rank, '{r.kind}' AS kind, list_filter(list_transform(range(2, len(w) + 1), lambda i: {{'m': split_part(w[i], chr(2), 1), 's': list_sum(list_transform(w[1:i - 1], lambda x: length(replace(x, chr(2), ''))))::BIGINT}}), "
            f"lambda z: length(regexp_extract(z.m, '^{head}({r.tail}+)$', 1)) >= {r.least}) AS found "
            f"FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS w FROM d)"
        )
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    listing = lambda where: f"coalesce(string_agg(kind || ':' || z.s || ':' || (z.s + length(z.m)), ',' ORDER BY z.s, rank) FILTER ({where}), '')"
    return (
        "WITH d AS MATERIALIZED (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '  ') AS t FROM documents), m AS (" + " UNION ALL ".join(parts) + "), x AS (SELECT doc_id, rank, kind, unnest(found) AS z FROM m), "
        f"g AS (SELECT doc_id, {', '.join(f'''count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}''' for r in BASE)}, {listing(f'kind IN ({kinds})')} AS base, {listing('true')} AS spans FROM x GROUP BY doc_id) "
        f"SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
    )


OP13_SQL = _op13_sql()
