"""Protected facts, organisations and names, and gates that a rewritten text must pass.

All are row-local scans: a document without a match costs one pass and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.stylometry import documents

# Fixed patterns of protected facts, by kind.
FACTS = {
    "code": r"```[\s\S]*?```|`[^`\n]+`",
    "url": r"https?://[^\s<>)\]]+",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "citation": r"\[[0-9]+\]|\((?:[A-Z][A-Za-z-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z-]+)*(?:\s+et al\.)?),?\s+\d{4}[a-z]?\)|\b[A-Z][A-Za-z-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z-]+)*\s+et al\.,?\s*\(?\d{4}[a-z]?\)?",
    "quote": r'[“"][^”"\n]+[”"]',
    "currency": r"(?:£|\$|€)\s?\d[\d,]*(?:\.\d+)?",
    "date": r"\b(?:\d{1,2}\s+[A-Z][a-z]+\s+\d{4}|\d{4}-\d{2}-\d{2})\b",
    "time": r"(?i)\b\d{1,2}:\d{2}(?:\s?[ap]m)?\b",
    "unit": r"\b\d+(?:\.\d+)?\s?(?:kg|g|km|m|cm|mm|GB|MB|%|°C)\b",
    "number": r"\b\d[\d,]*(?:\.\d+)?%?\b",
}
# Words that begin no name, and capitals that name no organisation.
NO_NAME = "The A An This That These Those It He She They We You I In On At For To From With By Of And But Or Nor If As Is Are Was Were Be Been Not No Yes See Run New Our Your Their His Her Its My Do Does Did Will Would Can Could Should May Might Must Have Has Had So Then There Here What Which Who Whose When Where Why How All Any Each Per Both More Most Some Such Other Also Just Only Now Today Yesterday Tomorrow Please Note"
NO_ACRONYM = "AM PM GMT UTC BST CET CEST EST EDT PST PDT EUR USD GBP JPY CHF AI IT TV OK PS NB ID IP FAQ API URL URI HTML CSS SQL PDF HTTP HTTPS VAT ASAP DIY CEO CTO CFO COO UK EU US USA RSVP ETA FYI QA DNA GPS SMS"
# Fixed patterns of organisations and names; group 1 is the entity.  Edges are spelt out: engines differ in what \b is beside accented letters.
_FROM, _TO = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
SUFFIXED = _FROM + r"((?:[A-Z][A-Za-z&.'-]*\s+){1,5}(?:Ltd\.?|Limited|LLC|Inc\.?|plc|GmbH|&\s?Co\.?|Agency|Council|University))" + _TO
TOKEN, ACRONYM = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*", r"^[A-Z]{2,6}(?:\.[A-Z]{2,6})*$"
HONORIFIC = _FROM + r"((?:Dr|Mr|Mrs|Ms|Prof|Sir|Dame)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})" + _TO
NAME_RUN = r"[^.!?:;…\s\"“”'‘’(\[][\s\"“”'‘’(\[]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})" + _TO
STOP = "^(?:(?:" + NO_NAME.replace(" ", "|") + r")\s+)+"
#: References that a rewrite must not add.
REFERENCE = r"https?://[^\s<>)\]]+|```[\s\S]*?```|`[^`\n]+`|\[[0-9]+\]|[“\"][^”\"\n]+[”\"]"


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, matched, n): every distinct fact of a document and how often it stands there."""
    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("matched")))

    kinds = F.array(*[of(kind, pattern) for kind, pattern in FACTS.items()])
    found = docs.select("doc_id", F.explode(F.flatten(kinds)).alias("x"))
    return found.groupBy("doc_id", "x.kind", "x.matched").agg(F.count("*").alias("n"))


def _q(text: str) -> str:
    return text.replace("'", "''")


FACTS_SQL = "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{_q(rx)}')) AS matched FROM documents" for kind, rx in FACTS.items()) + ") SELECT doc_id, kind, matched, count(*) AS n FROM f GROUP BY ALL"


def entities(docs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kind, rule, matched, n): organisations by suffix or capitals, names by title or within a sentence, given terms.

    Leading words that begin no name are peeled off an organisation; a run of capitalised
    words is a name only after other words of its sentence, and not within another entity.
    """
    every = lambda rx: F.regexp_extract_all("text", F.lit(rx), F.lit(1))
    peeled = F.filter(F.transform(every(SUFFIXED), lambda x: F.regexp_replace(x, STOP, "")), lambda x: x.rlike(r"\s"))
    capitals = F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda x: x.rlike(ACRONYM) & ~x.isin(*NO_ACRONYM.split()))
    runs = F.filter(every(NAME_RUN), lambda x: ~F.arrays_overlap(F.split(x, r"\s+"), F.array(*[F.lit(w) for w in NO_NAME.split()])))
    cut = docs.where("text is not null").select("doc_id", "text", peeled.alias("peeled"), capitals.alias("capitals"), every(HONORIFIC).alias("titled"), runs.alias("runs"))
    outside = F.filter("runs", lambda x: ~F.exists(F.concat("peeled", "titled"), lambda y: F.contains(y, x)))
    given = F.flatten(F.array(*[F.array_repeat(F.lit(t), ((F.length("text") - F.length(F.replace(F.col("text"), F.lit(t), F.lit("")))) / len(t)).cast("int")) for t in terms])) if terms else F.array().cast("array<string>")
    told = lambda a, kind, rule: F.transform(a, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), x.alias("matched")))
    rows = F.concat(*[told(*x) for x in ((F.col("peeled"), "organisation", "suffix"), (F.col("capitals"), "organisation", "capitals"), (F.col("titled"), "name", "title"), (outside, "name", "run"), (given, "term", "given"))])
    return cut.select("doc_id", F.explode(rows).alias("x")).groupBy("doc_id", "x.kind", "x.rule", "x.matched").agg(F.count("*").alias("n"))


#: Sentences with entities and facts, put behind every second document.
PROBES = (
    "They saw The Acme Widgets Ltd and met Dr Jane Smith there, then old John Brown spoke for NASA and the API team on 2024-05-01 at 10:30 pm.",
    "It was Oxford Council that paid £1,200.50 for 12 kg of tea [3] (Smith and Jones, 2019), as `code` says at https://example.org/a and in \"a short quote\".",
    "A note by Mr. Paul Green to Green Hill University: ask our friend Mary Ann Lee, she said 50% more.",
)
TERMS = ("tea", "speciality")


def probed(docs: DataFrame) -> DataFrame:
    probe = F.element_at(F.array(*[F.lit(p) for p in PROBES]), (F.pmod("doc_id", F.lit(len(PROBES))) + 1).cast("int"))
    return docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), probe)).otherwise(F.col("text")).alias("text"))


_PROBED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || chr(10) || ([" + ", ".join(f"'{_q(p)}'" for p in PROBES) + f"])[(doc_id % {len(PROBES)})::INT + 1] ELSE text END AS text FROM documents"
_LIST = lambda words: ", ".join(f"'{w}'" for w in words.split())
ENTITIES_SQL = rf"""
WITH b AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '{_q(SUFFIXED)}', 1), lambda x: regexp_replace(x, '{STOP}', '')), lambda x: regexp_matches(x, '\s')) AS peeled, list_filter(regexp_extract_all(text, '{TOKEN}'), lambda x: regexp_matches(x, '{ACRONYM}') AND x NOT IN ({_LIST(NO_ACRONYM)})) AS capitals,
  regexp_extract_all(text, '{HONORIFIC}', 1) AS titled, list_filter(regexp_extract_all(text, '{_q(NAME_RUN)}', 1), lambda x: NOT list_has_any(string_split_regex(x, '\s+'), [{_LIST(NO_NAME)}])) AS runs FROM ({_PROBED}) WHERE text IS NOT NULL),
e AS (SELECT doc_id, 'organisation' AS kind, 'suffix' AS rule, unnest(peeled) AS matched FROM b UNION ALL SELECT doc_id, 'organisation', 'capitals', unnest(capitals) FROM b UNION ALL SELECT doc_id, 'name', 'title', unnest(titled) FROM b
  UNION ALL SELECT doc_id, 'name', 'run', unnest(list_filter(runs, lambda x: len(list_filter(list_concat(peeled, titled), lambda y: contains(y, x))) = 0)) FROM b
  {" ".join(f"UNION ALL SELECT doc_id, 'term', 'given', '{t}' FROM (SELECT doc_id, unnest(range(0, (length(text) - length(replace(text, '{t}', ''))) // {len(t)})) FROM b)" for t in TERMS)})
SELECT doc_id, kind, rule, matched, count(*) AS n FROM e GROUP BY ALL
"""


def _times(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def gates(pairs: DataFrame) -> DataFrame:
    """Gates on (doc_id, source, candidate): facts that went missing or were doubled, references added, length ratio, markup, status."""
    facts_ = F.array_distinct(F.concat(*[F.regexp_extract_all("source", F.lit(FACTS[k]), F.lit(0)) for k in ("code", "url", "email", "citation", "quote", "currency", "date", "time")]))
    known = pairs.select("doc_id", "source", "candidate", facts_.alias("f"))
    missing = F.size(F.filter("f", lambda x: _times(F.col("candidate"), x) == 0))
    doubled = F.size(F.filter("f", lambda x: _times(F.col("candidate"), x) > _times(F.col("source"), x)))
    added = F.size(F.array_except(F.regexp_extract_all("candidate", F.lit(REFERENCE), F.lit(0)), F.regexp_extract_all("source", F.lit(REFERENCE), F.lit(0))))
    ratio = F.round(F.length("candidate") / F.greatest(F.length("source"), F.lit(1)), 6)
    markup = F.col("candidate").rlike(r"(?i)<(?:script|iframe|object)\b")
    out = known.select("doc_id", F.size("f").alias("n_facts"), missing.alias("n_missing"), doubled.alias("n_doubled"), added.alias("n_added"), ratio.alias("ratio"), markup.alias("markup"))
    return out.withColumn("status", F.when((F.col("n_missing") > 0) | (F.col("n_doubled") > 0) | (F.col("n_added") > 0) | F.col("markup") | ~F.col("ratio").between(0.5, 2.0), "fail").otherwise("pass"))


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, source, candidate): the text, and itself with its halves exchanged at a line or with the first half twice."""
    t, half = F.col("text"), F.ceil(F.length("text") / 2).cast("int")
    candidate = F.when(F.pmod("doc_id", F.lit(3)) == 0, t).when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.substring(t, F.lit(1), half), F.substring(t, F.lit(1), half))).otherwise(F.concat(t, F.lit(" see https://example.org/new [9]")))
    return docs.where("text is not null").select("doc_id", t.alias("source"), candidate.alias("candidate"))


_FACTS_OF = "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(source, '{_q(FACTS[k])}')" for k in ("code", "url", "email", "citation", "quote", "currency", "date", "time")) + "]))"
GATES_SQL = rf"""
WITH p AS (SELECT doc_id, text AS source, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, ceil(length(text) / 2)::INT) || substr(text, 1, ceil(length(text) / 2)::INT) ELSE text || ' see https://example.org/new [9]' END AS candidate FROM ({_PROBED}) WHERE text IS NOT NULL),
f AS (SELECT *, {_FACTS_OF} AS f FROM p),
g AS (SELECT doc_id, len(f)::INT AS n_facts, len(list_filter(f, lambda x: NOT contains(candidate, x)))::INT AS n_missing, len(list_filter(f, lambda x: (length(candidate) - length(replace(candidate, x, ''))) > (length(source) - length(replace(source, x, '')))))::INT AS n_doubled,
  len(list_filter(list_distinct(regexp_extract_all(candidate, '{_q(REFERENCE)}')), lambda x: NOT list_contains(regexp_extract_all(source, '{_q(REFERENCE)}'), x)))::INT AS n_added, round(length(candidate) / greatest(length(source), 1), 6) AS ratio, regexp_matches(candidate, '(?i)<(?:script|iframe|object)\b') AS markup FROM f)
SELECT *, CASE WHEN n_missing > 0 OR n_doubled > 0 OR n_added > 0 OR markup OR NOT ratio BETWEEN 0.5 AND 2.0 THEN 'fail' ELSE 'pass' END AS status FROM g
"""

QUERIES = {
    "protected_facts": lambda s, d: facts(documents(s, d)),
    "protected_entities": lambda s, d: entities(probed(documents(s, d)), TERMS),
    "rewrite_gates": lambda s, d: gates(rewritten(probed(documents(s, d)))),
}
ORACLE_SQL = {"protected_facts": FACTS_SQL, "protected_entities": ENTITIES_SQL, "rewrite_gates": GATES_SQL}
