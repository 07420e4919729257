"""Editorial verdict of a text from its findings: score, band, probabilities, confidence, escalation; one row per text.

It says how a text reads, never who wrote it.  All is read off the findings of the
row itself: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators import measured_rules as mr, writing_rules as wr
from textloom.operators.stylometry import documents

# Longest text that is scored, sets of rules, classes from cautious to bold.
MAX_WORDS = 10_000
RHYTHM_PACK = ("sentence-length-spectral-flatness", "conditional-compression", "lexical-register-distance", "punchline-fragment-density", "mic-drop-paragraph", "contrast-density", "rhetorical-procedural-ratio")
FURNITURE = ("markdown-bold", "markdown-heading", "markdown-furniture")
ARTEFACTS = ("ai-citation-markup", "ai-citation-token", "ai-utm-source", "reasoning-leak", "placeholder-token", "ai-placeholder", "pua-character", "math-alphanumeric")
SUPPORT = ("arrow-decoration", "escaped-markup-literal")
CLUSTER = ("bold-label-bullets", "heading-inflation", "emoji-decoration", "arrow-decoration")
CLASSES = ("human_like", "mixed_signals", "ai_like")
#: What may raise a class, in order of precedence, and the class it argues for (by place; -1: one above the base).
ESCALATIONS = (("citation_co_occurrence", 2), ("finding_breadth", -1), ("artefact_score", 1), ("artefact_floor", 1), ("furniture_gate", 1), ("formatting_floor", 1), ("formatting_cluster", 1))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, status, score, classification, human, mixed, ai, confidence, escalation, n_findings, n_rules) of every row.

    The class is the likeliest one, ties to the more cautious; escalations may raise
    it, never lower it, and leave the probabilities.  Rhythm rules of one pack, and
    rules of chat mark-up, count once for breadth.  Null and blank texts, texts of
    fewer than MIN_WORDS words or more than MAX_WORDS are not scored and have nulls.
    Rows that repeat a doc_id stay apart.
    """
    rated = _rated(docs)
    short = docs.select("doc_id", wr.word_count(F.col("text")).alias("w")).where(F.col("w") < wr.MIN_WORDS)
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in rated.dtypes if name not in ("doc_id", "status")]
    none = short.select("doc_id", F.when(F.col("w") == 0, "empty").otherwise("too_short").alias("status"), *nulls)
    return rated.unionByName(none)


def _rated(docs: DataFrame) -> DataFrame:
    base = mr.findings_of_rows(docs, ("width", "swaps", "tier2"))
    rules = F.array_distinct(F.transform("f", lambda f: f["rule"]))
    count = lambda names: F.size(F.filter("f", lambda f: f["rule"].isin(*names)))
    weight = lambda style: F.aggregate(F.filter("f", lambda f: f["rule"].isin(*mr.STYLE) == F.lit(style)), F.lit(0).cast("bigint"), lambda n, f: n + f["weight"])
    tier1 = F.size(F.array_distinct(F.transform(F.filter("f", lambda f: f["rule"] == "tier1"), lambda f: f["matched"])))
    hidden = (F.col("width") >= 2) | (F.col("swaps") >= 2)
    one = base.select("doc_id", "w", F.size("f").alias("n"), rules.alias("r"), weight(True).alias("style"), weight(False).alias("other"), count(RHYTHM_PACK).alias("n_rhythm"), count(FURNITURE).alias("n_furniture"), tier1.alias("tier1"), F.size("tier2").alias("tier2"), hidden.alias("hidden"))
    has = lambda name: F.array_contains("r", name)
    number = lambda names: F.size(F.array_intersect("r", F.array(*map(F.lit, names))))
    yes = lambda c: c.cast("int")
    dense = (F.col("w") >= 150) & (F.col("tier1") >= 5) & (F.col("tier2") >= 2) & has("transition")
    weak = yes(number(("punct-distribution", "cross-para-burstiness", "fnword-trigram-entropy")) >= 2) + yes(has("smart-punct-signature"))
    strong = yes(has("cutoff-disclaimer")) + yes(F.col("hidden")) + yes(has("reasoning-artifact") & has("chatbot")) + yes(dense)
    scored = one.select("*", mr.score_of(F.col("other") + F.least("style", F.greatest("other", F.lit(mr.STYLE_FLOOR))), F.col("w")).alias("score"), strong.alias("strong"), weak.alias("weak"))
    soft = scored.withColumn("soft", F.least(F.lit(0.97), F.col("score") / 100 + (F.col("strong") + F.col("weak")) * F.lit(0.06) + F.col("strong") * F.lit(0.08)))
    shaped = soft.withColumn("p", _shape(F.col("score"), F.col("strong"), F.col("weak"), F.col("soft")))
    total = F.col("p.human") + F.col("p.mixed") + F.col("p.ai")
    parts = shaped.withColumn("human", F.round(F.col("p.human") / total, 3)).withColumn("mixed", F.round(F.col("p.mixed") / total, 3))
    parts = parts.withColumn("ai", F.greatest(F.lit(0.0), F.round(1 - F.col("human") - F.col("mixed"), 3)))
    likeliest = F.when((F.col("human") >= F.col("mixed")) & (F.col("human") >= F.col("ai")), 0).when(F.col("mixed") >= F.col("ai"), 1).otherwise(2)
    sure = F.when((F.col("strong") >= 2) | has("cutoff-disclaimer") | ((F.col("score") < 8) & (F.col("w") >= 100)), "high").when((F.col("strong") >= 1) | ((F.col("score") >= 45) & (F.col("weak") >= 1)) | (F.col("score") < 20), "medium").otherwise("low")
    artefact = (number(ARTEFACTS) >= 1) | (number(SUPPORT) >= 2)
    once = lambda n: F.greatest(F.lit(0), F.col(n) - 1)
    breadth = F.size("r") - number(RHYTHM_PACK) - number(FURNITURE) + yes(F.col("n_rhythm") > 0) + yes(F.col("n_furniture") > 0)
    holds = {
        "citation_co_occurrence": has("ai-citation-markup") & has("ai-citation-token"),
        "finding_breadth": (F.col("n") - once("n_rhythm") - once("n_furniture") >= 6) & (breadth >= 4),
        "artefact_score": artefact & (F.col("score") >= 10),
        "artefact_floor": artefact,
        # for breadth, the chat mark-up rules go by one name of their own, so the gate by theirs never opens
        "furniture_gate": F.lit(False),
        "formatting_floor": has("formatting"),
        "formatting_cluster": number(CLUSTER) >= 3,
    }
    known = parts.select("*", likeliest.alias("base"), sure.alias("sure"), holds["artefact_score"].alias("lifts"))
    above = lambda to: F.least(F.lit(2), F.col("base") + 1) if to < 0 else F.lit(to)
    offers = F.array(*[F.when(holds[name], F.struct(above(to).alias("to"), F.lit(name).alias("name"))) for name, to in ESCALATIONS])
    start = F.struct(F.col("base").alias("to"), F.lit(None).cast("string").alias("name"))
    raised = F.aggregate(F.filter(offers, lambda o: o.isNotNull()), start, lambda z, o: F.when(o["to"] > z["to"], o).otherwise(z))
    out = known.withColumn("e", raised)
    inside = F.col("w") <= MAX_WORDS
    shown = lambda c, name: F.when(inside, c).alias(name)
    return out.select("doc_id", F.when(inside, "scored").otherwise("too_long").alias("status"), shown(F.col("score"), "score"), shown(F.element_at(F.array(*map(F.lit, CLASSES)), F.col("e.to") + 1), "classification"), *[shown(F.col(c), c) for c in ("human", "mixed", "ai")], shown(F.when(F.col("lifts") & (F.col("sure") == "low"), "medium").otherwise(F.col("sure")), "confidence"), shown(F.col("e.name"), "escalation"), shown(F.col("n").cast("bigint"), "n_findings"), shown(F.size("r").cast("bigint"), "n_rules"))


def _shape(score: Column, strong: Column, weak: Column, soft: Column) -> Column:
    """struct<human, mixed, ai>: shares before they are brought to the sum of one."""
    ai_like = (strong >= 1) | (score >= 70) | ((score >= 40) & (strong + weak >= 1))
    three = lambda h, m, a: F.struct(h.alias("human"), m.alias("mixed"), a.alias("ai"))
    return (
        F.when((score < 15) & (strong == 0), three(F.greatest(F.lit(0.6), 1 - soft), F.least(F.lit(0.35), soft * F.lit(0.8)), F.least(F.lit(0.1), soft * F.lit(0.3))))
        .when(ai_like, three(F.greatest(F.lit(0.02), 1 - soft - F.lit(0.05)), F.lit(0.1), soft))
        .otherwise(three(F.greatest(F.lit(0.15), F.lit(0.6) - soft * F.lit(0.5)), F.lit(0.5), soft * F.lit(0.7)))
    )


def _sql() -> str:
    listed = lambda names: ", ".join(f"'{x}'" for x in names)
    number = lambda names: f"len(list_filter(r, lambda x: x IN ({listed(names)})))"
    has = lambda name: f"list_contains(r, '{name}')"
    source = mr.probed_sql()
    bases = mr._measured_sql(source, f"SELECT doc_id, w, len(tier2) AS tier2, {mr._c('raw', f'[{wr.ZERO_WIDTH}]')} >= 2 OR {mr._c('raw', f'[{wr.LOOKALIKES[0]}]')} >= 2 AS hidden FROM k")
    offers = {
        "citation_co_occurrence": f"{has('ai-citation-markup')} AND {has('ai-citation-token')}",
        "finding_breadth": f"n - greatest(0, n_rhythm - 1) - greatest(0, n_furniture - 1) >= 6 AND len(r) - {number(RHYTHM_PACK)} - {number(FURNITURE)} + (n_rhythm > 0)::INT + (n_furniture > 0)::INT >= 4",
        "artefact_score": "artefact AND score >= 10",
        "artefact_floor": "artefact",
        "formatting_floor": has("formatting"),
        "formatting_cluster": f"{number(CLUSTER)} >= 3",
    }
    to = {name: "least(2, base + 1)" if t < 0 else str(t) for name, t in ESCALATIONS}
    # the first offer of the highest class above the base, among those that still raise at their turn
    best = ", ".join(f"CASE WHEN {holds} THEN {{'to': {to[name]}, 'name': '{name}'}} END" for name, holds in offers.items())
    return f"""
WITH x AS ({bases}), fs AS ({mr._ALL_SQL}),
a AS (SELECT doc_id, count(*) AS n, list(DISTINCT rule) AS r, sum(CASE WHEN rule IN ({mr._STYLE_SQL}) THEN weight ELSE 0 END) AS style, sum(CASE WHEN rule IN ({mr._STYLE_SQL}) THEN 0 ELSE weight END) AS other,
  count(*) FILTER (rule IN ({listed(RHYTHM_PACK)})) AS n_rhythm, count(*) FILTER (rule IN ({listed(FURNITURE)})) AS n_furniture, count(DISTINCT matched) FILTER (rule = 'tier1') AS tier1 FROM fs GROUP BY doc_id),
j AS (SELECT x.doc_id, w, tier2, hidden, coalesce(n, 0) AS n, coalesce(r, []) AS r, coalesce(style, 0) AS style, coalesce(other, 0) AS other, coalesce(n_rhythm, 0) AS n_rhythm, coalesce(n_furniture, 0) AS n_furniture, coalesce(tier1, 0) AS tier1 FROM x LEFT JOIN a USING (doc_id)),
s AS (SELECT *, least(100, round((other + least(style, greatest(other, {mr.STYLE_FLOOR}))) / greatest(1.0, log2(w / 50.0))))::BIGINT AS score, {has('cutoff-disclaimer')}::INT + hidden::INT + ({has('reasoning-artifact')} AND {has('chatbot')})::INT + (w >= 150 AND tier1 >= 5 AND tier2 >= 2 AND {has('transition')})::INT AS strong,
  ({number(('punct-distribution', 'cross-para-burstiness', 'fnword-trigram-entropy'))} >= 2)::INT + {has('smart-punct-signature')}::INT AS weak, {number(ARTEFACTS)} >= 1 OR {number(SUPPORT)} >= 2 AS artefact FROM j),
t AS (SELECT *, least(0.97::DOUBLE, score / 100 + (strong + weak) * 0.06::DOUBLE + strong * 0.08::DOUBLE) AS soft FROM s),
p AS (SELECT *, CASE WHEN score < 15 AND strong = 0 THEN [greatest(0.6::DOUBLE, 1 - soft), least(0.35::DOUBLE, soft * 0.8::DOUBLE), least(0.1::DOUBLE, soft * 0.3::DOUBLE)] WHEN strong >= 1 OR score >= 70 OR (score >= 40 AND strong + weak >= 1) THEN [greatest(0.02::DOUBLE, 1 - soft - 0.05::DOUBLE), 0.1::DOUBLE, soft] ELSE [greatest(0.15::DOUBLE, 0.6::DOUBLE - soft * 0.5::DOUBLE), 0.5::DOUBLE, soft * 0.7::DOUBLE] END AS p FROM t),
q AS (SELECT *, round(p[1] / (p[1] + p[2] + p[3]), 3) AS human, round(p[2] / (p[1] + p[2] + p[3]), 3) AS mixed FROM p), u AS (SELECT *, greatest(0.0::DOUBLE, round(1 - human - mixed, 3)) AS ai FROM q),
v AS (SELECT *, CASE WHEN human >= mixed AND human >= ai THEN 0 WHEN mixed >= ai THEN 1 ELSE 2 END AS base, CASE WHEN strong >= 2 OR {has('cutoff-disclaimer')} OR (score < 8 AND w >= 100) THEN 'high' WHEN strong >= 1 OR (score >= 45 AND weak >= 1) OR score < 20 THEN 'medium' ELSE 'low' END AS sure FROM u),
o AS (SELECT *, list_filter([{best}], lambda z: z.to > base) AS offers FROM v),
e AS (SELECT *, CASE WHEN len(offers) = 0 THEN NULL ELSE list_filter(offers, lambda z: z.to = list_max(list_transform(offers, lambda y: y.to)))[1] END AS e FROM o),
z AS (SELECT doc_id, CASE WHEN w <= {MAX_WORDS} THEN 'scored' ELSE 'too_long' END AS status, score, ['{CLASSES[0]}', '{CLASSES[1]}', '{CLASSES[2]}'][coalesce(e.to, base) + 1] AS classification, human, mixed, ai, CASE WHEN artefact AND score >= 10 AND sure = 'low' THEN 'medium' ELSE sure END AS confidence, e.name AS escalation, n::BIGINT AS n_findings, len(r)::BIGINT AS n_rules FROM e)
SELECT doc_id, status, {", ".join(f"CASE WHEN status = 'scored' THEN {c} END AS {c}" for c in ("score", "classification", "human", "mixed", "ai", "confidence", "escalation", "n_findings", "n_rules"))} FROM z
UNION ALL SELECT doc_id, CASE WHEN coalesce(w, 0) = 0 THEN 'empty' ELSE 'too_short' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT doc_id, {mr._w(wr.normalised_sql('text'))} AS w FROM ({source})) WHERE w IS NULL OR w < {wr.MIN_WORDS}
"""


QUERIES = {"editorial_verdicts": lambda s, d: verdicts(mr.probed(documents(s, d)))}
ORACLE_SQL = {"editorial_verdicts": _sql()}
