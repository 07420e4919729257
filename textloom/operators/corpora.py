"""Joins, set operations, listings and counts over corpora.

Joins are equi-joins on keys or hashes; the sides that repeat (held-out hashes,
word lists) are small tables whose size the optimiser sees, so it broadcasts or
shuffles them by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textloom.functions.text import norm_key
from textloom.operators import writing_rules as wr
from textloom.operators.forensics import FACTS
from textloom.operators.rules import STOCK_PHRASES
from textloom.operators.stylometry import documents, spread

_WORDS = r"[^ \t\n\r]+"
_NORM_SQL = r"sha256(lower(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))))"


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def conversations(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


# --- held-out guards -----------------------------------------------------------------


def outside(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Documents whose normal form is not among the held-out texts."""
    guard = held.where("text is not null").select(norm_key(F.col("text")).alias("h")).distinct()
    return docs.withColumn("h", norm_key(F.col("text"))).join(guard, "h", "left_anti")


def leaks(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(h, n, first_id): held-out normal forms that stand among the documents; a hard guard stops if there is a row."""
    guard = held.where("text is not null").select(norm_key(F.col("text")).alias("h")).distinct()
    return docs.withColumn("h", norm_key(F.col("text"))).join(guard, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def without_leaks(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``docs`` as they are; an error if the normal form of one is among the held-out texts."""
    found = leaks(docs, held).orderBy("first_id").limit(3).collect()
    if found:
        raise ValueError(f"held-out texts among the documents, first in {[r['first_id'] for r in found]}")
    return docs


def _held(spark, sf_dir: str) -> DataFrame:
    """The texts of documents with label quality 0, as a held-out corpus."""
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").select("doc_id").distinct()
    return documents(spark, sf_dir).join(bad, "doc_id", "left_semi").select("text")


_HELD_SQL = f"h AS (SELECT DISTINCT {_NORM_SQL} AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND text IS NOT NULL), k AS (SELECT doc_id, {_NORM_SQL} AS h FROM documents)"


# --- pairs ---------------------------------------------------------------------------


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Each turn with the one before it in its conversation: overlap of their words, and words that are new.

    The join is on (conv_id, turn), so no conversation has to fit a task.
    """
    tok = turns.where("text is not null").select("conv_id", "turn", "role", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0))).alias("w"))
    before = tok.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v"), F.col("role").alias("before"))
    both = tok.join(before, ["conv_id", "turn"])
    same = F.size(F.array_intersect("w", "v"))
    mean = (F.size("w") + F.size("v")) / 2.0
    return both.select("conv_id", "turn", "role", "before", F.size(F.array_except("w", "v")).cast("bigint").alias("n_new"), F.round(F.when(mean > 0, same * 100.0 / mean).otherwise(0.0), 1).alias("overlap_percent"))


TURN_PAIRS_SQL = rf"""
WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '{_WORDS}')) AS w FROM conversations WHERE text IS NOT NULL)
SELECT a.conv_id, a.turn, a.role, b.role AS before, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x)))::BIGINT AS n_new,
  round(CASE WHEN len(a.w) + len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) * 100.0::DOUBLE / ((len(a.w) + len(b.w)) / 2) ELSE 0 END, 1) AS overlap_percent
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
"""


def matched_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One to one, without replacement: documents of either quality in the same language and length bin, by hash order.

    Ranks run within (language, bin, side) and the first digit of the hash, with
    offsets from a histogram, so that a large bin does not sit in one task.
    """
    from textloom.operators.corpus import ranked

    side = labels.where("quality is not null").select("doc_id", F.col("quality").alias("side"))
    rows = docs.where("length(text) > 0").join(side, "doc_id").select("doc_id", "side", "lang", F.floor(F.log10(F.length("text").cast("double")) * 4).alias("bin"), F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("h"))
    placed = ranked(rows, ["side", "lang", "bin"], "h").select("side", "lang", "bin", "doc_id", "before")
    one = lambda s, name: placed.where(F.col("side") == s).select(F.coalesce("lang", F.lit("")).alias("lang"), "bin", "before", F.col("doc_id").alias(name))
    return one(0, "low_id").join(one(1, "high_id"), ["lang", "bin", "before"]).select("lang", "bin", "low_id", "high_id")


MATCHED_SQL = """
WITH r AS (SELECT doc_id, quality AS side, coalesce(lang, '') AS lang, floor(log10(length(text)::DOUBLE) * 4)::BIGINT AS bin FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND length(text) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY side, lang, bin ORDER BY sha256(doc_id::VARCHAR)) AS n FROM r)
SELECT a.lang, a.bin, a.doc_id AS low_id, b.doc_id AS high_id FROM p a JOIN p b ON a.lang = b.lang AND a.bin = b.bin AND a.n = b.n AND a.side = 0 AND b.side = 1
"""


# --- lexicon and spans --------------------------------------------------------------------


def lexicon_counts(docs: DataFrame, words: tuple[str, ...] = wr.TIER3) -> DataFrame:
    """(doc_id, word, n): listed words of every document, found by an equi-join with the list; counted map-side first."""
    lexicon = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    tok = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z-]+"), F.lit(0))).alias("word"))
    return tok.join(F.broadcast(lexicon), "word").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


LEXICON_SQL = "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z-]+')) AS word FROM (" + wr.probed_sql() + ")) WHERE word IN (" + ", ".join(f"'{w}'" for w in (*wr.TIER1, *wr.TIER3)) + ") GROUP BY ALL"

#: Kinds of facts whose spans findings are held against.
SPAN_KINDS = ("quote", "number", "url", "citation")


def fact_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, stop) of protected facts, in code points."""
    spans = F.concat(*[F.transform(wr.hits(wr.Rule(k, 0, "low", (FACTS[k],), fold=False), F.col("text")), lambda h: F.struct(F.lit(k).alias("kind"), h["start"].alias("start"), (h["start"] + F.length(h["matched"])).alias("stop"))) for k in SPAN_KINDS])
    return docs.where("text is not null").select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")


def protected_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, start, kind, fact_start): findings that overlap a protected fact."""
    found = wr.wording_findings(docs).select("doc_id", "rule", "start", (F.col("start") + F.length("matched")).alias("stop"))
    facts = fact_spans(docs).withColumnsRenamed({"start": "fact_start", "stop": "fact_stop"})
    return found.join(facts, "doc_id").where("start < fact_stop and stop > fact_start").select("doc_id", "rule", "start", "kind", "fact_start")


def _span_sql(source: str) -> str:
    parts = []
    for k in SPAN_KINDS:
        rx = FACTS[k].replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{k}' AS kind, (list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(part[1:j - 1], lambda x: length(x))), 0))::INT AS fact_start, length(part[j]) AS size "
            f"FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS part, string_split_regex(text, '{rx}') AS between, unnest(range(1, len(part) + 1)) AS j FROM ({source}) WHERE text IS NOT NULL)"
        )
    return " UNION ALL ".join(parts)


PROTECTED_SQL = f"SELECT f.doc_id, rule, start, kind, fact_start FROM ({wr.wording_sql(wr.probed_sql())}) f JOIN ({_span_sql(wr.probed_sql())}) s ON f.doc_id = s.doc_id AND start < fact_start + size AND start + length(matched) > fact_start"


def without_base_spans(docs: DataFrame) -> DataFrame:
    """Findings but for those whose span a stock phrase of the base pack has exactly."""
    base = wr.Rule("base", 0, "low", tuple(rf"\b{p}\b" for p in STOCK_PHRASES))
    spans = docs.where("text is not null").select("doc_id", F.explode(wr.hits(base, F.col("text"), normal=True)).alias("h")).select("doc_id", "h.start", F.lower("h.matched").alias("matched"))
    return wr.wording_findings(docs).join(spans, ["doc_id", "start", "matched"], "left_anti").select("doc_id", "rule", "matched", "start")


_BASE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, lower(part[j]) AS matched, (list_sum(list_transform(between[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(part[1:j - 1], lambda x: length(x))), 0))::INT AS start FROM (SELECT doc_id, regexp_extract_all(t, '(?i)\\b{wr._q(p)}\\b') AS part, string_split_regex(t, '(?i)\\b{wr._q(p)}\\b') AS between, unnest(range(1, len(part) + 1)) AS j FROM (SELECT doc_id, {wr.normalised_sql('text')} AS t FROM ({wr.probed_sql()})))"
    for p in STOCK_PHRASES
)
WITHOUT_BASE_SQL = f"SELECT f.doc_id, rule, f.matched, f.start FROM ({wr.wording_sql(wr.probed_sql())}) f WHERE NOT EXISTS (SELECT 1 FROM ({_BASE_SQL}) b WHERE b.doc_id = f.doc_id AND b.start = f.start AND b.matched = f.matched)"


def rule_pairs(findings: DataFrame) -> DataFrame:
    """(a, b, n_both, jaccard) of rules that fire in the same documents; pairs of the rules of a document, not of documents."""
    fired = findings.groupBy("doc_id").agg(F.array_sort(F.collect_set("rule")).alias("r"))
    single = fired.select(F.explode("r").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    pairs = fired.select(F.explode(F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, 1 << 20), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    both = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n_both"))
    named = both.join(F.broadcast(single.withColumnsRenamed({"rule": "a", "n": "n_a"})), "a").join(F.broadcast(single.withColumnsRenamed({"rule": "b", "n": "n_b"})), "b")  # a row per rule
    return named.select("a", "b", "n_both", F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 6).alias("jaccard"))


RULE_PAIRS_SQL = f"""
WITH f AS MATERIALIZED (SELECT DISTINCT doc_id, rule FROM ({wr.wording_sql(wr.probed_sql())})), n AS (SELECT rule, count(*) AS n FROM f GROUP BY 1),
p AS (SELECT x.rule AS a, y.rule AS b, count(*) AS n_both FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.rule < y.rule GROUP BY 1, 2)
SELECT a, b, n_both, round(n_both / (i.n + j.n - n_both), 6) AS jaccard FROM p JOIN n i ON i.rule = a JOIN n j ON j.rule = b
"""


# --- unions, listings, islands ---------------------------------------------------------------


def union_of_corpora(spark, sf_dir: str) -> DataFrame:
    """(corpus, n, n_words, longest): documents, conversations and benchmark items as one corpus, in one pass."""
    tables = [(documents(spark, sf_dir), "documents"), (conversations(spark, sf_dir), "conversations"), (_table(spark, sf_dir, "benchmark"), "benchmark")]
    every = None
    for table, name in tables:
        part = table.withColumn("corpus", F.lit(name))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    words = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0))
    return every.groupBy("corpus").agg(F.count("*").alias("n"), F.sum(words).cast("bigint").alias("n_words"), F.max(words).cast("bigint").alias("longest"), F.count("lang").alias("n_lang"))


UNION_SQL = rf"""
WITH u AS (SELECT 'documents' AS corpus, text, lang FROM documents UNION ALL SELECT 'conversations', text, NULL FROM conversations UNION ALL SELECT 'benchmark', text, NULL FROM benchmark)
SELECT corpus, count(*) AS n, sum(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0))::BIGINT AS n_words, max(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0))::BIGINT AS longest, count(lang) AS n_lang FROM u GROUP BY 1
"""


def last_by_key(turns: DataFrame) -> DataFrame:
    """The last turn of each (conversation, role): a later row of the key replaces an earlier one."""
    return turns.groupBy("conv_id", "role").agg(F.max_by(F.struct("turn", "text"), "turn").alias("x")).select("conv_id", "role", "x.turn", F.length("x.text").cast("bigint").alias("size"))


LAST_SQL = "SELECT conv_id, role, turn, length(text)::BIGINT AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1"


def role_islands(turns: DataFrame) -> DataFrame:
    """Runs of turns by one role: (conv_id, role, first, n), from the turns at which the role changes.

    Every other role marks a change, so a run's turns share the number of changes before them.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    change = F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))
    run = turns.withColumn("c", change).withColumn("run", F.sum("c").over(order))
    return run.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first"), F.count("*").alias("n")).select("conv_id", "role", "first", "n")


ISLANDS_SQL = """
WITH c AS (SELECT *, coalesce((lag(role) OVER w <> role)::INT, 1) AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT conv_id, role, min(turn) AS first, count(*) AS n FROM r GROUP BY conv_id, run, role
"""


def turn_verdicts(turns: DataFrame, gap: float = 0.34, threshold: float = 3.570935) -> DataFrame:
    """Verdict of every conversation from the scores of its turns: the largest, or the second with a bonus; and what their spread is.

    A turn's score is ln(1 + words).  Order for scoring: middle turn, last, first, then the rest.
    """
    scored = turns.select("conv_id", "turn", F.log1p(F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("double")).alias("m"))
    per = scored.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("m"), False).alias("v"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.array_sort(F.collect_list("turn")).alias("t"))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    middle = F.get("t", F.floor(F.size("t") / 2).cast("int"))
    order = F.array_distinct(F.concat(F.array(middle, F.col("hi"), F.col("lo")), F.col("t")))
    median = (F.get("v", F.floor((F.size("v") - 1) / 2).cast("int")) + F.get("v", F.floor(F.size("v") / 2).cast("int"))) / 2
    return per.select(
        "conv_id", "n", F.round(first, 6).alias("largest"), F.round(second, 6).alias("second"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(median, 6).alias("median"),
        F.round(first - F.element_at("v", -1), 6).alias("spread"), F.round(F.size(F.filter("v", lambda x: x >= 3.0)) / F.col("n"), 6).alias("share_over_3"),
        (F.greatest(first, F.coalesce(second + gap, first)) >= threshold).alias("flagged"), F.array_join(order, ",").alias("scoring_order"),
    )


VERDICTS_SQL = rf"""
WITH s AS (SELECT conv_id, turn, ln(1 + coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::DOUBLE) AS m FROM conversations),
p AS (SELECT conv_id, count(*) AS n, list(m ORDER BY m DESC) AS v, avg(m) AS mean, stddev_pop(m) AS sd, median(m) AS med, min(m) AS low, list(turn ORDER BY turn) AS t FROM s GROUP BY 1),
o AS (SELECT *, list_concat([t[len(t) // 2 + 1], t[len(t)], t[1]], t) AS q FROM p)
SELECT conv_id, n, round(v[1], 6) AS largest, round(v[2], 6) AS second, round(mean, 6) AS mean, round(sd, 6) AS sd, round(med, 6) AS median, round(v[1] - low, 6) AS spread,
  round(len(list_filter(v, lambda x: x >= 3.0)) / n, 6) AS share_over_3, greatest(v[1], coalesce(v[2] + 0.34::DOUBLE, v[1])) >= 3.570935::DOUBLE AS flagged,
  array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), ',') AS scoring_order FROM o
"""


def status_pivot(events: DataFrame) -> DataFrame:
    """Events of every user by type, one column each; the list of types is fixed, so one job does it."""
    types = ("click", "view", "purchase", "error")
    return events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types], F.count_if(~F.col("event_type").isin(*types)).alias("n_other"))


STATUS_SQL = "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'error')) AS n_other FROM events GROUP BY 1"


def manifest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents and characters by each of four dimensions, and overall; one pass, grouping sets."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(marks, "doc_id", "left").withColumn("size_band", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long"))
    dims = ["lang", "source", "size_band", "quality"]
    return rows.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum("toxic").alias("n_toxic")).select(*dims, "level", "n", "chars", "n_toxic")


MANIFEST_SQL = """
WITH m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
r AS (SELECT lang, source, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS size_band, quality, n_chars, toxic FROM documents LEFT JOIN m USING (doc_id))
SELECT lang, source, size_band, quality, grouping(lang, source, size_band, quality)::BIGINT AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(toxic)::BIGINT AS n_toxic FROM r GROUP BY GROUPING SETS ((lang), (source), (size_band), (quality), ())
"""


def top_words(docs: DataFrame, k: int = 50) -> DataFrame:
    """The k most frequent words of the corpus, ties by word."""
    tok = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("word"))
    return tok.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


TOP_WORDS_SQL = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 50"


def recent_repeats(events: DataFrame, history: int = 64) -> DataFrame:
    """(user_id, event_type, n, n_masked): events whose kind stood among the user's last ``history`` ones."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    placed = events.withColumn("p", F.row_number().over(order))
    before = F.lag("p").over(Window.partitionBy("user_id", "event_type").orderBy("p"))
    return placed.withColumn("masked", F.coalesce((F.col("p") - before <= history).cast("int"), F.lit(0))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("masked").alias("n_masked"))


REPEATS_SQL = "WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), l AS (SELECT *, p - lag(p) OVER (PARTITION BY user_id, event_type ORDER BY p) AS gap FROM p) SELECT user_id, event_type, count(*) AS n, sum(coalesce((gap <= 64)::INT, 0))::BIGINT AS n_masked FROM l GROUP BY ALL"


def near_equal_cuts(turns: DataFrame, limit: int = 120) -> DataFrame:
    """Turns dealt to the fewest near-equal parts of at most about ``limit`` words: part by the running total of words."""
    sized = turns.select("conv_id", "turn", F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("bigint").alias("w"))
    total = sized.groupBy("conv_id").agg(F.sum("w").alias("total"))
    running = sized.withColumn("upto", F.sum("w").over(Window.partitionBy("conv_id").orderBy("turn"))).join(total, "conv_id")
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / limit))
    part = F.least(parts - 1, F.floor((F.col("upto") - F.col("w") / 2) * parts / F.greatest(F.col("total"), F.lit(1))))
    return running.select("conv_id", "turn", "upto", parts.cast("bigint").alias("parts"), part.cast("bigint").alias("part"))


CUTS_SQL = rf"""
WITH s AS (SELECT conv_id, turn, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS w FROM conversations),
r AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, sum(w) OVER (PARTITION BY conv_id) AS total FROM s)
SELECT conv_id, turn, upto::BIGINT AS upto, greatest(1, ceil(total / 120))::BIGINT AS parts, least(greatest(1, ceil(total / 120)) - 1, floor((upto - w / 2) * greatest(1, ceil(total / 120)) / greatest(total, 1)))::BIGINT AS part FROM r
"""


def latest(events: DataFrame, n: int = 20) -> DataFrame:
    """The newest n events."""
    return events.select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(n)


QUERIES = {
    "held_out_guard": lambda s, d: outside(documents(s, d), _held(s, d)).select("doc_id", "h"),
    "held_out_leaks": lambda s, d: leaks(documents(s, d), _held(s, d)),
    "turn_pairs": lambda s, d: turn_pairs(conversations(s, d)),
    "matched_sample": lambda s, d: matched_sample(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
    "lexicon_counts": lambda s, d: lexicon_counts(wr.probed(documents(s, d)), (*wr.TIER1, *wr.TIER3)),
    "protected_findings": lambda s, d: protected_findings(wr.probed(documents(s, d))),
    "findings_without_base": lambda s, d: without_base_spans(wr.probed(documents(s, d))),
    "rule_pairs": lambda s, d: rule_pairs(wr.wording_findings(wr.probed(documents(s, d)))),
    "union_of_corpora": union_of_corpora,
    "last_by_key": lambda s, d: last_by_key(conversations(s, d)),
    "role_islands": lambda s, d: role_islands(conversations(s, d)),
    "turn_verdicts": lambda s, d: turn_verdicts(conversations(s, d)),
    "status_pivot": lambda s, d: status_pivot(_table(s, d, "events")),
    "corpus_manifest": lambda s, d: manifest(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
    "top_words": lambda s, d: top_words(documents(s, d)),
    "recent_repeats": lambda s, d: recent_repeats(_table(s, d, "events")),
    "near_equal_cuts": lambda s, d: near_equal_cuts(conversations(s, d)),
    "latest_events": lambda s, d: latest(_table(s, d, "events")),
}
ORACLE_SQL = {
    "held_out_guard": f"WITH {_HELD_SQL} SELECT doc_id, h FROM k WHERE h IS NULL OR h NOT IN (SELECT h FROM h)",
    "held_out_leaks": f"WITH {_HELD_SQL} SELECT h, count(*) AS n, min(doc_id) AS first_id FROM k WHERE h IN (SELECT h FROM h) GROUP BY h",
    "turn_pairs": TURN_PAIRS_SQL,
    "matched_sample": MATCHED_SQL,
    "lexicon_counts": LEXICON_SQL,
    "protected_findings": PROTECTED_SQL,
    "findings_without_base": WITHOUT_BASE_SQL,
    "rule_pairs": RULE_PAIRS_SQL,
    "union_of_corpora": UNION_SQL,
    "last_by_key": LAST_SQL,
    "role_islands": ISLANDS_SQL,
    "turn_verdicts": VERDICTS_SQL,
    "status_pivot": STATUS_SQL,
    "corpus_manifest": MANIFEST_SQL,
    "top_words": TOP_WORDS_SQL,
    "recent_repeats": REPEATS_SQL,
    "near_equal_cuts": CUTS_SQL,
    "latest_events": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
}
