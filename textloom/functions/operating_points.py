"""Operating points: best ordered cuts, a margin gap under a budget, one threshold for several routes.

All are read off counts per distinct value, so they do not grow with rows; running
sums and maxima over sorted values go by ranges: totals of ranges first, then each
range on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.operators.corpora import conversations
from textloom.operators.stylometry import documents

#: Ranges of sorted values that running results are computed in.
RANGES = 64
#: Shares of a class are whole numbers of this unit, so that ties are ties in every engine.
UNIT = 10**17


def _ranged(values: DataFrame, col: str) -> DataFrame:
    """With ``_range``: ascending ranges of about equally many values."""
    edges = values.select(F.percentile_approx(col, [i / RANGES for i in range(1, RANGES)], 10_000).alias("e")).first()["e"] or []
    return values.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>"), lambda e: e < F.col(col))))


def _running(values: DataFrame, col: str, results: dict[str, tuple]) -> DataFrame:
    """``values`` (with _range) plus running results from the first value on: name -> (aggregate, column, joining of two results)."""
    local = Window.partitionBy("_range").orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    totals = values.groupBy("_range").agg(*[agg(x).alias(f"_t_{name}") for name, (agg, x, _) in results.items()])
    offsets = totals.select("_range", *[agg(F.col(f"_t_{name}")).over(before).alias(f"_o_{name}") for name, (agg, _, _) in results.items()])
    own = values.select("*", *[agg(x).over(local).alias(f"_l_{name}") for name, (agg, x, _) in results.items()])
    joined = own.join(F.broadcast(offsets), "_range")  # RANGES rows
    return joined.select(*values.columns, *[join(F.col(f"_o_{name}"), F.col(f"_l_{name}")).alias(name) for name, (_, _, join) in results.items()])


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + b


def best_cuts(scores: DataFrame, classes: list[str]) -> DataFrame:
    """(balanced_accuracy, cuts) of rows (label, score): the best parting of the score axis into one range per class, in their order.

    Solved exactly: with running counts of each class, the best range edge for a
    class is a running maximum over the edges before.  cuts: the largest score of
    each range but the last (null: the range is empty at the bottom).  Equal scores stay
    together; of equally good edges the lowest counts.  Rows of other labels or
    without a score do not count; a class without rows is never right.
    """
    good = scores.where(F.col("label").isin(*classes) & F.col("score").isNotNull() & ~F.isnan("score"))
    sizes = {r["label"]: r["count"] for r in good.groupBy("label").count().collect()}
    counts = good.groupBy("score").agg(*[F.count_if(F.col("label") == c).alias(f"_n{i}") for i, c in enumerate(classes)])
    at = _running(_ranged(counts, "score"), "score", {"_place": (F.sum, F.lit(1), _plus), **{f"_c{i}": (F.sum, F.col(f"_n{i}"), _plus) for i in range(len(classes))}})
    share = lambda i: F.col(f"_c{i}") * F.lit(UNIT // sizes.get(classes[i], UNIT))
    path = F.array().cast("array<double>")
    state = at.withColumn("_best", share(0)).withColumn("_path", path)
    for i in range(1, len(classes)):
        edge = F.struct((F.col("_best") - share(i)).alias("gain"), (-F.col("_place")).alias("place"), F.concat("_path", F.array("score")).alias("path"))
        bottom = F.struct(F.lit(0).cast("bigint").alias("gain"), F.lit(0).cast("bigint").alias("place"), F.array_repeat(F.lit(None).cast("double"), i).alias("path"))
        state = _running(state, "score", {"_edge": (F.max, edge, lambda a, b: F.greatest(a, b))}).withColumn("_edge", F.greatest(bottom, "_edge"))
        state = state.withColumn("_best", F.col("_edge.gain") + share(i)).withColumn("_path", F.col("_edge.path")).drop("_edge")
    last = state.groupBy().agg(F.max_by(F.struct("_best", "_path"), "score").alias("z"), F.count("*").alias("n")).where("n > 0")
    return last.select(F.round(F.col("z._best") / F.lit(float(UNIT)) / len(classes), 9).alias("balanced_accuracy"), F.array_join(F.transform("z._path", lambda x: F.coalesce(F.round(x, 6).cast("string"), F.lit("-"))), "|").alias("cuts"))


def _micro(x: Column) -> Column:
    """Whole millionths at or below."""
    return F.floor(F.round(x * 1_000_000, 3)).cast("bigint")


def fitted_gap(margins: DataFrame, budget: int, grid: tuple[int, ...] = tuple(range(0, 2_000_001, 20_000))) -> DataFrame:
    """(gap, threshold, n_false, n_found) of rows (side, first, second): the gap that finds most of side 1 with ``budget`` false ones.

    A row's key is the larger of its best margin and its second best plus the gap
    (whole millionths).  For each gap of the grid the threshold lies above the key of
    side 0 that would be one too many; of gaps that find equally many the largest
    counts.  Rows are counted by (gap, key) before anything is sorted.
    """
    slim = margins.where("first is not null").select("side", _micro(F.col("first")).alias("a"), _micro(F.col("second")).alias("b"))
    counts = slim.groupBy("side", "a", "b").count().withColumn("gap", F.explode(F.array(*map(F.lit, grid))))
    keys = counts.groupBy("gap", F.greatest("a", F.col("b") + F.col("gap")).alias("key")).agg(F.sum(F.when(F.col("side") == 0, F.col("count")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("side") == 1, F.col("count")).otherwise(0)).alias("n1"))
    down = Window.partitionBy("gap").orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    fit = keys.withColumn("false", F.sum("n0").over(down)).withColumn("found", F.sum("n1").over(down)).where(F.col("false") <= budget)
    best = fit.groupBy("gap").agg(F.min("key").alias("threshold"), F.max("false").alias("n_false"), F.max("found").alias("n_found"))
    return best.orderBy(F.desc("n_found"), F.desc("gap")).limit(1).select("gap", "threshold", "n_false", "n_found")


# The pair of thresholds whose ratio is kept.
PRIMARY, SECONDARY = 0.9855, 0.9763
RATIO = SECONDARY / PRIMARY


def joint_threshold(scores: DataFrame, targets: dict[str, int]) -> DataFrame:
    """(primary, secondary): the lowest pair of six-decimal thresholds, in a fixed ratio, that keeps every route within its target.

    scores: (route, first, second), the two best scores of a row.  A row is flagged at a primary if
    its first score reaches it or its second the rounded secondary.  Candidates are
    the rows' own keys.  A row is flagged up to one largest candidate, so counts of
    rows by that candidate tell each route's lowest good one, without a search.
    """
    rows = scores.where(F.col("route").isin(*targets) & F.col("first").isNotNull())
    key = F.greatest("first", F.col("second") / F.lit(RATIO))
    counts = rows.groupBy("route", _micro(F.col("first")).alias("a"), _micro(F.col("second")).alias("b"), F.rint(F.round(key * 1_000_000, 3)).cast("bigint").alias("candidate")).count()
    listed = counts.select("candidate").distinct()
    top = listed.agg((F.max("candidate") + 1).alias("candidate"))
    every = listed.union(top)
    secondary = lambda p: F.rint(F.round(p * F.lit(RATIO), 3)).cast("bigint")
    # the largest primary at which a row is flagged: by its first score that score, by its second the largest whose secondary it reaches
    near = F.floor(F.col("b") / F.lit(RATIO)).cast("bigint")
    reach = F.array_max(F.filter(F.sequence(near - 3, near + 3), lambda p: secondary(p) <= F.col("b")))
    reached = counts.select("route", F.greatest("a", reach).alias("upto"), "count").groupBy("route", "upto").agg(F.sum("count").alias("n"))
    down = Window.partitionBy("route").orderBy(F.desc("upto")).rowsBetween(Window.unboundedPreceding, 0)
    budget = F.coalesce(*[F.when(F.col("route") == r, t) for r, t in targets.items()])
    over = reached.withColumn("flagged", F.sum("n").over(down)).where(F.col("flagged") > budget).agg(F.coalesce(F.max("upto"), F.lit(-1)).alias("over"))  # one row
    best = every.crossJoin(F.broadcast(over)).where("candidate > over").agg(F.min("candidate").alias("p")).where("p is not null")
    return best.select((F.col("p") / 1_000_000).alias("primary"), (secondary(F.col("p")) / 1_000_000).alias("secondary"))


# --- queries -------------------------------------------------------------------------------

CLASSES = ["de", "en", "es"]


def _word_lengths(spark, sf_dir: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))
    return documents(spark, sf_dir).where(words > 0).select(F.col("lang").alias("label"), F.round(F.length("text") / words, 3).alias("score"))


def _turn_scores(spark, sf_dir: str) -> DataFrame:
    """(conv_id, route, side, first, second): two best of the scores of a conversation's turns."""
    p = (F.length("text") * 7919 + F.col("turn") * 104_729) % 1_000_003 / F.lit(1_000_003.0)
    best = conversations(spark, sf_dir).where("text is not null").groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_list(p), asc=False), 1, 2).alias("s"))
    return best.select("conv_id", F.when(F.col("conv_id") % 2 == 0, "server").otherwise("client").alias("route"), F.when(F.col("conv_id") % 3 == 0, 0).otherwise(1).alias("side"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"))


CUTS_SQL = rf"""
WITH v AS (SELECT lang AS label, round(length(text) / len(regexp_extract_all(text, '[^ \t\n\r]+')), 3) AS score FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\r]+')) > 0 AND lang IN ({", ".join(f"'{c}'" for c in CLASSES)})),
u AS (SELECT {", ".join(f"{UNIT} // count(*) FILTER (label = '{c}') AS u{i}" for i, c in enumerate(CLASSES))} FROM v),
g AS (SELECT score, {", ".join(f"count(*) FILTER (label = '{c}') AS n{i}" for i, c in enumerate(CLASSES))} FROM v GROUP BY score),
p AS (SELECT score, row_number() OVER (ORDER BY score) AS b, {", ".join(f"sum(n{i}) OVER (ORDER BY score) * u{i} AS c{i}" for i in range(3))} FROM g, u UNION ALL SELECT NULL, 0, 0, 0, 0),
t AS (SELECT {", ".join(f"max(c{i}) AS t{i}" for i in range(3))} FROM p),
s AS (SELECT x.score AS s1, y.score AS s2, x.b AS b1, y.b AS b2, x.c0 + (y.c1 - x.c1) + (t2 - y.c2) AS total FROM p x JOIN p y ON x.b <= y.b, t)
SELECT round(total::DOUBLE / {float(UNIT)}::DOUBLE / 3, 9) AS balanced_accuracy, coalesce(round(s1, 6)::DOUBLE::VARCHAR, '-') || '|' || coalesce(round(s2, 6)::DOUBLE::VARCHAR, '-') AS cuts FROM s ORDER BY total DESC, b2, b1 LIMIT 1
"""
_TURNS_SQL = """
q AS (SELECT conv_id, list_reverse_sort(list((length(text) * 7919 + turn * 104729) % 1000003 / 1000003.0::DOUBLE)) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
z AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'server' ELSE 'client' END AS route, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END AS side, s[1] AS first, s[2] AS second FROM q)
"""
_MICRO = lambda x: f"floor(round({x} * 1000000, 3))::BIGINT"
GAP_SQL = f"""
WITH {_TURNS_SQL}, k AS (SELECT gap, side, greatest({_MICRO('first')}, {_MICRO('second')} + gap) AS key FROM z, (SELECT unnest(range(0, 2000001, 20000)) AS gap)),
c AS (SELECT gap, key, (SELECT count(*) FROM k y WHERE y.gap = x.gap AND y.side = 0 AND y.key >= x.key) AS f, (SELECT count(*) FROM k y WHERE y.gap = x.gap AND y.side = 1 AND y.key >= x.key) AS d FROM k x GROUP BY gap, key),
g AS (SELECT gap, min(key) AS threshold, max(f) AS n_false, max(d) AS n_found FROM c WHERE f <= 3 GROUP BY gap)
SELECT gap::INT AS gap, threshold, n_false, n_found FROM g ORDER BY n_found DESC, gap DESC LIMIT 1
"""
_SECOND = f"round_even(round(p * {RATIO!r}::DOUBLE, 3), 0)::BIGINT"
JOINT_SQL = f"""
WITH {_TURNS_SQL}, m AS (SELECT route, {_MICRO('first')} AS a, {_MICRO('second')} AS b, round_even(round(greatest(first, second / {RATIO!r}::DOUBLE) * 1000000, 3), 0)::BIGINT AS k FROM z),
c AS (SELECT k AS p FROM m UNION SELECT max(k) + 1 FROM m), s AS (SELECT p, {_SECOND} AS s FROM c),
o AS (SELECT p, s, count(*) FILTER (route = 'server' AND (a >= p OR b >= s)) AS n1, count(*) FILTER (route = 'client' AND (a >= p OR b >= s)) AS n2 FROM s, m GROUP BY p, s)
SELECT p / 1000000 AS "primary", s / 1000000 AS secondary FROM o WHERE n1 <= 4 AND n2 <= 6 ORDER BY p LIMIT 1
"""
QUERIES = {
    "best_ordered_cuts": lambda s, d: best_cuts(_word_lengths(s, d), CLASSES),
    "fitted_gap": lambda s, d: fitted_gap(_turn_scores(s, d), 3),
    "joint_threshold": lambda s, d: joint_threshold(_turn_scores(s, d), {"server": 4, "client": 6}),
}
ORACLE_SQL = {"best_ordered_cuts": CUTS_SQL, "fitted_gap": GAP_SQL, "joint_threshold": JOINT_SQL}
