"""Quotas over an event stream: sliding load, tumbling hours, replays, state checks.

The functions take a batch or (where marked) a streaming DataFrame of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Seconds of the sliding spans.
SPANS = {"minute": 60, "hour": 3_600, "day": 86_400}


#: Cost limits of the spans.
LIMITS = {"minute": 60.0, "hour": 300.0, "day": 900.0}


def sliding_load(events: DataFrame) -> DataFrame:
    """Events and cost of the same user within each span up to and including every event, and whether all spans stay within their limit."""
    rows = events.select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("cost"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    over = lambda span: Window.partitionBy("user_id").orderBy("s").rangeBetween(-span, 0)
    loads = rows.select("event_id", *[F.count("*").over(over(span)).alias(f"load_{name}") for name, span in SPANS.items()], *[F.round(F.sum("cost").over(over(span)), 4).alias(f"cost_{name}") for name, span in SPANS.items()])
    within = F.lit(True)
    for name in SPANS:
        within &= F.col(f"cost_{name}") <= LIMITS[name]
    return loads.withColumn("within", within)


LOAD_SQL = (
    "WITH e AS (SELECT event_id, user_id, coalesce(value, 0) AS cost, floor(epoch(ts))::BIGINT AS s FROM events), l AS (SELECT event_id, "
    + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {span} PRECEDING AND CURRENT ROW) AS load_{name}, round(sum(cost) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {span} PRECEDING AND CURRENT ROW), 4) AS cost_{name}" for name, span in SPANS.items())
    + " FROM e) SELECT *, " + " AND ".join(f"cost_{name} <= {LIMITS[name]}::DOUBLE" for name in SPANS) + " AS within FROM l"
)


def daily_quota(events: DataFrame, quota: int = 5) -> DataFrame:
    """Batch: events per user and day, those beyond the quota, and the first event that was."""
    days = events.select("user_id", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "event_id", "ts")
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return days.withColumn("i", place).groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("i") > quota).alias("n_over"), F.min(F.when(F.col("i") == quota + 1, F.col("event_id"))).alias("first_over"))


DAILY_SQL = "WITH p AS (SELECT user_id, ts::DATE AS day, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS i FROM events) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (i > 5) AS n_over, min(CASE WHEN i = 6 THEN event_id END) AS first_over FROM p GROUP BY ALL"


def hourly_quota(events: DataFrame, quota: int = 2, delay: str = "2 hours") -> DataFrame:
    """Streaming or batch: events per user and hour, and those beyond the quota; late events wait ``delay``."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = stamped.withWatermark("ts", delay) if events.isStreaming else stamped
    counted = marked.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("hour_start"), "user_id", "n", F.greatest(F.lit(0), F.col("n") - quota).cast("bigint").alias("over"))


HOURLY_SQL = "SELECT (floor(epoch(ts) / 3600)::BIGINT * 3600) AS hour_start, user_id, count(*) AS n, greatest(0, count(*) - 2)::BIGINT AS over FROM events GROUP BY 1, 2"


def single_use(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming or batch: (event_id, user_id, event_type) of the first event of each (user, type, day) key; replays go."""
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    if events.isStreaming:
        return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("event_id", "user_id", "event_type")
    return keyed.groupBy("user_id", "event_type", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id", "user_id", "event_type")


SINGLE_SQL = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS i FROM events) WHERE i = 1"

#: States that may follow a state; the first state of a log is always legal.
LEGAL = (("view", "view"), ("view", "click"), ("click", "view"), ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("click", "error"), ("error", "view"))


def transitions(events: DataFrame, legal: tuple[tuple[str, str], ...] = LEGAL) -> DataFrame:
    """How often each state follows each other one within a user's log, and whether it may."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("previous", F.lag("event_type").over(order))
    counts = steps.groupBy("previous", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    step = F.concat_ws(">", "previous", "event_type")
    return counts.withColumn("legal", F.col("previous").isNull() | step.isin(*[f"{a}>{b}" for a, b in legal]))


TRANSITIONS_SQL = "WITH s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT previous, event_type, count(*) AS n, count(DISTINCT user_id) AS users, previous IS NULL OR previous || '>' || event_type IN (" + ", ".join(f"'{a}>{b}'" for a, b in LEGAL) + ") AS legal FROM s GROUP BY 1, 2"


def _events(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


QUERIES = {
    "sliding_load": lambda s, d: sliding_load(_events(s, d)),
    "daily_quota": lambda s, d: daily_quota(_events(s, d)),
    "hourly_quota": lambda s, d: hourly_quota(_events(s, d)),
    "single_use_ledger": lambda s, d: single_use(_events(s, d)),
    "state_transitions": lambda s, d: transitions(_events(s, d)),
}
ORACLE_SQL = {"sliding_load": LOAD_SQL, "daily_quota": DAILY_SQL, "hourly_quota": HOURLY_SQL, "single_use_ledger": SINGLE_SQL, "state_transitions": TRANSITIONS_SQL}
