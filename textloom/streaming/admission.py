"""Admission under limits, where a refused event costs nothing: sliding spans, paced allowance, channel floors.

Whether an event is admitted hangs on what was admitted before it, so a key's events
are folded in order of time.  Batches sort them by key and fold a key as its rows
come by; only the key's state is held, not its events.  Streams keep the state in
Spark's store and wait with an event until the watermark has passed it (timers), so that
both admit the same events.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400


class SlidingLimiter:
    """Costs within each span stay within its limit; an event counts in a span for less than its seconds."""

    def __init__(self, limits: tuple[tuple[int, float], ...], state: str | None = None) -> None:
        self.limits = sorted(limits)
        self.events: deque[tuple[float, float]] = deque(tuple(e) for e in json.loads(state or "[]"))

    def admit(self, t: float, cost: float, channel: str) -> tuple[bool, int, str]:
        """(admitted, seconds to wait, the span in seconds that refused)."""
        while self.events and t - self.events[0][0] >= self.limits[-1][0]:
            self.events.popleft()
        for span, limit in self.limits:
            live = [e for e in self.events if t - e[0] < span]
            if sum(c for _, c in live) + cost > limit:
                return False, max(1, int(span - (t - (live[0][0] if live else t)))), str(span)
        self.events.append((t, cost))
        return True, 0, ""

    def state(self) -> str:
        return json.dumps(list(self.events))


class PacedQuota:
    """A day's cap that accrues from a burst on, of which channels have floors that pass to all as the day goes by."""

    def __init__(self, cap: int, burst: int, floors: tuple[tuple[str, int], ...], state: str | None = None) -> None:
        self.cap, self.burst = cap, burst
        self.floors = {c: max(0, cap * percent // 100) for c, percent in floors}
        self.day, self.used = json.loads(state or "[-1, {}]")

    def allowance(self, elapsed: int) -> int:
        """How much of the cap may be spent so many seconds into the day."""
        if self.burst >= self.cap:
            return self.cap
        return min(self.cap, int(self.burst + (self.cap - self.burst) * elapsed / DAY))

    def wait(self, elapsed: int, needed: int) -> int:
        """Seconds until the allowance reaches ``needed``; to the day's end if it never does."""
        left = DAY - elapsed
        if self.burst >= self.cap or needed > self.cap:
            return max(1, left)
        short = needed - self.allowance(elapsed)
        return 1 if short <= 0 else max(1, min(left, int(short / ((self.cap - self.burst) / DAY)) + 1))

    def held(self, channel: str, elapsed: int) -> int:
        """What of a channel's unspent floor the others cannot have yet."""
        return int(max(0, self.floors[channel] - self.used.get(channel, 0)) * (DAY - elapsed) / DAY)

    def admit(self, t: float, cost: int, channel: str) -> tuple[bool, int, str]:
        day, elapsed = int(t // DAY), int(t % DAY)
        if day != self.day:
            self.day, self.used = day, {}
        spent, mine, floor = sum(self.used.values()), self.used.get(channel, 0), self.floors.get(channel, 0)
        if spent + cost > self.allowance(elapsed):
            return False, self.wait(elapsed, spent + int(cost)), "paced_allowance"
        pool = max(0, self.cap - spent - sum(self.held(c, elapsed) for c in self.floors if c != channel))
        if mine + cost > floor and cost > pool:
            return False, max(1, DAY - elapsed), "channel_floor_exhausted" if mine >= floor else "shared_pool_exhausted"
        self.used[channel] = mine + cost
        return True, 0, ""

    def state(self) -> str:
        return json.dumps([self.day, self.used])


Rule = Callable[[str | None], SlidingLimiter | PacedQuota]
OUT = "event_id bigint, admitted boolean, wait bigint, reason string"


def admissions(events: DataFrame, rule: Rule) -> DataFrame:
    """(event_id, admitted, wait, reason) of rows (event_id, key, ts, cost, channel), in batch or stream.

    Events of a key go by (ts, event_id); a null key is a key.  In a stream, events
    later than the watermark are dropped, as Spark does.
    """
    return _streamed(events, rule) if events.isStreaming else _folded(events, rule)


def _folded(events: DataFrame, rule: Rule) -> DataFrame:
    slim = events.select("key", F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id", F.col("cost").cast("double").alias("cost"), "channel")
    ordered = slim.repartition("key").sortWithinPartitions("key", "t", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, limiter = object(), None
        for batch in batches:
            rows = []
            for key, t, event, cost, channel in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now or limiter is None:
                    now, limiter = key, rule(None)
                rows.append((event, *limiter.admit(t, cost, channel)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["event_id", "admitted", "wait", "reason"])

    return ordered.mapInArrow(run, OUT)


def _processor(rule: Rule) -> StatefulProcessor:
    class Waiting(StatefulProcessor):
        """Holds events until the watermark passes them; the limiter's state is one text."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.limiter = handle.getValueState("limiter", "state string")
            self.waiting = handle.getListState("waiting", "t double, event_id bigint, cost double, channel string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            for part in rows:
                for r in part.itertuples(index=False):
                    self.waiting.appendValue((float(r.t), int(r.event_id), float(r.cost), r.channel))
                    self.handle.registerTimer(int(r.t * 1000) + 1)
            yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "admitted": pd.Series(dtype="bool"), "wait": pd.Series(dtype="int64"), "reason": pd.Series(dtype="object")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() / 1000
            held = sorted(tuple(r) for r in self.waiting.get())
            due = [r for r in held if r[0] < passed]
            if due:
                limiter = rule(self.limiter.get()[0] if self.limiter.exists() else None)
                out = [(event, *limiter.admit(t, cost, channel)) for t, event, cost, channel in due]
                self.limiter.update((limiter.state(),))
                self.waiting.put(held[len(due) :]) if len(due) < len(held) else self.waiting.clear()
                yield pd.DataFrame(out, columns=["event_id", "admitted", "wait", "reason"])

        def close(self) -> None:
            pass

    return Waiting()


def _streamed(events: DataFrame, rule: Rule, delay: str = "1 hour") -> DataFrame:
    """Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slim = stamped.select("key", "ts", F.col("ts").cast("double").alias("t"), "event_id", "cost", "channel")
    return slim.groupBy("key").transformWithStateInPandas(_processor(rule), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


# --- queries ---------------------------------------------------------------------------------

LIMITS = ((3_600, 120.0), (DAY, 250.0), (7 * DAY, 900.0))
CAP, BURST, FLOORS = 90, 12, (("view", 20), ("click", 20), ("purchase", 30))


def limited(spark, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return admissions(events.select("event_id", F.col("user_id").alias("key"), "ts", F.round(F.coalesce("value", F.lit(0.0))).alias("cost"), F.col("event_type").alias("channel")), lambda state: SlidingLimiter(LIMITS, state))


def paced(spark, sf_dir: str) -> DataFrame:
    """A quota per site, a site being the users of one remainder of three."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return admissions(events.select("event_id", (F.col("user_id") % 3).alias("key"), "ts", (F.col("event_id") % 4 + 1).alias("cost"), F.col("event_type").alias("channel")), lambda state: PacedQuota(CAP, BURST, FLOORS, state))


_SPENT = lambda span, limit: f"(coalesce(list_sum(list_transform(list_filter(a, lambda x: t - x.t < {span}), lambda x: x.c)), 0) + c > {limit}::DOUBLE)"
LIMITED_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id AS u, epoch(ts)::DOUBLE AS t, round(coalesce(value, 0)) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT u, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted, 0 AS wait, '' AS reason, []::STRUCT(t DOUBLE, c DOUBLE)[] AS a FROM e
  UNION ALL SELECT u, k, event_id, span = 0, CASE WHEN span = 0 THEN 0 ELSE greatest(1, trunc(span - (t - coalesce(list_min(list_transform(list_filter(a, lambda x: t - x.t < span), lambda x: x.t)), t))))::INT END, CASE WHEN span = 0 THEN '' ELSE span::VARCHAR END, CASE WHEN span = 0 THEN list_append(a, {{'t': t, 'c': c}}) ELSE a END
  FROM (SELECT e.u, e.k, e.event_id, e.t, e.c, s.a, CASE {" ".join(f"WHEN {_SPENT(span, limit)} THEN {span}" for span, limit in LIMITS)} ELSE 0 END AS span FROM s JOIN e ON e.u = s.u AND e.k = s.k + 1))
SELECT event_id, admitted, wait::BIGINT AS wait, reason FROM s WHERE k > 0
"""
_CHANNELS = [c for c, _ in FLOORS]
_FLOOR = {c: CAP * p // 100 for c, p in FLOORS}
_HELD = lambda c: f"trunc(greatest(0, {_FLOOR[c]} - u_{c}) * ({DAY} - el) / {DAY}.0::DOUBLE)"
_NEXT = ", ".join(f"CASE WHEN reason = '' AND ch = '{c}' THEN u_{c} + c ELSE u_{c} END AS u_{c}" for c in _CHANNELS) + ", CASE WHEN reason = '' AND ch NOT IN (" + ", ".join(f"'{c}'" for c in _CHANNELS) + ") THEN u_other + c ELSE u_other END AS u_other"
_USED = [f"u_{c}" for c in (*_CHANNELS, "other")]
_MINE = "CASE ch " + " ".join(f"WHEN '{c}' THEN u_{c}" for c in _CHANNELS) + " ELSE 0 END"
_OWN = "CASE ch " + " ".join(f"WHEN '{c}' THEN {_FLOOR[c]}" for c in _CHANNELS) + " ELSE 0 END"
_ALLOWED = f"least({CAP}, trunc({BURST} + {CAP - BURST} * el / {DAY}.0::DOUBLE))"
#: Only channels with a floor are told apart; in the first three the query's channel has a floor, in others its own use does not matter.
PACED_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id % 3 AS site, event_type AS ch, (event_id % 4 + 1) AS c, ts::DATE AS day, floor(epoch(ts))::BIGINT % {DAY} AS el, row_number() OVER (PARTITION BY user_id % 3, ts::DATE ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT site, day, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::BIGINT AS wait, '' AS reason, {", ".join(f"0::BIGINT AS {u}" for u in _USED)} FROM e
  UNION ALL SELECT site, day, k, event_id, CASE reason WHEN '' THEN 0 WHEN 'paced_allowance' THEN CASE WHEN spent + c > {CAP} THEN greatest(1, {DAY} - el) ELSE greatest(1, least({DAY} - el, trunc((spent + c - allowed) / ({CAP - BURST}.0::DOUBLE / {DAY})) + 1)) END ELSE greatest(1, {DAY} - el) END::BIGINT, reason, {_NEXT}
  FROM (SELECT *, CASE WHEN spent + c > allowed THEN 'paced_allowance' WHEN mine + c <= own OR c <= greatest(0, {CAP} - spent - held) THEN '' WHEN mine >= own THEN 'channel_floor_exhausted' ELSE 'shared_pool_exhausted' END AS reason
    FROM (SELECT e.*, {", ".join(f"s.{u}" for u in _USED)}, ({" + ".join(_USED)}) AS spent, {_ALLOWED} AS allowed, {_MINE} AS mine, {_OWN} AS own, {" + ".join(f"(CASE WHEN ch = '{c}' THEN 0 ELSE {_HELD(c)} END)" for c in _CHANNELS)} AS held FROM s JOIN e ON e.site = s.site AND e.day = s.day AND e.k = s.k + 1)))
SELECT event_id, reason = '' AS admitted, wait, reason FROM s WHERE k > 0
"""
QUERIES = {"sliding_admission": limited, "paced_admission": paced}
ORACLE_SQL = {"sliding_admission": LIMITED_SQL, "paced_admission": PACED_SQL}
