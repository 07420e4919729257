"""Admission: literal cases, and streams that admit what batches do."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.streaming import admission

SF = "/root/testdata/sf0.001"


def test_refused_events_cost_nothing():
    limiter = admission.SlidingLimiter(((60, 3.0), (600, 5.0)))
    admit = lambda t, c: limiter.admit(t, c, "")
    assert admit(0, 2) == (True, 0, "") and admit(10, 2) == (False, 50, "60") and admit(20, 1) == (True, 0, "")
    assert admit(59, 1) == (False, 1, "60") and admit(60, 1)[0] and admit(61, 1)[0]
    assert admit(70, 1) == (False, 10, "60") and admit(130, 1) == (False, 470, "600")
    assert admit(600, 1)[0]  # the first one has gone
    again = admission.SlidingLimiter(((60, 3.0), (600, 5.0)), limiter.state())
    assert again.admit(601, 9, "") == limiter.admit(601, 9, "")


def test_allowance_accrues_and_floors_release():
    quota = admission.PacedQuota(100, 10, (("a", 50), ("b", 30)))
    assert [quota.allowance(x) for x in (0, 43_200, 86_400)] == [10, 55, 100]
    assert quota.admit(0, 11, "a") == (False, 961, "paced_allowance")
    assert quota.admit(0, 10, "c") == (True, 0, "")  # of the pool of 20
    noon = 43_200
    assert quota.admit(noon, 40, "c") == (True, 0, "")  # half of the floors is free by now
    assert quota.admit(noon, 6, "c") == (False, 961, "paced_allowance")
    assert quota.admit(80_000, 30, "c") == (True, 0, "")  # the floors are nearly free
    assert quota.admit(80_000, 13, "c") == (True, 0, "") and quota.admit(86_300, 7, "c")[2] == "paced_allowance"
    tight = admission.PacedQuota(100, 100, (("a", 50), ("b", 30)))
    assert tight.admit(0, 50, "a")[0] and tight.admit(0, 21, "a") == (False, 86_400, "channel_floor_exhausted")
    assert tight.admit(0, 31, "b")[0] and tight.admit(0, 19, "c")[0] and tight.admit(0, 1, "c")[2] == "paced_allowance"
    fresh = admission.PacedQuota(100, 100, (("a", 50), ("b", 30)))
    assert fresh.admit(0, 71, "a") == (False, 86_400, "shared_pool_exhausted")
    assert quota.admit(86_400, 11, "a")[2] == "paced_allowance" and quota.used == {}


def test_batch_and_stream_admit_alike(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.coalesce("value", F.lit(0.0))).alias("cost"), F.col("event_type").alias("channel"))
    last = events.agg(F.max("ts")).first()[0]
    # two far events push the watermark past all others
    tail = spark.createDataFrame([(-1, -1, last, 0.0, "x"), (-2, -1, last, 0.0, "x")], "event_id bigint, key bigint, ts timestamp, cost double, channel string").withColumn("ts", F.expr("ts + interval 3 days"))
    at = str(tmp_path / "in")
    for i, part in enumerate((events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"))):
        part.coalesce(1).write.mode("append").parquet(at)
    rule = lambda state: admission.SlidingLimiter(((3_600, 60.0), (admission.DAY, 80.0)), state)
    stream = spark.readStream.schema(events.schema).parquet(at)
    # both files arrive at once; the tail follows
    def run():
        query = admission.admissions(stream, rule).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        tail.coalesce(1).write.mode("append").parquet(at)
        query.processAllAvailable()
        query.stop()

    run()
    key = lambda df: sorted(tuple(r) for r in df.where("event_id >= 0").collect())
    want = key(admission.admissions(events, rule))
    assert key(spark.table("admitted")) == want and {r[1] for r in want} == {True, False}
