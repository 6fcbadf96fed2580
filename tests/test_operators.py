import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, windows
from millrace.plans import catalog
from millrace.sources import formats
from millrace.streaming import events as streams

SMALL = "/root/testdata/sf0.001"


def test_asof_join_against_a_search(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    moment = lambda: start + dt.timedelta(minutes=rng.randrange(20000))
    left = [(i, rng.choice([1, 2, 3, None]), moment()) for i in range(300)]
    right = [(rng.choice([1, 1, 1, 2, None]), moment(), v) for v in range(400)]
    one = spark.createDataFrame(left, "id long, k int, at timestamp_ntz")
    two = spark.createDataFrame(right, "k int, at timestamp_ntz, v long")
    found = {r.id: r.v for r in joins.asof_join(one, two, ["k"], "at", "at", ["v"], bucket="6 hours").collect()}
    want = {i: max(((t, v) for key, t, v in right if key == k and k is not None and t <= at), default=(0, None))[1] for i, k, at in left}
    assert {i: v for i, v in found.items() if dict((x[0], x[1]) for x in left)[i] is not None} == {i: v for i, v in want.items() if dict((x[0], x[1]) for x in left)[i] is not None}
    assert len(found) == 300


def test_salted_join_is_the_join(spark):
    large = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(500)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, w string")
    assert sorted(joins.salted_join(large, small, "k", 7).collect()) == sorted(large.join(small, "k").collect())


def test_trailing_count_is_the_range_frame(spark):
    """With null keys and times, equal times, rows exactly a range apart, times before 1970 and whole slots without rows."""
    rng = random.Random(3)
    start = dt.datetime(1969, 12, 30)
    moment = lambda: rng.choice([None, start + dt.timedelta(hours=6 * rng.randrange(60)), start + dt.timedelta(days=90, seconds=rng.randrange(400000), microseconds=rng.randrange(2))])
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 1, None]), moment()) for i in range(600)]
    table = spark.createDataFrame(rows, "_time int, k string, j int, at timestamp_ntz")
    for days in (1, 3):
        found = windows.trailing_count(table, "at", days, ["k", "j"], "n")
        table.createOrReplaceTempView("trailing")
        want = spark.sql(f"SELECT *, count(*) OVER (PARTITION BY k, j ORDER BY at RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND CURRENT ROW) AS n FROM trailing")
        assert found.columns == want.columns
        assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)


def test_trailing_count_of_many_rows(spark):
    """40,000 rows of one key, all in the range of the last: each frame summed up by itself would take 800 million steps."""
    table = spark.range(40_000).select("id", F.lit(1).alias("k"), F.expr("timestamp_ntz '2024-01-01 12:00:00' + make_dt_interval(0, 0, 0, id)").alias("at"))
    counted = windows.trailing_count(table, "at", 1, ["k"], "n")
    assert counted.filter("n != id + 1").count() == 0
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan
    assert "range_frame" in catalog.QUERIES
    found = catalog.QUERIES["range_frame"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in found and "INTERVAL '1' DAY, currentrow" not in found


@pytest.mark.parametrize("kind", formats.FORMATS)
def test_formats_round_trip(spark, tmp_path, kind):
    nations = spark.read.parquet(f"{SMALL}/nation.parquet")
    path = f"{tmp_path}/{kind}"
    formats.write(nations, path, kind, ["n_regionkey"])
    again = formats.read(spark, path, kind, "n_nationkey int, n_name string, n_regionkey int").select(nations.columns)
    assert sorted(again.collect()) == sorted(nations.collect())
    with pytest.raises(ValueError):
        formats.write(nations, path, "xls")


def drained(stream, mode, tmp_path, name):
    return streams.drain(stream, mode, f"{tmp_path}/{name}", name)


def test_streams_match_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    read = lambda: streams.read_events(spark, SMALL, "30 days", pattern="events.parquet")
    sessions = drained(streams.user_sessions(read(), "3 hours"), "complete", tmp_path, "sessions")
    want = batch.groupBy(F.session_window("ts", "3 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    assert sorted(sessions.select("user_id", "n").collect()) == sorted(want.select("user_id", "n").collect())
    once = drained(streams.first_of_each(read(), "user_id", "event_type"), "append", tmp_path, "once")
    assert once.count() == batch.select("user_id", "event_type").distinct().count()
    pairs = drained(streams.matched_within(read(), read(), 3600), "append", tmp_path, "pairs")
    later = batch.alias("a").join(batch.alias("b"), F.expr("a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR"))
    assert pairs.count() == later.count()
    totals = drained(streams.running_totals(read()), "update", tmp_path, "totals")
    assert {r.user_id: r.n for r in totals.collect()} == {r.user_id: r["count"] for r in batch.groupBy("user_id").count().collect()}


def test_late_events_are_dropped(spark, tmp_path):
    rows = lambda *hours: spark.createDataFrame([(h, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 1, "view", 1.0, "{}") for h in hours], streams.EVENT_SCHEMA)
    for hours in ((0, 1), (40,), (41,), (2, 42), (90,)):  # lateness is judged by the watermark of the batch before
        rows(*hours).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counts = streams.windowed_counts(streams.read_events(spark, f"{tmp_path}/in", "5 hours"), "1 hour")
    found = {r.window_start.hour + 24 * (r.window_start.day - 1): r.n for r in drained(counts, "append", tmp_path, "late").collect()}
    assert found == {0: 1, 1: 1, 40: 1, 41: 1, 42: 1}
