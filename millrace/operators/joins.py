"""Joins that Spark has no single operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], bucket: str = "1 day") -> DataFrame:
    """left with the values of the last row of right, by time, that has the same keys and isn't later.

    Of right rows with equal keys and time the one of greatest values counts.
    Keys must not be null to match. Both sides are dealt to buckets of time, so
    a key with very many rows is spread over tasks; each bucket then needs only
    the last right row before it, and there is one candidate a bucket.
    """
    slot = lambda c: F.window(F.col(c).cast("timestamp"), bucket)["start"]
    picked = right.select(*keys, F.col(right_time).alias("_time"), F.struct(*values).alias("_value")).groupBy(*keys, "_time").agg(F.max("_value").alias("_value"))
    picked = picked.withColumn("_slot", slot("_time"))
    rows = left.withColumn("_row", F.struct(*left.columns)).select(*keys, F.col(left_time).alias("_time"), "_row", slot(left_time).alias("_slot"), F.lit(1).alias("_side"))
    both = rows.unionByName(picked.select(*keys, "_time", "_value", "_slot", F.lit(0).alias("_side")), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_slot").orderBy("_time", "_side")
    near = both.withColumn("_near", F.last("_value", ignorenulls=True).over(within)).filter("_side = 1").drop("_value")
    # The last value of each bucket, carried to the buckets after it: one row for each key and bucket.
    ends = picked.groupBy(*keys, "_slot").agg(F.max_by("_value", "_time").alias("_end"))
    slots = near.select(*keys, "_slot").distinct().join(ends, [*keys, "_slot"], "full")
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end").filter("_carried IS NOT NULL")
    joined = near.join(carried, [*keys, "_slot"], "left")
    value = F.coalesce("_near", "_carried")
    return joined.select("_row.*", *(value[v].alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs with equal keys and right's time in (left's time, left's time + seconds].

    The time condition becomes part of the key: rows are dealt to buckets as
    long as the interval, and each left row looks into two of them.
    """
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(at(c) / seconds)
    one = left.withColumn("_slot", F.explode(F.array(slot(left_time), slot(left_time) + 1)))
    two = right.withColumn("_slot", slot(right_time))
    same = reduce(lambda a, b: a & b, (one[k] == two[k] for k in keys), one["_slot"] == two["_slot"])
    late = (two[right_time].cast("timestamp") > one[left_time].cast("timestamp")) & (two[right_time].cast("timestamp") <= one[left_time].cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds)))
    return one.join(two, same & late).select(*(one[c] for c in left.columns), *(two[c] for c in right.columns if c not in left.columns))


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """An inner equi-join in which every key's rows of the large side are spread over salts tasks.

    The small side is repeated salts times, so it should be much the smaller;
    use it where a few keys hold most rows and adaptive execution is off.
    """
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
