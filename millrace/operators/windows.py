"""Event-time windows over batch tables, trailing counts, and top rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling(df: DataFrame, time: str, length: str, *keys: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by keys and window; window_start is without a time zone. With slide, windows overlap."""
    window = F.window(F.col(time).cast("timestamp"), length, slide)
    return df.groupBy(window.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, *keys: str, **aggregates: Column) -> DataFrame:
    """Aggregates by keys and session: rows less than gap apart."""
    window = F.session_window(F.col(time).cast("timestamp"), gap)
    grouped = df.groupBy(window.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), *keys, *aggregates)


def trailing_count(df: DataFrame, time: str, days: int, keys: list[str], name: str) -> DataFrame:
    """df with the number of rows of equal keys whose time is at most days before the row's and not after it.

    time is without a time zone. Null keys are equal; a row without time counts
    those without. Spark's own frame adds up a row's whole range again for each
    row. Here rows are dealt to slots of that many days, and each also goes, by
    the time at which it leaves the range, to the next slot: a row counts those
    of its slot so far and those that came over, less those that left. So a
    slot is sorted and summed up once, and a key is spread over tasks.
    """
    columns = df.columns
    slot = F.floor(F.date_diff(F.to_date(time), F.lit("1970-01-01").cast("date")) / days)
    own = df.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col(time).alias("_time"), slot.alias("_slot"), F.lit(0).alias("_left"), F.struct(*columns).alias("_row"))
    over = own.filter("_time IS NOT NULL").withColumns({"_time": F.col("_time") + F.make_dt_interval(F.lit(days)), "_slot": F.col("_slot") + 1, "_left": F.lit(1), "_row": F.lit(None).cast(own.schema["_row"].dataType)})
    together = Window.partitionBy(*(f"_key{i}" for i in range(len(keys))), "_slot")
    so_far = together.orderBy("_time", "_left").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a row leaves after those of its time are counted
    counted = own.union(over).withColumn("_n", F.sum(1 - 2 * F.col("_left")).over(so_far) + F.sum("_left").over(together))
    return counted.filter("_left = 0").select("_row.*", F.col("_n").cast("long").alias(name))


def top_of_groups(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their place in rank_in_group."""
    ranked = df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank_in_group") <= n)
