"""Named queries, each with the DuckDB SQL that gives the same rows where there is any.

Float aggregates are rounded on both sides, as parallel sums differ in the last
bits, and integer types are cast alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import frames
from millrace.operators import joins, windows
from millrace.session import shared_folder
from millrace.sources import formats
from millrace.sources.tables import TABLES, table
from millrace.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(name: str, text: str, duck: str | None = None) -> None:
    """Registers SQL in which {table} stands for a table; duck is given where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})

    QUERIES[name] = run
    ORACLES[name] = duck or text.replace("{", "").replace("}", "")


def frame(oracle: str | None = None):
    """Registers a function as the query of its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# Scans, filters, projections.


@frame(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


sql("filter_project", "SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice * CAST(0.9 AS DOUBLE) AS reduced FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority LIKE '%-%H%'")
sql("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, coalesce(nullif(p_type, 'SMALL'), 'none') AS kind FROM {part}")

# Joins and subqueries.

sql("join_inner", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
sql("join_left", "SELECT o_orderkey, count(l_orderkey) AS items FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
sql("join_right", "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 5000")
sql("join_full", "SELECT r_name, n_name FROM (SELECT * FROM {region} WHERE r_regionkey < 3) r FULL JOIN (SELECT * FROM {nation} WHERE n_regionkey > 0) n ON r_regionkey = n_regionkey")
sql("join_semi", "SELECT o_orderkey, o_totalprice FROM {orders} LEFT SEMI JOIN {lineitem} ON o_orderkey = l_orderkey AND l_quantity > 49", "SELECT o_orderkey, o_totalprice FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49")
sql("join_anti", "SELECT o_orderkey, o_totalprice FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
sql("join_cross", "SELECT a.r_name AS one, b.r_name AS two FROM {region} a CROSS JOIN {region} b")
sql("join_theta", "SELECT a.n_name AS one, b.n_name AS two FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
sql("join_hints", "SELECT /*+ BROADCAST(n), MERGE(s) */ n_name, count(*) AS pairs FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey JOIN {supplier} s ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
sql("join_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(o) */ c_mktsegment, count(*) AS n FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
sql("exists_subquery", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
sql("in_subquery", "SELECT s_suppkey, s_name FROM {supplier} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_discount > 0.09 AND l_quantity < 3)")
sql("scalar_subquery", "SELECT c_custkey, round(c_acctbal, 2) AS balance FROM {customer} c WHERE c_acctbal > (SELECT avg(d.c_acctbal) FROM {customer} d WHERE d.c_nationkey = c.c_nationkey)")
sql("lateral_join", "SELECT n_name, t.c_custkey, t.c_acctbal FROM {nation}, LATERAL (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")


@frame(
    """SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return joins.asof_join(buys, views, ["user_id"], "ts", "ts", ["view_id", "view_value"]).drop("ts")


@frame("SELECT a.event_id, b.event_id AS error_id, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'click' AND b.event_type = 'error'")
def interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("error_ts"))
    return joins.interval_join(clicks, errors, ["user_id"], "ts", "error_ts", 6 * 3600).select("event_id", "error_id", "user_id")


@frame("SELECT l_orderkey, l_linenumber, l_quantity, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1")
def salted_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_quantity")
    parts = table(spark, sf_dir, "part").filter("p_size = 1").select("p_partkey", "p_name")
    return joins.salted_join(items, parts, "p_partkey", 4).drop("p_partkey")


# Aggregation.

sql("distinct_and_filtered", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS reduced, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag")
sql("having", "SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS largest FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("rollup", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS BIGINT) AS is_total, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("percentiles", "SELECT p_brand, round(percentile(p_retailprice, 0.9), 4) AS p90, round(median(p_retailprice), 4) AS middle FROM {part} GROUP BY p_brand", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 4) AS p90, round(median(p_retailprice), 4) AS middle FROM part GROUP BY p_brand")
sql("extremes", "SELECT c_nationkey, max_by(c_custkey, struct(c_acctbal, c_custkey)) AS richest, bool_or(c_acctbal < -900) AS in_debt, bit_xor(c_custkey) AS parity FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, max_by(c_custkey, (c_acctbal, c_custkey)) AS richest, bool_or(c_acctbal < -900) AS in_debt, bit_xor(c_custkey) AS parity FROM customer GROUP BY c_nationkey")
sql("moments", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS spread, round(corr(l_quantity, l_extendedprice), 6) AS related, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM {lineitem} GROUP BY l_returnflag")
sql("string_list", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("ordered_sets", "SELECT p_brand, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice), 4) AS lower_quarter, any_value(p_brand) AS brand, round(try_sum(p_retailprice), 2) AS total FROM {part} GROUP BY p_brand", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.25), 4) AS lower_quarter, p_brand AS brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand")
sql("listagg", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")


@frame("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


@frame("SELECT p_partkey, 'p_name' AS field, p_name AS content FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part")
def unpivot(spark, sf_dir):
    return table(spark, sf_dir, "part").unpivot("p_partkey", ["p_name", "p_brand"], "field", "content")


@frame()
def approximate(spark, sf_dir):
    """Estimates and sketches, whose values depend on the engine."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return items.agg(
        F.approx_count_distinct("l_partkey").alias("parts"),
        F.percentile_approx("l_quantity", 0.5).alias("middle"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey")).alias("suppliers"),
        F.histogram_numeric("l_extendedprice", F.lit(8)).alias("histogram"),
    )


# Windows over rows.

sql("ranking", "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS place, CAST(rank() OVER w AS BIGINT) AS ranked, CAST(dense_rank() OVER w AS BIGINT) AS dense, CAST(ntile(4) OVER w AS BIGINT) AS quarter, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS below FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)")
sql("offsets", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2, -1) OVER w AS after, first_value(event_type) OVER w AS started, nth_value(event_id, 2) OVER w AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS recent, count(*) OVER (PARTITION BY o_custkey) AS orders FROM {orders}")


@frame("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events")
def range_frame(spark, sf_dir):
    return windows.trailing_count(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "ts", 1, ["event_type"], "last_day").select("event_id", "last_day")


@frame("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank_in_group FROM orders QUALIFY rank_in_group <= 2")
def top_of_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_of_groups(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


# Sorts, limits, sets, recursion.

sql("top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("offset_limit", "SELECT c_custkey, c_name FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 30")
sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("intersect_distinct", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql("except_distinct", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0")
sql("recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")

# Scalar functions.

sql("strings", "SELECT p_partkey, substr(p_name, 2, 5) AS part_of, CAST(length(p_name) AS BIGINT) AS size, lpad(p_brand, 12, '*') AS padded, reverse(p_type) AS backwards, replace(p_name, 'a', 'A') AS replaced, concat_ws('-', p_brand, p_type) AS joined, initcap('x') || trim('  y ') AS fixed FROM {part}", "SELECT p_partkey, substr(p_name, 2, 5) AS part_of, length(p_name) AS size, lpad(p_brand, 12, '*') AS padded, reverse(p_type) AS backwards, replace(p_name, 'a', 'A') AS replaced, concat_ws('-', p_brand, p_type) AS joined, 'X' || trim('  y ') AS fixed FROM part")
sql("patterns", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS masked, regexp_extract(c_name, '([0-9]+)', 1) AS digits, c_mktsegment ILIKE '%build%' AS builds, split_part(c_name, '#', 1) AS head FROM {customer}", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS masked, regexp_extract(c_name, '([0-9]+)', 1) AS digits, c_mktsegment ILIKE '%build%' AS builds, split_part(c_name, '#', 1) AS head FROM customer")
sql("dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(dayofweek(o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS due FROM {orders}", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS due FROM orders")
sql("numbers", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit, CAST(floor(l_tax * 100) AS BIGINT) AS tax, greatest(l_tax, l_discount) AS larger, round(sqrt(l_quantity), 6) AS root, l_orderkey % 7 AS rest, abs(l_discount - l_tax) AS gap FROM {lineitem}")
sql("json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("json_parsed", "SELECT event_id, from_json(props, 'k BIGINT').k AS typed, variant_get(parse_json(props), '$.k', 'bigint') AS loose FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS typed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS loose FROM events")
sql("zipped", "SELECT p_partkey, aggregate(zip_with(array(p_size, p_size + 1), array(2, 3), (a, b) -> a * b), CAST(0 AS BIGINT), (s, x) -> s + x) AS dot, CAST(transform_values(map('a', p_size), (k, v) -> v * 2)['a'] AS BIGINT) AS doubled FROM {part}", "SELECT p_partkey, CAST(p_size * 2 + (p_size + 1) * 3 AS BIGINT) AS dot, CAST(p_size * 2 AS BIGINT) AS doubled FROM part")
sql("arrays", "SELECT user_id, CAST(size(ids) AS BIGINT) AS n, ids[0] AS first_id, aggregate(ids, CAST(0 AS BIGINT), (a, x) -> a + x) AS total, CAST(size(filter(ids, x -> x % 2 = 0)) AS BIGINT) AS even FROM (SELECT user_id, sort_array(collect_list(event_id)) AS ids FROM {events} GROUP BY user_id)", "SELECT user_id, len(ids) AS n, ids[1] AS first_id, CAST(list_sum(ids) AS BIGINT) AS total, len(list_filter(ids, lambda x: x % 2 = 0)) AS even FROM (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id)")
sql("explode_array", "SELECT p_partkey, letter FROM {part} LATERAL VIEW explode(split(p_brand, '#')) AS letter", "SELECT p_partkey, unnest(string_split(p_brand, '#')) AS letter FROM part")
sql("maps", "SELECT user_id, m['view'] AS views, CAST(size(map_filter(m, (k, v) -> v > 1)) AS BIGINT) AS repeated FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) GROUP BY user_id)", "SELECT user_id, max(n) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
sql("pipe_syntax", "FROM {orders} |> WHERE o_totalprice > 1000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")

# Longer plans.

sql("top_orders", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1999-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1999-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
sql("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
sql("discount_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("customer_distribution", "SELECT orders, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) GROUP BY orders")

# Event time.


@frame("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type", n=F.count("*"), total=F.round(F.sum("value"), 4))


@frame("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * back AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) b(back) GROUP BY ALL")
def sliding_window(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "2 hours", slide="1 hour", n=F.count("*"))


@frame(
    """SELECT min(ts) AS session_start, max(ts) + INTERVAL 4 HOURS AS session_end, user_id, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def session_window(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "4 hours", "user_id", n=F.count("*"))


@frame("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_window(spark, sf_dir):
    """The table as a stream, complete results of daily windows."""
    counts = streams.windowed_counts(streams.read_events(spark, sf_dir, "1 day", pattern="events.parquet"), "1 day")
    return _drained(spark, counts, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _drained(spark, stream, mode):
    name = f"stream_{uuid.uuid4().hex}"
    return streams.drain(stream, mode, f"{shared_folder(spark)}/{name}", name)


def _streamed(spark, sf_dir):
    return streams.read_events(spark, sf_dir, "30 days", pattern="events.parquet")


@frame(
    """SELECT user_id, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""
)
def streamed_sessions(spark, sf_dir):
    return _drained(spark, streams.user_sessions(_streamed(spark, sf_dir), "3 hours"), "complete").select("user_id", "n")


@frame("SELECT DISTINCT user_id, event_type FROM events")
def streamed_deduplication(spark, sf_dir):
    return _drained(spark, streams.first_of_each(_streamed(spark, sf_dir), "user_id", "event_type"), "append").select("user_id", "event_type")


@frame("SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def streamed_pairs(spark, sf_dir):
    """A stream joined with a stream."""
    return _drained(spark, streams.matched_within(_streamed(spark, sf_dir), _streamed(spark, sf_dir), 3600), "append")


@frame("SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def streamed_static_join(spark, sf_dir):
    return _drained(spark, streams.with_customers(_streamed(spark, sf_dir), table(spark, sf_dir, "customer")), "append")


@frame("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def streamed_state(spark, sf_dir):
    """State of our own, updated by batch; the table is one batch."""
    return _drained(spark, streams.running_totals(_streamed(spark, sf_dir)), "update").select("user_id", "n")


# File formats.


def _round_trip(kind):
    def run(spark, sf_dir):
        path = f"{shared_folder(spark)}/nations_{uuid.uuid4().hex}"
        nations = table(spark, sf_dir, "nation")
        formats.write(nations, path, kind, ["n_regionkey"])
        return formats.read(spark, path, kind, "n_nationkey int, n_name string, n_regionkey int").select(nations.columns)

    return run


for _kind in formats.FORMATS:
    QUERIES[f"format_{_kind}"] = _round_trip(_kind)
    ORACLES[f"format_{_kind}"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


# Functions written in Python, in Arrow batches.


@frame("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def scalar_udf(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", frames.charge("l_extendedprice", "l_discount", "l_tax").alias("charge"))


@frame("SELECT c_nationkey, round(avg(c_acctbal), 4) AS middle FROM customer GROUP BY c_nationkey")
def aggregate_udf(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(frames.mean("c_acctbal"), 4).alias("middle"))


@frame("SELECT c_custkey, c_nationkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS distance FROM customer")
def grouped_map(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return customers.groupBy("c_nationkey").applyInPandas(frames.distance_from_mean, "c_custkey long, c_nationkey int, distance double")


@frame("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def cogrouped_map(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    sizes = customers.groupBy("n_nationkey").cogroup(suppliers.groupBy("n_nationkey")).applyInPandas(frames.group_sizes, "n_nationkey int, customers long, suppliers long")
    named = table(spark, sf_dir, "nation").join(sizes, "n_nationkey", "left")
    return named.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@frame("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice > 200000")
def arrow_map(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(frames.double_large, "o_orderkey long, doubled double")


@frame("SELECT n_nationkey, unnest(range(0, n_nationkey % 4)) AS step FROM nation")
def table_function(spark, sf_dir):
    spark.udtf.register("millrace_steps", frames.Steps)
    return spark.sql("SELECT n_nationkey, step FROM {nation}, LATERAL millrace_steps(n_nationkey % 4)", nation=table(spark, sf_dir, "nation"))
