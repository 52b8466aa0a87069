"""Joins, cubes and event-time windows over the star schema: what Spark brings, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as windows
from .registry import query, table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def events_tumbling(spark, sf_dir):
    return windows.windowed(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2, 3")
def events_sliding(spark, sf_dir):
    return windows.windowed(table(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@query(
    "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM"
    " (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"
)
def events_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti")


@query("SELECT a.n_name AS a, b.n_name AS b, a.n_regionkey AS region FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def theta_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("region")), n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("region"))
    return a.join(b, "region").filter("a < b").select("a", "b", "region")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def lineitem_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def supplier_rollup(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order"
    " FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"
)
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )
