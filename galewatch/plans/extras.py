"""Queries on the star-schema tables for what Spark brings along: join kinds, grouping sets, set operations, ranking,
time windows. They guard the session's settings rather than operators of the engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from galewatch.plans.radar_queries import ORACLES, QUERIES  # noqa: F401
from galewatch.plans.radar_queries import query
from galewatch.plans.views import read


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("""SELECT n_name, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def nation_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("o_custkey").alias("buyers"), F.round(F.sum("total"), 2).alias("total"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n, CAST(grouping(n_name) + 2 * grouping(c_mktsegment) AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)""")
def customer_cube(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_name", "c_mktsegment").agg(F.count("*").alias("n"), (F.grouping("n_name") + F.grouping("c_mktsegment") * 2).cast("int").alias("level"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def idle_customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    idle = c.join(read(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
    return idle.subtract(c.where(F.col("c_acctbal") < 0).select("c_custkey"))


@query("""SELECT p_brand, p_partkey, CAST(rank() OVER w AS INTEGER) AS price_rank, CAST(ntile(4) OVER w AS INTEGER) AS quartile FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""")
def part_ranks(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.rank().over(w).alias("price_rank"), F.ntile(4).over(w).alias("quartile"))


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", "total")
