"""Joins, aggregates, windows, sets, paging and streams over the star schema and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..streaming import streams
from .registry import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional aggregates in one scan."""
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Star join; line items are aggregated per order before they are joined."""
    t = lambda n: table(spark, sf, n)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("c"))
    cust = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = per_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name", "r_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("c").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a large order."""
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without orders."""
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(have, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_count(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per customer, 0 where none."""
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return table(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region EXCEPT SELECT 3")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection and difference."""
    a, b = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    return a.intersect(b).exceptAll(spark.createDataFrame([(3,)], "k int"))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 100")
def paging(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 50."""
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size").orderBy(F.desc("p_size"), "p_partkey").offset(100).limit(50)


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open_orders, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) > 3")
def having_open(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with more than three open orders."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count("*").alias("n"))
    return per.where("open_orders > 3")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS rank, p_name FROM part ORDER BY rank, p_name, p_partkey LIMIT 200")
def case_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Ordering by cases."""
    rank = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    return table(spark, sf, "part").select("p_partkey", rank.alias("rank"), "p_name").orderBy("rank", "p_name", "p_partkey").limit(200)


@query("SELECT event_type, round(quantile_cont(value, 0.2), 6) AS p20, round(sqrt(avg(value * value)), 6) AS rms, max(abs(value)) AS peak FROM events GROUP BY event_type")
def frame_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile, level and peak by group."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.2)), 6).alias("p20"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.max(F.abs("value")).alias("peak"))


@query("""WITH a AS (SELECT user_id, value - lag(value) OVER w AS d, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) FILTER (sign(d) <> sign(p)) AS turns FROM (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM a) GROUP BY user_id""")
def sign_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each user's values turn."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("p", F.lag("d").over(w))
    return rows.groupBy("user_id").agg(F.count_if(F.signum("d") != F.signum("p")).alias("turns"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, CAST(island AS BIGINT) AS island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY ALL""")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of events no more than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS")
    rows = table(spark, sf, "events").withColumn("b", F.when(near, 0).otherwise(1)).withColumn("island", F.sum("b").over(w))
    return rows.groupBy("user_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS whole FROM orders)
    SELECT o_custkey, min(run) AS reached FROM (SELECT o_custkey, round(run, 2) AS run FROM c WHERE run >= 0.85 * whole - 0.001) GROUP BY o_custkey""")
def running_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Where each customer's running total first reaches 85 %."""
    by = Window.partitionBy("o_custkey")
    w = by.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf, "orders").select("o_custkey", F.sum("o_totalprice").over(w).alias("run"), F.sum("o_totalprice").over(by).alias("whole"))
    return rows.where("run >= 0.85 * whole - 0.001").groupBy("o_custkey").agg(F.min(F.round("run", 2)).alias("reached"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A field of a JSON text."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregation in batch form, tumbling."""
    return streams.windowed(table(spark, sf, "events"), "ts", "6 hours", None, "1 day", "event_type", value="value").withColumn("total", F.round("total", 4))


@query("""WITH w AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT s AS start, s + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT *, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 3 HOUR AS s FROM w) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregation in batch form, sliding."""
    return streams.windowed(table(spark, sf, "events"), "ts", "6 hours", "3 hours", "1 day", "event_type", value="value").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session windows of the event stream in batch form."""
    return streams.sessions(table(spark, sf, "events"), "ts", "6 hours", "1 day", "user_id")


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts FROM events GROUP BY ALL")
def first_events(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each user and type."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
