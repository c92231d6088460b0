"""Plain relational queries: joins, aggregates and windows over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.operators.ordered import previous, running_total
from heronry.plans.registry import query
from heronry.sources.tables import table

_MONEY = "cast(round({}, 2) as double)"


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net, round(avg(l_discount), 6) as avg_discount, count(*) as n
from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus"""
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_net"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as orders
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"""
)
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query(
    """with r as (select c_nationkey, c_custkey, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey group by all),
k as (select *, row_number() over (partition by c_nationkey order by total desc, c_custkey) as rank from r) select * from k where rank <= 3"""
)
def top_customers_per_nation(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "orders").select("o_custkey", "o_totalprice"), F.col("c_custkey") == F.col("o_custkey"))
    r = j.groupBy("c_nationkey", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey")).cast("long")).where("rank <= 3")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= '2000-01-01')")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order since 2000; every customer has one before that."""
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(recent, "c_custkey", "left_anti")


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_per_hour(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as visit from g)
select user_id, visit::bigint as visit, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from s group by user_id, visit"""
)
def user_visits(spark: SparkSession, d: str) -> DataFrame:
    e = previous(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "ts", "before")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    e = running_total(e.withColumn("new", F.when(gap <= 30 * 60 * 1_000_000, 0).otherwise(1)), "user_id", ["ts", "event_id"], F.col("new"), "visit").withColumn("visit", F.col("visit") + F.col("new"))
    return e.groupBy("user_id", "visit").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
