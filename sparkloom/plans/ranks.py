"""Percentiles, ranks and cumulative shares over tables of any size: no group stands in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ranking import percentiles, ranked, value_ranks
from sparkloom.plans.registry import Registry
from sparkloom.plans.sqltext import REVENUE, r2
from sparkloom.sources.tables import table

R = Registry()


@R.add("ref_a11_quantile_grouped", f"SELECT o_orderpriority, {r2('quantile_cont(o_totalprice, 0.9)')} AS p90 FROM orders GROUP BY o_orderpriority")
def quantile_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """The interpolated 90th percentile of each priority."""
    return percentiles(table(spark, sf, "orders", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", {"p90": 0.9}).selectExpr("o_orderpriority", f"{r2('p90')} AS p90")


def _above(df: DataFrame, value: str, q: float) -> DataFrame:
    """df with the overall percentile beside each row: one row, broadcast."""
    return df.crossJoin(F.broadcast(percentiles(df, [], value, {"__limit": q})))


@R.add("ref_a12_quantile_threshold", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)")
def quantile_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Customers at or above the 95th percentile of all balances."""
    return _above(table(spark, sf, "customer", "c_custkey", "c_acctbal"), "c_acctbal", 0.95).where("c_acctbal >= __limit").select("c_custkey")


@R.add("p90_outlier_flag", "SELECT s_suppkey, s_acctbal > (SELECT quantile_cont(s_acctbal, 0.9) FROM supplier) AS outlier FROM supplier")
def p90_outlier_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers above the 90th percentile of all balances."""
    return _above(table(spark, sf, "supplier", "s_suppkey", "s_acctbal"), "s_acctbal", 0.9).selectExpr("s_suppkey", "s_acctbal > __limit AS outlier")


@R.add("ref_a13_nearest_rank_latency", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def nearest_rank_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles of event values."""
    return percentiles(table(spark, sf, "events", "event_type", "value"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, nearest=True)


@R.add("ref_a38_median", f"SELECT p_type, {r2('median(p_retailprice)')} AS median_price FROM part GROUP BY p_type")
def median(spark: SparkSession, sf: str) -> DataFrame:
    """The median price of each type."""
    return percentiles(table(spark, sf, "part", "p_type", "p_retailprice"), ["p_type"], "p_retailprice", {"m": 0.5}).selectExpr("p_type", f"{r2('m')} AS median_price")


@R.add("ref_w8_rank_over_aggregate", "SELECT user_id, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS rk FROM events GROUP BY user_id")
def rank_over_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Users ranked by their number of events; only the distinct numbers are put in order."""
    return value_ranks(table(spark, sf, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), [], "n").select("user_id", "n", "rk")


@R.add(
    "ref_w4_w6_partitioned_ranks",
    "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr FROM part",
)
def partitioned_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank by price and dense rank by size within the brand."""
    by_price = value_ranks(table(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice", "p_size"), ["p_brand"], "p_retailprice", rank="rk", dense="_d")
    return value_ranks(by_price, ["p_brand"], "p_size", descending=False, rank="_r", dense="dr").select("p_partkey", "rk", "dr")


@R.add(
    "ref_w12_named_window",
    f"SELECT s_suppkey, CAST(rank() OVER w AS BIGINT) AS rk, {r2('s_acctbal - first_value(s_acctbal) OVER w')} AS gap FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)",
)
def named_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rank within the nation and distance to its first, from one order: the first is the largest, a partial maximum."""
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    top = s.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"))
    return ranked(s, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], "rk").join(top, "s_nationkey").selectExpr("s_suppkey", "rk", f"{r2('s_acctbal - top')} AS gap")


_PARETO = f"""
SELECT l_suppkey, revenue, row_number() OVER w AS rn, CAST(sum(revenue) OVER w AS BIGINT) AS running, CAST(sum(revenue) OVER () AS BIGINT) AS total
FROM (SELECT l_suppkey, CAST(sum({REVENUE}) AS BIGINT) AS revenue FROM lineitem GROUP BY l_suppkey)
WINDOW w AS (ORDER BY revenue DESC, l_suppkey ROWS UNBOUNDED PRECEDING)
"""


def _cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by revenue with the running total and the total; the order is spread over range partitions."""
    by = table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice", "l_discount").groupBy("l_suppkey").agg(F.expr(f"CAST(sum({REVENUE}) AS BIGINT) AS revenue"))
    run = ranked(by, [], [F.col("revenue").desc(), F.col("l_suppkey")], "rn", {"running": "revenue"})
    return run.crossJoin(F.broadcast(by.agg(F.sum("revenue").alias("total"))))


@R.add("pareto_supplier_80", f"SELECT l_suppkey, revenue, rn, {r2('100 * running / total')} AS cumulative_pct, running - revenue < total * 8 / 10 AS in_first_80 FROM ({_PARETO})")
def pareto_supplier_80(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by revenue; a supplier belongs to the first 80 % while those before it have less."""
    return _cumulative(spark, sf).selectExpr("l_suppkey", "revenue", "rn", f"{r2('100 * running / total')} AS cumulative_pct", "running - revenue < total * 8 / 10 AS in_first_80")


@R.add("pareto_vital_few", f"SELECT l_suppkey, pct, coalesce(lag(pct) OVER (ORDER BY rn), 0) < 80 AS vital FROM (SELECT l_suppkey, rn, {r2('100 * running / total', 1)} AS pct FROM ({_PARETO}))")
def pareto_vital_few(spark: SparkSession, sf: str) -> DataFrame:
    """The vital few include the one that crosses 80 %, by rounded shares: the share before a row is that of its total without it."""
    return _cumulative(spark, sf).selectExpr("l_suppkey", f"{r2('100 * running / total', 1)} AS pct", f"{r2('100 * (running - revenue) / total', 1)} < 80 AS vital")
