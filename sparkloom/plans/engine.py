"""Queries of the composed operators: allocation, ledgers, reconciliation, retention, entities, graph, sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import entities, ledger, reconcile, retention
from sparkloom.operators.allocate import largest_remainder, rounded_then_corrected
from sparkloom.operators.ranking import ranked
from sparkloom.plans.registry import Registry
from sparkloom.plans.sqltext import REVENUE, cents, r2, sql_query
from sparkloom.sources import files
from sparkloom.session import shared_path
from sparkloom.sources.tables import table
from sparkloom.streaming.windows import hourly_counts

R = Registry()

_LINES = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_quantity AS BIGINT) AS qty, {cents('l_extendedprice')} AS price, {REVENUE} AS revenue FROM lineitem"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_LINES.replace("lineitem", "{lineitem}") + "", lineitem=table(spark, sf, "lineitem"))


# Allocation -----------------------------------------------------------------
_ALLOC = """
WITH x AS ({lines}), s AS (SELECT *, sum({w}) OVER g AS tot FROM x WINDOW g AS (PARTITION BY l_orderkey)),
f AS (SELECT *, CAST((CAST(10007 AS HUGEINT) * {w}) // tot AS BIGINT) AS fl, (CAST(10007 AS HUGEINT) * {w}) % tot AS rest FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, {tie}) AS rn, 10007 - sum(fl) OVER (PARTITION BY l_orderkey) AS spare FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, qty, price, CAST(fl + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS cents FROM n
"""
_TIE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, qty, price"


@R.add("ref_b1_b6_alloc_freight_value", _ALLOC.format(lines=_LINES, w="price", tie=_TIE))
def alloc_freight_value(spark: SparkSession, sf: str) -> DataFrame:
    """A freight of 100.07 per order over its lines by value, ties in line order."""
    lines = _lines(spark, sf).drop("revenue").withColumn("total", F.lit(10007).cast("bigint"))
    return largest_remainder(lines, ["l_orderkey"], "total", "price", [F.col(c) for c in _TIE.split(", ")]).drop("total")


@R.add(
    "ref_b2_alloc_pool_driver",
    """WITH d AS (SELECT n_regionkey, n_name, count(c_custkey) FILTER (WHERE c_acctbal > 9990) AS w FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
    s AS (SELECT *, sum(w) OVER (PARTITION BY n_regionkey) AS t0, count(*) OVER (PARTITION BY n_regionkey) AS k FROM d),
    e AS (SELECT n_regionkey, n_name, CASE WHEN t0 = 0 THEN 1 ELSE w END AS w, CASE WHEN t0 = 0 THEN k ELSE t0 END AS tot FROM s),
    f AS (SELECT *, 1000003 * w // tot AS fl, 1000003 * w % tot AS rest FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY rest DESC, n_name) AS rn, 1000003 - sum(fl) OVER (PARTITION BY n_regionkey) AS spare FROM f)
    SELECT n_regionkey, n_name, CAST(fl + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS cents FROM n""",
)
def alloc_pool_driver(spark: SparkSession, sf: str) -> DataFrame:
    """A shared cost of 10,000.03 per region over its nations by a driver that may be zero everywhere, ties by name."""
    rich = table(spark, sf, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 9990").groupBy("c_nationkey").count()
    d = table(spark, sf, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_regionkey", "n_name", F.coalesce("count", F.lit(0)).alias("w"), F.lit(1000003).cast("bigint").alias("total"))
    return largest_remainder(d, ["n_regionkey"], "total", "w", [F.col("n_name")]).drop("w", "total")


@R.add(
    "ref_b4_alloc_call_prorata",
    f"""WITH x AS (SELECT c_nationkey, c_custkey, greatest({cents('c_acctbal')}, 0) AS w FROM customer), s AS (SELECT *, sum(w) OVER (PARTITION BY c_nationkey) AS tot FROM x),
    f AS (SELECT *, CAST((2 * CAST(5000000 AS HUGEINT) * w + tot) // (2 * tot) AS BIGINT) AS near FROM s), g AS (SELECT *, CAST(5000000 AS HUGEINT) * w - CAST(near AS HUGEINT) * tot AS rest FROM f),
    n AS (SELECT *, 5000000 - sum(near) OVER (PARTITION BY c_nationkey) AS short, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, w DESC, c_custkey) AS up, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest, w DESC, c_custkey) AS down FROM g)
    SELECT c_nationkey, c_custkey, CAST(near + CASE WHEN short > 0 AND up <= short THEN 1 WHEN short < 0 AND down <= -short THEN -1 ELSE 0 END AS BIGINT) AS cents FROM n""",
)
def alloc_call_prorata(spark: SparkSession, sf: str) -> DataFrame:
    """A call of 50,000.00 per nation over its customers by balance: rounded, then corrected up or down."""
    x = table(spark, sf, "customer").selectExpr("c_nationkey", "c_custkey", f"greatest({cents('c_acctbal')}, CAST(0 AS BIGINT)) AS w", "CAST(5000000 AS BIGINT) AS total")
    return rounded_then_corrected(x, ["c_nationkey"], "total", "w", [F.col("w").desc(), F.col("c_custkey")]).drop("w", "total")


# Ledgers and schedules --------------------------------------------------------
_WAC = """
WITH RECURSIVE o AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, qty, cents) AS n
  FROM (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_returnflag = 'R' AS is_issue, CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
), s AS (
  SELECT *, CASE WHEN is_issue THEN -qty ELSE qty END AS on_hand, CASE WHEN is_issue THEN 0 ELSE cents END AS value_left, CAST(0 AS BIGINT) AS issue_value, is_issue AND qty > 0 AS went_negative FROM o WHERE n = 1
  UNION ALL
  SELECT b.l_partkey, b.l_shipdate, b.l_orderkey, b.l_linenumber, b.l_suppkey, b.is_issue, b.qty, b.cents, b.n,
    CASE WHEN b.is_issue THEN a.on_hand - b.qty ELSE a.on_hand + b.qty END,
    CASE WHEN b.is_issue THEN a.value_left - t.taken ELSE a.value_left + b.cents END,
    CASE WHEN b.is_issue THEN t.taken ELSE 0 END,
    a.went_negative OR (b.is_issue AND a.on_hand - b.qty < 0)
  FROM s a JOIN o b ON b.l_partkey = a.l_partkey AND b.n = a.n + 1,
  LATERAL (SELECT CASE WHEN a.on_hand > 0 THEN CAST(sign(a.value_left) * ((2 * abs(CAST(a.value_left AS HUGEINT)) * b.qty + a.on_hand) // (2 * a.on_hand)) AS BIGINT) ELSE 0 END AS taken) t
)
SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, is_issue, qty, cents, CAST(on_hand AS BIGINT) AS on_hand, CAST(value_left AS BIGINT) AS value_left, CAST(issue_value AS BIGINT) AS issue_value, went_negative FROM s
"""


@R.add("ref_b10_wac_ledger", _WAC)
def wac_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Perpetual weighted-average cost of each part: returns are issues, all other lines receipts."""
    rows = table(spark, sf, "lineitem").selectExpr("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag = 'R' AS is_issue", "CAST(l_quantity AS BIGINT) AS qty", f"{cents('l_extendedprice')} AS cents")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "qty", "cents")]
    return ledger.perpetual_average_cost(rows, "l_partkey", order, "is_issue", "qty", "cents").drop("l_suppkey")


@R.add(
    "ref_b11_excise_brackets",
    """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM lineitem GROUP BY 1),
    r AS (SELECT *, CAST(sum(volume) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) - volume AS BIGINT) AS before FROM d)
    SELECT day, volume, before, CAST(greatest(0, least(before + volume, 20000) - greatest(before, 0)) * 3 + greatest(0, least(before + volume, 500000) - greatest(before, 20000)) * 5 + greatest(0, before + volume - greatest(before, 500000)) * 9 AS BIGINT) AS charge FROM r""",
)
def excise_brackets(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes by day threaded through brackets of the running total."""
    days = table(spark, sf, "lineitem", "l_shipdate", "l_quantity").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("volume"))
    run = ranked(days, [], [F.col("day")], "_rn", {"_run": "volume"}).withColumn("before", F.col("_run") - F.col("volume"))
    return ledger.through_brackets(run, F.col("before"), F.col("volume"), [(0, 20_000, 3), (20_000, 500_000, 5), (500_000, None, 9)]).select("day", "volume", "before", "charge")


@R.add(
    "ref_b12_amortize_orders",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey, {cents('o_totalprice')} AS principal FROM orders),
    l AS (SELECT *, CAST(floor(principal * 0.005 / (1 - pow(1.005, -12)) + 0.5) AS BIGINT) AS pay FROM o),
    s AS (SELECT o_orderkey, principal, pay, 0 AS period, CAST(0 AS BIGINT) AS interest, CAST(0 AS BIGINT) AS part, principal AS balance FROM l
      UNION ALL SELECT o_orderkey, principal, pay, period + 1, (balance * 600 * 2 + 120000) // 240000, CASE WHEN period + 1 = 12 THEN balance ELSE least(balance, pay - (balance * 600 * 2 + 120000) // 240000) END,
        balance - CASE WHEN period + 1 = 12 THEN balance ELSE least(balance, pay - (balance * 600 * 2 + 120000) // 240000) END FROM s WHERE period < 12)
    SELECT o_orderkey, principal, period, interest, CAST(interest + part AS BIGINT) AS paid, CAST(part AS BIGINT) AS principal_part, CAST(balance AS BIGINT) AS balance FROM s WHERE period > 0""",
)
def amortize_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a loan over twelve periods at 6 % a year."""
    return ledger.amortization(table(spark, sf, "orders").selectExpr("o_orderkey", f"{cents('o_totalprice')} AS principal"), "principal", 600, 12)


@R.add("ref_w20_running_totals", """WITH d AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS c
        FROM events) SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(sum(c) OVER w AS BIGINT) AS spent
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Number and running amount of each user's events, spread over tasks even for a user with most of them."""
    e = table(spark, sf, "events").selectExpr("user_id", "event_id", "ts", f"{cents('value')} AS c")
    return ranked(e, ["user_id"], [F.col("ts"), F.col("event_id")], "rn", {"spent": "c"}).select("user_id", "event_id", "rn", "spent")


# Reconciliation and quality -----------------------------------------------------
_A = f"SELECT l_orderkey, CAST(sum({REVENUE}) AS BIGINT) AS amount FROM lineitem GROUP BY l_orderkey"


@R.add(
    "ref_j8_j9_b50_reconcile_ledgers",
    f"WITH a AS (SELECT * FROM ({_A}) WHERE l_orderkey % 11 <> 0), b AS (SELECT l_orderkey, amount + CASE WHEN l_orderkey % 7 = 0 THEN 90000 WHEN l_orderkey % 5 = 0 THEN 40 ELSE 0 END AS amount FROM ({_A}) WHERE l_orderkey % 13 <> 0) "
    "SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.amount AS left_amount, b.amount AS right_amount, b.amount - a.amount AS difference, CASE WHEN b.l_orderkey IS NULL THEN 'only_left' WHEN a.l_orderkey IS NULL THEN 'only_right' WHEN abs(b.amount - a.amount) <= 100 THEN 'match' ELSE 'mismatch' END AS status FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey",
)
def reconcile_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    """Two ledgers of order revenue, the second with keys missing and amounts shifted."""
    base = _lines(spark, sf).groupBy("l_orderkey").agg(F.sum("revenue").cast("bigint").alias("amount"))
    k = F.col("l_orderkey")
    other = base.where(k % 13 != 0).withColumn("amount", F.col("amount") + F.when(k % 7 == 0, 90000).when(k % 5 == 0, 40).otherwise(0))
    return reconcile.reconcile(base.where(k % 11 != 0), other, "l_orderkey", "amount", 100)


_SHIP = "SELECT o_orderkey, o_orderdate, o_orderpriority, max(l_shipdate) AS closed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING max(l_shipdate) >= o_orderdate"


def _closed(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.where(F.col("closed") >= F.col("o_orderdate")).drop("l_orderkey")


@R.add(
    "ref_j16_b53_flow_backlog",
    f"WITH o AS ({_SHIP}), m AS (SELECT CAST(unnest(generate_series((SELECT min(date_trunc('month', o_orderdate)) FROM o), (SELECT max(date_trunc('month', closed)) FROM o), INTERVAL 1 MONTH)) AS TIMESTAMP) AS m0), "
    "c AS (SELECT m0, (SELECT count(*) FROM o WHERE o_orderdate < m0) - (SELECT count(*) FROM o WHERE closed < m0) AS opening, (SELECT count(*) FROM o WHERE date_trunc('month', o_orderdate) = m0) AS opened, (SELECT count(*) FROM o WHERE date_trunc('month', closed) = m0) AS closed FROM m) "
    "SELECT strftime(m0, '%Y-%m') AS month, opening, opened, closed, opening + opened - closed AS closing FROM c",
)
def flow_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Orders open, opened and closed in each month; opening + opened - closed = closing."""
    return reconcile.backlog(_closed(spark, sf), F.col("o_orderdate"), F.col("closed"))


@R.add(
    "ref_b23_sla_breach",
    f"""WITH o AS ({_SHIP}), d AS (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(closed AS DATE)) AS days, CASE substr(o_orderpriority,
                1, 1) WHEN '1' THEN 200 WHEN '2' THEN 400 WHEN '3' THEN 600 ELSE 900 END AS target
        FROM o) SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE days > target) AS breaches, {r2('avg(days)')} AS mean_days
    FROM d GROUP BY o_orderpriority""",
)
def sla_breach(spark: SparkSession, sf: str) -> DataFrame:
    """Days to close against a target by priority; a breach is strictly over it."""
    days = F.datediff(F.to_date("closed"), F.to_date("o_orderdate"))
    p = F.substring("o_orderpriority", 1, 1)
    d = _closed(spark, sf).select("o_orderpriority", days.alias("days"), F.when(p == "1", 200).when(p == "2", 400).when(p == "3", 600).otherwise(900).alias("target"))
    return d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("days") > F.col("target")).alias("breaches"), F.expr(f"{r2('avg(days)')}").alias("mean_days"))


@R.add(
    "ref_f12_dq_suite",
    "WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL), x AS (SELECT o.o_orderdate, l.*, c.copies FROM lineitem l JOIN c USING (l_orderkey, l_linenumber) LEFT JOIN orders o ON o_orderkey = l.l_orderkey) "
    "SELECT concat_ws('+', CASE WHEN o_orderdate IS NULL THEN 'no_order' END, CASE WHEN l_shipdate < o_orderdate THEN 'shipped_before_order' END, CASE WHEN copies > 1 THEN 'duplicate_line' END) AS reasons, count(*) AS n FROM x GROUP BY 1",
)
def dq_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with the checks it fails, summed up by their combination."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    copies = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))
    x = lines.join(copies, ["l_orderkey", "l_linenumber"]).join(table(spark, sf, "orders", "o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    checks = {"no_order": F.col("o_orderkey").isNull(), "shipped_before_order": F.col("l_shipdate") < F.col("o_orderdate"), "duplicate_line": F.col("copies") > 1}
    return reconcile.rejects(x, checks).groupBy(F.array_join("reasons", "+").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "ref_x5_b57_reason_lists",
    "SELECT event_id, concat_ws(',', CASE WHEN value > 300 THEN 'large' END, CASE WHEN hour(ts) < 6 THEN 'night' END, CASE WHEN event_type = 'error' THEN 'error' END) AS reasons FROM events",
)
def reason_lists(spark: SparkSession, sf: str) -> DataFrame:
    """All reasons that hold for an event, in order."""
    e = reconcile.rejects(table(spark, sf, "events"), {"large": F.col("value") > 300, "night": F.hour("ts") < 6, "error": F.col("event_type") == "error"})
    return e.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@R.add("ref_b55_total_is_sum_of_parts", """SELECT o_orderdate, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') + count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_orderstatus = 'P') AS parts,
        count(*) = count(*) FILTER (WHERE o_orderstatus IN ('O', 'F', 'P')) AS holds
    FROM orders GROUP BY o_orderdate""")
def total_is_sum_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders a day against the sum over their states."""
    parts = sum((F.count_if(F.col("o_orderstatus") == s) for s in "FP"), F.count_if(F.col("o_orderstatus") == "O"))
    return table(spark, sf, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("total"), parts.alias("parts")).withColumn("holds", F.col("total") == F.col("parts"))


@R.add(
    "ref_j22_b56_variance_rollup",
    """WITH t AS (SELECT c_nationkey AS nk, year(o_orderdate) AS yr, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY ALL), a AS (SELECT nk, n FROM t WHERE yr = 1999), b AS (SELECT nk, n
        FROM t WHERE yr = 2000) SELECT coalesce(a.nk, b.nk) AS nk, coalesce(b.n, 0) - coalesce(a.n, 0) AS gap, CASE WHEN abs(coalesce(b.n, 0) - coalesce(a.n,
                0)) > 10 AND abs(coalesce(b.n, 0) - coalesce(a.n, 0)) * 20 > coalesce(a.n, 0) THEN 'investigate' ELSE 'ok' END AS status
    FROM a FULL JOIN b ON a.nk = b.nk""",
)
def variance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a nation in two years; a variance counts when both thresholds are passed."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate").join(table(spark, sf, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy(F.col("c_nationkey").alias("nk"), F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    a, b = (t.where(F.col("yr") == y).select("nk", F.col("n").alias(f"n{y}")) for y in (1999, 2000))
    both = a.join(b, "nk", "full").na.fill(0)
    gap = F.col("n2000") - F.col("n1999")
    return both.select("nk", gap.alias("gap"), F.when((F.abs(gap) > 10) & (F.abs(gap) * 20 > F.col("n1999")), "investigate").otherwise("ok").alias("status"))


@R.add(
    "ref_j17_overlap_pairs",
    """WITH i AS (SELECT user_id, event_id, ts AS s, ts + INTERVAL 40 MINUTE AS e
        FROM events) SELECT a.user_id, a.event_id AS \"left\", b.event_id AS \"right\"
    FROM i a JOIN i b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e""",
)
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one user whose forty-minute intervals overlap."""
    e = table(spark, sf, "events", "user_id", "event_id", "ts").selectExpr("user_id", "event_id", "CAST(ts AS TIMESTAMP) AS s", "CAST(ts AS TIMESTAMP) + INTERVAL 40 MINUTES AS e")
    return reconcile.overlapping_pairs(e, ["user_id"], "event_id", "s", "e")


@R.add(
    "ref_b20_aging_buckets",
    f"""WITH b(bucket, lo, hi) AS (VALUES ('current', -99999, 0), ('1-30', 1, 30), ('31-60', 31, 60), ('61-90', 61, 90), ('91-plus', 91, 99999)), d AS (SELECT date_diff('day',
                CAST(l_shipdate AS DATE), DATE '2001-06-30') AS days, {cents('l_extendedprice')} AS cents
        FROM lineitem) SELECT bucket, count(days) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents
    FROM b LEFT JOIN d ON days BETWEEN lo AND hi
    GROUP BY bucket""",
)
def aging_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by days since shipping at a fixed day, empty buckets present; summed before the scaffold is met."""
    days = F.datediff(F.lit("2001-06-30").cast("date"), F.to_date("l_shipdate"))
    # The labels of the buckets.
    names = ["current", "1-30", "31-60", "61-90", "91-plus"]
    bucket = F.when(days <= 0, names[0]).when(days <= 30, names[1]).when(days <= 60, names[2]).when(days <= 90, names[3]).otherwise(names[4])
    found = table(spark, sf, "lineitem").where(days.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(cents("l_extendedprice"))).cast("bigint").alias("cents"))
    return spark.createDataFrame([(x,) for x in names], "bucket string").join(F.broadcast(found), "bucket", "left").na.fill(0)


# Retention, triangles, scores ---------------------------------------------------
_MRR = f"SELECT o_custkey, date_trunc('month', o_orderdate) AS m, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS amount FROM orders GROUP BY 1, 2"


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum(F.expr(cents("o_totalprice"))).cast("bigint").alias("amount"))


@R.add(
    "ref_b80_mrr_movement",
    f"WITH x AS ({_MRR}), p AS (SELECT m, lead(m) OVER (ORDER BY m) AS nxt FROM (SELECT DISTINCT m FROM x)), w AS (SELECT o_custkey, nxt AS m, amount AS was FROM x JOIN p USING (m) WHERE nxt IS NOT NULL), "
    "f AS (SELECT coalesce(x.m, w.m) AS m, coalesce(amount, 0) AS now, coalesce(was, 0) AS was FROM x FULL JOIN w ON x.o_custkey = w.o_custkey AND x.m = w.m) "
    "SELECT CAST(m AS DATE) AS m, CAST(sum(was) AS BIGINT) AS opening, CAST(sum(CASE WHEN was = 0 AND now > 0 THEN now ELSE 0 END) AS BIGINT) AS \"new\", CAST(sum(CASE WHEN was > 0 AND now > was THEN now - was ELSE 0 END) AS BIGINT) AS expansion, CAST(sum(CASE WHEN was > 0 AND now > 0 AND now < was THEN was - now ELSE 0 END) AS BIGINT) AS contraction, CAST(sum(CASE WHEN was > 0 AND now = 0 THEN was ELSE 0 END) AS BIGINT) AS churned, CAST(sum(now) AS BIGINT) AS closing FROM f GROUP BY 1",
)
def mrr_movement(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by customer and month as a movement from the ledger month before."""
    return retention.movement(_monthly(spark, sf), "o_custkey", "m", "amount").withColumn("m", F.to_date("m"))


@R.add(
    "ref_b81_cohort_retention",
    f"""WITH x AS (SELECT o_custkey, CAST(year(m) * 12 + month(m) AS BIGINT) AS mi, amount
        FROM ({_MRR})), f AS (SELECT o_custkey, min(mi) AS cohort
        FROM x GROUP BY 1) SELECT cohort, mi - cohort AS age, count(DISTINCT o_custkey) AS keys, CAST(sum(amount) AS BIGINT) AS amount
    FROM x JOIN f USING (o_custkey) GROUP BY ALL""",
)
def cohort_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and revenue by month of the first order and months since."""
    x = _monthly(spark, sf).select("o_custkey", (F.year("m") * 12 + F.month("m")).cast("bigint").alias("mi"), "amount")
    return retention.cohorts(x, "o_custkey", "mi", "amount")


@R.add(
    "ref_b84_loss_ratio_grid",
    f"""WITH c AS (SELECT c_mktsegment AS seg, year(o_orderdate) AS yr, o_orderkey, {cents('o_totalprice')} AS premium
        FROM orders JOIN customer ON o_custkey = c_custkey), l AS (SELECT l_orderkey, CAST(sum({cents('l_extendedprice')}) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS loss
        FROM lineitem GROUP BY 1) SELECT seg, CAST(yr AS BIGINT) AS yr, {r2('100 * CAST(sum(coalesce(loss, 0)) AS DOUBLE) / CAST(sum(premium) AS DOUBLE)')} AS ratio_pct
    FROM c LEFT JOIN l ON o_orderkey = l_orderkey
    GROUP BY seg, yr""",
)
def loss_ratio_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Returned value over order value by segment and year; each order's value counts once, not once a line."""
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum(F.expr(cents("l_extendedprice"))).alias("loss"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = o.groupBy(F.col("c_mktsegment").alias("seg"), F.year("o_orderdate").cast("bigint").alias("yr")).agg(F.sum(F.coalesce("loss", F.lit(0))).alias("loss"), F.sum(F.expr(cents("o_totalprice"))).alias("premium"))
    return sums.selectExpr("seg", "yr", f"{r2('100 * CAST(loss AS DOUBLE) / CAST(premium AS DOUBLE)')} AS ratio_pct")


_TRI = f"SELECT year(o_orderdate) AS origin, year(l_shipdate) - year(o_orderdate) AS age, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1, 2"


@R.add(
    "ref_a37_chain_ladder",
    f"""WITH t AS ({_TRI}), c AS (SELECT origin, age, sum(paid) OVER (PARTITION BY origin
            ORDER BY age) AS paid FROM t), f AS (SELECT a.age, CAST(sum(b.paid) AS DOUBLE) / CAST(sum(a.paid) AS DOUBLE) AS factor
        FROM c a JOIN c b ON a.origin = b.origin AND b.age = a.age + 1
        GROUP BY a.age) SELECT CAST(age AS BIGINT) AS age, {r2('factor', 6)} AS factor, {r2('product(factor) OVER (ORDER BY age DESC)', 6)} AS to_ultimate
    FROM f""",
)
def chain_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Development factors of shipped value by order year and years since, and their products to the end."""
    return retention.triangle_factors(cumulative_triangle(spark, sf), "origin", "age", "total").selectExpr("age", f"{r2('factor', 6)} AS factor", f"{r2('to_ultimate', 6)} AS to_ultimate")


def cumulative_triangle(spark: SparkSession, sf: str) -> DataFrame:
    """(origin, age, total): shipped value by order year and years since, summed up over the ages."""
    o = table(spark, sf, "lineitem").join(table(spark, sf, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    t = o.groupBy(F.year("o_orderdate").alias("origin"), (F.year("l_shipdate") - F.year("o_orderdate")).cast("bigint").alias("age")).agg(F.sum(F.expr(cents("l_extendedprice"))).alias("paid"))
    return ranked(t, ["origin"], [F.col("age")], "_rn", {"total": "paid"}).select("origin", "age", "total")


@R.add(
    "ref_b86_model_scorecard",
    f"""WITH x AS (SELECT o_orderstatus = 'F' AS truth, o_totalprice > 250000 AS guess
        FROM orders), c AS (SELECT count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE NOT truth AND guess) AS fp, count(*) FILTER (WHERE truth AND NOT guess) AS fn,
            count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn
        FROM x) SELECT tp, fp, fn, tn, {r2('tp / nullif(tp + fp, 0)', 6)} AS \"precision\", {r2('tp / nullif(tp + fn, 0)', 6)} AS recall, {r2('2 * tp / nullif(2 * tp + fp + fn, 0)', 6)} AS f1
    FROM c""",
)
def model_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """A rule scored against a truth."""
    c = retention.confusion(table(spark, sf, "orders", "o_orderstatus", "o_totalprice"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000)
    return c.selectExpr("tp", "fp", "fn", "tn", *[f"{r2(f'`{x}`', 6)} AS `{x}`" for x in ("precision", "recall", "f1")])


@R.add("ref_a26_w1_latest_per_key", """SELECT o_custkey, o_orderkey, o_orderstatus
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn
        FROM orders) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's latest order by a partial maximum: no window, no sort of the group."""
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("x"))
    return last.select("o_custkey", "x.o_orderkey", "x.o_orderstatus")


_LOADS = "SELECT DISTINCT CAST(p_size AS DOUBLE) AS load FROM part"


@R.add(
    "ref_b43_erlang_agents",
    f"""WITH RECURSIVE l AS ({_LOADS}), e AS (SELECT load, 0 AS n, CAST(1 AS DOUBLE) AS b
        FROM l UNION ALL SELECT load, n + 1, load * b / (n + 1 + load * b)
        FROM e WHERE b > 0.02) SELECT load, CAST(max(n) AS BIGINT) AS agents
    FROM e GROUP BY load""",
)
def erlang_agents(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest agents that block at most 2 % of a load (Erlang B)."""
    loads = _sql_loads(spark, sf)
    return loads.select("load", retention.erlang_agents("load", lambda n, b: b <= 0.02).alias("agents"))


@R.add(
    "ref_b43_erlang_c_agents",
    f"WITH RECURSIVE l AS ({_LOADS}), e AS (SELECT load, 0 AS n, CAST(1 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS level FROM l "
    "UNION ALL SELECT load, n + 1, nb, CASE WHEN n + 1 > load THEN greatest(0, 1 - nb / (1 - load / (n + 1) * (1 - nb)) * exp(-(n + 1 - load) * 20 / 180)) ELSE 0 END FROM (SELECT *, load * b / (n + 1 + load * b) AS nb FROM e WHERE level < 0.8)) "
    "SELECT load, CAST(max(n) AS BIGINT) AS agents FROM e GROUP BY load",
)
def erlang_c_agents(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest agents that answer 80 % of a load's calls of 180 s within 20 s (Erlang C)."""
    load = F.col("load")
    level = lambda n, b: F.greatest(F.lit(0.0), 1 - b / (1 - load / n * (1 - b)) * F.exp(-(n - load) * 20 / 180))
    return _sql_loads(spark, sf).select("load", retention.erlang_agents("load", lambda n, b: (n > load) & (level(n, b) >= 0.8)).alias("agents"))


def _sql_loads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part", "p_size").select(F.col("p_size").cast("double").alias("load")).distinct()


_CONTACTS = "SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN concat('user', CAST(c_custkey % 500 AS VARCHAR), '@example.org') WHEN c_custkey % 7 = 0 THEN ' ' END AS email, CASE WHEN c_custkey % 5 = 0 THEN concat('555-', CAST(c_custkey % 300 AS VARCHAR)) END AS phone, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer"


# The rest of B22, B25, B59, B60, B72, B82 and B95 ------------------------------------
_AS_OF = "2001-06-30"
_TARGET = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 10 WHEN '2' THEN 14 WHEN '3' THEN 21 ELSE 30 END"


def _on(sql: str) -> tuple[str, str]:
    """sql for Spark and for the twin: DAYS(a, b) are the days from a to b."""
    return re.sub(r"DAYS\(([^,]+), ([^,]+)\)", r"datediff(\2, \1)", sql), re.sub(r"DAYS\(([^,]+), ([^,]+)\)", r"date_diff('day', \1, \2)", sql)


sql_query(
    R,
    "ref_b22_open_aging",
    *_on(
        f"WITH s AS (SELECT l_orderkey, max(l_shipdate) AS closed FROM {{lineitem}} GROUP BY l_orderkey), o AS (SELECT DAYS(CAST(o_orderdate AS DATE), DATE '{_AS_OF}') AS days, {_TARGET} AS target FROM {{orders}} LEFT JOIN s ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) <= DATE '{_AS_OF}' AND (closed IS NULL OR CAST(closed AS DATE) > DATE '{_AS_OF}')), "
        "b(bucket, lo, hi) AS (VALUES ('0-7', 0, 7), ('8-14', 8, 14), ('15-30', 15, 30), ('31+', 31, 9999999)), a AS (SELECT CASE WHEN days <= 7 THEN 0 WHEN days <= 14 THEN 8 WHEN days <= 30 THEN 15 ELSE 31 END AS lo, count(*) AS n, count(*) FILTER (WHERE days > target) AS late FROM o GROUP BY 1) "
        "SELECT bucket, coalesce(n, 0) AS open_count, coalesce(late, 0) AS overdue FROM b LEFT JOIN a ON a.lo = b.lo"
    ),
)

sql_query(
    R,
    "ref_b25_maturity_ladder",
    *_on(
        f"WITH d AS (SELECT DAYS(DATE '{_AS_OF}', CAST(l_shipdate AS DATE)) AS days, {cents('l_extendedprice')} AS cents FROM {{lineitem}} WHERE l_shipdate IS NOT NULL), k AS (SELECT CASE WHEN days < 0 THEN 0 WHEN days >= 91 THEN 14 ELSE CAST(floor(days / 7) AS INTEGER) + 1 END AS step, cents FROM d), "
        "t AS (SELECT step, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM k GROUP BY step), w(step) AS (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14)), f AS (SELECT w.step, coalesce(n, 0) AS n, coalesce(cents, 0) AS cents FROM w LEFT JOIN t ON t.step = w.step), late AS (SELECT cents AS overdue FROM f WHERE step = 0) "
        "SELECT step, CASE WHEN step = 0 THEN 'Overdue' WHEN step = 14 THEN 'Beyond' ELSE concat('W', CAST(step AS VARCHAR(2))) END AS label, n, cents, step BETWEEN 1 AND 13 AND cents >= 50000000 AS heavy, CAST(CASE WHEN step = 1 THEN cents + overdue WHEN step BETWEEN 2 AND 13 THEN cents END AS BIGINT) AS debt_due FROM f CROSS JOIN late"
    ),
)

# A line assigns its supplier to its order's shift: at orderkey % 3 * 4 + 8 o'clock for six hours, 2 to 4 needed; cleared means a balance of 0 or more.
_ASSIGNED = (
    "x AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS rn FROM {lineitem}), "
    "j AS (SELECT l_orderkey, l_linenumber, l_suppkey, o_orderdate, CASE WHEN o_orderkey IS NULL THEN 'no_shift' WHEN rn > 1 THEN 'duplicate' WHEN s_suppkey IS NULL THEN 'not_on_roster' WHEN s_acctbal >= 0 THEN 'counted' ELSE 'not_cleared' END AS outcome FROM x LEFT JOIN {orders} ON o_orderkey = l_orderkey LEFT JOIN {supplier} ON s_suppkey = l_suppkey)"
)
sql_query(
    R,
    "ref_b59_shift_coverage",
    f"""WITH {_ASSIGNED}, c AS (SELECT l_orderkey, count(*) AS n
        FROM j WHERE outcome = 'counted' GROUP BY l_orderkey) SELECT o_orderkey AS shift, coalesce(n, 0) AS cleared, CASE WHEN o_orderdate IS NULL THEN 'invalid' WHEN coalesce(n,
            0) < 2 THEN 'understaffed' WHEN n > 4 THEN 'overstaffed' ELSE 'ok' END AS status
    FROM {{orders}} LEFT JOIN c ON o_orderkey = l_orderkey""",
)
sql_query(R, "ref_b59_rejected_assignments", f"WITH {_ASSIGNED} SELECT l_orderkey AS shift, l_linenumber, l_suppkey, outcome AS reason FROM j WHERE outcome <> 'counted'")
sql_query(
    R,
    "ref_b59_double_booking",
    f"""WITH {_ASSIGNED}, c AS (SELECT l_suppkey, l_orderkey AS shift, CAST(o_orderdate AS DATE) AS day, l_orderkey % 3 * 4 + 8 AS h
        FROM j WHERE outcome = 'counted' AND o_orderdate IS NOT NULL) SELECT a.l_suppkey, a.day, a.shift AS shift_a, b.shift AS shift_b
    FROM c a JOIN c b ON a.l_suppkey = b.l_suppkey AND a.day = b.day AND a.shift < b.shift AND a.h < b.h + 6 AND b.h < a.h + 6""",
)

# An event is an entry of event_id % 36 + 5 minutes, of 500 for each 97th.
_ENTRIES = "SELECT user_id, event_id, ts, CAST(CASE WHEN event_id % 97 = 0 THEN 500 ELSE event_id % 36 + 5 END AS BIGINT) AS minutes FROM events"


@R.add(
    "ref_b60_hours_anomalies",
    f"WITH e AS ({_ENTRIES}), i AS (SELECT *, CAST(ts AS DATE) AS day, ts + minutes * INTERVAL 1 MINUTE AS till FROM e) "
    "SELECT 'excessive-entry' AS type, user_id, day, event_id AS item, CAST(NULL AS BIGINT) AS other, minutes FROM i WHERE minutes > 480 "
    "UNION ALL SELECT 'excessive-day', user_id, day, NULL, NULL, CAST(sum(minutes) AS BIGINT) FROM i GROUP BY user_id, day HAVING sum(minutes) > 600 "
    "UNION ALL SELECT 'overlap', a.user_id, a.day, a.event_id, b.event_id, NULL FROM i a JOIN i b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id AND a.ts < b.till AND b.ts < a.till",
)
def hours_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Entries over 480 minutes, days over 600, and pairs of a user's entries on one day that overlap."""
    e = spark.sql(_ENTRIES.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events")).withColumn("day", F.to_date("ts"))
    none = F.lit(None).cast("bigint")
    entry = e.where("minutes > 480").select(F.lit("excessive-entry").alias("type"), "user_id", "day", F.col("event_id").alias("item"), none.alias("other"), "minutes")
    day = e.groupBy("user_id", "day").agg(F.sum("minutes").alias("minutes")).where("minutes > 600").select(F.lit("excessive-day").alias("type"), "user_id", "day", none.alias("item"), none.alias("other"), "minutes")
    spans = e.selectExpr("user_id", "day", "event_id", "CAST(ts AS TIMESTAMP) AS s", "CAST(ts AS TIMESTAMP) + make_dt_interval(0, 0, CAST(minutes AS INT)) AS e")
    pairs = reconcile.overlapping_pairs(spans, ["user_id", "day"], "event_id", "s", "e").select(F.lit("overlap").alias("type"), "user_id", "day", F.col("left").alias("item"), F.col("right").alias("other"), none.alias("minutes"))
    return entry.unionByName(day).unionByName(pairs)


sql_query(
    R,
    "ref_b60_milestones",
    f"""WITH e AS ({_ENTRIES.replace('FROM events', 'FROM {events}')}), t AS (SELECT user_id, count(*) AS entries, CAST(sum(minutes) AS BIGINT) AS minutes
        FROM e GROUP BY user_id) SELECT user_id, entries, minutes, CASE WHEN minutes >= 6000 THEN 100 WHEN minutes >= 3000 THEN 50 WHEN minutes >= 1500 THEN 25 WHEN minutes >= 600 THEN 10 END AS milestone
    FROM t""",
)


@R.add(
    "ref_b72_display_name",
    f"WITH c AS ({_CONTACTS}), k AS (SELECT c.*, coalesce(CASE WHEN trim(email) <> '' THEN '0:' || trim(email) END, CASE WHEN trim(phone) <> '' THEN '1:' || trim(phone) END, '2:' || trim(name)) AS key, {cents('c_acctbal')} AS amount FROM c JOIN customer ON c_custkey = seq), "
    "v AS (SELECT key, name, sum(coalesce(amount, 0)) AS s, count(*) AS n FROM k WHERE key IS NOT NULL AND trim(name) <> '' GROUP BY key, name) SELECT key, name AS display_name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, n DESC, name) AS rn FROM v) WHERE rn = 1",
)
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    """Of each merged contact the name with the largest balance, then the most rows."""
    contacts = _CONTACTS.replace(" FROM customer", f", {cents('c_acctbal')} AS amount FROM {{customer}}").replace("VARCHAR", "STRING")
    c = spark.sql(contacts, customer=table(spark, sf, "customer")).withColumn("key", entities.match_key(F.col("email"), F.col("phone"), F.col("name")))
    return entities.dominant_variant(c, "key", "name", "amount", "display_name")


@R.add(
    "ref_b82_retention_rates",
    f"""SELECT m, {r2('churned / CAST(nullif(opening, 0) AS DOUBLE)', 6)} AS churn_rate, {r2('(opening - contraction - churned) / CAST(nullif(opening, 0) AS DOUBLE)', 6)} AS grr,
        {r2('(opening - contraction - churned + expansion) / CAST(nullif(opening, 0) AS DOUBLE)', 6)} AS nrr
    FROM ({R.sql['ref_b80_mrr_movement']})""",
)
def retention_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Churn rate, gross and net revenue retention of each month; null in a month that opens at zero."""
    return retention.rates(mrr_movement(spark, sf)).selectExpr("m", *[f"{r2(c, 6)} AS {c}" for c in ("churn_rate", "grr", "nrr")])


_NODES = "SELECT concat('s', CAST(s_suppkey AS VARCHAR)) AS id, 'supplier' AS type, s_name AS label FROM supplier UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR)), 'nation', n_name FROM nation UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR)), 'region', r_name FROM region"
_TERMS = "SELECT upper(label) AS term FROM ({n}) n UNION ALL SELECT id FROM ({n}) n UNION ALL SELECT substr(id, 2) FROM ({n}) n UNION ALL SELECT concat(label, '?') FROM ({n}) n"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    text = _NODES.replace("VARCHAR", "STRING")
    return spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", text), **{t: table(spark, sf, t) for t in ("supplier", "nation", "region")})


@R.add(
    "ref_b95_term_resolution",
    f"WITH n AS ({_NODES}), t AS (SELECT DISTINCT term FROM ({_TERMS.replace('({n}) n', 'n')})), c AS (SELECT term, id, CASE WHEN id = trim(term) THEN 0 WHEN id = 's' || trim(term) THEN 1 WHEN type = 'supplier' THEN 2 ELSE 3 END AS rk FROM t JOIN n ON id = trim(term) OR id = 's' || trim(term) OR lower(label) = lower(trim(term))) "
    "SELECT t.term, x.id FROM t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rk, id) AS rn FROM c) x ON x.term = t.term AND rn = 1",
)
def term_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, bare supplier numbers, labels in another case and unknown words, each with the node it means."""
    nodes = _nodes(spark, sf)
    terms = spark.sql(_TERMS.replace("({n})", "{n}"), n=nodes)
    return entities.resolve_terms(terms, nodes, "s", "supplier")


# Entities, graph, text ------------------------------------------------------------


@R.add(
    "ref_b90_b91_entity_merge",
    f"""WITH c AS ({_CONTACTS}), k AS (SELECT *, coalesce(CASE WHEN trim(email) <> '' THEN '0:' || trim(email) END, CASE WHEN trim(phone) <> '' THEN '1:' || trim(phone) END,
                '2:' || trim(name)) AS key FROM c) SELECT key, count(*) AS copies, arg_min(segment, seq) FILTER (WHERE segment IS NOT NULL) AS segment, arg_min(name,
            seq) AS name, coalesce(min(segment) <> max(segment), false) AS segment_conflict, coalesce(min(name) <> max(name), false) AS name_conflict
    FROM k GROUP BY key""",
)
def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts merged by email, else phone, else name; the first value of each field, and conflicts."""
    c = spark.sql(_CONTACTS.replace("VARCHAR", "STRING").replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer"))
    keyed = c.withColumn("key", entities.match_key(F.col("email"), F.col("phone"), F.col("name")))
    return entities.merge_entities(keyed, "key", "seq", ["segment", "name"])


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("in_region").alias("rel"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit("in_nation").alias("rel"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return n.unionByName(s)


_EDGES = "SELECT 'n' || n_nationkey AS src, 'in_region' AS rel, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'in_nation', 'n' || s_nationkey FROM supplier"


@R.add("ref_b92_graph_neighbours", f"WITH e AS ({_EDGES}) SELECT src AS id, rel, dst AS other, 'out' AS direction FROM e UNION ALL SELECT dst, rel, src, 'in' FROM e")
def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """All neighbours, both ways."""
    return entities.neighbours(_edges(spark, sf))


@R.add(
    "ref_b93_graph_distances",
    f"""WITH RECURSIVE e AS ({_EDGES}), u AS (SELECT src AS id, dst AS other
        FROM e UNION SELECT dst, src FROM e), w(id, distance) AS (SELECT 's0', 0 UNION SELECT u.other, distance + 1
        FROM w JOIN u ON u.id = w.id WHERE distance < 8) SELECT id, CAST(min(distance) AS INTEGER) AS distance
    FROM w GROUP BY id""",
)
def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every node from the first supplier."""
    return entities.distances(_edges(spark, sf), "s0")


@R.add("ref_b97_graph_counts", f"WITH e AS ({_EDGES}) SELECT dst AS id, rel, count(*) AS n, min(src) AS first_src FROM e GROUP BY dst, rel")
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Degree by relation: a node's context in brief."""
    return _edges(spark, sf).groupBy(F.col("dst").alias("id"), "rel").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"))


@R.add(
    "ref_b98_search_score",
    """SELECT row_id, CASE WHEN lower(name) = 'road' THEN 100 WHEN lower(name) LIKE 'road%' THEN 60 WHEN lower(name) LIKE '%road%' THEN 40 ELSE 0 END + CASE WHEN lower(tags) LIKE '%road%' THEN 12 ELSE 0 END
    + CASE WHEN lower(category) LIKE '%road%' THEN 10 ELSE 0 END + CASE WHEN lower(description) LIKE '%road%' THEN 8 ELSE 0 END AS score FROM catalogue_raw""",
)
def search_score(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue entries scored for a term."""
    return table(spark, sf, "catalogue_raw").select("row_id", entities.search_score(F.col("name"), F.col("tags"), F.col("category"), F.col("description"), "road").alias("score"))


@R.add(
    "ref_x7_b73_name_normalisers",
    "SELECT row_id, trim(regexp_replace(regexp_replace(upper(trim(owner)), '[.,]', '', 'g'), ' (INC|LTD|LIMITED)$', '')) AS vendor_key FROM ev_raw",
)
def name_normalisers(spark: SparkSession, sf: str) -> DataFrame:
    """Owner names as keys: upper case, without punctuation and legal suffix."""
    return table(spark, sf, "ev_raw").select("row_id", F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.trim("owner")), "[.,]", ""), " (INC|LTD|LIMITED)$", "")).alias("vendor_key"))


# Sources and sinks -------------------------------------------------------------------
@R.add("ref_s1_s6_s13_csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers to an ordered CSV and back under a declared schema."""
    path = shared_path(spark, "supplier")
    files.write_csv(table(spark, sf, "supplier"), path, F.col("s_suppkey"))
    return files.read_csv_declared(spark, path, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@R.add("ref_s2_csv_sniffed", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_sniffed(spark: SparkSession, sf: str) -> DataFrame:
    """Nations through a CSV whose types are inferred."""
    path = shared_path(spark, "nation")
    files.write_csv(table(spark, sf, "nation"), path)
    return files.read_csv_sniffed(spark, path)


@R.add("ref_s3_s4_s11_csv_glob_text_with_tag", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment AS segment FROM customer")
def csv_glob(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written to a folder per segment, read back by glob as text, the segment taken from the path."""
    path = shared_path(spark, "customer")
    table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").write.partitionBy("c_mktsegment").option("header", True).csv(path)
    text = files.read_csv_text(spark, f"{path}/c_mktsegment=*/", ["c_custkey", "c_name"])
    return files.with_file_tag(text, "segment", r"c_mktsegment=([^/]+)/")


@R.add("ref_s5_s10_s12_header_synonyms", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name FROM customer")
def header_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads with different headers brought under one and stacked."""
    known = {"id": ("Supplier ID", "custkey"), "name": ("display name", "Full_Name")}
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("Supplier ID"), F.col("s_name").alias("Display Name"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("CUST_KEY"), F.col("c_name").alias("full name"))
    return files.canonical_headers(a, known).unionByName(files.canonical_headers(b, known))


@R.add("ref_s7_s14_geojson_round_trip", "SELECT row_id, evcsid, lon, lat FROM ev_raw")
def geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Chargers to GeoJSON features and back."""
    path = shared_path(spark, "ev")
    files.point_features(table(spark, sf, "ev_raw", "row_id", "evcsid", "lon", "lat"), "lon", "lat", ["row_id", "evcsid"]).write.text(path)
    return files.read_features(spark, path, "row_id: BIGINT, evcsid: STRING")


@R.add(
    "ref_x4_ring_centroid",
    f"""WITH v AS (SELECT zone_id, ring, unnest(range(1, len(ring))) AS i
        FROM zones), e AS (SELECT zone_id, ring[1].lon AS x0, ring[1].lat AS y0, ring[i].lon - ring[1].lon AS ax, ring[i].lat - ring[1].lat AS ay, ring[i+1].lon - ring[1].lon AS bx,
            ring[i+1].lat - ring[1].lat AS by2 FROM v) SELECT zone_id, {r2('min(x0) + sum((ax + bx) * (ax * by2 - bx * ay)) / (3 * sum(ax * by2 - bx * ay))', 5)} AS lon,
        {r2('min(y0) + sum((ay + by2) * (ax * by2 - bx * ay)) / (3 * sum(ax * by2 - bx * ay))', 5)} AS lat
    FROM e GROUP BY zone_id""",
)
def ring_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """Centroids of the zones."""
    lon, lat = files.ring_centroid("ring")
    return table(spark, sf, "zones", "zone_id", "ring").select("zone_id", lon.alias("lon"), lat.alias("lat")).selectExpr("zone_id", f"{r2('lon', 5)} AS lon", f"{r2('lat', 5)} AS lat")


@R.add("ref_s9_parquet_store", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def parquet_store(spark: SparkSession, sf: str) -> DataFrame:
    """Customers inserted into a partitioned store, consolidated from it by partition."""
    path = shared_path(spark, "store")
    table(spark, sf, "customer", "c_custkey", "c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@R.add("extra_hourly_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extra_hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events by tumbling hour; the batch twin of the stream."""
    out = hourly_counts(table(spark, sf, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
