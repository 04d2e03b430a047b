"""Further composite operators, as SQL over the whole tables: timelines, projections, matches, roll-ups, validations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.allocate import largest_remainder
from sparkloom.plans.registry import Registry
from sparkloom.plans.sqltext import REVENUE, cents, r2, sql_query
from sparkloom.sources.tables import table

R = Registry()


def q(name: str, sql: str, twin: str | None = None) -> None:
    sql_query(R, name, sql, twin)


@R.add("ref_f11_bound_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderpriority = '1-URGENT'")
def bound_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate whose values are bound, not pasted."""
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= CAST(:since AS TIMESTAMP) AND o_orderpriority = :priority", args={"since": "2000-01-01", "priority": "1-URGENT"}, orders=table(spark, sf, "orders"))


@R.add(
    "ref_b3_alloc_ties_by_highest_position",
    f"""WITH x AS (SELECT s_nationkey, s_suppkey, CAST(greatest(floor(s_acctbal / 4000), 0) AS BIGINT) AS w FROM supplier), s AS (SELECT *, sum(w) OVER g AS t0, count(*) OVER g AS k FROM x WINDOW g AS (PARTITION BY s_nationkey)),
    e AS (SELECT s_nationkey, s_suppkey, CASE WHEN t0 = 0 THEN 1 ELSE w END AS w, CASE WHEN t0 = 0 THEN k ELSE t0 END AS tot FROM s), f AS (SELECT *, 100001 * w // tot AS fl, 100001 * w % tot AS rest FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY rest DESC, s_suppkey DESC) AS rn, 100001 - sum(fl) OVER (PARTITION BY s_nationkey) AS spare FROM f) SELECT s_nationkey, s_suppkey, CAST(fl + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS cents FROM n""",
)
def alloc_highest_position(spark: SparkSession, sf: str) -> DataFrame:
    """1,000.01 per nation over its suppliers by a coarse weight that is often zero; leftovers go to the highest position."""
    x = table(spark, sf, "supplier").selectExpr("s_nationkey", "s_suppkey", "CAST(greatest(floor(s_acctbal / 4000), 0) AS BIGINT) AS w", "CAST(100001 AS BIGINT) AS total")
    return largest_remainder(x, ["s_nationkey"], "total", "w", [F.col("s_suppkey").desc()]).drop("w", "total")


q("ref_j23_b62_three_way_match", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(billed - ordered) <= greatest(500, ordered / 100) AND abs(received - ordered) <= ordered / 50 THEN 'match' WHEN abs(billed - ordered) <= greatest(500,
            ordered / 100) THEN 'quantity' WHEN abs(received - ordered) <= ordered / 50 THEN 'price' ELSE 'both' END AS status
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cents('l_extendedprice')} AS ordered, {cents('l_extendedprice')} + (l_orderkey % 7) * 200 AS billed,
            {cents('l_extendedprice')} - (l_partkey % 5) * 30000 AS received
        FROM {{lineitem}}) t""")
q("ref_a30_running_extremum_first_breach", """SELECT user_id, min(balance) AS lowest, min(CASE WHEN balance < -500 THEN rn END) AS first_breach
    FROM (SELECT user_id, rn, CAST(sum(step) OVER (PARTITION BY user_id
                ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
        FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN -CAST(floor(value) AS BIGINT) ELSE 50 END AS step, CAST(row_number() OVER (PARTITION BY user_id
                    ORDER BY ts, event_id) AS BIGINT) AS rn FROM {events}) a) b
    GROUP BY user_id""")
q("ref_b14_running_spend_without_copies", f"""SELECT l_orderkey, l_linenumber, CAST(sum(c) OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber) AS BIGINT) AS spent
    FROM (SELECT l_orderkey, l_linenumber, min({cents('l_extendedprice')}) AS c
        FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) t""")
q("extra_cumulative_ratio_bands", f"""SELECT wk, CASE WHEN {r2('earned / spent')} < 0.5 THEN 'over' WHEN {r2('earned / spent')} < 1.05 THEN 'near' ELSE 'under' END AS band, {r2('earned / spent')} AS ratio
    FROM (SELECT wk, CAST(sum(e) OVER (ORDER BY wk) AS DOUBLE) AS earned, CAST(sum(s) OVER (ORDER BY wk) AS DOUBLE) AS spent
        FROM (SELECT CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS wk, sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS e,
                sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS s
            FROM {{events}} GROUP BY 1) a) b""")
q("ref_b18_moving_average_projection", f"""SELECT s.k, {r2('m.last_n + s.k * m.mean_n')} AS projected
    FROM (SELECT avg(n) AS mean_n, max(CASE WHEN rn = 1 THEN n END) AS last_n
        FROM (SELECT n, row_number() OVER (ORDER BY mi DESC) AS rn
            FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS mi, count(*) AS n
                FROM {{orders}} GROUP BY 1) a) b WHERE rn <= 3) m
    CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS s(k)""")
q("ref_b19_run_rate", f"SELECT event_type, {r2('sum(CAST(round(value * 100) AS BIGINT)) / 100 / 15 * 31')} AS forecast FROM {{events}} WHERE day(ts) <= 15 GROUP BY event_type")
q("ref_b24_latest_flag", "SELECT o_orderkey, o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) AS is_latest FROM {orders}")
q("ref_b36_sensitivity", f"""SELECT p_brand, s.step, {r2('sum(CAST(round(p_retailprice * 100) AS BIGINT)) / 100 * (100 + s.step) / 100')} AS cost
    FROM {{part}} CROSS JOIN (VALUES (-10), (0), (10)) AS s(step)
    GROUP BY p_brand, s.step""")
q("ref_b44_volume_weighted_ratio", f"""SELECT CAST(hour(ts) AS BIGINT) AS hr, {r2('100 * CAST(sum(CASE WHEN value <= 20 THEN 1 ELSE 0 END) AS DOUBLE) / count(*)')} AS within_pct
    FROM {{events}} GROUP BY hour(ts)""")
q("ref_b51_book_versus_count", f"""SELECT k, book, counted, CASE WHEN abs(counted - book) > 50 THEN 'recount' WHEN counted <> book THEN 'adjust' ELSE 'ok' END AS status
    FROM (SELECT l_partkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS book, CAST(sum(CAST(l_quantity AS BIGINT)) + CASE WHEN l_partkey % 9 = 0 THEN 60 WHEN l_partkey % 4 = 0 THEN -3 ELSE 0 END AS BIGINT) AS counted
        FROM {{lineitem}} GROUP BY l_partkey) t""")
q("ref_b52_trial_balance", f"""SELECT account, side, CAST(sum(c) AS BIGINT) AS cents
    FROM (SELECT 'receivable' AS account, 'debit' AS side, {cents('o_totalprice')} AS c
        FROM {{orders}} UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'sales' ELSE 'deferred' END, 'credit', {cents('o_totalprice')}
        FROM {{orders}}) t GROUP BY account, side""")
q("ref_b75_margin_rollup", f"""SELECT p_brand, CAST(sum({REVENUE}) AS BIGINT) AS revenue, CAST(sum({REVENUE}) - sum({cents('p_retailprice')} * 100 * CAST(l_quantity AS BIGINT)) AS BIGINT) AS margin
    FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
    GROUP BY p_brand""")
q("ref_b76_weighted_unit_cost", f"""SELECT l_partkey, {r2('CAST(sum(' + cents('l_extendedprice') + ') AS DOUBLE) / nullif(sum(CAST(l_quantity AS BIGINT)), 0) / 100', 4)} AS unit_cost
    FROM {{lineitem}} GROUP BY l_partkey""")
q("ref_b78_totals_beside_rows", f"SELECT coalesce(s, 'TOTAL') AS status, n FROM (SELECT o_orderstatus AS s, count(*) AS n FROM {{orders}} GROUP BY ROLLUP (o_orderstatus)) t")
q("ref_b83_horizon", """SELECT o_orderkey, CAST((year(o_orderdate) * 12 + month(o_orderdate)) - (2001 * 12 + 5) AS BIGINT) AS months_ahead
    FROM {orders} WHERE (year(o_orderdate) * 12 + month(o_orderdate)) - (2001 * 12 + 5) BETWEEN 0 AND 2""")
q("ref_b87_positions_with_assertion", f"""SELECT user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN c ELSE 0 END) AS BIGINT) AS opening, CAST(sum(CASE WHEN event_type = 'purchase' THEN -c WHEN event_type = 'view' THEN c ELSE 0 END) AS BIGINT) AS flow,
        CASE WHEN sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 0 THEN 'missing opening' WHEN sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) > 1 THEN 'several openings' ELSE 'ok' END AS finding
    FROM (SELECT user_id, event_type, {cents('value')} AS c
        FROM {{events}}) t GROUP BY user_id""")
q("ref_b100_dataset_validation", """SELECT 'orphan nation' AS finding, count(*) AS n
    FROM {customer} LEFT ANTI JOIN {nation} ON c_nationkey = n_nationkey
    UNION ALL SELECT 'duplicate order', count(*)
    FROM (SELECT o_orderkey FROM {orders} GROUP BY o_orderkey
        HAVING count(*) > 1) d UNION ALL SELECT 'negative price', count(*)
    FROM {part} WHERE p_retailprice < 0 UNION ALL SELECT 'duplicate line', count(*)
    FROM (SELECT l_orderkey, l_linenumber FROM {lineitem}
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) l""", """SELECT 'orphan nation' AS finding, count(*) AS n
    FROM customer ANTI JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'duplicate order', count(*)
    FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey
        HAVING count(*) > 1) d UNION ALL SELECT 'negative price', count(*)
    FROM part WHERE p_retailprice < 0 UNION ALL SELECT 'duplicate line', count(*)
    FROM (SELECT l_orderkey, l_linenumber FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) l""")
q("extra_vector_lengths", f"""SELECT label, count(*) AS n, {r2('avg(len)')} AS mean_len
    FROM (SELECT label, CAST(size(embedding) AS DOUBLE) AS len
        FROM {{embeddings}}) t GROUP BY label""", f"""SELECT label, count(*) AS n, {r2('avg(len)')} AS mean_len
    FROM (SELECT label, CAST(len(embedding) AS DOUBLE) AS len
        FROM embeddings) t GROUP BY label""")
