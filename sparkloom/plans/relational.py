"""Projections, filters, joins, aggregates, windows, sorts, set operations and scalars, one query or more for each."""

from __future__ import annotations

from sparkloom.plans.registry import Registry
from sparkloom.plans.sqltext import REVENUE, cents, r2, sql_query

R = Registry()


def q(name: str, sql: str, twin: str | None = None) -> None:
    sql_query(R, name, sql, twin)


# Projections and filters
q("ref_p1_p2_p3_star_plus_computed", "SELECT *, n_regionkey * 10 AS region_code, n_name AS nation_label FROM {nation}")
q("ref_p4_searched_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band FROM {customer}")
q("ref_p5_simple_case_map", """SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' ELSE 'other' END AS status_name, count(*) AS orders
    FROM {orders} GROUP BY o_orderstatus""")
q("ref_p6_nested_case", """SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value > 200 THEN 'severe' WHEN value > 50 THEN 'plain' ELSE 'slight' END ELSE CASE WHEN value IS NULL THEN 'none' ELSE 'normal' END END AS level
    FROM {events}""")
q("ref_p7_case_without_else", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'oversize' END AS oversize FROM {part}")
q("ref_p8_p9_constant_and_boolean", "SELECT s_suppkey, 'supplier' AS kind, s_acctbal > 5000 AS is_rich FROM {supplier}")
q("ref_f1_f7_non_blank_case_insensitive", "SELECT row_id, trim(owner) AS owner FROM {ev_raw} WHERE owner IS NOT NULL AND trim(owner) <> '' AND lower(trim(assetstat)) = 'ins'")
q("ref_f2_in_not_in", "SELECT l_shipdate, count(*) AS n FROM {lineitem} WHERE l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('F') GROUP BY l_shipdate")
q("ref_f3_between", "SELECT p_brand, count(*) AS n FROM {part} WHERE p_size BETWEEN 10 AND 20 GROUP BY p_brand")
q("ref_f4_regex_predicate", "SELECT row_id, instyr FROM {ev_raw} WHERE regexp_like(instyr, '^[0-9]{{4}}$')", "SELECT row_id, instyr FROM ev_raw WHERE regexp_matches(instyr, '^[0-9]{4}$')")
q("ref_f5_cast_success", "SELECT row_id, try_cast(aadt AS INTEGER) AS aadt FROM {raw_counts} WHERE trim(aadt) RLIKE '^[0-9]{{1,9}}$'", "SELECT row_id, try_cast(trim(aadt) AS INTEGER) AS aadt FROM raw_counts WHERE regexp_matches(trim(aadt), '^[0-9]{1,9}$')")
q("ref_f6_mixed_and_or", """SELECT row_id FROM {collisions_raw} WHERE (lat IS NOT NULL AND lon IS NULL) OR (lat IS NULL AND lon IS NOT NULL) OR (weather_condition = 'Snow' AND light_condition IS NOT NULL)""")
q("ref_f8_scalar_subquery_filter", "SELECT o_orderkey FROM {orders} WHERE o_orderdate = (SELECT max(o_orderdate) FROM {orders})")
q("ref_f9_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15")
q("ref_f10_rank_filter", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn
        FROM {orders}) t WHERE rn <= 2""")
# Joins
q("ref_j1_inner_using", "SELECT n_name, count(*) AS suppliers FROM (SELECT s_suppkey, s_nationkey AS n_nationkey FROM {supplier}) s JOIN {nation} USING (n_nationkey) GROUP BY n_name")
q("ref_j2_inner_two_keys", """SELECT a.p_brand, a.p_type, a.n, b.top FROM (SELECT p_brand, p_type, count(*) AS n
        FROM {part} GROUP BY p_brand, p_type) a JOIN (SELECT p_brand, p_type, max(p_size) AS top
        FROM {part} GROUP BY p_brand, p_type) b ON a.p_brand = b.p_brand AND a.p_type = b.p_type""")
q("ref_j3_inner_extra_predicate", """SELECT c_custkey, t.o_orderkey FROM {customer}
    JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn
        FROM {orders}) t ON c_custkey = t.o_custkey AND t.rn = 1""")
q("ref_j4_left_outer", "SELECT o_orderkey, count(l_orderkey) AS lines FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
q("ref_j5_cross_one_row", f"""SELECT c_mktsegment, count(*) AS n, {r2('100 * count(*) / max(total)')} AS pct
    FROM {{customer}} CROSS JOIN (SELECT count(*) AS total
        FROM {{customer}}) t GROUP BY c_mktsegment""")
q("ref_j6_j12_comma_join_where", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
q("ref_j7_grid", """SELECT y.yr, s.seg, count(o_orderkey) AS orders
    FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS yr
        FROM {orders}) y CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg
        FROM {customer}) s LEFT JOIN (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS yr, c_mktsegment AS seg
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey) o ON o.yr = y.yr AND o.seg = s.seg
    GROUP BY y.yr, s.seg""")
q("ref_j10_left_anti", "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)")
q(
    "ref_j11_not_in_null_aware",  # an anti join on distinct keys and the null rules stated, since NOT IN itself broadcasts its list whatever the size
    """SELECT s.row_id FROM {shelters_raw} s
    LEFT ANTI JOIN (SELECT DISTINCT busstopid FROM {stops_raw} WHERE busstopid IS NOT NULL) t ON s.busstopid = t.busstopid
    WHERE s.busstopid IS NOT NULL OR NOT EXISTS (SELECT 1 FROM {stops_raw} WHERE busstopid IS NOT NULL)""",
    "SELECT row_id FROM shelters_raw WHERE busstopid NOT IN (SELECT busstopid FROM stops_raw WHERE busstopid IS NOT NULL)",
)
q("ref_j13_exists_flag", """SELECT s.busstopid, CASE WHEN EXISTS (SELECT 1
        FROM {shelters_raw} h WHERE h.busstopid = s.busstopid) THEN 1 ELSE 0 END AS has_shelter
    FROM (SELECT DISTINCT busstopid FROM {stops_raw}) s""")
q("ref_j14_correlated_count", "SELECT n_nationkey, (SELECT count(*) FROM {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 1000) AS rich FROM {nation}")
q("ref_j15_correlated_sum_join", f"SELECT r_regionkey, (SELECT coalesce(sum({cents('c_acctbal')}), 0) FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS cents FROM {{region}}".replace("coalesce(sum(", "CAST(coalesce(sum(").replace(", 0) FROM", ", 0) AS BIGINT) FROM"))
q("ref_j19_j20_lookup_with_miss", """SELECT row_id, trim(r.feed) AS feed, coalesce(t.trust, 0) AS trust, CASE WHEN t.feed IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS status
    FROM {raw_counts} r LEFT JOIN {feed_trust} t ON r.feed = t.feed""")
q("ref_j21_union_of_keys", """SELECT k.nk, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers
    FROM (SELECT c_nationkey AS nk FROM {customer} UNION SELECT s_nationkey
        FROM {supplier}) k LEFT JOIN (SELECT c_nationkey, count(*) AS n
        FROM {customer} GROUP BY c_nationkey) c ON c.c_nationkey = k.nk
    LEFT JOIN (SELECT s_nationkey, count(*) AS n
        FROM {supplier} GROUP BY s_nationkey) s ON s.s_nationkey = k.nk""")
q("ref_j24_children_as_list", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS nations FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
# Aggregates
q("ref_a1_a2_a4_basic", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS cents, min(l_quantity) AS least_qty, max(l_quantity) AS most_qty
    FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus""")
q("ref_a3_avg_rounded", f"SELECT event_type, {r2('avg(CAST(round(value * 100) AS BIGINT)) / 100')} AS mean_value FROM {{events}} GROUP BY event_type")
q("ref_a5_a7_distinct_filtered", """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 100) AS big_users, count(*) FILTER (WHERE value > 100) AS big
    FROM {events} GROUP BY event_type""")
q("ref_a8_conditional_sums", """SELECT CAST(hour(ts) AS BIGINT) AS hr, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases
    FROM {events} GROUP BY hour(ts)""")
q("ref_a9_pivot_by_max_case", """SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS top_open, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS top_filled
    FROM {orders} GROUP BY o_custkey""")
q("ref_a10_arg_min_max", """SELECT o_custkey, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS cheapest, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS dearest
    FROM {orders} GROUP BY o_custkey""", """SELECT o_custkey, arg_min(o_orderkey, row(o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) AS dearest
    FROM orders GROUP BY o_custkey""")
q("ref_a14_ordered_string_agg", """SELECT r_name, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS nations
    FROM {region} JOIN {nation} ON r_regionkey = n_regionkey
    GROUP BY r_name""", "SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name DESC) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
q("ref_a15_a16_group_by_ordinal_expression", "SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, upper(substr(o_orderpriority, 3)) AS priority, count(*) AS n FROM {orders} GROUP BY 1, 2")
q("ref_a17_group_by_alias", "SELECT substr(p_name, 1, 3) AS prefix, count(*) AS n FROM {part} GROUP BY prefix")
q("ref_a18_global", "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, max(c_acctbal) AS top FROM {customer}")
q("ref_a19_two_level", "SELECT max(n) AS busiest, min(n) AS quietest FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) t")
q("ref_a20_a21_guarded_ratios", f"""SELECT user_id, {r2('100 * count(*) FILTER (WHERE event_type = ' + chr(39) + 'purchase' + chr(39) + ') / nullif(count(*) FILTER (WHERE event_type = ' + chr(39) + 'view' + chr(39) + '), 0)')} AS conversion_pct
    FROM {{events}} GROUP BY user_id""")
q("ref_a22_a23_share_over_aggregate", f"SELECT o_orderpriority, count(*) AS n, {r2('100 * count(*) / sum(count(*)) OVER ()')} AS pct FROM {{orders}} GROUP BY o_orderpriority")
q("ref_a24_complete_periods", "SELECT CAST(year(o_orderdate) AS BIGINT) AS yr FROM {orders} GROUP BY year(o_orderdate) HAVING count(DISTINCT month(o_orderdate)) = 12")
q("ref_a25_distinct", "SELECT DISTINCT p_brand, p_type FROM {part}")
q("ref_a27_first_copy", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_part FROM {lineitem} GROUP BY l_orderkey, l_linenumber")
q("ref_a28_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
q(
    "ref_a29_zero_filled_buckets",  # summed by bucket first, then met by the scaffold
    """SELECT b.bucket, coalesce(n, 0) AS parts FROM (VALUES ('0-10'), ('11-25'), ('26-50'), ('51-plus')) AS b(bucket)
    LEFT JOIN (SELECT CASE WHEN p_size BETWEEN 0 AND 10 THEN '0-10' WHEN p_size BETWEEN 11 AND 25 THEN '11-25' WHEN p_size BETWEEN 26 AND 50 THEN '26-50' WHEN p_size BETWEEN 51 AND 9999 THEN '51-plus' END AS bucket, count(*) AS n FROM {part} GROUP BY 1) p ON p.bucket = b.bucket""",
    """SELECT b.bucket, count(p_partkey) AS parts
    FROM (VALUES ('0-10', 0, 10), ('11-25', 11, 25), ('26-50', 26, 50), ('51-plus', 51, 9999)) AS b(bucket, lo, hi)
    LEFT JOIN part ON p_size BETWEEN b.lo AND b.hi
    GROUP BY b.bucket""",
)
q("ref_a31_top_n_average", f"""SELECT o_custkey, {r2('avg(CAST(round(o_totalprice * 100) AS BIGINT)) / 100')} AS best_five
    FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn
        FROM {{orders}}) t WHERE rn <= 5 GROUP BY o_custkey""")
q("ref_a32_regression", f"""SELECT p_brand, {r2('regr_slope(p_retailprice, CAST(p_size AS DOUBLE))', 4)} AS slope, {r2('regr_intercept(p_retailprice, CAST(p_size AS DOUBLE))', 3)} AS intercept
    FROM {{part}} GROUP BY p_brand""")
q("ref_a33_countifs_sumifs", f"""SELECT count(*) FILTER (WHERE l_quantity > 25 AND l_discount >= 0.05) AS matches, CAST(sum({cents('l_extendedprice')}) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned_cents,
        {r2('avg(l_quantity) FILTER (WHERE l_linestatus = ' + chr(39) + 'O' + chr(39) + ')')} AS open_mean
    FROM {{lineitem}}""")
q("ref_a34_label_of_maximum", """SELECT event_type, hr AS peak_hour FROM (SELECT event_type, CAST(hour(ts) AS BIGINT) AS hr, row_number() OVER (PARTITION BY event_type
            ORDER BY count(*) DESC, hour(ts)) AS rn FROM {events}
        GROUP BY event_type, hour(ts)) t WHERE rn = 1""")
q("ref_a35_sum_of_rounded", f"SELECT o_orderstatus, CAST(sum(CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS BIGINT) AS whole FROM {{orders}} GROUP BY o_orderstatus")
# Windows
q("ref_w1_row_number_tiebreak", """SELECT l_orderkey, l_partkey, l_shipdate, CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate NULLS LAST, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS BIGINT) AS rn
    FROM {lineitem}""")
q("ref_w2_w3_w5_global_ranks", """SELECT n_name, n, CAST(row_number() OVER (ORDER BY n DESC, n_name) AS BIGINT) AS rn, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS rk, CAST(dense_rank() OVER (ORDER BY n DESC) AS BIGINT) AS dr
    FROM (SELECT n_name, count(*) AS n FROM {nation}
        JOIN {customer} ON c_nationkey = n_nationkey
        GROUP BY n_name) t""")
q("ref_w7_rank_over_rounded_share", f"""SELECT p_brand, share, CAST(dense_rank() OVER (ORDER BY share DESC) AS BIGINT) AS share_rank
    FROM (SELECT p_brand, {r2('100 * count(*) FILTER (WHERE p_size > 25) / count(*)', 1)} AS share
        FROM {{part}} GROUP BY p_brand) t""")
q("ref_w9_w11_lag_yoy", f"""SELECT yr, n, n - lag(n) OVER (ORDER BY yr) AS change, {r2('100 * (n - lag(n) OVER (ORDER BY yr)) / lag(n) OVER (ORDER BY yr)')} AS pct
    FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n
        FROM {{orders}} GROUP BY year(o_orderdate)) t""")
q("ref_w10_lag_guarded_by_adjacency", """SELECT nk, yr, n, CASE WHEN lag(yr) OVER w = yr - 1 THEN n - lag(n) OVER w END AS change
    FROM (SELECT c_nationkey AS nk, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        WHERE o_custkey % 7 <> year(o_orderdate) % 7 OR c_nationkey % 5 <> 0
        GROUP BY c_nationkey, year(o_orderdate)) t
    WINDOW w AS (PARTITION BY nk ORDER BY yr)""")
q("ref_w13_running_rows", f"""SELECT d, CAST(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
    FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n
        FROM {{orders}} GROUP BY CAST(o_orderdate AS DATE)) t""")
q("ref_w14_running_range_peers", """SELECT p_size, p_brand, n, CAST(sum(n) OVER (PARTITION BY p_brand
            ORDER BY p_size % 10) AS BIGINT) AS running
    FROM (SELECT p_size, p_brand, count(*) AS n
        FROM {part} GROUP BY p_size, p_brand) t""")
q("ref_w15_w16_partition_and_grand_total", f"""SELECT n_nationkey, n, CAST(sum(n) OVER (PARTITION BY n_regionkey) AS BIGINT) AS region_n, CAST(sum(n) OVER () AS BIGINT) AS all_n
    FROM (SELECT n_nationkey, n_regionkey, count(*) AS n
        FROM {{nation}} JOIN {{customer}} ON c_nationkey = n_nationkey
        GROUP BY n_nationkey, n_regionkey) t""")
q("ref_w17_dominant_flag", """SELECT p_type, p_brand, n, CASE WHEN row_number() OVER (PARTITION BY p_type
        ORDER BY n DESC, p_brand) = 1 THEN 1 ELSE 0 END AS is_dominant
    FROM (SELECT p_type, p_brand, count(*) AS n
        FROM {part} GROUP BY p_type, p_brand) t""")
q("ref_w18_export_row_id", "SELECT CAST(row_number() OVER (ORDER BY r_name, n_name) AS BIGINT) AS id, r_name, n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
q("ref_w19_count_beside_row_number", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate NULLS LAST, o_orderkey) AS BIGINT) AS nth, count(*) OVER (PARTITION BY o_custkey) AS of_n
    FROM {orders}""")
q("ref_w21_moving_averages", f"""SELECT d, {r2('avg(n) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS mean3, {r2('(3 * n + 2 * coalesce(lag(n, 1) OVER (ORDER BY d), n) + coalesce(lag(n, 2) OVER (ORDER BY d), n)) / 6')} AS weighted3
    FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n
        FROM {{events}} GROUP BY CAST(ts AS DATE)) t""")
q("ref_w22_m11_rolling_three_months", """SELECT mi, CAST(sum(n) OVER (ORDER BY mi RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling3
    FROM (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS mi, count(*) AS n
        FROM {orders} GROUP BY year(o_orderdate) * 12 + month(o_orderdate)) t""")
q("ref_w23_same_period_last_year", """SELECT a.mi, a.n, b.n AS last_year FROM (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS mi, count(*) AS n
        FROM {orders} GROUP BY 1) a LEFT JOIN (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS mi, count(*) AS n
        FROM {orders} GROUP BY 1) b ON b.mi = a.mi - 12""")
q("ref_w24_direction_flag", """SELECT d, n, CASE WHEN n > lag(n) OVER (ORDER BY d) THEN 'up' WHEN n < lag(n) OVER (ORDER BY d) THEN 'down' WHEN n = lag(n) OVER (ORDER BY d) THEN 'flat' END AS direction
    FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n
        FROM {events} GROUP BY CAST(ts AS DATE)) t""")
# Sort and top-k: the limit is the feature
q("ref_o1_o2_o8_nulls_last_topk", "SELECT row_id, county FROM {raw_counts} ORDER BY county NULLS LAST, row_id LIMIT 50")
q("ref_o3_o4_o10_null_flag_and_case_order", "SELECT row_id FROM {collisions_raw} ORDER BY (lat IS NULL) DESC, CASE light_condition WHEN 'Dark' THEN 1 WHEN 'Dawn' THEN 2 ELSE 3 END, row_id LIMIT 40")
q("ref_o5_sort_by_cast", "SELECT row_id, objectid FROM {calls_raw} ORDER BY try_cast(objectid AS BIGINT) DESC NULLS LAST, row_id LIMIT 25")
q("ref_o6_order_limit_one", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1")
q("ref_o7_o11_top_n_by_rank", """SELECT n_name, s_suppkey FROM (SELECT n_name, s_suppkey, rank() OVER (PARTITION BY n_name
            ORDER BY s_acctbal DESC) AS rk FROM {supplier}
        JOIN {nation} ON s_nationkey = n_nationkey) t
    WHERE rk <= 3""")
q("ref_o9_offset_page_with_total", "SELECT c_custkey, total FROM {customer} CROSS JOIN (SELECT count(*) AS total FROM {customer}) t ORDER BY c_custkey LIMIT 20 OFFSET 40")
# Set operations
q("ref_u1_u4_stacked_sections", """SELECT 'status' AS section, o_orderstatus AS item, count(*) AS n
    FROM {orders} GROUP BY o_orderstatus UNION ALL SELECT 'priority', o_orderpriority, count(*)
    FROM {orders} GROUP BY o_orderpriority UNION ALL SELECT 'all', 'all', count(*)
    FROM {orders}""")
q("ref_u2_u5_unpivot", f"""SELECT l_suppkey, measure, amount FROM (SELECT l_suppkey, CAST(sum({cents('l_extendedprice')}) AS BIGINT) AS cents, count(*) AS lines
        FROM {{lineitem}} GROUP BY l_suppkey) t UNPIVOT (amount FOR measure IN (cents, lines))""")
q("ref_u3_union_distinct", "SELECT c_nationkey AS nk FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
q("ref_u6_set_difference", "SELECT p_partkey FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R'")
# Scalars
q("ref_c1_c2_c3_c5_text", "SELECT row_id, upper(trim(evcsid)) AS code, lower(trim(owner)) AS owner, substr(trim(location), 1, 4) AS head, replace(location, '-', ' ') AS spaced FROM {ev_raw}")
q("ref_c4_sentence_case", "SELECT row_id, upper(substr(trim(owner), 1, 1)) || lower(substr(trim(owner), 2)) AS owner FROM {ev_raw}")
q("ref_c6_c7_scrub_white_space", r"SELECT row_id, trim(regexp_replace(replace(loc_desc, chr(160), ' '), '[ \\t\\r\\n]+', ' ')) AS loc_desc FROM {cap_raw}", r"SELECT row_id, trim(regexp_replace(replace(loc_desc, chr(160), ' '), '[ \t\r\n]+', ' ', 'g')) AS loc_desc FROM cap_raw")
q("ref_c8_c9_c10_regex", """SELECT name, regexp_replace(name, '^[A-Z][a-z]+#0*', '') AS tail, regexp_extract(name, '#([0-9]+)$', 1) AS digits, regexp_like(name, '7$') AS ends_in_seven
    FROM (SELECT s_name AS name FROM {supplier}) t""", """SELECT name, regexp_replace(name, '^[A-Z][a-z]+#0*', '') AS tail, regexp_extract(name, '#([0-9]+)$', 1) AS digits, regexp_matches(name, '7$') AS ends_in_seven
    FROM (SELECT s_name AS name FROM supplier)""")
q("ref_c11_c12_c13_format", """SELECT n_nationkey, concat(n_name, ' (', CAST(n_regionkey AS STRING), ')') AS label, format_string('%03d', n_nationkey) AS padded, format_number(n_nationkey * 123456,
            0) AS grouped FROM {nation}""", """SELECT n_nationkey, concat(n_name, ' (', CAST(n_regionkey AS VARCHAR), ')') AS label, printf('%03d', n_nationkey) AS padded, format('{:,}', n_nationkey * 123456) AS grouped
    FROM nation""")
q("ref_c14_coalesce_nullif", "SELECT row_id, coalesce(nullif(trim(category), ''), 'none') AS category FROM {catalogue_raw}")
q(
    "ref_c15_c16_casts",  # every row: what doesn't cast is null (C16); C15 casts what has been tested
    """SELECT row_id, try_cast(CASE WHEN trim(handled) RLIKE '^[+-]?[0-9]{{1,18}}$' THEN trim(handled) END AS INTEGER) AS handled,
    CAST(CASE WHEN trim(average_talk_time) RLIKE '^[0-9]+([.][0-9]+)?$' THEN trim(average_talk_time) ELSE '-1' END AS DOUBLE) AS talk FROM {calls_raw}""",
    """SELECT row_id, try_cast(CASE WHEN regexp_full_match(trim(handled), '[+-]?[0-9]{1,18}') THEN trim(handled) END AS INTEGER) AS handled, CAST(CASE WHEN regexp_full_match(trim(average_talk_time),
                '[0-9]+([.][0-9]+)?') THEN trim(average_talk_time) ELSE '-1' END AS DOUBLE) AS talk
    FROM calls_raw""",
)
q("ref_c17_c19_c20_c21_numbers", f"""SELECT s_suppkey, {r2('s_acctbal / 3')} AS third, abs(s_acctbal) AS size, least(s_acctbal, 5000) AS capped, CAST(floor((s_suppkey + 6) / 7) AS BIGINT) AS week
    FROM {{supplier}}""")
q("ref_c18_cagr", f"""SELECT nk, {r2('100 * (pow(last_n / CAST(first_n AS DOUBLE), CAST(1 AS DOUBLE) / (last_yr - first_yr)) - 1)', 3)} AS cagr_pct
    FROM (SELECT nk, min(yr) AS first_yr, max(yr) AS last_yr, max(CASE WHEN yr = 1995 THEN n END) AS first_n, max(CASE WHEN yr = 2000 THEN n END) AS last_n
        FROM (SELECT c_nationkey AS nk, year(o_orderdate) AS yr, count(*) AS n
            FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
            WHERE year(o_orderdate) <= 2000 GROUP BY c_nationkey, year(o_orderdate)) a
        GROUP BY nk) b""")
q("ref_d1_d2_d3_d4_dates", """SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mon, CAST(weekday(o_orderdate) + 1 AS BIGINT) AS iso_day,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start
    FROM {orders}""", """SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mon, CAST(isodow(o_orderdate) AS BIGINT) AS iso_day,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start
    FROM orders""")
q("ref_d5_month_boundaries", "SELECT o_orderkey, CAST((2001 * 12 + 8) - (year(o_orderdate) * 12 + month(o_orderdate)) AS BIGINT) AS months FROM {orders}", "SELECT o_orderkey, date_diff('month', o_orderdate, TIMESTAMP '2001-08-01') AS months FROM orders")
q(
    "ref_d6_parse_with_pattern",  # every row: texts of another shape, or no real moment, are null
    "SELECT row_id, CAST(try_to_timestamp(trim(call_date), 'M/d/yyyy h:mm:ss a') AS TIMESTAMP_NTZ) AS at FROM {calls_raw}",
    """SELECT row_id, CASE WHEN regexp_full_match(trim(call_date), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [APap][Mm]') THEN try_strptime(trim(call_date),
            '%-m/%-d/%Y %-I:%M:%S %p') END AS at FROM calls_raw""",
)
q("ref_d7_d15_period_labels", """SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS period, date_format(add_months(CAST(o_orderdate AS DATE), 1), 'yyyy-MM') AS next_period
    FROM {orders}""", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next_period
    FROM orders""")
q("ref_d8_d9_d10_day_distances", """SELECT o_orderkey, CAST(datediff(DATE '2001-08-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(greatest(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)),
                0) AS BIGINT) AS overdue FROM {orders}""", """SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS days, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01'),
            0) AS overdue FROM orders""")
q("ref_d11_d12_month_ends", """SELECT o_orderkey, add_months(CAST(o_orderdate AS DATE), 1) AS next_month, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS BIGINT) AS month_days
    FROM {orders}""", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS BIGINT) AS month_days
    FROM orders""")
q("ref_d13_week_bucket", "SELECT event_id, CAST(floor(datediff(CAST(ts AS DATE), DATE '2024-01-01') / 7) + 1 AS BIGINT) AS wk FROM {events}", "SELECT event_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) + 1 AS BIGINT) AS wk FROM events")
q("ref_d14_whole_years", "SELECT o_orderkey, CAST(floor(months_between(DATE '2001-08-15', CAST(o_orderdate AS DATE)) / 12) AS BIGINT) AS age FROM {orders}", "SELECT o_orderkey, CAST(floor(date_sub('month', CAST(o_orderdate AS DATE), DATE '2001-08-15') / 12) AS BIGINT) AS age FROM orders")
q(
    "ref_d16_strict_dates",  # every row: what isn't exactly a real yyyy-mm-dd is null and marked
    """SELECT row_id, d, d IS NOT NULL AS is_valid FROM (SELECT row_id, CASE WHEN trim(count_date) RLIKE '^(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast(trim(count_date) AS DATE) END AS d FROM {raw_counts}) t""",
    """SELECT row_id, d, d IS NOT NULL AS is_valid
    FROM (SELECT row_id, CASE WHEN regexp_full_match(trim(count_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND NOT starts_with(trim(count_date), '0000') THEN try_cast(trim(count_date) AS DATE) END AS d
        FROM raw_counts)""",
)
q("ref_d17_time_of_day_minutes", """SELECT row_id, CAST(CAST(substr(trim(call_interval), 1, 2) AS INTEGER) * 60 + CAST(substr(trim(call_interval), 4, 2) AS INTEGER) AS BIGINT) AS minutes
    FROM {calls_raw} WHERE trim(call_interval) RLIKE '^([01][0-9]|2[0-3]):[0-5][0-9]$'""", """SELECT row_id, CAST(CAST(substr(trim(call_interval), 1, 2) AS INTEGER) * 60 + CAST(substr(trim(call_interval), 4, 2) AS INTEGER) AS BIGINT) AS minutes
    FROM calls_raw WHERE regexp_matches(trim(call_interval), '^([01][0-9]|2[0-3]):[0-5][0-9]$')""")
q("ref_x1_x2_x3_nested", "SELECT z.zone_id, z.ring[0].lon AS first_lon, p.lat FROM {zones} z LATERAL VIEW explode(z.ring) e AS p", "SELECT zone_id, ring[1].lon AS first_lon, p.lat AS lat FROM (SELECT zone_id, ring, unnest(ring) AS p FROM zones)")
q("ref_s7_json_properties", "SELECT event_id, from_json(props, 'k INT').k AS k FROM {events}", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
q("ref_x6_slug", "SELECT name_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-'), '^-|-$', '') AS slug FROM {name_register}", "SELECT name_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM name_register")
q("ref_x8_money_text_to_cents", """SELECT s_suppkey, CAST(CAST(regexp_replace(t, '[$,]', '') AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
    FROM (SELECT s_suppkey, concat('$', format_number(s_acctbal, 2)) AS t
        FROM {supplier}) x""", "SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM supplier")
q(
    "ref_x9_unit_conversion",  # every row: a unit that isn't known has no conversion and says so
    "SELECT row_id, power * u.factor AS watts, u.unit IS NOT NULL AS is_known FROM {ev_raw} LEFT JOIN (VALUES ('KW', 1000), ('W', 1)) AS u(unit, factor) ON upper(trim(powerunit)) = u.unit",
    "SELECT row_id, power * CASE upper(trim(powerunit)) WHEN 'KW' THEN 1000 WHEN 'W' THEN 1 END AS watts, coalesce(upper(trim(powerunit)) IN ('KW', 'W'), false) AS is_known FROM ev_raw",
)
# Measures over a context
q("ref_m1_m2_m3_measures", f"""SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations, {r2('sum(CAST(round(c_acctbal * 100) AS BIGINT)) / nullif(count(*) FILTER (WHERE c_acctbal > 0), 0) / 100')} AS per_positive
    FROM {{customer}} GROUP BY c_mktsegment""")
q("ref_m4_m5_previous_calendar_year", """SELECT a.seg, a.yr, a.n, b.n AS prior, a.n - b.n AS change
    FROM (SELECT c_mktsegment AS seg, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        GROUP BY 1, 2) a LEFT JOIN (SELECT c_mktsegment AS seg, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        GROUP BY 1, 2) b ON a.seg = b.seg AND b.yr = a.yr - 1""")
q("ref_m6_m7_m9_rank_and_share_of_all", f"""SELECT p_brand, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS rk, {r2('100 * n / sum(n) OVER ()')} AS pct, max(n) OVER () AS top
    FROM (SELECT p_brand, count(*) AS n FROM {{part}}
        GROUP BY p_brand) t""")
q("ref_m8_cumulative", "SELECT yr, CAST(sum(n) OVER (ORDER BY yr) AS BIGINT) AS so_far FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n FROM {orders} GROUP BY 1) t")
q("ref_m10_what_if", f"""SELECT o_orderstatus, s.rate, CAST(sum(CAST(floor(CAST(round(o_totalprice * 100) AS BIGINT) * (100 + s.rate) / 100) AS BIGINT)) AS BIGINT) AS cents
    FROM {{orders}} CROSS JOIN (VALUES (0), (5), (10)) AS s(rate)
    GROUP BY o_orderstatus, s.rate""")
# Composite reports
q("window_trend", """SELECT nk, first_yr, last_yr, first_n, last_n, last_n - first_n AS change, CASE WHEN last_n > first_n THEN 'rising' WHEN last_n < first_n THEN 'falling' ELSE 'steady' END AS trend,
        CAST(dense_rank() OVER (ORDER BY last_n - first_n DESC) AS BIGINT) AS trend_rank
    FROM (SELECT nk, min(yr) AS first_yr, max(yr) AS last_yr, min_by(n, yr) AS first_n, max_by(n, yr) AS last_n
        FROM (SELECT c_nationkey AS nk, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n
            FROM {orders} JOIN {customer} ON o_custkey = c_custkey
            GROUP BY 1, 2) a GROUP BY nk) b""", """SELECT nk, first_yr, last_yr, first_n, last_n, last_n - first_n AS change, CASE WHEN last_n > first_n THEN 'rising' WHEN last_n < first_n THEN 'falling' ELSE 'steady' END AS trend,
        dense_rank() OVER (ORDER BY last_n - first_n DESC) AS trend_rank
    FROM (SELECT nk, min(yr) AS first_yr, max(yr) AS last_yr, arg_min(n, yr) AS first_n, arg_max(n, yr) AS last_n
        FROM (SELECT c_nationkey AS nk, year(o_orderdate) AS yr, count(*) AS n
            FROM orders JOIN customer ON o_custkey = c_custkey
            GROUP BY 1, 2) a GROUP BY nk) b""")
q("surplus_league", f"""SELECT n_name, yr, net, CAST(rank() OVER (PARTITION BY yr
            ORDER BY net DESC) AS BIGINT) AS best, CAST(rank() OVER (PARTITION BY yr
            ORDER BY net) AS BIGINT) AS worst, CAST(count(*) OVER w AS BIGINT) AS years, net - lag(net) OVER (PARTITION BY n_name
        ORDER BY yr) AS change FROM (SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(sum({REVENUE}) AS BIGINT) AS net
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
        JOIN {{customer}} ON o_custkey = c_custkey
        JOIN {{nation}} ON c_nationkey = n_nationkey
        GROUP BY n_name, year(o_orderdate)) t WINDOW w AS (PARTITION BY n_name)""")
q("pivot_day_hour", """SELECT * FROM (SELECT CAST(hour(ts) AS BIGINT) AS hr, event_type
        FROM {events}) PIVOT (count(*) FOR event_type IN ('view' AS view_n, 'click' AS click_n, 'purchase' AS purchase_n, 'error' AS error_n, 'signup' AS signup_n))""", "SELECT CAST(hour(ts) AS BIGINT) AS hr, " + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{e}'), 0) AS {e}_n" for e in ("view", "click", "purchase", "error", "signup")) + " FROM events GROUP BY hour(ts)")
q("freshness_report", """SELECT 'bucket' AS section, bucket AS item, count(*) AS n
    FROM (SELECT CASE WHEN last_at IS NULL THEN 'No date' WHEN months <= 3 THEN 'Fresh' WHEN months <= 12 THEN 'Aging' WHEN months <= 36 THEN 'Stale' ELSE 'Dormant' END AS bucket
        FROM (SELECT c_custkey, max(o_orderdate) AS last_at, (2001 * 12 + 8) - (year(max(o_orderdate)) * 12 + month(max(o_orderdate))) AS months
            FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey
            GROUP BY c_custkey) a) b GROUP BY bucket UNION ALL SELECT 'segment', c_mktsegment, count(*)
    FROM {customer} GROUP BY c_mktsegment""")
