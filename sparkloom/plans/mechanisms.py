"""Queries for mechanisms that stand by themselves: as-of tiers, splits, matrices, ladders, scores, graphs, stores, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.measures import Measures
from sparkloom.operators import entities, ledger, reconcile, retention
from sparkloom.operators.allocate import largest_remainder
from sparkloom.operators.ranking import ranked
from sparkloom.plans.engine import _EDGES, _NODES, _TRI, _edges, _nodes, cumulative_triangle
from sparkloom.plans.registry import Registry
from sparkloom.plans.sqltext import cents, r2, sql_query
from sparkloom.session import shared_path
from sparkloom.sources import files
from sparkloom.sources.tables import table

R = Registry()


def _sql(spark: SparkSession, sf: str, text: str, *tables: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf, t) for t in tables}, **frames)


# Tiers ---------------------------------------------------------------------------------------
_TIERS = "SELECT DISTINCT p_brand AS brand, p_size AS least, p_size % 7 AS pct FROM part WHERE p_size % 4 = 1"


@R.add(
    "ref_j18_tier_asof",
    f"""WITH t AS ({_TIERS}), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, (SELECT pct FROM t WHERE t.brand = l.brand AND t.least <= l.qty ORDER BY least DESC LIMIT 1) AS pct FROM l""",
)
def tier_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the highest tier of its brand whose minimum quantity it reaches, from a table of tiers; null below all."""
    lines = _sql(spark, sf, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, p_brand AS brand
    FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""", "lineitem", "part")
    tiers = _sql(spark, sf, _TIERS.replace("FROM part", "FROM {part}"), "part")
    return reconcile.asof_tier(lines, tiers, ["brand"], "qty", "least", "pct").drop("brand")


@R.add(
    "ref_b32_split_over_tiers",
    f"""WITH t(tier, lo, hi, pct) AS (VALUES (1, 0, 10000000, 2), (2, 10000000, 30000000, 3), (3, 30000000, NULL, 5))
    SELECT o_orderkey, tier, CAST(least(c, coalesce(hi, c)) - lo AS BIGINT) AS part, CAST(((least(c, coalesce(hi, c)) - lo) * pct + 50) // 100 AS BIGINT) AS charge
    FROM (SELECT o_orderkey, {cents("o_totalprice")} AS c FROM orders) o JOIN t ON c > lo""",
)
def split_over_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's value split over the tiers it spans, each part charged and rounded by itself."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{cents('o_totalprice')} AS c")
    return ledger.split_over_tiers(o, "c", [(0, 10_000_000, 2), (10_000_000, 30_000_000, 3), (30_000_000, None, 5)]).drop("c")


_POOLS = "VALUES ('rent', 1000003, 'customers'), ('power', 500001, 'suppliers'), ('cards', 77, 'rich')"
_DRIVERS = """SELECT n_name, 'customers' AS driver, count(c_custkey) AS w FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT n_name, 'suppliers', count(s_suppkey) FROM {nation} LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT n_name, 'rich', count(c_custkey) FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 9995 GROUP BY n_name"""


@R.add(
    "ref_b5_pool_matrix",
    f"""WITH p(pool, total, driver) AS ({_POOLS}), d AS ({_DRIVERS.replace("{", "").replace("}", "")}), x AS (SELECT pool, n_name, total, w, sum(w) OVER (PARTITION BY pool) AS s, count(*) OVER (PARTITION BY pool) AS k FROM p JOIN d USING (driver)),
    e AS (SELECT pool, n_name, total, CASE WHEN s = 0 THEN 1 ELSE w END AS w, CASE WHEN s = 0 THEN k ELSE s END AS s FROM x), f AS (SELECT *, total * w // s AS fl, total * w % s AS rest FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY rest DESC, n_name) AS rn, total - sum(fl) OVER (PARTITION BY pool) AS spare FROM f), c AS (SELECT pool, n_name, CAST(fl + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS cents FROM n)
    SELECT pool, n_name, cents FROM c UNION ALL SELECT pool, 'all', CAST(sum(cents) AS BIGINT) FROM c GROUP BY pool UNION ALL SELECT 'all', n_name, CAST(sum(cents) AS BIGINT) FROM c GROUP BY n_name UNION ALL SELECT 'all', 'all', CAST(sum(cents) AS BIGINT) FROM c""",
)
def pool_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Three cost pools, each over the nations by its own driver, with row and column totals."""
    pools = spark.sql(f"SELECT pool, CAST(total AS BIGINT) AS total, driver FROM ({_POOLS}) AS p(pool, total, driver)")
    cells = largest_remainder(_sql(spark, sf, _DRIVERS, "nation", "customer", "supplier").join(F.broadcast(pools), "driver"), ["pool"], "total", "w", [F.col("n_name")])
    return cells.cube("pool", "n_name").agg(F.sum("cents").cast("bigint").alias("cents")).na.fill("all", ["pool", "n_name"])


# Timelines -------------------------------------------------------------------------------------
_DAILY = f"SELECT CAST(ts AS DATE) AS day, CAST(sum(CASE event_type WHEN 'purchase' THEN {cents('value')} WHEN 'error' THEN -{cents('value')} ELSE 0 END) AS BIGINT) AS net FROM {{events}} GROUP BY 1"


@R.add(
    "ref_b13_opening_closing",
    f"""WITH d AS ({_DAILY.replace('{events}', 'events')}), c AS (SELECT day, net, 100000 + CAST(sum(net) OVER (ORDER BY day) AS BIGINT) AS closing
        FROM d) SELECT day, coalesce(lag(closing) OVER (ORDER BY day), 100000) AS opening, net, closing
    FROM c""",
)
def opening_closing(spark: SparkSession, sf: str) -> DataFrame:
    """Daily positions: each day opens with the closing of the day before."""
    run = ranked(_sql(spark, sf, _DAILY, "events"), [], [F.col("day")], "_rn", {"_run": "net"})
    return run.selectExpr("day", "CAST(100000 + _run - net AS BIGINT) AS opening", "net", "CAST(100000 + _run AS BIGINT) AS closing")


sql_query(
    R,
    "ref_b16_allowed_and_disallowed",
    f"""WITH d AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS mi, o_orderstatus <> 'P' AS allowed, {cents("o_totalprice")} AS c FROM {{orders}}),
    m AS (SELECT mi, sum(CASE WHEN allowed THEN c ELSE 0 END) AS a, sum(CASE WHEN allowed THEN 0 ELSE c END) AS b FROM d GROUP BY mi)
    SELECT mi, CAST(sum(a) OVER w AS BIGINT) AS allowed, CAST(sum(b) OVER w AS BIGINT) AS disallowed, {r2("CAST(sum(a) OVER w AS DOUBLE) / (mi - min(mi) OVER () + 1) * 12 / 100")} AS per_year FROM m WINDOW w AS (ORDER BY mi)""",
    f"""WITH d AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS mi, o_orderstatus AS st, {cents("o_totalprice")} AS c FROM orders), k AS (SELECT DISTINCT mi FROM d)
    SELECT k.mi, CAST(coalesce(sum(c) FILTER (WHERE st <> 'P'), 0) AS BIGINT) AS allowed, CAST(coalesce(sum(c) FILTER (WHERE NOT coalesce(st <> 'P', false)), 0) AS BIGINT) AS disallowed,
    {r2("CAST(coalesce(sum(c) FILTER (WHERE st <> 'P'), 0) AS DOUBLE) / (k.mi - (SELECT min(mi) FROM d) + 1) * 12 / 100")} AS per_year FROM k JOIN d ON d.mi <= k.mi GROUP BY k.mi""",
)
sql_query(
    R,
    "ref_b18_runway",
    f"""WITH m AS (SELECT c_nationkey AS nk, year(o_orderdate) * 12 + month(o_orderdate) AS mi, sum({cents("o_totalprice")}) AS spent FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY 1, 2),
    l AS (SELECT nk, avg(spent) AS burn FROM (SELECT nk, spent, row_number() OVER (PARTITION BY nk ORDER BY mi DESC) AS rn FROM m) t WHERE rn <= 3 GROUP BY nk), b AS (SELECT c_nationkey AS nk, sum({cents("c_acctbal")}) * 10 AS balance FROM {{customer}} GROUP BY 1)
    SELECT b.nk, CASE WHEN burn > 0 AND balance > 0 THEN CAST(floor(balance / burn) AS BIGINT) WHEN balance <= 0 THEN CAST(0 AS BIGINT) END AS months FROM b LEFT JOIN l ON l.nk = b.nk""",
)


# Conversion, checks, consolidation ----------------------------------------------------------------
_RATES = "VALUES ('1-URGENT', 10000), ('2-HIGH', 13600), ('3-MEDIUM', 14800), ('4-NOT SPECIFIED', 8250)"


@R.add(
    "ref_b42_convert_and_reconcile",
    f"""WITH r(currency, rate) AS ({_RATES}), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority AS currency, {cents("l_extendedprice")} AS c FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
    v AS (SELECT l.*, rate, CAST(sum(CASE WHEN rate IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, c ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nth FROM l LEFT JOIN r USING (currency)),
    s AS (SELECT CASE WHEN rate IS NULL THEN 'skipped' WHEN nth > 1 THEN 'duplicate' ELSE 'counted' END AS status, c, (c * rate + 5000) // 10000 AS base FROM v)
    SELECT status, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents, CAST(sum(CASE WHEN status = 'counted' THEN base END) AS BIGINT) AS base_cents FROM s GROUP BY status""",
)
def convert_and_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Lines converted at the rate of their currency; unknown currencies are skipped, of repeated lines the first with a rate counts."""
    lines = _sql(spark, sf, f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority AS currency, {cents('l_extendedprice')} AS c
    FROM {{lineitem}} LEFT JOIN {{orders}} ON o_orderkey = l_orderkey""", "lineitem", "orders")
    rates = spark.sql(f"SELECT * FROM ({_RATES}) AS r(currency, rate)")
    met = lines.join(F.broadcast(rates), "currency", "left")
    first = met.where("rate IS NOT NULL").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "c")).alias("f"), F.count(F.lit(1)).alias("copies"), F.sum("c").alias("all_c"), F.min_by(F.expr("(c * rate + 5000) div 10000"), F.struct("l_partkey", "l_suppkey", "c")).alias("base"))
    counted = first.agg(F.count(F.lit(1)).alias("n"), F.sum("f.c").alias("cents"), F.sum("base").alias("base_cents")).select(F.lit("counted").alias("status"), "n", "cents", "base_cents")
    again = first.agg(F.sum(F.col("copies") - 1).alias("n"), F.sum(F.col("all_c") - F.col("f.c")).alias("cents")).select(F.lit("duplicate").alias("status"), "n", "cents", F.lit(None).cast("bigint").alias("base_cents"))
    none = met.where("rate IS NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents")).select(F.lit("skipped").alias("status"), "n", "cents", F.lit(None).cast("bigint").alias("base_cents"))
    return counted.unionByName(again).unionByName(none).where("n > 0")


_REPORTS = "SELECT row_id, collision_id, accident_datetime, lat, lon, loaded_at, coalesce(trim(non_fatal_injury), '') AS hurt, coalesce(trim(fatal_injury), '') AS killed FROM collisions_raw"


@R.add(
    "ref_b54_rejects_and_clean",
    f"""WITH r AS ({_REPORTS}), k AS (SELECT collision_id, min(row_id) AS keep FROM r WHERE collision_id IS NOT NULL GROUP BY 1),
    m AS (SELECT row_id FROM r WHERE collision_id IS NULL OR accident_datetime IS NULL OR lat IS NULL OR lon IS NULL), e AS (SELECT row_id FROM r WHERE loaded_at < TIMESTAMP '2000-01-01'), s AS (SELECT row_id FROM r WHERE hurt = '' AND killed <> '' OR hurt <> '' AND killed = '')
    SELECT 'duplicate' AS finding, row_id FROM r JOIN k USING (collision_id) WHERE row_id <> keep UNION ALL SELECT 'missing', row_id FROM m UNION ALL SELECT 'early', row_id FROM e UNION ALL SELECT 'inconsistent', row_id FROM s
    UNION ALL SELECT 'clean', keep FROM k WHERE keep NOT IN (SELECT row_id FROM m UNION SELECT row_id FROM e UNION SELECT row_id FROM s)""",
)
def rejects_and_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Reports by what is wrong with them (each fault a row), and the clean ones: the first copy, if it passes every check."""
    r = _sql(spark, sf, _REPORTS.replace("FROM collisions_raw", "FROM {collisions_raw}"), "collisions_raw")
    keep = r.where("collision_id IS NOT NULL").groupBy("collision_id").agg(F.min("row_id").alias("keep"))
    met = r.join(keep, "collision_id", "left")
    first = F.col("row_id") == F.col("keep")
    faults = {"missing": F.expr("collision_id IS NULL OR accident_datetime IS NULL OR lat IS NULL OR lon IS NULL"), "early": F.expr("loaded_at < TIMESTAMP '2000-01-01'"), "inconsistent": F.expr("(hurt = '') <> (killed = '')")}
    found = reconcile.rejects(met, {"duplicate": ~first} | faults)
    clean = F.when((F.size(F.array_remove("reasons", "duplicate")) == 0) & first, F.array(F.lit("clean"))).otherwise(F.array().cast("array<string>"))
    return found.select(F.explode(F.concat("reasons", clean)).alias("finding"), "row_id")


@R.add("ref_b61_consolidate_files", f"SELECT c_mktsegment AS unit, c_nationkey AS account, count(*) AS n, CAST(sum({cents('c_acctbal')}) AS BIGINT) AS cents FROM customer GROUP BY 1, 2")
def consolidate_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file per unit, read together by glob with the unit from the path, summed by unit and account."""
    path = shared_path(spark, "budgets")
    table(spark, sf, "customer", "c_nationkey", "c_acctbal", "c_mktsegment").write.partitionBy("c_mktsegment").option("header", True).csv(path)
    rows = files.with_file_tag(files.read_csv_declared(spark, f"{path}/c_mktsegment=*/", "account INT, amount DOUBLE"), "unit", r"c_mktsegment=([^/]+)/")
    return rows.groupBy("unit", "account").agg(F.count(F.lit(1)).alias("n"), F.expr(f"CAST(sum({cents('amount')}) AS BIGINT) AS cents"))


_ERRORS = """SELECT 'customer without nation' AS code, CAST(c_custkey AS {T}) AS key FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey IS NULL
UNION SELECT 'line without order', CAST(l_orderkey AS {T}) FROM {lineitem} LEFT JOIN {orders} ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL
UNION SELECT 'repeated line', concat(CAST(l_orderkey AS {T}), '-', CAST(l_linenumber AS {T})) FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION SELECT 'negative balance', CAST(c_custkey AS {T}) FROM {customer} WHERE c_acctbal < 0"""


@R.add("ref_b100_error_rows", _ERRORS.replace("{T}", "VARCHAR").replace("{", "").replace("}", ""))
def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every error of the dataset as a row, each once."""
    t = {x: table(spark, sf, x) for x in ("customer", "nation", "lineitem", "orders")}
    text = lambda c: F.col(c).cast("string").alias("key")
    found = {
        "customer without nation": t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select(text("c_custkey")),
        "line without order": t["lineitem"].join(t["orders"].select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(text("l_orderkey")),
        "repeated line": t["lineitem"].groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")),
        "negative balance": t["customer"].where("c_acctbal < 0").select(text("c_custkey")),
    }
    return reconcile.all_errors(found)


# Triangles, scores, top-k ----------------------------------------------------------------------------
@R.add(
    "ref_b85_ultimate_and_reserve",
    f"""WITH t AS ({_TRI}), c AS (SELECT origin, age, CAST(sum(paid) OVER (PARTITION BY origin ORDER BY age) AS BIGINT) AS paid FROM t), f AS (SELECT a.age, CAST(sum(b.paid) AS DOUBLE) / CAST(sum(a.paid) AS DOUBLE) AS factor FROM c a JOIN c b ON a.origin = b.origin AND b.age = a.age + 1 GROUP BY a.age),
    l AS (SELECT origin, max(age) AS age, arg_max(paid, age) AS paid FROM c GROUP BY origin), u AS (SELECT origin, l.age, paid, coalesce((SELECT product(factor) FROM f WHERE f.age >= l.age), 1) AS cdf FROM l)
    SELECT CAST(origin AS BIGINT) AS origin, CAST(age AS BIGINT) AS age, paid, {r2("cdf", 6)} AS cdf, {r2("paid * cdf / 100000", 0)} AS ultimate_k, {r2("(paid * cdf - paid) / 100000", 0)} AS reserve_k FROM u""",
)
def ultimate_and_reserve(spark: SparkSession, sf: str) -> DataFrame:
    """Each origin's latest paid, its factor to ultimate, the ultimate and what is still to come, in thousands."""
    out = retention.ultimates(cumulative_triangle(spark, sf), "origin", "age", "total")
    return out.selectExpr("CAST(origin AS BIGINT) AS origin", "CAST(age AS BIGINT) AS age", "CAST(paid AS BIGINT) AS paid", f"{r2('to_ultimate', 6)} AS cdf", f"{r2('ultimate / 100000', 0)} AS ultimate_k", f"{r2('(ultimate - paid) / 100000', 0)} AS reserve_k")


@R.add(
    "ref_b86_weighted_score",
    f"""WITH x AS (SELECT c_mktsegment AS model, o_orderstatus = 'F' AS truth, o_totalprice > 250000 AS guess, o_orderkey % 1000 AS cost, o_custkey % 500 AS ms FROM orders JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT model, count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE truth <> guess) AS wrong, CAST(sum(cost) AS DOUBLE) / count(*) FILTER (WHERE truth = guess) AS unit, max(ms) AS slowest FROM x GROUP BY model),
    e AS (SELECT min(unit) AS u0, max(unit) AS u1, min(slowest) AS s0, max(slowest) AS s1 FROM m)
    SELECT model, {r2("100 * (0.5 * CAST(2 * tp AS DOUBLE) / (2 * tp + wrong) + 0.3 * CASE WHEN u1 = u0 THEN 1 ELSE (u1 - unit) / (u1 - u0) END + 0.2 * CASE WHEN s1 = s0 THEN 1 ELSE CAST(s1 - slowest AS DOUBLE) / (s1 - s0) END)")} AS score FROM m, e""",
)
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    """Five models scored by F1, cost and speed, the latter two scaled between the best and the worst on the card."""
    x = _sql(spark, sf, """SELECT c_mktsegment AS model, o_orderstatus = 'F' AS truth, o_totalprice > 250000 AS guess, o_orderkey % 1000 AS cost, o_custkey % 500 AS ms
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey""", "orders", "customer")
    m = x.groupBy("model").agg(
        F.expr("2 * count_if(truth AND guess) / (2 * count_if(truth AND guess) + count_if(truth <> guess))").alias("f1"), F.expr("CAST(sum(cost) AS DOUBLE) / count_if(truth = guess)").alias("unit"), F.max("ms").cast("double").alias("slowest")
    )
    return retention.weighted_score(m, "model", {"f1": 0.5}, {"unit": 0.3, "slowest": 0.2}).selectExpr("model", f"{r2('score')} AS score")


@R.add(
    "ref_a36_large_tie_safe",
    """WITH n AS (SELECT n_name, count(*) FILTER (WHERE c_acctbal > 9000) * 1000 + (999 - n_nationkey) AS key FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)
    SELECT CAST((SELECT count(*) FROM n b WHERE b.key > a.key) + 1 AS BIGINT) AS k, n_name, key // 1000 AS rich FROM n a WHERE (SELECT count(*) FROM n b WHERE b.key > a.key) < 10""",
)
def large_tie_safe(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest by a key that no two share: the value, then the place in the list."""
    n = _sql(spark, sf, """SELECT n_name, n_nationkey, count(*) FILTER (WHERE c_acctbal > 9000) AS rich
    FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey
    GROUP BY n_name, n_nationkey""", "nation", "customer")
    top = n.orderBy((F.col("rich") * 1000 + (999 - F.col("n_nationkey"))).desc()).limit(10)
    return ranked(top, [], [(F.col("rich") * 1000 + (999 - F.col("n_nationkey"))).desc()], "k").select("k", "n_name", "rich")


# Graphs -----------------------------------------------------------------------------------------------
_GRAPH = f"WITH e AS ({_EDGES}), u AS (SELECT src AS id, dst AS other, rel, 'out' AS direction FROM e UNION ALL SELECT dst, src, rel, 'in' FROM e)"


@R.add(
    "ref_b93_shortest_path",
    _GRAPH.replace("WITH ", "WITH RECURSIVE ")
    + """, w(id, d) AS (SELECT 's0', 0 UNION SELECT u.other, d + 1 FROM w JOIN u ON u.id = w.id WHERE d < 6), b AS (SELECT id, min(d) AS d FROM w GROUP BY id),
    p(id, step) AS (SELECT id, d FROM b WHERE id = 's7' UNION ALL SELECT x.prev, step - 1 FROM p JOIN (SELECT b.id, min(a.id) AS prev FROM b JOIN u ON u.other = b.id JOIN b a ON a.id = u.id AND a.d = b.d - 1 GROUP BY b.id) x ON x.id = p.id),
    s AS (SELECT step, id, lag(id) OVER (ORDER BY step) AS prev FROM p)
    SELECT step, s.id, min(u.rel) AS rel, min(u.direction) AS direction FROM s LEFT JOIN u ON u.id = s.prev AND u.other = s.id GROUP BY step, s.id""",
)
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    """The steps from one supplier to another over edges in either direction."""
    return entities.shortest_path(_edges(spark, sf), "s0", "s7")


_SLUG = "trim(BOTH '-' FROM regexp_replace(lower({0}), '[^a-z0-9]+', '-'{g}))"


@R.add(
    "ref_b94_attribute_search",
    f"""SELECT row_id, name FROM catalogue_raw WHERE {_SLUG.format("trim(category)", g=", 'g'")} = 'roads' AND list_contains(list_transform(regexp_split_to_array(coalesce(tags, ''), '[,;|]'), lambda x: {_SLUG.format("trim(x)", g=", 'g'")}), 'traffic')
    AND contains(lower(concat(coalesce(name, ''), ' ', coalesce(description, ''))), 'count')""",
)
def attribute_search(spark: SparkSession, sf: str) -> DataFrame:
    """Assets of a category that have a tag and a word in name or description, however these are written."""
    c = table(spark, sf, "catalogue_raw", "row_id", "name", "category", "tags", "description").withColumn("tags", F.split(F.coalesce("tags", F.lit("")), "[,;|]"))
    return entities.find(c, {"category": "Roads"}, {"tags": " traffic"}, ["name", "description"], "COUNT").select("row_id", "name")


@R.add(
    "ref_b96_node_context",
    f"""{_GRAPH}, n AS ({_NODES}) SELECT n.id, n.type, n.label, concat(u.rel, CASE u.direction WHEN 'out' THEN ' ->' ELSE ' <-' END) AS link, o.id AS other, o.type AS other_type,
        o.label AS other_label FROM n JOIN u ON u.id = n.id
    JOIN n o ON o.id = u.other""",
)
def node_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every node's bundle: the node and its direct neighbours by relation and direction, a row each (a hub's list is never gathered)."""
    return entities.context(_nodes(spark, sf), _edges(spark, sf))


_NESTED_ORACLE = "SELECT DISTINCT src, rel, dst FROM (SELECT 's' || s_suppkey AS src, 'in_nation' AS rel, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'in_region', 'r' || n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, 'tagged', 't:' || unnest(CASE WHEN s_acctbal < 0 THEN ['debt', 'watch'] WHEN s_acctbal > 5000 THEN ['rich'] ELSE [] END) FROM supplier)"


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as nested JSON documents in files, one a line, with nation, region and a list of tags inside."""
    docs = _sql(
        spark,
        sf,
        """SELECT to_json(named_struct('id', s_suppkey, 'name', s_name, 'nation', named_struct('id', n_nationkey, 'name', n_name, 'region', named_struct('id', r_regionkey, 'name', r_name)),
        'tags', CASE WHEN s_acctbal < 0 THEN array('debt', 'watch') WHEN s_acctbal > 5000 THEN array('rich') ELSE CAST(array() AS ARRAY<STRING>) END)) AS value FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
        "supplier",
        "nation",
        "region",
    )
    path = shared_path(spark, "suppliers.json")
    docs.write.text(path)
    return spark.read.schema("id BIGINT, name STRING, nation STRUCT<id: INT, name: STRING, region: STRUCT<id: INT, name: STRING>>, tags ARRAY<STRING>").json(path)


@R.add("ref_b99_graph_from_nested_json", _NESTED_ORACLE)
def graph_from_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    """Edges laid down from nested documents: in nation, in region, tagged; each once."""
    return entities.graph_of_documents(_nested(spark, sf))[1]


@R.add(
    "ref_s19_graph_store",
    f"""WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT 'node' AS part, type AS kind, count(*) AS n
    FROM n GROUP BY type UNION ALL SELECT 'edge', rel, count(*)
    FROM e GROUP BY rel UNION ALL SELECT 'dangling', rel, count(*)
    FROM e LEFT JOIN n ON n.id = e.dst WHERE n.id IS NULL
    GROUP BY rel""",
)
def graph_store(spark: SparkSession, sf: str) -> DataFrame:
    """A graph as two tables, written and loaded back: nodes by type, edges by relation, and edges that lead nowhere."""
    path = shared_path(spark, "graph")
    entities.write_graph(_nodes(spark, sf), _edges(spark, sf), path)
    nodes, edges = entities.read_graph(spark, path)
    part = lambda x, df, k: df.groupBy(F.col(k).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x).alias("part"), "kind", "n")
    return part("node", nodes, "type").unionByName(part("edge", edges, "rel")).unionByName(part("dangling", edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti"), "rel"))


# Sources, sinks, measures ---------------------------------------------------------------------------------
@R.add("ref_s8_spatial_scan", f"SELECT zone_id, zone_name, len(ring) AS corners, {r2('list_max(list_transform(ring, lambda p: p.lat))', 5)} AS north FROM zones")
def spatial_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Zones written as polygon features and scanned back with their geometry."""
    path = shared_path(spark, "zones.geojson")
    files.polygon_features(table(spark, sf, "zones"), "ring", ["zone_id", "zone_name"]).write.text(path)
    return files.read_polygons(spark, path, "zone_id: BIGINT, zone_name: STRING").selectExpr("zone_id", "zone_name", "CAST(size(ring) AS BIGINT) AS corners", f"{r2('array_max(transform(ring, p -> p.lat))', 5)} AS north")


@R.add("ref_s15_two_sinks", "SELECT row_id, evcsid, lon, lat, true AS agree FROM ev_raw")
def two_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """One mart, made once, to a CSV and a GeoJSON sink; both read back and compared."""
    mart = table(spark, sf, "ev_raw", "row_id", "evcsid", "lon", "lat")
    text, features = files.write_both(mart, shared_path(spark, "ev"), "lon", "lat", ["row_id", "evcsid"])
    a = files.read_csv_declared(spark, text, "row_id BIGINT, evcsid STRING, lon DOUBLE, lat DOUBLE")
    b = files.read_features(spark, features, "row_id: BIGINT, evcsid: STRING").select("row_id", F.struct("lon", "lat").alias("g"))
    return a.join(b, "row_id").select("row_id", "evcsid", "lon", "lat", (F.struct(F.when(F.col("lat").isNotNull(), F.col("lon")).alias("lon"), F.when(F.col("lon").isNotNull(), F.col("lat")).alias("lat")).eqNullSafe(F.col("g"))).alias("agree"))


@R.add("ref_s16_csv_from_rows", "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def csv_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A short report as rows of a dict (one per region), written to CSV under a declared header and read back."""
    rows = [r.asDict() for r in _sql(spark, sf, "SELECT r_name AS region, count(*) AS nations FROM {region} JOIN {nation} ON n_regionkey = r_regionkey GROUP BY r_name", "region", "nation").collect()]
    path = shared_path(spark, "regions")
    files.write_csv(spark.createDataFrame(rows, "region STRING, nations BIGINT"), path, F.col("region"), single=True)
    return files.read_csv_declared(spark, path, "region STRING, nations BIGINT")


@R.add("ref_s18_typed_bulk_load", "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderdate AS at, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderstatus AS status FROM orders")
def typed_bulk_load(spark: SparkSession, sf: str) -> DataFrame:
    """Texts loaded in bulk into a typed store, cast by its declared schema, and read from it."""
    texts = table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "CAST(o_orderdate AS STRING) AS at", "format_number(o_totalprice, '0.00') AS amount", "o_orderstatus AS status")
    return files.bulk_load(texts, "id BIGINT, at TIMESTAMP_NTZ, amount DECIMAL(12,2), status STRING", shared_path(spark, "orders"))


#: Measures are defined once and evaluated in any context of rows and grouping.
MEASURES = (
    Measures()
    .add("orders", "count(*)")
    .add("revenue", f"CAST(sum({cents('o_totalprice')}) AS BIGINT)")
    .add("filled", "count(*) FILTER (WHERE o_orderstatus = 'F')")
    .add("filled_pct", r2("100 * [filled] / nullif([orders], 0)"))
    .add("share_pct", r2("100 * CAST([revenue] AS DOUBLE) / nullif([revenue@all], 0)"))
)


@R.add(
    "ref_s20_measure_layer",
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT o_orderpriority, count(*) AS orders, CAST(sum({cents("o_totalprice")}) AS BIGINT) AS revenue, {r2("100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*)")} AS filled_pct,
    {r2(f"100 * CAST(sum({cents('o_totalprice')}) AS DOUBLE) / (SELECT sum({cents('o_totalprice')}) FROM o)")} AS share_pct FROM o GROUP BY o_orderpriority""",
)
def measure_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Named measures, some made of others and one over all rows of the context, by priority within a filter."""
    return MEASURES.evaluate(table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP '1998-01-01'"), ["orders", "revenue", "filled_pct", "share_pct"], ["o_orderpriority"])


# Timelines, tiers and margins in SQL; the twins say the same another way ------------------------------------------
_WEEKLY = f"SELECT CAST(floor(({{days}}) / 7) AS BIGINT) AS wk, o_orderstatus AS st, {cents('o_totalprice')} AS c FROM orders"
sql_query(
    R,
    "ref_b15_earned_value",  # every week from the first to the last; ratios of what has been earned and spent so far
    f"""WITH o AS ({_WEEKLY.format(days="datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')").replace("FROM orders", "FROM {orders}")}),
    g AS (SELECT explode(sequence(min(wk), max(wk))) AS wk FROM o), w AS (SELECT wk, sum(CASE WHEN st = 'F' THEN c ELSE 0 END) AS e, sum(CASE WHEN st <> 'O' THEN c ELSE 0 END) AS s FROM o GROUP BY wk), t AS (SELECT sum(c) AS budget FROM o),
    r AS (SELECT g.wk, CAST(sum(coalesce(e, 0)) OVER x AS BIGINT) AS earned, CAST(sum(coalesce(s, 0)) OVER x AS BIGINT) AS spent FROM g LEFT JOIN w ON w.wk = g.wk WINDOW x AS (ORDER BY g.wk))
    SELECT wk, earned, spent, {r2("CAST(earned AS DOUBLE) / nullif(spent, 0)", 6)} AS cpi, {r2("CAST(budget AS DOUBLE) * spent / nullif(earned, 0) / 10000", 0)} AS eac, {r2("(CAST(budget AS DOUBLE) - CAST(budget AS DOUBLE) * spent / nullif(earned, 0)) / 10000", 0)} AS vac, CAST(earned / 10 AS BIGINT) AS held FROM r CROSS JOIN t""".replace("CAST(earned / 10 AS BIGINT)", "CAST(floor(earned / 10) AS BIGINT)"),
    f"""WITH o AS ({_WEEKLY.format(days="date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))")}), g AS (SELECT unnest(range((SELECT min(wk) FROM o), (SELECT max(wk) FROM o) + 1)) AS wk),
    d AS (SELECT wk, st, sum(c) AS c FROM o GROUP BY ALL), r AS (SELECT g.wk, CAST(coalesce((SELECT sum(c) FROM d WHERE d.wk <= g.wk AND st = 'F'), 0) AS BIGINT) AS earned, CAST(coalesce((SELECT sum(c) FROM d WHERE d.wk <= g.wk AND st IN ('F', 'P')), 0) AS BIGINT) AS spent, (SELECT sum(c) FROM o) AS budget FROM g)
    SELECT wk, earned, spent, {r2("CAST(earned AS DOUBLE) / nullif(spent, 0)", 6)} AS cpi, {r2("CAST(budget AS DOUBLE) * spent / nullif(earned, 0) / 10000", 0)} AS eac, {r2("(CAST(budget AS DOUBLE) - CAST(budget AS DOUBLE) * spent / nullif(earned, 0)) / 10000", 0)} AS vac, earned // 10 AS held FROM r""",
)
_PLAN = "SELECT DISTINCT p_brand AS plan, p_size AS lo, p_size + p_partkey % 4 * 2 AS hi FROM part WHERE p_partkey % 3 = 0"
sql_query(
    R,
    "ref_b33_tier_findings",  # tiers of each plan against the next one by start
    f"""WITH t AS ({_PLAN.replace("FROM part", "FROM {part}")}), l AS (SELECT *, lead(lo) OVER (PARTITION BY plan ORDER BY lo, hi) AS nxt FROM t)
    SELECT plan, lo, hi, CASE WHEN hi <= lo THEN 'order' WHEN nxt > hi THEN 'gap' WHEN nxt < hi THEN 'overlap' END AS finding FROM l WHERE hi <= lo OR nxt <> hi""",
    f"""WITH t AS ({_PLAN}), l AS (SELECT *, (SELECT min(lo) FROM t u WHERE u.plan = t.plan AND (u.lo > t.lo OR u.lo = t.lo AND u.hi > t.hi)) AS nxt FROM t)
    SELECT plan, lo, hi, 'order' AS finding FROM l WHERE hi <= lo UNION ALL SELECT plan, lo, hi, 'gap' FROM l WHERE hi > lo AND nxt > hi UNION ALL SELECT plan, lo, hi, 'overlap' FROM l WHERE hi > lo AND nxt < hi""",
)
sql_query(
    R,
    "ref_b34_tier_expansion",  # a price from cost and margin, laid out over the tiers
    f"SELECT p_partkey, t.least_qty, {r2('p_retailprice / (1 - t.margin)')} AS price FROM {{part}} CROSS JOIN (VALUES (1, 0.4D), (10, 0.3D), (50, 0.2D)) AS t(least_qty, margin)",
    f"SELECT p_partkey, least_qty, {r2('p_retailprice / (1 - CASE least_qty WHEN 1 THEN CAST(0.4 AS DOUBLE) WHEN 10 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END)')} AS price FROM (SELECT p_partkey, p_retailprice, unnest([1, 10, 50]) AS least_qty FROM part)",
)


@R.add(
    "ref_b77_margin_by_line_and_channel",
    f"""SELECT p_brand, c_mktsegment, CAST(sum({cents("l_extendedprice")} - {cents("p_retailprice")} * CAST(l_quantity AS BIGINT)) AS BIGINT) AS margin FROM lineitem, part, orders, customer
    WHERE l_partkey = p_partkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey GROUP BY ROLLUP (p_brand, c_mktsegment)""",
)
def margin_by_line_and_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Margin by brand and segment, by brand, and in all; lines are summed by part and order's customer before the dimensions are met."""
    by = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.expr(f"sum({cents('l_extendedprice')})").alias("v"), F.expr("sum(CAST(l_quantity AS BIGINT))").alias("q"))
    met = by.join(table(spark, sf, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(table(spark, sf, "part", "p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return met.rollup("p_brand", "c_mktsegment").agg(F.expr(f"CAST(sum(v - {cents('p_retailprice')} * q) AS BIGINT)").alias("margin"))


# Bands ---------------------------------------------------------------------------------------------------------
def _bands(name: str, table_: str, key: str, value: str, steps: list[tuple[str, str]], last: str) -> None:
    """A searched CASE; the twin asks for the bands one by one and stacks them."""
    case = " ".join(f"WHEN {c.format(v=value)} THEN '{label}'" for c, label in steps)
    earlier, parts = [], []
    for c, label in [*steps, ("true", last)]:
        none = "".join(f" AND NOT coalesce({e}, false)" for e in earlier)
        parts.append(f"SELECT {key}, '{label}' AS band FROM {table_} WHERE coalesce({c.format(v=value)}, false){none}")
        earlier.append(c.format(v=value))
    sql_query(R, name, f"SELECT {key}, CASE {case} ELSE '{last}' END AS band FROM {{{table_}}}", " UNION ALL ".join(parts))


_bands("ref_b27_deadline_bands", "lineitem", "l_orderkey, l_linenumber", "l_shipdate", [("{v} IS NULL", "none"), ("{v} < TIMESTAMP '2000-01-01'", "past"), ("{v} < TIMESTAMP '2000-01-31'", "soon"), ("{v} < TIMESTAMP '2000-03-31'", "later")], "far")
_bands("ref_b28_renewal_action", "customer", "c_custkey", "c_custkey % 120", [("{v} < 30 AND c_acctbal < 3000", "drop"), ("{v} < 30", "renew"), ("{v} < 90 AND c_acctbal < 3000", "review")], "keep")
_bands("ref_b29_budget_status", "orders", "o_orderkey", "round(o_totalprice * 100)", [("{v} > 40000000", "over"), ("{v} >= 36000000", "near")], "within")
_bands("ref_b30_quota_band", "supplier", "s_suppkey", "floor(s_acctbal / 50)", [("{v} >= 120", "above"), ("{v} >= 100", "met"), ("{v} >= 80", "close")], "below")
_bands("ref_b31_billing_status", "orders", "o_orderkey", "o_orderkey % 7 - o_custkey % 7", [("{v} > 0", "over"), ("{v} < 0", "under")], "even")
