"""Movements, cohorts, ratios, triangles and scorecards over keyed measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def movement(df: DataFrame, key: str, period: str, amount: str) -> DataFrame:
    """(period, opening, new, expansion, contraction, churned, closing) by ledger period.

    The period before is the one that the ledger has before, not the calendar's. df has one row per
    key and period. A key is churned in the ledger period after its last one.
    """
    periods = df.select(period).distinct()
    order = Window.orderBy(period)  # a row per period
    steps = periods.withColumn("_next", F.lead(period).over(order))
    now = df.select(key, period, F.col(amount).alias("_now"))
    before = df.join(F.broadcast(steps), period).where(F.col("_next").isNotNull()).select(key, F.col("_next").alias(period), F.col(amount).alias("_was"))
    both = now.join(before, [key, period], "full").na.fill(0, ["_now", "_was"])
    gain = F.col("_now") - F.col("_was")
    total = lambda c: F.sum(c).cast("bigint")
    return both.groupBy(period).agg(
        total("_was").alias("opening"),
        total(F.when((F.col("_was") == 0) & (F.col("_now") > 0), F.col("_now")).otherwise(0)).alias("new"),
        total(F.when((F.col("_was") > 0) & (F.col("_now") > 0) & (gain > 0), gain).otherwise(0)).alias("expansion"),
        total(F.when((F.col("_was") > 0) & (F.col("_now") > 0) & (gain < 0), -gain).otherwise(0)).alias("contraction"),
        total(F.when((F.col("_was") > 0) & (F.col("_now") == 0), F.col("_was")).otherwise(0)).alias("churned"),
        total("_now").alias("closing"),
    )


def rates(moved: DataFrame) -> DataFrame:
    """A movement with churn_rate, grr and nrr as ratios of its opening; null where it opens at zero."""
    base = F.when(F.col("opening") > 0, F.col("opening").cast("double"))
    kept = F.col("opening") - F.col("contraction") - F.col("churned")
    return moved.withColumns({"churn_rate": F.col("churned") / base, "grr": kept / base, "nrr": (kept + F.col("expansion")) / base})


def cohorts(df: DataFrame, key: str, period_index: str, amount: str) -> DataFrame:
    """(cohort, age, keys, amount): by the period of each key's first row and the distance to it."""
    first = df.groupBy(key).agg(F.min(period_index).alias("cohort"))
    return df.join(first, key).groupBy("cohort", (F.col(period_index) - F.col("cohort")).alias("age")).agg(F.count_distinct(key).alias("keys"), F.sum(amount).cast("bigint").alias("amount"))


def triangle_factors(df: DataFrame, origin: str, age: str, amount: str) -> DataFrame:
    """(age, factor, to_ultimate) of cumulative amounts by origin and age: volume-weighted, adjacent ages, product of the later factors."""
    nxt = df.select(origin, (F.col(age) - 1).alias(age), F.col(amount).alias("_next"))
    f = df.join(nxt, [origin, age]).groupBy(age).agg((F.sum("_next") / F.sum(amount)).alias("factor"))
    later = Window.orderBy(F.col(age).desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row per age
    return f.withColumn("to_ultimate", F.aggregate(F.collect_list("factor").over(later), F.lit(1.0), lambda a, x: a * x))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1; null where a ratio has no base."""
    n = lambda c: F.count_if(c)
    counts = df.agg(n(truth & guess).alias("tp"), n(~truth & guess).alias("fp"), n(truth & ~guess).alias("fn"), n(~truth & ~guess).alias("tn"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def ultimates(df: DataFrame, origin: str, age: str, amount: str) -> DataFrame:
    """(origin, age, paid, to_ultimate, ultimate): each origin's latest cumulative amount carried to the end; the oldest age has factor 1."""
    latest = df.groupBy(origin).agg(F.max(age).alias(age), F.max_by(amount, age).alias("paid"))
    met = latest.join(F.broadcast(triangle_factors(df, origin, age, amount).select(age, "to_ultimate")), age, "left").na.fill(1.0, ["to_ultimate"])  # a row per age
    return met.select(origin, age, "paid", "to_ultimate", (F.col("paid") * F.col("to_ultimate")).alias("ultimate"))


def weighted_score(df: DataFrame, key: str, as_is: dict[str, float], lower_is_better: dict[str, float]) -> DataFrame:
    """(key, score, rank) of a short card: weighted sum in percent; the latter columns are scaled so that the best has 1 and the worst 0.

    A column that is alike for all scales to 1, a null one to 0; ties in rank go by key.
    """
    ends = df.agg(*[f(c).alias(f"__sl_{n}_{c}") for c in lower_is_better for n, f in (("least", F.min), ("most", F.max))])
    total = F.lit(0.0)
    for c, w in as_is.items():
        total = total + F.coalesce(c, F.lit(0.0)) * w
    for c, w in lower_is_better.items():
        least, most = F.col(f"__sl_least_{c}"), F.col(f"__sl_most_{c}")
        total = total + F.when(F.col(c).isNull(), 0.0).when(most == least, 1.0).otherwise((most - F.col(c)) / (most - least)) * w
    scored = df.crossJoin(F.broadcast(ends)).select(key, (total * 100).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # a row per card


def erlang_agents(load: str, enough) -> Column:  # noqa: ANN001
    """The fewest agents at which `enough(agents, blocking)` holds, by the Erlang B recursion; null for a null or negative load.

    The candidates end at load + 10 sqrt(load) + 50, where what is blocked or waits is far below any target; so there
    is no fixed limit, and a row's work is in proportion to its load.
    """
    x = F.col(load)
    last = F.ceil(x + 10 * F.sqrt(x) + 50).cast("int")

    def step(s: Column, n: Column) -> Column:
        b = x * s["b"] / (n + x * s["b"])
        return F.struct(b.alias("b"), F.coalesce(s["at"], F.when(enough(n, b), n.cast("bigint"))).alias("at"))

    return F.when(x >= 0, F.aggregate(F.sequence(F.lit(1), last), F.struct(F.lit(1.0).alias("b"), F.lit(None).cast("bigint").alias("at")), step)["at"])
