"""Comparing two sides of the same facts, and lookups by range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.skew import bounded_broadcast, hot_keys


def reconcile(left: DataFrame, right: DataFrame, key: str, amount: str, tolerance: int) -> DataFrame:
    """(key, left_amount, right_amount, difference, status) of two ledgers with one row per key.

    status: only_left, only_right, match (within the tolerance, inclusive) or mismatch. Rows with a
    null key meet nothing.
    """
    a = left.select(key, F.col(amount).alias("left_amount"), F.lit(1).alias("_l"))
    b = right.select(key, F.col(amount).alias("right_amount"), F.lit(1).alias("_r"))
    gap = F.col("right_amount") - F.col("left_amount")
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.abs(gap) <= tolerance, "match").otherwise("mismatch")
    return a.join(b, key, "full").select(key, "left_amount", "right_amount", gap.alias("difference"), status.alias("status"))


def backlog(df: DataFrame, opened: Column, closed: Column) -> DataFrame:
    """(month, opening, opened, closed, closing) for every month from the first opening to the last event.

    Made from one pass of +1 and -1 per month and a running sum over the months, instead of a range
    join; opening + opened - closed = closing. Rows without an opening take no part.
    """
    month = lambda c: F.year(c) * 12 + F.month(c) - 1
    deltas = df.where(opened.isNotNull()).select(F.explode(F.array(F.struct(month(opened).alias("mi"), F.lit(1).alias("o"), F.lit(0).alias("c")), F.struct(month(closed).alias("mi"), F.lit(0).alias("o"), F.lit(1).alias("c")))).alias("d"))
    months = deltas.select("d.*").where(F.col("mi").isNotNull()).groupBy("mi").agg(F.sum("o").alias("opened"), F.sum("c").alias("closed"))
    grid = months.agg(F.min("mi").alias("a"), F.max("mi").alias("b")).where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("mi"))
    full = grid.join(months, "mi", "left").na.fill(0, ["opened", "closed"])
    run = Window.orderBy("mi").rowsBetween(Window.unboundedPreceding, 0)  # a row per month
    closing = F.sum(F.col("opened") - F.col("closed")).over(run)
    return full.select(F.date_format(F.make_date((F.col("mi") / 12).cast("int"), (F.col("mi") % 12 + 1).cast("int"), F.lit(1)), "yyyy-MM").alias("month"), (closing - F.col("opened") + F.col("closed")).alias("opening"), "opened", "closed", closing.alias("closing"))


def asof_tier(df: DataFrame, tiers: DataFrame, keys: list[str], value: str, least: str, payload: str) -> DataFrame:
    """df with the payload of the highest tier of its keys whose `least` is at most `value`; null below all, without tiers or value.

    The tier table is turned into half-open intervals and met by key; it is broadcast while it is small (counted),
    else joined with hot keys of df spread over salts. Of tiers with the same `least` the largest payload counts.
    """
    one = tiers.where(F.col(least).isNotNull()).groupBy(*keys, least).agg(F.max(payload).alias(payload))
    until = F.lead(least).over(Window.partitionBy(*keys).orderBy(least))  # the tiers of one key, a few
    spans = one.select(*[F.col(k).alias(f"__sl_{k}") for k in keys], F.col(least).alias("__sl_from"), until.alias("__sl_until"), F.col(payload).alias("__sl_payload"))
    small = bounded_broadcast(spans, spans.count())
    within = (F.col(value) >= F.col("__sl_from")) & (F.col("__sl_until").isNull() | (F.col(value) < F.col("__sl_until")))
    left, same = df, F.lit(True)
    if small is spans:
        hot = hot_keys(df, keys)
        salts = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.xxhash64(*keys)], F.lit(1)) if hot else F.lit(1)
        left = df.withColumn("__sl_salt", F.pmod(F.xxhash64(*df.columns), salts).cast("int"))
        spread = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.xxhash64(*[f"__sl_{k}" for k in keys])], F.lit(1)) if hot else F.lit(1)
        small = spans.withColumn("__sl_at", F.explode(F.sequence(F.lit(0), spread - 1)))
        same = F.col("__sl_salt") == F.col("__sl_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__sl_{k}"))
    kept = [F.col(c) for c in df.columns if c != payload]
    return left.join(small, same & within, "left").select(*kept, F.col("__sl_payload").alias(payload))


def overlapping_pairs(df: DataFrame, key: list[str], item: str, start: str, end: str, bucket_s: int = 3600) -> DataFrame:
    """(key, left, right) of intervals of one key that overlap (half-open), the smaller item first.

    Intervals are laid out over time buckets and meet only within a bucket; a pair is kept in
    the bucket where its overlap begins, so it comes out once and no group forms all its pairs.
    """
    parts = df.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.unix_seconds(start) / bucket_s), F.floor(F.unix_seconds(end) / bucket_s))))
    a = parts.select(*key, "_b", F.col(item).alias("left"), F.col(start).alias("_s1"), F.col(end).alias("_e1"))
    b = parts.select(*key, "_b", F.col(item).alias("right"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    met = a.join(b, [*key, "_b"]).where((F.col("left") < F.col("right")) & (F.col("_s1") < F.col("_e2")) & (F.col("_s2") < F.col("_e1")))
    return met.where(F.floor(F.unix_seconds(F.greatest("_s1", "_s2")) / bucket_s) == F.col("_b")).select(*key, "left", "right")


def rejects(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with `reasons`: the names of the checks that fail, in order; an empty list is a clean row."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]
    return df.withColumn("reasons", F.filter(F.array(*found), lambda x: x.isNotNull()))


def all_errors(found: dict[str, DataFrame]) -> DataFrame:
    """(code, key) of every error found, each once; `found` has a frame with `key` by code."""
    parts = [df.select(F.lit(code).alias("code"), F.col("key").cast("string").alias("key")) for code, df in found.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def asserted(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """df unchanged, if the condition holds for every row that is read; else the action fails with the message. Null counts as not holding."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(holds, F.lit(False)), F.col(first)).otherwise(F.raise_error(message).cast(df.schema[first].dataType)))
