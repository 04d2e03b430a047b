"""Largest-remainder allocation: whole cents that add up to the total, exactly.

All arithmetic is in integers. Ranks come from `ranked`, so a group of any size stays distributed.
Defined results: null weights count as 0; a group whose weights are all 0 is split evenly; negative
weights are an error of the caller and get their proportional share; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.ranking import LARGEST_GROUP, largest_group, ranked


def _weighted(df: DataFrame, group: list[str], weight: str, small: bool) -> DataFrame:
    """With _w, the weight as it counts, and _sum, the sum of its group."""
    total, rows = F.coalesce(F.sum(weight), F.lit(0)).cast("decimal(38,0)"), F.count(F.lit(1)).cast("decimal(38,0)")
    if small:
        w = Window.partitionBy(*group)
        out = df.withColumns({"_sum": F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("decimal(38,0)"), "_rows": F.count(F.lit(1)).over(w).cast("decimal(38,0)")})
    else:
        out = df.join(df.groupBy(*group).agg(total.alias("_sum"), rows.alias("_rows")), group)
    counts = F.when(F.col("_sum") == 0, F.lit(1)).otherwise(F.coalesce(F.col(weight), F.lit(0))).cast("decimal(38,0)")
    return out.withColumn("_w", counts).withColumn("_sum", F.when(F.col("_sum") == 0, F.col("_rows")).otherwise(F.col("_sum"))).drop("_rows")


def _with_given(df: DataFrame, group: list[str], part: str, small: bool) -> DataFrame:
    """With _given, the sum of what the group's rows have got."""
    if small:
        return df.withColumn("_given", F.sum(part).over(Window.partitionBy(*group)))
    return df.join(df.groupBy(*group).agg(F.sum(part).alias("_given")), group)


def _numbered(df: DataFrame, group: list[str], order: list[Column], rn: str, small: bool, largest: int) -> DataFrame:
    if small:
        return df.withColumn(rn, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked(df, group, order, rn, largest=largest)


def largest_remainder(df: DataFrame, group: list[str], total: str, weight: str, tie: list[Column], out: str = "cents", largest: int = LARGEST_GROUP) -> DataFrame:
    """df with `out`: the floor of each proportional share, and one more cent for the largest remainders, ties by `tie`.

    Groups of at most `largest` rows share one shuffle; with larger ones sums are joined and ranks distributed.
    """
    small = largest_group(df, group) <= largest
    shared = _weighted(df, group, weight, small)
    shared = shared.withColumn("_share", F.expr(f"CAST({total} AS DECIMAL(20,0)) * CAST(_w AS DECIMAL(18,0))")).withColumn("_floor", F.expr("CAST(_share div _sum AS BIGINT)")).withColumn("_rest", F.col("_share") % F.col("_sum"))
    given = _with_given(shared.drop("_w", "_share", "_sum"), group, "_floor", small)
    numbered = _numbered(given, group, [F.col("_rest").desc(), *tie], "_rn", small, largest)
    return numbered.select(*df.columns, (F.col("_floor") + F.when(F.col("_rn") <= F.col(total) - F.col("_given"), 1).otherwise(0)).alias(out))


def rounded_then_corrected(df: DataFrame, group: list[str], total: str, weight: str, tie: list[Column], out: str = "cents", largest: int = LARGEST_GROUP) -> DataFrame:
    """df with `out`: each share rounded half up, then corrected by a cent, up for the largest remainders or down for the smallest."""
    small = largest_group(df, group) <= largest
    shared = _weighted(df, group, weight, small)
    shared = shared.withColumn("_share", F.expr(f"CAST({total} AS DECIMAL(20,0)) * CAST(_w AS DECIMAL(17,0))")).withColumn("_near", F.expr("CAST((2 * _share + _sum) div (2 * _sum) AS BIGINT)"))
    shared = shared.withColumn("_rest", F.expr("_share - CAST(_near AS DECIMAL(20,0)) * CAST(_sum AS DECIMAL(17,0))")).drop("_w", "_share", "_sum")
    given = _with_given(shared, group, "_near", small)
    both = _numbered(_numbered(given, group, [F.col("_rest").desc(), *tie], "_up", small, largest), group, [F.col("_rest").asc(), *tie], "_down", small, largest)
    short = F.col(total) - F.col("_given")
    step = F.when((short > 0) & (F.col("_up") <= short), 1).when((short < 0) & (F.col("_down") <= -short), -1).otherwise(0)
    return both.select(*df.columns, (F.col("_near") + step).alias(out))
