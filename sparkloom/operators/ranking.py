"""Row numbers and running sums that stay distributed, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import written

#: Rows of a group that one task may number.
LARGEST_GROUP = 1_000_000


def largest_group(df: DataFrame, group: list[str]) -> int:
    """How many rows the largest group has; counted with map-side combining."""
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def ranked(df: DataFrame, group: list[str], order: list[Column], rn: str = "rn", sums: dict[str, str] | None = None, largest: int = LARGEST_GROUP) -> DataFrame:
    """df with a row number within its group, and running sums ({new column: summed column}), by `order`.

    While every group has at most `largest` rows, a plain window does it. Else, and always without a group, rows are
    range-partitioned by group and order, so a group that holds a third of all rows, or the only
    group there is, spreads over tasks. Each part is numbered on its own; the parts a group began in
    before give the offset. A part can continue only one group, so the offsets are at most one row
    per part and are broadcast. `order` must be total for a repeatable result; nulls sort as the
    given columns say; an empty table stays empty. Null values add nothing to sums. Columns already
    called like the new ones are replaced.
    """
    sums = sums or {}
    df = df.drop(*({rn, *sums} - set(group) - set(sums.values())))
    if group and largest_group(df, group) <= largest:
        window = Window.partitionBy(*group).orderBy(*order)
        out = df.withColumn(rn, F.row_number().over(window).cast("bigint"))
        return out.withColumns({new: F.sum(old).over(window.rowsBetween(Window.unboundedPreceding, 0)) for new, old in sums.items()})
    keys = [F.col(g).asc_nulls_first() for g in group]
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("__sl_part", F.spark_partition_id()))
    local = Window.partitionBy("__sl_part", *group).orderBy(*order)
    out = ranged.withColumn(rn, F.row_number().over(local).cast("bigint"))
    for new, old in sums.items():
        out = out.withColumn(new, F.sum(old).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranged.groupBy("__sl_part", *group).agg(F.count(F.lit(1)).alias("__sl_n"), *[F.sum(old).alias(f"__sl_s_{new}") for new, old in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("__sl_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = [F.col("__sl_part").alias("__sl_part_o"), *[F.col(g).alias(f"__sl_g_{g}") for g in group]]
    offsets = parts.select(*moved, F.sum("__sl_n").over(earlier).alias("__sl_n"), *[F.sum(f"__sl_s_{new}").over(earlier).alias(f"__sl_s_{new}") for new in sums]).where(F.col("__sl_n") > 0)
    same = F.col("__sl_part") == F.col("__sl_part_o")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__sl_g_{g}"))
    met = out.join(F.broadcast(offsets), same, "left")
    met = met.withColumn(rn, F.col(rn) + F.coalesce("__sl_n", F.lit(0)))
    for new in sums:
        met = met.withColumn(new, F.when(F.col(f"__sl_s_{new}").isNull(), F.col(new)).otherwise(F.coalesce(F.col(new), F.lit(0)) + F.col(f"__sl_s_{new}")))
    return met.select(*df.columns, rn, *sums)


def _same(group: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return out


def value_ranks(df: DataFrame, group: list[str], value: str, descending: bool = True, rank: str = "rk", dense: str = "dr") -> DataFrame:
    """df with rank and dense rank of a value within its group, ties alike; nulls come last.

    Rows are counted by value first, with map-side combining; only the distinct values are put in order, by
    `ranked`, and each row meets its own value again.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__sl_c"))
    placed = ranked(counts, group, [order], dense, {"__sl_run": "__sl_c"}).withColumn(rank, F.col("__sl_run") - F.col("__sl_c") + 1).drop("__sl_run", "__sl_c")
    kept = [c for c in df.columns if c not in (rank, dense)]
    return df.select(kept).alias("a").join(placed.alias("b"), _same([*group, value], "a", "b")).select("a.*", f"b.{rank}", f"b.{dense}")


def percentiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """(group, one column per wanted share): exact percentiles, interpolated or (`nearest`) the value of the nearest rank; nulls don't count.

    Values are counted first and put in order by `ranked`, so no group's values stand in one task, save few; a
    group without values has null.
    """
    counts = df.groupBy(*group, value).agg(F.count(value).alias("__sl_c"))
    placed = ranked(counts, group, [F.col(value).asc_nulls_last()], "__sl_rn", {"__sl_run": "__sl_c"})
    totals = counts.groupBy(*group).agg(F.sum("__sl_c").alias("__sl_n"))
    met = placed.alias("a").join(F.broadcast(totals).alias("b") if not group else totals.alias("b"), _same(group, "a", "b")).select("a.*", "b.__sl_n")
    run, n = F.col("__sl_run"), F.col("__sl_n")

    def at(position: Column) -> Column:  # counted from 0
        return F.max(F.when((run - F.col("__sl_c") <= position) & (position < run), F.col(value)))

    picks, out = {}, []
    for name, q in wanted.items():
        spot = (n - 1) * F.lit(q)
        picks[f"__sl_a_{name}"] = at(F.ceil(n * F.lit(q)) - 1 if nearest else F.floor(spot))
        if nearest:
            out.append(F.col(f"__sl_a_{name}").alias(name))
        else:
            picks[f"__sl_b_{name}"], picks[f"__sl_f_{name}"] = at(F.ceil(spot)), F.max(spot - F.floor(spot))
            out.append((F.col(f"__sl_a_{name}") + (F.col(f"__sl_b_{name}") - F.col(f"__sl_a_{name}")) * F.col(f"__sl_f_{name}")).alias(name))
    grouped = met.groupBy(*group) if group else met.groupBy()
    return grouped.agg(*[c.alias(k) for k, c in picks.items()]).select(*group, *out)
