"""Order-dependent ledgers and schedules.

The perpetual ledger streams: rows are brought together by key and sorted, and a fold carries one
small state from row to row, across batches; a key of any length needs constant memory. What must
happen in order happens in order; everything else stays parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


def half_up(numerator: int, denominator: int) -> int:
    """Quotient of integers, halves away from zero; the denominator is positive."""
    sign = -1 if numerator < 0 else 1
    return sign * ((2 * abs(numerator) + denominator) // (2 * denominator))


def perpetual_average_cost(df: DataFrame, key: str, order: list[Column], issue: str, quantity: str, value: str) -> DataFrame:
    """df with the state after each row: on_hand, value_left, issue_value and went_negative (in integers).

    A receipt adds quantity and value; an issue takes quantity at the average so far, rounded at
    each step; from the first negative stock on the flag stays set and the run continues. An issue
    without stock has value 0. Null quantities and values count as 0, a null issue flag is a
    receipt; rows of a null key are one key. `order` must be total. Columns already called like the
    new ones are replaced. One key is one task's work, about 100,000 rows a second.
    """
    made = ["on_hand", "value_left", "issue_value", "went_negative"]
    kept = [c for c in df.columns if c not in made]
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(c, LongType()) for c in made[:3]], StructField(made[3], BooleanType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stock, worth, negative = object(), 0, 0, False
        for b in batches:
            k, f, n, v = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (key, issue, quantity, value))
            out: tuple[list, ...] = ([], [], [], [])
            for i in range(b.num_rows):
                if k[i] != last:
                    last, stock, worth, negative = k[i], 0, 0, False
                amount, taken = n[i] or 0, 0
                if f[i]:
                    taken = half_up(worth * amount, stock) if stock > 0 else 0
                    stock, worth = stock - amount, worth - taken
                    negative = negative or stock < 0
                else:
                    stock, worth = stock + amount, worth + (v[i] or 0)
                for column, x in zip(out, (stock, worth, taken, negative), strict=True):
                    column.append(x)
            arrays = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *arrays], names=[*kept, *made])

    return df.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), *order).mapInArrow(convert, schema)


def amortization(df: DataFrame, principal: str, rate_bp: int, periods: int) -> DataFrame:
    """One row per period of each loan: period, interest, paid, principal_part, balance, in cents.

    Equal principal-and-interest payments rounded to the cent; interest is rounded each period and the
    last payment clears the balance. rate_bp is the yearly rate in hundredths of a percent; 0 is
    allowed. All loans of a batch step through the periods together. A null principal counts as 0.
    """
    made = {"period": IntegerType(), "interest": LongType(), "paid": LongType(), "principal_part": LongType(), "balance": LongType()}
    kept = [c for c in df.columns if c not in made]
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(c, t) for c, t in made.items()]])
    rate = rate_bp / 120_000

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            balance = pc.fill_null(b.column(b.schema.get_field_index(principal)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False).copy()
            level = np.floor((balance / periods if rate == 0 else balance * rate / (1 - (1 + rate) ** -periods)) + 0.5).astype(np.int64)
            for period in range(1, periods + 1):
                interest = (balance * (2 * rate_bp) + 120_000) // 240_000
                part = balance if period == periods else np.minimum(balance, level - interest)
                balance = balance - part
                row = [pa.array(np.full(b.num_rows, period, np.int32)), *map(pa.array, (interest, interest + part, part, balance))]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *row], names=[*kept, *made])

    return df.mapInArrow(convert, schema)


def through_brackets(df: DataFrame, before: Column, amount: Column, brackets: list[tuple[int, int | None, int]]) -> DataFrame:
    """df with `charge`: the amount that follows `before` units, split over the brackets (from, to, rate) it spans."""
    charge = F.lit(0)
    for low, high, rate in brackets:
        top = before + amount if high is None else F.least(before + amount, F.lit(high))
        charge = charge + F.greatest(F.lit(0), top - F.greatest(before, F.lit(low))) * rate
    return df.withColumn("charge", charge.cast("bigint"))


def split_over_tiers(df: DataFrame, amount: str, tiers: list[tuple[int, int | None, int]]) -> DataFrame:
    """One row per tier (from, to, rate in percent) that an amount reaches into: tier from 1, part and charge, rounded half up by part.

    The parts add up to the amount; amounts of 0 or less and nulls reach no tier.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(low).cast("bigint").alias("low"), F.lit(high).cast("bigint").alias("high"), F.lit(rate).alias("rate")) for i, (low, high, rate) in enumerate(tiers, 1)])
    part = (F.least(F.col(amount), F.coalesce("__sl_t.high", F.col(amount))) - F.col("__sl_t.low")).cast("bigint")
    met = df.withColumn("__sl_t", F.explode(rows)).where(F.col(amount) > F.col("__sl_t.low"))
    return met.select(*df.columns, F.col("__sl_t.tier").alias("tier"), part.alias("part"), F.floor((part * F.col("__sl_t.rate") + 50) / 100).cast("bigint").alias("charge"))
