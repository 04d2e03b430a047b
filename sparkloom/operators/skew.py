"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many rows of a side are ever broadcast by the helpers here.
BROADCAST_ROWS = 200_000
#: A key is hot when it holds more than this share of its side; so there are at most 1/share of them.
HOT_SHARE = 0.002
#: Size of the frequent-items sketch; it is off by less than 4/TRACKED of the rows.
TRACKED = 16_384


def bounded_broadcast(df: DataFrame, rows: int, width: int = 64, most_bytes: int = 32 << 20) -> DataFrame:
    """df marked for broadcast when `rows` rows of `width` bytes at most stay under the bound, else df."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * width <= most_bytes else df


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = 20_000) -> dict[int, int]:
    """Hashes of the keys that hold more than `share` of the rows (and more than `least`), each with a number of salts.

    One pass with a frequent-items sketch of fixed size, no shuffle; the sketch misses no key of that share
    (its error is far below it). At most 1/share keys, so what reaches the driver is bounded.
    """
    found = df.select(F.xxhash64(*keys).alias("h")).selectExpr("count(*) AS n", f"approx_top_k(h, {int(1 / share)}, {TRACKED}) AS top").first()
    limit = max(least, int(found["n"] * share))
    return {r["item"]: -(-r["count"] // limit) for r in found["top"] if r["count"] > limit}


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], hot: dict[int, int], how: str = "inner") -> DataFrame:
    """big joined with small on keys; rows of hot keys are spread over salts by a hash of `spread`.

    `hot` comes from hot_keys(big, ...); only the rows of small that meet a hot key are repeated, once for
    each salt. Without hot keys this is a plain join. Null keys meet nothing.
    """
    if not hot:
        return big.join(small, keys, how)
    salts = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.xxhash64(*keys)], F.lit(1))
    left = big.withColumn("__sl_salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
    right = small.withColumn("__sl_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "__sl_salt"], how).drop("__sl_salt")
