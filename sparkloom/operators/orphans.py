"""References to records that do not exist, are gone, or came later.

Parents are brought to one row per key once, written to the shared folder. A Bloom filter of their keys, split
by a hash of the key into parts of 8 MB at most, is broadcast; it proves the definite orphans, which need no
join. Only references that pass it are verified by an exact join with the parents. The filter has up to 16
parts (room for about 100 million keys at ten bits each); more keys make more false positives, never a wrong result.

Defined results: a reference without a usable key is no case; an empty parent table makes every
reference `missing`; ties for the latest parent row go to the larger tie-break column.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import strip_ws
from sparkloom.operators.skew import bounded_broadcast, hot_keys, salted_join
from sparkloom.session import written

MAX_FILTER_BITS = 64 << 20  # 8 MB a part
MAX_PARTS = 16
HASHES = 4
_PAGE = 1 << 15  # bits that Spark's bitmap functions keep together


def reference_key(c: Column) -> Column:
    """Surrounding white space removed, letter case ignored; null unless it holds a digit."""
    k = F.upper(strip_ws(c))
    return F.when(k.rlike(r"\p{Nd}"), k)


class BloomFilter:
    """Bits of a set of keys, in parts: one array of bytes each."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts = parts

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        """Which 64-bit hashes may be among those of the keys; False is certain."""
        h = hashes.astype(np.uint64)
        part = (h >> np.uint64(56)).astype(np.int64) % len(self.parts)
        out = np.ones(len(h), bool)
        for k, bits in enumerate(self.parts):
            here = np.flatnonzero(part == k)
            size = np.uint64(len(bits) * 8)
            for i in range(HASHES):
                at = ((h[here] + np.uint64(i) * ((h[here] >> np.uint64(17)) | np.uint64(1))) & (size - np.uint64(1))).astype(np.int64)
                out[here] &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def bloom_filter(keys: DataFrame, key: str, expected: int, max_bits: int = MAX_FILTER_BITS, max_parts: int = MAX_PARTS) -> BloomFilter:
    """The filter of the keys, ten bits a key or more, in a power of two of bits a part; made from Spark's bitmap aggregates."""
    parts = min(max_parts, -(-10 * max(1, expected) // max_bits))
    size = min(max_bits, max(_PAGE, 1 << int(10 * max(1, expected) / parts - 1).bit_length()))
    size = max(_PAGE, 1 << (size.bit_length() - 1))
    h = F.xxhash64(key)
    step = F.shiftrightunsigned(h, 17).bitwiseOR(F.lit(1))
    low = h.bitwiseAND(F.lit(size - 1))  # a sum with h itself may pass 64 bits, which is an error in ANSI mode
    spots = keys.select(F.pmod(F.shiftrightunsigned(h, 56), F.lit(parts)).alias("part"), F.explode(F.array(*[(low + step * i).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)])).alias("at"))
    spots = spots.select("part", F.floor(F.col("at") / _PAGE).alias("page"), F.pmod("at", F.lit(_PAGE)).alias("bit"))
    made = [np.zeros(size // 8, np.uint8) for _ in range(parts)]
    for r in spots.groupBy("part", "page").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow().to_pylist():  # at most max_parts x max_bits in all
        made[r["part"]][r["page"] * (_PAGE // 8) : (r["page"] + 1) * (_PAGE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return BloomFilter(made)


def broadcast_test(keys: DataFrame, key: str, expected: int) -> Callable[[Column], Column]:
    """A test whether a key may be among the keys, through a broadcast filter; only hashes pass to Python, in Arrow batches."""
    shared = keys.sparkSession.sparkContext.broadcast(bloom_filter(keys, key, expected))

    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(shared.value.might_contain(hashes.to_numpy(zero_copy_only=False)))

    return lambda c: test(F.xxhash64(c))


def orphan_references(
    children: DataFrame, parents: DataFrame, *, child_key: str, parent_key: str, child_time: str, parent_time: str, parent_status: str, parent_tie: str, removed: str = "REM"
) -> DataFrame:
    """The rows of children in disorder with `reason`: missing, deleted or late; a column of that name is replaced."""
    kids = children.drop("reason").withColumn("__sl_key", reference_key(F.col(child_key))).where(F.col("__sl_key").isNotNull())
    keyed = parents.select(
        reference_key(F.col(parent_key)).alias("__sl_key"), F.col(parent_time).alias("__sl_at"), F.upper(F.trim(parent_status)).alias("__sl_status"), F.col(parent_tie).alias("__sl_tie")
    ).where(F.col("__sl_key").isNotNull())
    state = written(keyed.groupBy("__sl_key").agg(F.max_by("__sl_status", F.struct("__sl_at", "__sl_tie")).alias("__sl_last"), F.min("__sl_at").alias("__sl_first")))
    size = state.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("__sl_key")).alias("width")).first()
    passed = broadcast_test(state, "__sl_key", size["n"])(F.col("__sl_key"))
    small = bounded_broadcast(state, size["n"], 4 * (size["width"] or 0) + 64)
    reason = F.when(F.col("__sl_first").isNull(), "missing").when(F.col("__sl_last") == removed, "deleted").when(F.col("__sl_first") > F.col(child_time), "late")
    made = [*[c for c in kids.columns if c != "__sl_key"], "reason"]
    if small is not state:  # one pass over the children: a proven orphan's key is left out of the join
        tested = kids.withColumn("__sl_key", F.when(passed, F.col("__sl_key")))
        return tested.join(small, "__sl_key", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select(made)
    tested = kids.withColumn("__sl_passed", passed)
    proven = tested.where(~F.col("__sl_passed")).withColumn("reason", F.lit("missing")).select(made)
    maybe = tested.where("__sl_passed")
    spread = [c for c in kids.columns if c not in (child_key, "__sl_key")] or [child_key]
    met = salted_join(maybe, state, ["__sl_key"], spread, hot_keys(maybe, ["__sl_key"]), "left")
    return proven.unionByName(met.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(made))
