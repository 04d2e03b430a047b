"""A corpus mixed so that each source has its target share of the tokens.

Tokens are summed per source; a source's rate is its share of the mix over what it has; each
document then comes out floor(rate) times, plus once more with the fraction as probability, decided
by a hash of seed and document. The size of the mix is the largest at which every target share
is met within the sources' caps, or the size asked for; then sources that reach their cap give
what they have and the report shows the share that came out.

Defined results: documents of sources that no positive weight asks for (null source too) don't
come out; a source without documents or tokens has no share and the weights of the others are
scaled to one; an empty corpus gives an empty mix; a document never comes out more than
max_repeats times. Repeated doc_ids share one decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.session import cut


def source_rates(sized: DataFrame, targets: DataFrame, source: str, size: str, total: float | None = None) -> DataFrame:
    """One row per target source: what it has, its target share, its rate of repetition, and whether it binds the size of the mix."""
    have = sized.groupBy(source).agg(F.sum(size).cast("bigint").alias("have"), F.count(F.lit(1)).alias("docs"))
    wanted = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    known = wanted.join(have, source, "left").na.fill(0, ["have", "docs"])
    usable = (F.col("have") > 0) & (F.col("target_weight") > 0) & (F.col("max_repeats") > 0)
    all_rows = Window.partitionBy()  # a row per target source, a few
    share = F.when(usable, F.col("target_weight") / F.sum(F.when(usable, F.col("target_weight"))).over(all_rows))
    out = known.withColumn("target_share", share)
    largest = F.min(F.col("have") * F.col("max_repeats") / F.col("target_share")).over(all_rows)
    out = out.withColumn("mix_total", F.lit(float(total)) if total is not None else largest)
    # The source that lets the mix be no larger: used as often as it may be.
    out = out.withColumn("binding", F.coalesce(usable & (F.col("have") * F.col("max_repeats") / F.col("target_share") <= F.col("mix_total")), F.lit(False)))
    rate = F.least(F.col("max_repeats").cast("double"), F.col("mix_total") * F.col("target_share") / F.col("have"))
    return out.withColumn("rate", F.coalesce(F.when(usable, rate), F.lit(0.0)))


def _chance(seed: int, key: str) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) / float(1 << 52)


def mix(sized: DataFrame, rates: DataFrame, key: str, source: str, seed: int = 42) -> DataFrame:
    """Each document as often as it is drawn, with copy_no from 1 (a column of that name is replaced); no shuffle, the rates are a few rows."""
    rate, n = F.col("__sl_rate"), F.col("__sl_copies")
    drawn = sized.drop("copy_no").join(F.broadcast(rates.where(F.col("rate") > 0).select(source, F.col("rate").alias("__sl_rate"))), source)
    copies = F.floor(rate) + F.when(_chance(seed, key) < rate - F.floor(rate), 1).otherwise(0)
    return drawn.withColumn("__sl_copies", copies).where(n > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), n.cast("int")))).drop("__sl_copies", "__sl_rate")


def share_report(mixed: DataFrame, rates: DataFrame, source: str, size: str) -> DataFrame:
    """Target and actual share of each target source."""
    got = mixed.groupBy(source).agg(F.sum(size).cast("bigint").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_docs"), F.max("copy_no").cast("int").alias("most_copies"))
    out = rates.join(F.broadcast(got), source, "left").na.fill(0, ["mix_tokens", "mix_docs", "most_copies"])
    actual = F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(Window.partitionBy()))
    return out.withColumn("actual_share", F.coalesce(actual, F.lit(0.0))).drop("mix_total")


def sized_documents(docs: DataFrame, count_tokens) -> DataFrame:  # noqa: ANN001
    """doc_id, source, n_tokens; written to the shared folder once, for the sums and the drawing."""
    return cut(count_tokens(docs).select("doc_id", "source", "n_tokens"))
