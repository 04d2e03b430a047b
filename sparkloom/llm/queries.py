"""Queries p3, p7, p8, p9, p10: texts and records for training data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import fold_ws
from sparkloom.llm.lookalike import char_frequencies, match_disguised, rewrite_rules
from sparkloom.llm.mixing import mix, share_report, sized_documents, source_rates
from sparkloom.llm.subjects import fitted, leaf_report, subjects_of
from sparkloom.llm.survivors import consensus_survivors
from sparkloom.llm.tokens import MULTI_RANKS, with_ids, with_text, with_token_count
from sparkloom.operators.skew import bounded_broadcast
from sparkloom.operators.timestamps import wall_day, with_utc_micros
from sparkloom.plans.registry import Registry
from sparkloom.session import written
from sparkloom.sources.tables import table

R = Registry()

#: The four fields of disguised names.
NAME_FIELDS = (("cap_raw", "proj_name"), ("stops_raw", "location"), ("shelters_raw", "location"), ("parkride_raw", "name"))
USABLE_LENGTH = 10


@R.add("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that read as a registered name but are made of other characters."""
    register = table(spark, sf, "name_register", "name_id", "name")
    rules = rewrite_rules(spark, char_frequencies(register, "name"))
    texts = reduce(DataFrame.unionByName, [table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", F.col(c).alias("text")) for t, c in NAME_FIELDS])
    return match_disguised(texts, "text", register, "name_id", "name", rules).select("table_name", "row_id", "name_id")


def _few(df: DataFrame) -> DataFrame:
    """A small dimension, broadcast if it is one (counted)."""
    return bounded_broadcast(df, df.count())


def _dated_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts with highway and section number, Halifax day, trust and what is usable."""
    number = lambda k: F.regexp_replace(F.regexp_extract("section_id", r"\A\P{Nd}*(\p{Nd}+)\P{Nd}+(\p{Nd}+)\P{Nd}*\z", k), r"\A0+(?=\d)", "")
    counts = table(spark, sf, "raw_counts", "row_id", "section_id", "count_date", "section_description", "county", "feed", "loaded_at")
    trust = _few(table(spark, sf, "feed_trust", "feed", "trust").groupBy("feed").agg(F.max("trust").alias("trust")))
    codes = _few(table(spark, sf, "county_codes").select(F.col("county").alias("_code"), F.lit(True).alias("_known")).distinct())
    ready = (
        counts.join(trust, "feed", "left")
        .withColumn("_code", F.upper(F.trim("county")))
        .join(codes, "_code", "left")
        .select(
            "row_id", "count_date", "loaded_at", number(1).alias("hw"), number(2).alias("sec"), F.coalesce("trust", F.lit(0)).alias("trust"), "county", "section_description",
            F.coalesce("_known", F.lit(False)).alias("county_ok"), F.coalesce(F.length(fold_ws(F.col("section_description"))) >= USABLE_LENGTH, F.lit(False)).alias("description_ok"),
        )
        .where(F.col("hw") != "")
    )
    return with_utc_micros(ready, "count_date").withColumn("day", wall_day("utc_us"))


def _usable(counts: DataFrame) -> dict:
    return {"county": F.when(F.col("county_ok"), F.col("county")), "section_description": F.when(F.col("description_ok"), F.col("section_description"))}


@R.add("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The row that supplies county and description of each traffic count reported more than once: the consensus of ranked votes."""
    counts = _dated_counts(spark, sf)
    rank = [F.col("trust"), F.unix_micros("loaded_at")]
    return consensus_survivors(counts, ["hw", "sec", "day"], "row_id", _usable(counts), rank=rank).select("group_id", "field", "row_id")


@R.add("p7_consensus")
def p7_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """For each field of a count reported more than once the usable value closest to the consensus of its reports, votes weighted by trust.

    Counts are those of p7_found, with the same group_id, also where only one report's value is usable.
    """
    counts = _dated_counts(spark, sf)
    return consensus_survivors(counts, ["hw", "sec", "day"], "row_id", _usable(counts), weight=F.col("trust") + 1).select("group_id", "field", "consensus", "value")


@R.add("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return with_ids(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "ids")


@R.add("p8_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts back from their ids: the exact round trip."""
    return with_text(with_ids(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "ids")).select("doc_id", "text")


@R.add("p8_ids_multi")
def p8_ids_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by the vocabulary for many languages."""
    return with_ids(table(spark, sf, "documents", "doc_id", "text"), ranks=MULTI_RANKS).select("doc_id", "ids")


@R.add("p8_decoded_multi", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_decoded_multi(spark: SparkSession, sf: str) -> DataFrame:
    """The exact round trip with the vocabulary for many languages."""
    ids = with_ids(table(spark, sf, "documents", "doc_id", "text"), ranks=MULTI_RANKS).select("doc_id", "ids")
    return with_text(ids, ranks=MULTI_RANKS).select("doc_id", "text")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return sized_documents(table(spark, sf, "documents", "doc_id", "source", "text"), with_token_count)


@R.add("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed corpus: one row per document and copy."""
    sized = _sized(spark, sf)
    return mix(sized, source_rates(sized, table(spark, sf, "mix_targets"), "source", "n_tokens"), "doc_id", "source").select("doc_id", "source", "copy_no", "n_tokens")


@R.add("p9_shares")
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    sized = _sized(spark, sf)
    rates = source_rates(sized, table(spark, sf, "mix_targets"), "source", "n_tokens")
    return share_report(mix(sized, rates, "doc_id", "source"), rates, "source", "n_tokens")


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "doc_labels", "doc_id", "subject"), table(spark, sf, "subjects", "subject")


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    return subjects_of(*_inputs(spark, sf))


@R.add("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, sf).select("doc_id", "subject").distinct()


@R.add("p10_composition")
def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents and sentences of the corpus each subject has."""
    return _subjects(spark, sf).groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences"))


@R.add("p10_leaves")
def p10_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves that documents were clustered into: size, discriminative words, and the subject each leans to."""
    docs, labels, subjects = _inputs(spark, sf)
    return leaf_report(docs, fitted(docs, labels, subjects)[1]).withColumn("terms", F.array_join("terms", " "))
