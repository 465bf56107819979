"""Evidence of candidate pairs: one aggregate over all blocks that made a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ("source1_entity_id", "candidate_entity_id")


def match_keys(pairs: DataFrame) -> DataFrame:
    """Distinct block names of a pair in order, joined by '|', and their number, strongest first."""
    out = pairs.groupBy(*PAIR).agg(F.sort_array(F.collect_set("block_name")).alias("names"))
    return out.select(*PAIR, F.array_join("names", "|").alias("match_keys"), F.size("names").cast("bigint").alias("exact_key_count"))


def aggregated(pairs: DataFrame, clip: int = 5) -> DataFrame:
    """``evidence_rows``, ``evidence_file_count`` (distinct blocks), ``exact_key_count`` (at most
    ``clip``) and ``block_names``."""
    return pairs.groupBy(*PAIR).agg(
        F.count("*").alias("evidence_rows"),
        F.countDistinct("block_name").alias("evidence_file_count"),
        F.least(F.lit(clip), F.sum("is_exact")).cast("bigint").alias("exact_key_count"),
        F.array_join(F.sort_array(F.collect_set("block_name")), ",").alias("block_names"),
    )


def aggregated_labelled(rows: DataFrame) -> DataFrame:
    """Evidence of candidate files that carry their own (``block_name``, ``exact_key_count``,
    ``match_keys``): rows, distinct blocks, the largest exact count, and both lists of names."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.nullif(c, F.lit("")))), ",").alias
    return rows.groupBy(*PAIR).agg(
        F.count("*").alias("evidence_rows"),
        F.countDistinct("block_name").alias("evidence_file_count"),
        F.max("exact_key_count").cast("bigint").alias("exact_key_count"),
        names("block_name")("block_names"),
        names("match_keys")("match_keys"),
    )


def by_strength(rows: DataFrame) -> DataFrame:
    """Candidates of each record, strongest first; equal ones by id."""
    return rows.orderBy("source1_entity_id", F.desc("exact_key_count"), "candidate_entity_id")


def merged(pairs: DataFrame) -> DataFrame:
    """Summed evidence, the largest block name and whether an exact key made the pair."""
    return pairs.groupBy(*PAIR).agg(F.count("*").alias("evidence_count"), F.max("block_name").alias("last_block"), F.bool_or(F.col("is_exact") == 1).alias("from_exact"))


def strength_counts(pairs: DataFrame) -> DataFrame:
    return match_keys(pairs).groupBy("exact_key_count").agg(F.count("*").alias("pairs"))


def candidate_lists(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a source-1 record: its distinct candidates in order, joined by commas, or null."""
    lists = pairs.select(*PAIR).distinct().groupBy("source1_entity_id").agg(F.array_join(F.sort_array(F.collect_list("candidate_entity_id")), ",").alias("candidate_entity_ids"))
    return s1.select(F.col("entity_id").alias("source1_entity_id")).join(lists, "source1_entity_id", "left")
