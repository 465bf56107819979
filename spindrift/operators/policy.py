"""Decision policies over ranked pairs: top-1 with abstention, margins, result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import C, S1


def accepted(ranked: DataFrame, rank: str, utility: str, threshold: float, most: int = 1) -> DataFrame:
    """The best ``most`` candidates of a record whose utility reaches the threshold."""
    return ranked.where((F.col(rank) <= most) & (F.col(utility) >= threshold))


def best_two(ranked: DataFrame, rank: str, utility: str) -> DataFrame:
    """One row a record: first candidate, both best utilities, and their margin (infinite where
    there is no second one)."""
    of = lambda k, c: F.max(F.when(F.col(rank) == k, F.col(c)))
    two = ranked.where(F.col(rank) <= 2).groupBy(S1).agg(of(1, C).alias("c1"), of(1, utility).alias("u1"), of(2, utility).alias("u2"))
    return two.withColumn("margin", F.coalesce(F.col("u1") - F.col("u2"), F.lit(float("inf"))))


def margin_accepted(ranked: DataFrame, rank: str, utility: str, threshold: float, margin: float) -> DataFrame:
    return best_two(ranked, rank, utility).where((F.col("u1") >= threshold) & (F.col("margin") >= margin))


def matching_results(s1: DataFrame, by_target: list[DataFrame]) -> DataFrame:
    """One row a source-1 record: its accepted candidates of every target, in the targets' order,
    joined by commas; null means that it abstains."""
    out = s1.select(F.col("entity_id").alias(S1))
    for i, matches in enumerate(by_target):
        lists = matches.groupBy(S1).agg(F.array_join(F.sort_array(F.collect_list(C)), ",").alias(f"m{i}"))
        out = out.join(lists, S1, "left")
    joined = F.concat_ws(",", *(f"m{i}" for i in range(len(by_target))))
    return out.select(S1, F.nullif(joined, F.lit("")).alias("matched_entity_ids"))
