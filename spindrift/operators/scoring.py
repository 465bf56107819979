"""Features, transparent scores, ranks and utilities of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import similarity

# Weights of the base score and clips of its counts.
BASE_WEIGHTS = {"name_exact": 30.0, "address_exact": 25.0, "country_exact": 8.0, "name_similarity": 22.0, "address_similarity": 12.0, "name_length_ratio": 2.0, "address_length_ratio": 1.0}
BASE_CLIPPED = {"evidence_file_count": (0.75, 4), "exact_key_count": (0.25, 5)}

# The learned ranker's features, in the order of its coefficients.
FEATURES = ("name_similarity", "address_similarity", "name_exact", "address_exact", "country_exact", "name_length_ratio", "address_length_ratio", "evidence_rows", "evidence_file_count", "exact_key_count", "base_score", "log_base_rank", "name_x_address", "name_minus_address", "similarity_mean", "similarity_min", "exact_field_count")

S1, C = "source1_entity_id", "candidate_entity_id"


def with_attributes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Both records' normalised fields beside each pair, as l_* and r_*."""
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), *(F.col(f"{f}_norm").alias(f"{p}_{f}") for f in ("name", "address", "country")))
    return pairs.join(side(left, S1, "l"), S1).join(side(right, C, "r"), C)


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact flags, length ratios and indel similarities of each evidence-aggregated pair."""
    rows = with_attributes(pairs, left, right)
    l, r = lambda f: F.col(f"l_{f}"), lambda f: F.col(f"r_{f}")  # noqa: E731, E741
    rows = rows.withColumns({f"{f}_exact": similarity.exact_flag(l(f), r(f)) for f in ("name", "address", "country")})
    rows = rows.withColumns({f"{f}_length_ratio": F.round(similarity.length_ratio(l(f), r(f)), 6) for f in ("name", "address")})
    rows = rows.withColumns({f"{f}_similarity": F.round(similarity.indel_ratio(l(f), r(f)), 6) for f in ("name", "address")})
    return rows.drop(*(f"{p}_{f}" for p in "lr" for f in ("name", "address", "country")))


def base_score() -> Column:
    score = sum((F.col(c) * w for c, w in BASE_WEIGHTS.items()), F.lit(0.0))
    for c, (w, most) in BASE_CLIPPED.items():
        score = score + F.least(F.col(c), F.lit(most)) * w
    return F.round(score, 6)


def wide_score(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The Jaro-Winkler and character-set score, at most 1, of pairs with ``evidence_count``."""
    rows = with_attributes(pairs, left, right)
    ln, rn, la, ra = F.col("l_name"), F.col("r_name"), F.col("l_address"), F.col("r_address")
    rows = rows.withColumns({"name_jw": similarity.jaro_winkler(ln, rn), "address_jw": similarity.jaro_winkler(la, ra)})
    rows = rows.withColumns({"name_jac": similarity.char_jaccard(ln, rn), "address_jac": similarity.char_jaccard(la, ra)})
    both = F.col("name_jw") * 0.45 + F.col("address_jw") * 0.40 + F.col("name_jac") * 0.10 + F.col("address_jac") * 0.05
    name_only = F.col("name_jw") * 0.75 + F.col("name_jac") * 0.25
    bonus = similarity.exact_flag(ln, rn) * 0.10 + similarity.exact_flag(la, ra) * 0.15 + F.least(F.col("evidence_count"), F.lit(5)) * 0.01
    score = F.least(F.lit(1.0), F.when((la != "") & (ra != ""), both).otherwise(name_only) + bonus)
    exact = [similarity.exact_flag(la, ra).alias("address_exact"), similarity.exact_flag(ln, rn).alias("name_exact")]
    return rows.select(S1, C, "evidence_count", *exact, F.round(score, 6).alias("match_score"))


def ranked(rows: DataFrame, score: str, into: str, *ties: Column) -> DataFrame:
    """Place of each pair within its source-1 record; every order ends in the candidate's id."""
    order = Window.partitionBy(S1).orderBy(F.desc(score), *ties, F.asc(C))
    return rows.withColumn(into, F.row_number().over(order).cast("bigint"))


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Features, base score and base rank in one lazy plan."""
    rows = pair_features(pairs, left, right).withColumn("base_score", base_score())
    return ranked(rows, "base_score", "base_rank")


def top_k(rows: DataFrame, rank: str, k: int) -> DataFrame:
    return rows.where(F.col(rank) <= k)


def derived_features(rows: DataFrame) -> DataFrame:
    """The 17 features of the learned ranker, as doubles under their names."""
    n, a = F.col("name_similarity"), F.col("address_similarity")
    rows = rows.withColumns(
        {
            "log_base_rank": F.log1p(F.coalesce(F.col("base_rank"), F.lit(1_000_000)).cast("double")),
            "name_x_address": n * a,
            "name_minus_address": n - a,
            "similarity_mean": (n + a) / 2,
            "similarity_min": F.least(n, a),
            "exact_field_count": F.col("name_exact") + F.col("address_exact") + F.col("country_exact"),
        }
    )
    return rows.withColumns({f: F.col(f).cast("double") for f in FEATURES})
