"""Audits: holdouts, what a pool adds, how blocks transfer, margins and thresholds around a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.files import written_once

from . import metrics
from .scoring import C, S1


def restricted(rows: DataFrame, ids: DataFrame, column: str = S1) -> DataFrame:
    """Rows of an evaluation universe only: ``ids`` are semi-joined, so repeated ones don't matter."""
    return rows.join(ids.select(column), column, "left_semi")


# --- holdouts ------------------------------------------------------------------------------


def holdout_evaluation(truth: DataFrame, ranked: DataFrame, holdout: DataFrame, trained: DataFrame, rank: str, ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """One row: how a ranking does on a locked holdout of source-1 ids, and why pairs are missed.
    A holdout that shares an id with what the model was trained on is refused."""
    if restricted(holdout, trained).limit(1).count():
        raise ValueError("the holdout and the training data share records")
    truth, ranked = restricted(truth, holdout), restricted(ranked, holdout)
    found = truth.join(ranked.select(S1, C, F.col(rank).alias("r")), [S1, C], "left")
    within = {k: F.count(F.when(F.col("r") <= k, 1)) for k in ks}
    share = lambda n: F.round(n / F.nullif(F.count("*"), F.lit(0)), 9)
    pairs = found.agg(
        F.count("*").alias("truth_pairs"),
        F.countDistinct(S1).alias("truth_records"),
        F.count("r").alias("covered"),
        *(n.alias(f"covered_at_{k}") for k, n in within.items()),
        *(share(n).alias(f"recall_at_{k}") for k, n in within.items()),
        (F.count("*") - F.count("r")).alias("missed_not_candidate"),
        (F.count("r") - within[max(ks)]).alias(f"missed_rank_over_{max(ks)}"),
    )
    alone = truth.select(S1).distinct().join(ranked.select(S1), S1, "left_anti").agg(F.count("*").alias("records_without_candidates"))
    return pairs.crossJoin(ranked.agg(F.count("*").alias("candidate_rows"))).crossJoin(alone)  # one row each


# --- pools ---------------------------------------------------------------------------------


def coverage_audit(truth: DataFrame, baseline: DataFrame, added: DataFrame) -> DataFrame:
    """One row: truth that a baseline and another pool cover, miss and newly recover, by pairs and by
    source-1 records."""
    flag = lambda df, name: df.select(S1, C).distinct().withColumn(name, F.lit(1))
    rows = truth.join(flag(baseline, "b"), [S1, C], "left").join(flag(added, "a"), [S1, C], "left")
    b, a = F.col("b").isNotNull(), F.col("a").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    records = lambda c: F.countDistinct(F.when(c, F.col(S1)))
    return rows.agg(
        F.count("*").alias("truth"),
        count(b).alias("baseline_covered"),
        count(a).alias("added_covered"),
        count(~b).alias("baseline_missed"),
        count(~a).alias("added_missed"),
        count(a & ~b).alias("new_recovered"),
        F.round(count(a & ~b) / F.nullif(count(~b), F.lit(0)), 9).alias("share_of_missed"),
        records(b).alias("baseline_records"),
        records(a).alias("added_records"),
        (records(a) - records(b)).alias("record_gain"),
    )


def coverage_of_classes(truth: metrics.LinkedTruth, pairs: DataFrame) -> DataFrame:
    """``coverage_audit`` from ``classes.true_pairs``."""
    n = F.col("n_left") * F.col("n_right")
    of = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    b, a = F.col("b") == 1, F.col("a") == 1
    one = pairs.groupBy(S1).agg(F.first("n_left").alias("n_left"), F.max("b").alias("b"), F.max("a").alias("a"), of(b, n).alias("in_b"), of(a, n).alias("in_a"), of(a & ~b, n).alias("new"))
    total = metrics.truth_counts(truth).agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("truth"))
    sums = {"baseline_covered": F.sum("in_b"), "added_covered": F.sum("in_a"), "new_recovered": F.sum("new"), "baseline_records": of(b, F.col("n_left")), "added_records": of(a, F.col("n_left"))}
    out = total.crossJoin(one.agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items())))  # one row each
    missed = F.col("truth") - F.col("baseline_covered")
    return out.select(
        "truth",
        "baseline_covered",
        "added_covered",
        missed.alias("baseline_missed"),
        (F.col("truth") - F.col("added_covered")).alias("added_missed"),
        "new_recovered",
        F.round(F.col("new_recovered") / F.nullif(missed, F.lit(0)), 9).alias("share_of_missed"),
        "baseline_records",
        "added_records",
        (F.col("added_records") - F.col("baseline_records")).alias("record_gain"),
    )


def new_truth_histograms(truth: DataFrame, baseline: DataFrame, evidence: DataFrame, patterns: int = 30) -> DataFrame:
    """Truth that a baseline lacks, by the number of blocks that make it, and by which blocks do (the
    ``patterns`` most frequent)."""
    new = truth.join(baseline.select(S1, C), [S1, C], "left_anti").join(evidence.select(S1, C, "evidence_file_count", "block_names"), [S1, C])
    by_number = new.groupBy(F.lit("number").alias("by"), F.col("evidence_file_count").cast("string").alias("value")).agg(F.count("*").alias("n"))
    by_pattern = new.groupBy(F.lit("pattern").alias("by"), F.col("block_names").alias("value")).agg(F.count("*").alias("n"))
    return by_number.unionByName(by_pattern.orderBy(F.desc("n"), "value").limit(patterns))


def augmented_impact(records: DataFrame, truth: DataFrame | metrics.LinkedTruth, before: DataFrame, after: DataFrame, rank: str, utility: str, threshold: float) -> DataFrame:
    """What more candidates change under one fixed model: a row for the ranking before and after,
    with recalls and the metrics of the threshold policy."""

    def row(pool: str, ranked: DataFrame) -> DataFrame:
        taken = ranked.where((F.col(rank) == 1) & (F.col(utility) >= threshold))
        policy = metrics.policy_metrics(metrics.policy_table(records, truth, taken))
        return metrics.recall_at(truth, ranked, rank).crossJoin(policy).select(F.lit(pool).alias("pool"), "*")  # one row each

    return row("before", before).unionByName(row("after", after))


def block_transfer(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two tables of ``metrics.block_recovery`` side by side: new truth of each block on old and on
    fresh records, and their ratio."""
    side = lambda df, p: df.select("block", *(F.col(c).alias(f"{p}_{c}") for c in ("pairs", "new_truth", "new_per_million")))
    both = side(old, "old").join(side(fresh, "fresh"), "block")
    return both.withColumn("transfer_ratio", F.when(F.col("old_new_truth") > 0, F.round(F.col("fresh_new_truth") / F.col("old_new_truth"), 9)))


# --- policies around a policy --------------------------------------------------------------


def margin_pairs(table: DataFrame, two_a: DataFrame, two_b: DataFrame, truth: DataFrame | metrics.LinkedTruth, threshold: float, margins, best: int = 5) -> DataFrame:
    """Margin gates of both targets: each target's ``best`` margins with the other's gate open, and
    no margin, are then judged together. ``two_*`` are tables of ``policy.best_two``."""
    margins = sorted({0.0, *map(float, margins)})

    def levels(two: DataFrame) -> DataFrame:
        passed = sum((F.when(F.col("margin") >= m, 1).otherwise(0) for m in margins), F.lit(0))
        return two.select(S1, F.col("c1").alias(C), F.when(F.col("u1") >= threshold, passed).otherwise(0).alias("level"))

    cells = written_once(metrics.policy_cells(table, levels(two_a), levels(two_b), truth))
    chosen = []
    for at in (0, 1):
        line = [(i, 0) if at == 0 else (0, i) for i in range(len(margins))]
        rows = metrics.cell_metrics(cells, line).collect()  # a row a margin
        first = sorted(rows, key=lambda r: (-r.macro_f05, r.ia + r.ib))[:best]
        chosen.append(sorted({r.ia if at == 0 else r.ib for r in first} | {0}))
    name = F.array(*map(F.lit, margins))
    out = metrics.cell_metrics(cells, [(i, j) for i in chosen[0] for j in chosen[1]])
    return out.select(F.get(name, "ia").alias("margin_a"), F.get(name, "ib").alias("margin_b"), "macro_f05", "n_predicted", "n_hits")


def neighbours(tops: DataFrame, utility: str, wanted: float, reach: int = 4) -> list[float]:
    """The observed utility closest to ``wanted`` (of equal ones the higher) and up to ``reach``
    observed ones above and below it, in rising order."""
    seen = written_once(tops.select(F.col(utility).alias("u")).where("u is not null").distinct())
    center = seen.orderBy(F.abs(F.col("u") - wanted), F.desc("u")).limit(1).collect()
    if not center:
        return []
    u = center[0].u
    above = seen.where(F.col("u") > u).orderBy("u").limit(reach).collect()  # ``reach`` rows
    below = seen.where(F.col("u") < u).orderBy(F.desc("u")).limit(reach).collect()
    return sorted([u, *(r.u for r in above), *(r.u for r in below)])


def robustness_grid(table: DataFrame, tops_a: DataFrame, tops_b: DataFrame, utility: str, truth: DataFrame | metrics.LinkedTruth, a: float, b: float, reach: int = 4) -> DataFrame:
    """Metrics of every pair of neighbouring observed thresholds around (``a``, ``b``)."""
    return metrics.threshold_grid(table, tops_a, tops_b, utility, truth, neighbours(tops_a, utility, a, reach), neighbours(tops_b, utility, b, reach))


def best_policies(grid: DataFrame, names: tuple[str, str], k: int = 10) -> DataFrame:
    """The ``k`` best policies of a grid with their place: by macro F0.5, then precision, then fewer
    predictions, then lower thresholds."""
    precision = F.coalesce(F.col("n_hits") / F.nullif("n_predicted", F.lit(0)), F.lit(0.0))
    order = [F.desc("macro_f05"), F.desc("precision"), F.asc("n_predicted"), *names]
    best = grid.withColumn("precision", F.round(precision, 9)).orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # ``k`` rows
