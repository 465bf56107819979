"""Evaluation: coverage, recall, F0.5, threshold and margin sweeps, block recovery, triage.

Truth is (source1_entity_id, matched_entity_id, label); it is always restricted to positive labels
and to the target that is judged. Truth between groups of records may be given as ``LinkedTruth``
where only its counts and flags of pairs are read: its pairs are then never made."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.files import written_once

from . import blocking
from .scoring import C, S1

#: Distinct utilities that are summed up in one task, about.
RANGE_ROWS = 1_000_000
M = "matched_entity_id"


def truth_of(truth: DataFrame, target: str | None = None) -> DataFrame:
    """Distinct positive pairs, of one target if it is named."""
    rows = truth.where(F.coalesce(F.col("label"), F.lit(1)) == 1)
    if target:
        rows = rows.where(F.col(M).startswith(f"{target}-"))
    return rows.select(S1, F.col(M).alias(C)).distinct()


@dataclass(frozen=True)
class LinkedTruth:
    """Truth by groups: a record of ``left`` (source1_entity_id, left_group) matches all those of
    ``right`` (candidate_entity_id, right_group) whose groups ``links`` (left_group, right_group)
    has, once each. A record has one group at most."""

    left: DataFrame
    right: DataFrame
    links: DataFrame

    def of(self, target: str | None) -> LinkedTruth:
        return LinkedTruth(self.left, self.right.where(F.col(C).startswith(f"{target}-")), self.links) if target else self

    def pairs(self) -> DataFrame:
        return self.left.join(self.links, "left_group").join(self.right, "right_group").select(S1, C)


def truth_counts(truth: DataFrame | LinkedTruth) -> DataFrame:
    """(source1_entity_id, truth) of records that have any."""
    if isinstance(truth, DataFrame):
        return truth.groupBy(S1).agg(F.count("*").alias("truth"))
    sizes = truth.right.groupBy("right_group").agg(F.count("*").alias("n"))
    matched = truth.links.join(sizes, "right_group").groupBy("left_group").agg(F.sum("n").alias("truth"))
    return truth.left.join(matched, "left_group").select(S1, "truth")


def flagged(pairs: DataFrame, truth: DataFrame | LinkedTruth, name: str) -> DataFrame:
    """``pairs`` with ``name``: 1 if they are true, else null."""
    if isinstance(truth, DataFrame):
        return pairs.join(truth.withColumn(name, F.lit(1)), [S1, C], "left")
    rows = pairs.join(truth.left, S1, "left").join(truth.right, C, "left")
    rows = rows.join(truth.links.withColumn(name, F.lit(1)), ["left_group", "right_group"], "left")
    return rows.select(*pairs.columns, name)


def coverage(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Truth pairs, covered ones and their share; candidates are only semi-joined."""
    hit = truth.join(pairs.select(S1, C), [S1, C], "left_semi").agg(F.count("*").alias("covered"))
    total = truth.agg(F.count("*").alias("truth"))
    return total.crossJoin(hit).withColumn("share", F.when(F.col("truth") > 0, F.round(F.col("covered") / F.col("truth"), 9)))  # one row each


def coverage_ledger(truth: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """Truth pairs that each block is the first to cover, in the blocks' order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("block_name"))
    first = truth.join(pairs.select(S1, C, place.alias("place")), [S1, C]).groupBy(S1, C).agg(F.min("place").alias("place"))
    return first.groupBy("place").agg(F.count("*").alias("new_truth")).select(F.element_at(F.array(*map(F.lit, order)), F.col("place").cast("int")).alias("block"), "new_truth")


def recall_at(truth: DataFrame | LinkedTruth, ranked: DataFrame, rank: str, ks=(1, 3, 5, 10, 20)) -> DataFrame:
    """Share of truth pairs ranked k or better, for all k in one pass."""
    if isinstance(truth, LinkedTruth):
        found = flagged(ranked.where(F.col(rank) <= max(ks)).select(S1, C, rank), truth, "hit").where("hit is not null")
        hits = found.agg(*(F.count(F.when(F.col(rank) <= k, 1)).alias(f"h{k}") for k in ks))
        total = truth_counts(truth).agg(F.coalesce(F.sum("truth"), F.lit(0)).alias("truth"))
        shares = (F.round(F.col(f"h{k}") / F.nullif("truth", F.lit(0)), 9).alias(f"recall_{k}") for k in ks)
        return total.crossJoin(hits).select("truth", *shares)  # one row each
    best = truth.join(ranked.select(S1, C, rank), [S1, C], "left").groupBy(S1, C).agg(F.min(rank).alias("r"))
    return best.agg(F.count("*").alias("truth"), *(F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall_{k}") for k in ks))


def f05(truth: Column, predicted: Column, hits: Column) -> Column:
    """1 if nothing is true or predicted, 0 if one is, else the F-measure with beta 0.5."""
    return F.when((truth == 0) & (predicted == 0), 1.0).when((truth == 0) | (predicted == 0), 0.0).otherwise(1.25 * hits / (0.25 * truth + predicted))


def policy_table(records: DataFrame, truth: DataFrame | LinkedTruth, predicted: DataFrame) -> DataFrame:
    """One row a record of ``records``: truth, predictions and hits."""
    counts = truth_counts(truth)
    hits = flagged(predicted.select(S1, C), truth, "hit").groupBy(S1).agg(F.count("*").alias("predicted"), F.count("hit").alias("hits"))
    out = records.select(F.col("entity_id").alias(S1)).join(counts, S1, "left").join(hits, S1, "left")
    return out.select(S1, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("truth", "predicted", "hits")))


def policy_metrics(table: DataFrame) -> DataFrame:
    """Macro F0.5, micro precision and recall, and the counts behind them, in one aggregate."""
    t, p, h = F.col("truth"), F.col("predicted"), F.col("hits")
    return table.agg(
        F.round(F.avg(f05(t, p, h)), 9).alias("macro_f05"),
        F.round(F.sum(h) / F.nullif(F.sum(p), F.lit(0)), 9).alias("precision"),
        F.round(F.sum(h) / F.nullif(F.sum(t), F.lit(0)), 9).alias("recall"),
        F.sum(p).alias("n_predicted"),
        F.sum(h).alias("n_hits"),
        F.count(F.when((t == 0) & (p == 0), 1)).alias("correctly_empty"),
        F.count(F.when((t == 0) & (p > 0), 1)).alias("fp_singletons"),
    )


# --- sweeps --------------------------------------------------------------------------------


def _events(table: DataFrame, tops: DataFrame, utility: str, truth: DataFrame | LinkedTruth) -> DataFrame:
    """What accepting each top candidate adds, in falling order of utility within a record.
    ``table`` has truth and the predictions and hits that are fixed already."""
    hit = flagged(tops.select(S1, C, F.col(utility).alias("u")), truth, "hit")
    rows = hit.select(S1, C, "u", F.coalesce("hit", F.lit(0)).alias("hit")).join(table, S1)
    # several targets of one record at the same utility are accepted together
    rows = rows.groupBy(S1, "u", "truth", "predicted", "hits").agg(F.count("*").alias("more"), F.sum("hit").alias("more_hits"))
    so_far = Window.partitionBy(S1).orderBy(F.desc("u")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, base: F.col(base) + F.coalesce(F.sum(c).over(so_far), F.lit(0))
    rows = rows.withColumns({"p0": before("more", "predicted"), "h0": before("more_hits", "hits")})
    gain = f05(F.col("truth"), F.col("p0") + F.col("more"), F.col("h0") + F.col("more_hits")) - f05(F.col("truth"), F.col("p0"), F.col("h0"))
    single = F.when((F.col("truth") == 0) & (F.col("p0") == 0), 1).otherwise(0)
    return rows.select("u", "more", "more_hits", gain.alias("gain"), single.alias("single"))


def threshold_curve(table: DataFrame, tops: DataFrame, utility: str, truth: DataFrame | LinkedTruth) -> DataFrame:
    """Macro F0.5 at every observed utility taken as threshold; equal utilities advance together.

    Gains are added up by utility first and written once, so the ordered running sum passes over one
    row a distinct utility; ranges between quantiles of the utility are summed apart and then
    offset, so no task holds the whole order."""
    by_u = written_once(_events(table, tops, utility, truth).groupBy("u").agg(*(F.sum(c).alias(c) for c in ("gain", "more", "more_hits", "single"))))
    totals = table.agg(F.count("*").alias("records"), F.sum(f05(F.col("truth"), F.col("predicted"), F.col("hits"))).alias("base"), F.sum("truth").alias("all_truth"), F.sum("predicted").alias("base_p"), F.sum("hits").alias("base_h"))
    ranges = 8 + by_u.count() // RANGE_ROWS
    cuts = sorted(set(by_u.approxQuantile("u", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    # the number of cuts above: falls as the utility rises
    above = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x > F.col("u")))
    spread = by_u.withColumn("range", above)
    within = Window.partitionBy("range").orderBy(F.desc("u"))
    sums = [F.sum(c).over(within).alias(f"s_{c}") for c in ("gain", "more", "more_hits")]
    local = spread.select("u", "range", *sums)
    # one row a range
    ends = spread.groupBy("range").agg(*(F.sum(c).alias(f"e_{c}") for c in ("gain", "more", "more_hits")))
    offset = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("range", *(F.coalesce(F.sum(f"e_{c}").over(offset), F.lit(0)).alias(f"o_{c}") for c in ("gain", "more", "more_hits")))
    rows = local.join(F.broadcast(offsets), "range").crossJoin(F.broadcast(totals))  # one row
    value = lambda c: F.col(f"s_{c}") + F.col(f"o_{c}")
    predicted, hits = F.col("base_p") + value("more"), F.col("base_h") + value("more_hits")
    return rows.select(
        F.col("u").alias("threshold"),
        F.round((F.col("base") + value("gain")) / F.col("records"), 9).alias("macro_f05"),
        F.round(hits / predicted, 9).alias("precision"),
        F.round(hits / F.nullif("all_truth", F.lit(0)), 9).alias("recall"),
        predicted.cast("bigint").alias("n_predicted"),
        hits.cast("bigint").alias("n_hits"),
    )


def best_threshold(table: DataFrame, tops: DataFrame, utility: str, truth: DataFrame | LinkedTruth) -> DataFrame:
    """The threshold with the best macro F0.5, the highest of equal ones; infinity accepts none."""
    curve = threshold_curve(table, tops, utility, truth)
    none = policy_metrics(table).select(F.lit(float("inf")).alias("threshold"), "macro_f05", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"), "n_predicted", "n_hits")
    return curve.unionByName(none).orderBy(F.desc("macro_f05"), F.desc("threshold")).limit(1)


def policy_cells(table: DataFrame, a: DataFrame, b: DataFrame, truth: DataFrame | LinkedTruth) -> DataFrame:
    """Records by what decides the outcome of a pair of policies: (la, lb, truth, ha, hb, n). ``a``
    and ``b`` have a record's candidate and ``level``, how many of a target's policies, in rising
    order of strictness, accept it. Few rows, whatever the number of records."""
    side = lambda df, p: flagged(df.select(S1, C, F.col("level").alias(f"l{p}")), truth, f"h{p}").drop(C)
    rows = table.select(S1, "truth").join(side(a, "a"), S1, "left").join(side(b, "b"), S1, "left")
    return rows.groupBy("truth", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("la", "lb", "ha", "hb"))).agg(F.count("*").alias("n"))


def cell_metrics(cells: DataFrame, policies: list[tuple[int, int]]) -> DataFrame:
    """Metrics of pairs of policies, given by their numbers (ia, ib): policy i accepts what has a
    level above i. Cells meet a stated set of policies, records don't."""
    grid = cells.sparkSession.createDataFrame(policies, "ia int, ib int")
    rows = cells.crossJoin(F.broadcast(grid))
    takes = lambda p: (F.col(f"l{p}") > F.col(f"i{p}")).cast("int")
    rows = rows.select("ia", "ib", "n", "truth", (takes("a") + takes("b")).alias("p"), (takes("a") * F.col("ha") + takes("b") * F.col("hb")).alias("h"))
    score = f05(F.col("truth"), F.col("p"), F.col("h"))
    total = lambda c, name: F.sum(F.col("n") * c).cast("bigint").alias(name)
    return rows.groupBy("ia", "ib").agg(F.round(F.sum(F.col("n") * score) / F.sum("n"), 9).alias("macro_f05"), total(F.col("p"), "n_predicted"), total(F.col("h"), "n_hits"))


def threshold_grid(table: DataFrame, tops_a: DataFrame, tops_b: DataFrame, utility: str, truth: DataFrame | LinkedTruth, a: list[float], b: list[float]) -> DataFrame:
    """Metrics of every pair of thresholds of a small grid, in one pass over the records."""
    a, b = sorted(set(a)), sorted(set(b))

    def levels(tops: DataFrame, cuts: list[float]) -> DataFrame:
        passed = sum((F.when(F.col(utility) >= x, 1).otherwise(0) for x in cuts), F.lit(0))
        return tops.select(S1, C, passed.alias("level"))

    cells = policy_cells(table, levels(tops_a, a), levels(tops_b, b), truth)
    out = cell_metrics(cells, [(i, j) for i in range(len(a)) for j in range(len(b))])
    name = lambda cuts, i: F.get(F.array(*map(F.lit, cuts)).cast("array<double>"), i)
    return out.select(name(a, "ia").alias("ta"), name(b, "ib").alias("tb"), "macro_f05", "n_predicted", "n_hits")


def joint_thresholds(table: DataFrame, tops_a: DataFrame, tops_b: DataFrame, utility: str, truth: DataFrame | LinkedTruth) -> DataFrame:
    """The best pair of thresholds over all observed utilities of both targets, exactly; of equal
    pairs the one with the highest first threshold, then second. Infinity accepts none.

    A record's score depends on its two utilities only through four outcomes, so the surface is a
    sum of two one-dimensional step functions and one two-dimensional one. Gains are added up by
    pair of utilities first; the driver then holds a row a distinct pair and one line of the
    surface, and passes over the first thresholds in falling order."""
    side = lambda tops, p: flagged(tops.select(S1, C, F.col(utility).alias(f"u{p}")), truth, f"h{p}").drop(C)
    rows = table.select(S1, "truth").join(side(tops_a, "a"), S1, "left").join(side(tops_b, "b"), S1, "left")
    hit = lambda p: F.coalesce(f"h{p}", F.lit(0))
    t = F.col("truth")
    rows = rows.withColumns({"s0": f05(t, F.lit(0), F.lit(0)), "sa": f05(t, F.lit(1), hit("a")), "sb": f05(t, F.lit(1), hit("b")), "sab": f05(t, F.lit(2), hit("a") + hit("b"))})
    # a null utility is no candidate
    pairs = rows.groupBy("ua", "ub").agg(F.sum(F.col("sa") - F.col("s0")).alias("a"), F.sum(F.col("sb") - F.col("s0")).alias("b"), F.sum(F.col("sab") - F.col("sa") - F.col("sb") + F.col("s0")).alias("ab"), F.sum("s0").alias("none"), F.count("*").alias("n")).toPandas()
    ua, ub = pairs["ua"].to_numpy(float), pairs["ub"].to_numpy(float)
    cuts = [np.concatenate([[np.inf], np.unique(u[~np.isnan(u)])[::-1]]) for u in (ua, ub)]
    # the number of the highest threshold that accepts
    ia, ib = (np.where(np.isnan(u), 0, np.searchsorted(-c, -u)) for u, c in zip((ua, ub), cuts, strict=True))
    line = np.zeros(len(cuts[1]))
    np.add.at(line, ib[ib > 0], pairs["b"].to_numpy(float)[ib > 0])
    line = line.cumsum() + pairs["none"].sum()
    order = np.argsort(ia, kind="stable")
    order = order[ia[order] > 0]
    ia, ib, a, ab = ia[order], ib[order], pairs["a"].to_numpy(float)[order], pairs["ab"].to_numpy(float)[order]
    starts = np.searchsorted(ia, np.arange(len(cuts[0]) + 1))
    records, best = max(1, pairs["n"].sum()), (-np.inf, 0, 0)
    for i in range(len(cuts[0])):
        these = slice(starts[i], starts[i + 1])
        if i:
            both = ib[these] > 0
            gain = np.bincount(ib[these][both], ab[these][both], len(line))
            gain[0] += a[these].sum()
            line += gain.cumsum()
        scores = np.round(line / records, 12)
        j = int(np.argmax(scores))
        if scores[j] > best[0]:
            best = (scores[j], i, j)
    score, i, j = best
    return table.sparkSession.createDataFrame([(float(cuts[0][i]), float(cuts[1][j]), round(float(score), 9))], "threshold_a double, threshold_b double, macro_f05 double")


def margin_grid(table: DataFrame, two: DataFrame, truth: DataFrame | LinkedTruth, threshold: float, margins) -> DataFrame:
    """Metrics of a margin gate at each margin, beside a fixed threshold."""
    grid = table.sparkSession.createDataFrame([(float(m),) for m in margins], "gate double")
    hit = flagged(two.select(S1, F.col("c1").alias(C), "u1", "margin"), truth, "hit")
    rows = table.select(S1, "truth").join(hit, S1, "left").crossJoin(F.broadcast(grid))  # a stated set
    takes = F.coalesce((F.col("u1") >= threshold) & (F.col("margin") >= F.col("gate")), F.lit(False)).cast("int")
    rows = rows.select("gate", "truth", takes.alias("predicted"), (takes * F.coalesce("hit", F.lit(0))).alias("hits"))
    t, p, h = F.col("truth"), F.col("predicted"), F.col("hits")
    return rows.groupBy("gate").agg(F.round(F.avg(f05(t, p, h)), 9).alias("macro_f05"), F.sum(p).alias("n_predicted"), F.sum(h).alias("n_hits"))


# --- blocks --------------------------------------------------------------------------------


def truth_keys(truth: DataFrame, left: DataFrame, right: DataFrame, specs) -> DataFrame:
    """(pair, block) of truth pairs whose records share the block's key, without making pairs."""
    counts = blocking.key_counts(blocking.keyed(left, specs), blocking.keyed(right, specs)).select("block", "key")
    l_rows = blocking.keyed(left, specs).select("block", "key", F.col("id").alias(S1))
    r_rows = blocking.keyed(right, specs).select("block", "key", F.col("id").alias(C))
    return truth.join(l_rows, S1).join(r_rows, ["block", "key", C]).join(counts, ["block", "key"], "left_semi").select(S1, C, "block").distinct()


def block_recovery(truth: DataFrame, baseline: DataFrame, left: DataFrame, right: DataFrame, specs) -> DataFrame:
    """Of each block its cost, the truth it covers, what of that the baseline lacks, and new truth
    a million pairs."""
    shared = truth_keys(truth, left, right, specs)
    known = baseline.select(S1, C).distinct().withColumn("known", F.lit(1))
    covered = shared.join(known, [S1, C], "left").groupBy("block").agg(F.count("*").alias("covered"), F.count(F.when(F.col("known").isNull(), 1)).alias("new_truth"))
    cost = blocking.pair_estimates(left, right, specs).select("block", "pairs")
    out = cost.join(covered, "block", "left").select("block", "pairs", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("covered", "new_truth")))
    return out.withColumn("new_per_million", F.when(F.col("pairs") > 0, F.round(F.col("new_truth") * 1_000_000 / F.col("pairs"), 6)))


def union_recovery(truth: DataFrame, baseline: DataFrame, left: DataFrame, right: DataFrame, specs) -> DataFrame:
    """New truth that the blocks recover together, and each prefix of their order."""
    place = F.array_position(F.array(*(F.lit(s.name) for s in specs)), F.col("block"))
    new = truth_keys(truth, left, right, specs).join(baseline.select(S1, C), [S1, C], "left_anti")
    first = new.groupBy(S1, C).agg(F.min(place).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    steps = truth.sparkSession.createDataFrame([(i + 1, s.name) for i, s in enumerate(specs)], "k bigint, block string")
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row a block
    return steps.join(F.broadcast(first), "k", "left").select("k", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("recovered"))


def greedy_blocks(recovery: DataFrame, pair_budget: int) -> list[str]:
    """Blocks by falling new truth a million pairs, while their pairs fit the budget."""
    chosen, spent = [], 0
    for r in recovery.where("new_truth > 0").orderBy(F.desc("new_per_million"), "block").collect():  # a row a block
        if spent + r.pairs <= pair_budget:
            chosen.append(r.block)
            spent += r.pairs
    return chosen


def pool_audit(truth: DataFrame, baseline: DataFrame, added: DataFrame) -> DataFrame:
    """Sizes of a pool and of what is added, their overlap, growth, and pairs a new truth pair."""
    base = baseline.select(S1, C).distinct().withColumn("b", F.lit(1))
    more = added.select(S1, C).distinct().withColumn("a", F.lit(1))
    pool = base.join(more, [S1, C], "full").join(truth.withColumn("t", F.lit(1)), [S1, C], "left")
    only = F.col("a").isNotNull() & F.col("b").isNull()
    out = pool.agg(F.count("b").alias("baseline"), F.count("a").alias("added"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("overlap"), F.count("*").alias("combined"), F.count(F.when(F.col("b").isNotNull() & F.col("t").isNotNull(), 1)).alias("baseline_truth"), F.count(F.when(only & F.col("t").isNotNull(), 1)).alias("new_truth"))
    return with_growth(out)


def with_growth(sizes: DataFrame) -> DataFrame:
    """Growth of a pool and pairs a new truth pair, from its sizes."""
    return sizes.withColumn("expansion", F.when(F.col("baseline") > 0, F.round((F.col("combined") - F.col("baseline")) / F.col("baseline"), 9))).withColumn("pairs_per_new", F.when(F.col("new_truth") > 0, F.round((F.col("combined") - F.col("baseline")) / F.col("new_truth"), 6)))


# --- triage --------------------------------------------------------------------------------


def record_summary(records: DataFrame, truth: DataFrame | LinkedTruth, ranked: DataFrame, rank: str, utility: str, shown=("name_exact", "address_exact", "country_exact", "name_similarity", "address_similarity")) -> DataFrame:
    """One row a record: its first candidate, its best true candidate and how high truth ranks."""
    counts = truth_counts(truth).withColumnRenamed("truth", "truth_count")
    rows = flagged(ranked, truth, "true")
    top = lambda c: F.max(F.when(F.col(rank) == 1, F.col(c)))
    within = lambda k: F.max(F.when((F.col(rank) <= k) & F.col("true").isNotNull(), 1).otherwise(0)).alias(f"top{k}_tp")
    summary = rows.groupBy(S1).agg(top(C).alias("top1_candidate"), top(utility).alias("top1_utility"), *(top(c).alias(f"top1_{c}") for c in shown), F.min(F.when(F.col("true").isNotNull(), F.col(rank))).alias("best_true_rank"), F.max(F.when(F.col("true").isNotNull(), F.col(utility))).alias("best_true_utility"), *map(within, (1, 3, 5, 10, 20)))
    out = records.select(F.col("entity_id").alias(S1)).join(counts, S1, "left").join(summary, S1, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("truth_count", "top1_tp", "top3_tp", "top5_tp", "top10_tp", "top20_tp")})


def triage(summary: DataFrame, threshold: float) -> DataFrame:
    """How many records end in each outcome, in one aggregate."""
    u, tp, t, r = (F.col(c) for c in ("top1_utility", "top1_tp", "truth_count", "best_true_rank"))
    takes, wrong = F.coalesce(u >= threshold, F.lit(False)), (t > 0) & u.isNotNull() & (tp == 0)
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return summary.agg(
        count(takes, "accepted"),
        count(takes & (tp == 1), "accepted_tp"),
        count(takes & (tp == 0), "accepted_fp"),
        count(~takes & (tp == 1), "rejected_tp"),
        count(wrong & (r <= 20), "wrong_true_le20"),
        count(wrong & (r > 20), "wrong_true_gt20"),
        count(wrong & r.isNull(), "wrong_true_missing"),
        count(takes & (t == 0), "singleton_fp"),
    )


def utility_bins(summary: DataFrame, threshold: float) -> DataFrame:
    """Records by the distance of their first utility to the threshold."""
    u = F.col("top1_utility")
    # Names and edges of the bins.
    name = F.when(u.isNull(), "NO_TOP1").when(u < threshold - 10, "BELOW_LT10").when(u < threshold - 5, "BELOW_10_TO_5").when(u < threshold, "BELOW_5_TO_0").when(u < threshold + 5, "ABOVE_0_TO_5").when(u < threshold + 10, "ABOVE_5_TO_10").otherwise("ABOVE_GT10")
    return summary.groupBy(name.alias("bin")).agg(F.count("*").alias("n"), F.sum("top1_tp").alias("tp"), F.count(F.when((F.col("truth_count") == 0) & (u >= threshold), 1)).alias("singleton_fp"))


def false_patterns(summary: DataFrame, threshold: float) -> DataFrame:
    """Accepted wrong candidates by which fields agree exactly."""
    flags = ["top1_name_exact", "top1_address_exact", "top1_country_exact"]
    return summary.where((F.col("top1_utility") >= threshold) & (F.col("top1_tp") == 0)).groupBy(*flags).agg(F.count("*").alias("n"))


def gap_stats(summary: DataFrame) -> DataFrame:
    """Utility gap and best true rank where a true candidate lost, exact quantiles."""
    lost = summary.where((F.col("top1_tp") == 0) & F.col("best_true_rank").isNotNull()).withColumn("gap", F.col("top1_utility") - F.col("best_true_utility"))
    q = lambda c, p: F.round(F.percentile(c, p), 6).alias(f"{c}_p{round(100 * p)}")
    return lost.agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("gap_mean"), q("gap", 0.5), q("gap", 0.9), F.round(F.avg("best_true_rank"), 6).alias("rank_mean"), q("best_true_rank", 0.5), q("best_true_rank", 0.9))


def candidate_distribution(records: DataFrame, pairs: DataFrame, exact: bool = True) -> DataFrame:
    """Candidates a record: mean, quantiles and maximum; ``exact`` off uses the sketch."""
    n = pairs.groupBy(S1).agg(F.count("*").alias("n"))
    rows = records.select(F.col("entity_id").alias(S1)).join(n, S1, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    q = (lambda p: F.percentile("n", p)) if exact else (lambda p: F.percentile_approx("n", p).cast("double"))
    return rows.agg(F.round(F.avg("n"), 9).alias("mean"), *(F.round(q(p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)), F.max("n").alias("largest"))


def reproduction(a: DataFrame, b: DataFrame, rank: str, utility: str) -> DataFrame:
    """Agreement of two rankings' first candidates, and of their utilities."""
    first = lambda df, p: df.where(F.col(rank) == 1).select(S1, F.col(C).alias(f"c{p}"), F.col(utility).alias(f"u{p}"))
    both = first(a, "a").join(first(b, "b"), S1).withColumn("d", F.abs(F.col("ua") - F.col("ub")))
    return both.agg(F.count("*").alias("n"), F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("same"), F.round(F.max("d"), 9).alias("max_difference"), F.round(F.avg("d"), 9).alias("mean_difference"), (F.coalesce(F.max("d"), F.lit(0.0)) < 1e-5).alias("passes"))
