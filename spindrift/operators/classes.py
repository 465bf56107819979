"""Classes of equal records: pairs are made and scored between their representatives.

Records that agree in every field that blocks and scores read form a class; its smallest id stands for
it, and ``members`` holds all its ids. Blocks, evidence and features are the same for all pairs of two
classes, so they are computed once; key counts, and with them caps, still count records. Results over
records come from the members at the end, without a shuffle of the pairs that they make. A source
with repeated ids is no set of classes (evidence adds up by id): its pairs are made record by record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.files import written_once

from . import blocking, evidence, scoring, tiles
from .metrics import LinkedTruth, with_growth
from .scoring import C, S1

#: Rows of a table of classes, and ids in it, that may be broadcast; more are joined by a shuffle.
MAX_CLASSES, MAX_IDS = 200_000, 1_000_000
#: Source-1 classes whose pairs one task makes, about.
DEALT = 128
NORMS = ("name_norm", "address_norm", "country_norm")


@dataclass(frozen=True)
class Classes:
    """``rows``: a class each, with its fields, ``entity_id`` (the representative), ``n`` and
    ``members`` in order."""

    rows: DataFrame
    classes: int
    ids: int

    def tasks(self) -> int:
        return 1 + min(self.classes // DEALT, 4096)

    def attributes(self) -> DataFrame:
        return F.broadcast(self.rows) if self.classes <= MAX_CLASSES else self.rows

    def members(self, column: str, most: int | None = None) -> DataFrame:
        """(``column``, members): the first ``most`` ids of each class, or all."""
        ids = F.col("members") if most is None else F.slice("members", 1, most)
        rows = self.rows.select(F.col("entity_id").alias(column), ids.alias("members"))
        return F.broadcast(rows) if self.classes <= MAX_CLASSES and self.ids <= MAX_IDS else rows

    def sizes(self, column: str, name: str = "n") -> DataFrame:
        rows = self.rows.select(F.col("entity_id").alias(column), F.col("n").alias(name))
        return F.broadcast(rows) if self.classes <= MAX_CLASSES else rows


def classes_of(records: DataFrame, specs, more: tuple[str, ...] = ()) -> Classes | None:
    """The classes of ``records`` under ``specs``, equal in the fields ``more`` too, or None if an id
    is repeated."""
    fields = dict.fromkeys([*more, *NORMS, *(f for s in specs for f, _, _ in s.parts()), *(f for s in specs for f, _ in s.least)])
    apart = [F.col("entity_id").startswith("S1-") | F.col("entity_id").startswith(f"{t}-") for t in sorted({s.only for s in specs if s.only})]
    rows = records.where("entity_id is not null").groupBy(*fields, *(c.alias(f"side_{i}") for i, c in enumerate(apart)))
    rows = rows.agg(F.sort_array(F.collect_list("entity_id")).alias("members")).select(*fields, F.element_at("members", 1).alias("entity_id"), F.size("members").cast("bigint").alias("n"), "members")
    rows = written_once(rows)
    n, ids = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows.select(F.explode("members").alias("id")).distinct().count() != ids:
        return None
    return Classes(rows, n, ids)


def of_both(left: DataFrame, right: DataFrame, specs, more: tuple[str, ...] = ()) -> tuple[Classes, Classes] | None:
    l_classes, r_classes = classes_of(left, specs, more), classes_of(right, specs, more)
    return (l_classes, r_classes) if l_classes and r_classes else None


def block_pairs(both: tuple[Classes, Classes], specs) -> DataFrame:
    """``blocking.block_pairs`` between representatives. Keys of few classes are broadcast to the
    source-1 classes, dealt by their representative: what then groups pairs by it moves no pair."""
    left, right = both
    if right.classes > MAX_CLASSES:
        return blocking.block_pairs(left.rows, right.rows, specs, "n")
    l_rows, r_rows = blocking.keyed(left.rows, specs, "n"), blocking.keyed(right.rows, specs, "n")
    good = blocking.key_counts(l_rows, r_rows).select("block", "key")
    candidates = r_rows.join(good, ["block", "key"]).select("block", "key", F.col("id").alias(C))
    dealt = blocking.keyed(left.rows.repartition(left.tasks(), "entity_id"), specs)
    pairs = dealt.select("block", "key", "exact", F.col("id").alias(S1)).join(F.broadcast(candidates), ["block", "key"])
    return pairs.select(S1, C, F.col("block").alias("block_name"), F.col("exact").alias("is_exact"))


def expanded(rows: DataFrame, classes: Classes, column: str, **more: Callable[[Column], Column]) -> DataFrame:
    """``rows`` once for each member of the class that ``column`` names; columns keep their order.
    ``more`` are further columns, computed once a member from its id."""
    names, members = rows.columns, classes.members(column)
    if more:
        members = members.withColumn("members", F.transform("members", lambda x: F.struct(x.alias(column), *(f(x).alias(k) for k, f in more.items()))))
    rows = rows.join(members, column).drop(column)
    if more:
        return rows.select("*", F.explode("members").alias("member")).select("*", "member.*").select(*names, *more)
    return rows.select("*", F.explode("members").alias(column)).select(*names)


def pairs_of(rows: DataFrame, both: tuple[Classes, Classes]) -> DataFrame:
    """Rows of pairs of representatives as rows of pairs of records."""
    return expanded(expanded(rows, both[1], C), both[0], S1)


def ranked(rows: DataFrame, both: tuple[Classes, Classes], order: list[str], into: str, most: int | None = None) -> DataFrame:
    """Pairs of records with their place within the source-1 record, by the columns ``order``, falling,
    and then the candidate's id; with ``most``, only places up to it. All records of a source-1 class
    have the same candidates in the same places, so places are given a class."""
    names, falling = rows.columns, [F.desc(c) for c in order]
    if most is None:
        members, rows = both[1].members(C), rows.repartition(both[0].tasks(), S1)
    else:
        # each class has a record before those of the next, so only the first ``most`` can count
        first = F.row_number().over(Window.partitionBy(S1).orderBy(*falling, C))
        rows = rows.withColumn("first", first).where(F.col("first") <= most).select(*names)
        # candidates before those that tie with this one: classes that begin after ``most`` can go
        upto = F.sum("size").over(Window.partitionBy(S1).orderBy(*falling).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        tied = F.sum("size").over(Window.partitionBy(S1, *order))
        rows = rows.join(both[1].sizes(C, "size"), C).withColumns({"upto": upto, "tied": tied}).where(F.col("upto") - F.col("tied") < most).select(*names)
        members = both[1].members(C, most)
    rows = rows.join(members, C).drop(C).select("*", F.explode("members").alias(C)).select(*names)
    rows = scoring.ranked(rows, order[0], into, *falling[1:])
    return expanded(rows if most is None else rows.where(F.col(into) <= most), both[0], S1)


def scored(left: DataFrame, right: DataFrame, specs, most: int | None = None) -> DataFrame:
    """``scoring.scored`` of the evidence of ``specs``; with ``most``, only ranks up to it."""
    both = of_both(left, right, specs)
    if both is None:
        rows = scoring.scored(evidence.aggregated(blocking.block_pairs(left, right, specs)), left, right)
        return rows if most is None else rows.where(F.col("base_rank") <= most)
    pairs = evidence.aggregated(block_pairs(both, specs)) if most is None else tiles.best_pairs(*key_columns(both, specs, tiles.NORMS), specs, most)
    rows = scoring.pair_features(pairs, both[0].attributes(), both[1].attributes()).withColumn("base_score", scoring.base_score())
    return ranked(rows, both, ["base_score"], "base_rank", most)


def labelled(both: tuple[Classes, Classes], specs, truth: LinkedTruth) -> DataFrame:
    """Scored pairs of ``grouped_classes`` with ``label`` (1 if true, else 0), ``before``, how many
    records rank before all those of the same score, ``best``, the best score of a true pair, and
    ``held``, 1 if any pair of this score is true. All of it is the same for all records of a source-1 class."""
    rows = scoring.pair_features(evidence.aggregated(block_pairs(both, specs)), both[0].attributes(), both[1].attributes())
    rows = rows.withColumn("base_score", scoring.base_score())
    for side, key, group in zip(both, (S1, C), ("left_group", "right_group"), strict=True):
        mine = side.rows.select(F.col("entity_id").alias(key), F.col("truth_group").alias(group), *(["n"] if key == C else []))
        rows = rows.join(F.broadcast(mine) if side.classes <= MAX_CLASSES else mine, key)
    links = written_once(truth.links)
    links = links.withColumn("t", F.lit(1))
    rows = rows.join(F.broadcast(links) if links.count() <= MAX_IDS else links, ["left_group", "right_group"], "left")
    rows = rows.withColumn("label", F.coalesce("t", F.lit(0))).drop("t", "left_group", "right_group")
    upto = F.sum("n").over(Window.partitionBy(S1).orderBy(F.desc("base_score")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum("n").over(Window.partitionBy(S1, "base_score"))
    best = F.max(F.when(F.col("label") == 1, F.col("base_score"))).over(Window.partitionBy(S1))
    held = F.max("label").over(Window.partitionBy(S1, "base_score"))
    return rows.withColumns({"upto": upto, "tied": tied, "best": best, "held": held}).withColumn("before", F.col("upto") - F.col("tied")).drop("upto", "tied", "n")


def candidates_of(rows: DataFrame, both: tuple[Classes, Classes]) -> DataFrame:
    """Rows of ``labelled`` as rows of source-1 classes and candidates' records, with ``base_rank``.
    What was left out before must be whole scores of a class: ranks then stay those of all."""
    place = F.row_number().over(Window.partitionBy(S1, "base_score").orderBy(C))
    return expanded(rows, both[1], C).withColumn("base_rank", (F.col("before") + place).cast("bigint")).drop("before", "best", "held")


def wide_scored(left: DataFrame, right: DataFrame, specs) -> tuple[DataFrame, tuple[Classes, Classes] | None]:
    """``scoring.wide_score`` of the merged evidence of ``specs``, between representatives, and the
    classes; between records, and None, if an id is repeated."""
    both = of_both(left, right, specs)
    pairs = evidence.merged(block_pairs(both, specs) if both else blocking.block_pairs(left, right, specs)).select(S1, C, "evidence_count")
    sides = [c.attributes() for c in both] if both else (left, right)
    return scoring.wide_score(pairs, *sides), both


def aggregated(left: DataFrame, right: DataFrame, specs, aggregate=evidence.aggregated) -> DataFrame:
    """``aggregate`` of the pairs that ``specs`` make, a row a pair of records."""
    both = of_both(left, right, specs)
    return pairs_of(aggregate(block_pairs(both, specs)), both) if both else aggregate(blocking.block_pairs(left, right, specs))


def key_columns(both: tuple[Classes, Classes], specs, fields: tuple[str, ...] = ("truth_group",)) -> list[DataFrame]:
    """Of each side (entity_id, n, the ``fields``, k0, k1, ...): its classes with the key of every block,
    null where it has none or the key is over its cap."""
    capped = [s for s in specs if s.cap is not None]
    good = written_once(blocking.key_counts(*(blocking.keyed(c.rows, capped, "n") for c in both)).select("block", "key")) if capped else None
    out = []
    for side in both:
        rows = side.rows.select("entity_id", "n", *fields, *(blocking.key_column(s).alias(f"k{i}") for i, s in enumerate(specs)))
        for i, s in enumerate(specs):
            if s.cap is not None:
                mine = good.where(F.col("block") == s.name).select(F.col("key").alias(f"k{i}"), F.lit(True).alias("good"))
                rows = rows.join(mine, f"k{i}", "left").withColumn(f"k{i}", F.when(F.col("good"), F.col(f"k{i}"))).drop("good")
        out.append(rows)
    return out


def true_pairs(both: tuple[Classes, Classes], baseline, added, truth: LinkedTruth) -> DataFrame:
    """(source1_entity_id, n_left, n_right, b, a): true pairs of classes, how many records they stand
    for, and whether (1 or 0) each set of blocks makes them. Keys are compared; no block's pairs are made."""
    specs = [*baseline, *added]
    l_rows, r_rows = key_columns(both, specs)
    named = lambda rows, p: rows.select(F.col("entity_id").alias(f"{p}_id"), F.col("n").alias(f"n_{p}"), F.col("truth_group").alias(f"{p}_group"), *(F.col(f"k{i}").alias(f"{p}{i}") for i in range(len(specs))))
    right = named(r_rows, "right")
    right = F.broadcast(right) if both[1].classes <= MAX_CLASSES else right
    links = written_once(truth.links)
    links = F.broadcast(links) if links.count() <= MAX_IDS else links
    rows = named(l_rows, "left").repartition(both[0].tasks(), "left_id").join(links, "left_group").join(right, "right_group")
    same = lambda first, last: F.greatest(F.lit(0), *((F.col(f"left{i}") == F.col(f"right{i}")).cast("int") for i in range(first, last)))
    return rows.select(F.col("left_id").alias(S1), "n_left", "n_right", same(0, len(baseline)).alias("b"), same(len(baseline), len(specs)).alias("a"))


def union_size(sides: list[DataFrame], columns: list[str]) -> DataFrame:
    """(size): pairs of records that share a key of any of ``columns``, by inclusion and exclusion over
    sets of columns: keys are counted, pairs are not made."""
    sets = [[c for i, c in enumerate(columns) if m >> i & 1] for m in range(1, 1 << len(columns))]
    all_of = lambda cs: reduce(Column.__and__, (F.col(c).isNotNull() for c in cs))
    each = F.array(*(F.when(all_of(cs), F.struct(F.lit(m).alias("m"), F.lit(1 if len(cs) % 2 else -1).cast("bigint").alias("sign"), F.array(*cs).alias("keys"))) for m, cs in enumerate(sets)))
    count = lambda rows, name: rows.select("n", F.explode(each).alias("x")).where("x is not null").select("x.*", "n").groupBy("m", "sign", "keys").agg(F.sum("n").alias(name))
    both = count(sides[0], "n_left").join(count(sides[1], "n_right"), ["m", "sign", "keys"])
    return both.agg(F.coalesce(F.sum(F.col("sign") * F.col("n_left") * F.col("n_right")), F.lit(0)).alias("size"))


def pool_audit(both: tuple[Classes, Classes], baseline, added, truth: LinkedTruth) -> DataFrame:
    """``metrics.pool_audit`` of two sets of blocks: pairs of classes are made for the baseline alone,
    what the other set has of them and of truth is told by its keys."""
    n, keys = F.col("n_left") * F.col("n_right"), [f"k{i}" for i in range(len(baseline), len(baseline) + len(added))]
    sides = [written_once(rows) for rows in key_columns(both, [*baseline, *added])]
    pairs = block_pairs(both, baseline).select(S1, C).distinct()
    for rows, c, key, p in zip(sides, both, (S1, C), ("left", "right"), strict=True):
        mine = rows.select(F.col("entity_id").alias(key), F.col("n").alias(f"n_{p}"), *(F.col(k).alias(f"{p}_{k}") for k in keys))
        pairs = pairs.join(F.broadcast(mine) if c.classes <= MAX_CLASSES else mine, key)
    shared = F.greatest(F.lit(0), *((F.col(f"left_{k}") == F.col(f"right_{k}")).cast("int") for k in keys))
    total = lambda v, name: F.coalesce(F.sum(v), F.lit(0)).alias(name)
    sizes = pairs.agg(total(n, "baseline"), total(n * shared, "overlap"))
    found = true_pairs(both, baseline, added, truth).agg(total(n * F.col("b"), "baseline_truth"), total(n * F.col("a") * (1 - F.col("b")), "new_truth"))
    out = sizes.crossJoin(union_size(sides, keys).withColumnRenamed("size", "added")).crossJoin(found)  # one row each
    out = out.withColumn("combined", F.col("baseline") + F.col("added") - F.col("overlap"))
    return with_growth(out.select("baseline", "added", "overlap", "combined", "baseline_truth", "new_truth"))


def grouped_classes(left: DataFrame, right: DataFrame, specs, truth: LinkedTruth) -> tuple[Classes, Classes] | None:
    """Classes whose records are of one truth group, ``truth_group``, too."""
    group = lambda df, side, key, name: df.join(side.select(F.col(key).alias("entity_id"), F.col(name).alias("truth_group")), "entity_id", "left")
    return of_both(group(left, truth.left, S1, "left_group"), group(right, truth.right, C, "right_group"), specs, ("truth_group",))


def candidate_lists(left: DataFrame, targets: list[DataFrame], specs) -> DataFrame | None:
    """``evidence.candidate_lists`` of targets in the order of their ids' prefixes: lists are made a
    class, where its pairs are made; None if an id is repeated."""
    rows = None
    for i, right in enumerate(targets):
        both = of_both(left, right, specs)
        if both is None:
            return None
        pairs = block_pairs(both, specs).select(S1, C).distinct().join(both[1].members(C), C)
        lists = pairs.groupBy(S1).agg(F.array_join(F.sort_array(F.flatten(F.collect_list("members"))), ",").alias(f"c{i}"))
        if rows is None:
            rows = both[0].rows.select(F.col("entity_id").alias(S1), F.col("members").alias("all")).repartition(both[0].tasks(), S1)
        rows = rows.join(lists, S1, "left")
    joined = F.concat_ws(",", *(f"c{i}" for i in range(len(targets))))
    return rows.select(F.explode("all").alias(S1), F.nullif(joined, F.lit("")).alias("candidate_entity_ids"))
