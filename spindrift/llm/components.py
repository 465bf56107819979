"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed: each round is two aggregates and joins whose output is written to the
checkpoint folder, so lost executors cost one round at most, and stars shrink towards the smallest
node of a component. A hub's neighbours never meet in one task: its minimum is a combining
aggregate, and minima of nodes with very many edges come back to their edges by a broadcast, whose
size is bounded by the number of edges (see ``join_facts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: A key is heavy from this many rows, or from a share of all rows that leaves at most so many keys.
HEAVY, MOST_HEAVY = 1000, 1_000_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of ``facts``, one row a ``key``, whose
    ``n_rows`` tells how many rows have the key. Heavy keys are few (``total`` / limit at most) and
    are broadcast, so their rows stay where they are; the others are joined by a shuffle."""
    limit = max(HEAVY, total // MOST_HEAVY)
    names = [c for c in facts.columns if c not in (key, "n_rows")]
    heavy = facts.where(F.col("n_rows") > limit).select(key, F.struct(*names).alias("heavy_facts"))
    marked = rows.join(F.broadcast(heavy), key, "left")
    hot = marked.where("heavy_facts is not null").select(*rows.columns, *(F.col(f"heavy_facts.{c}").alias(c) for c in names))
    rest = marked.where("heavy_facts is null").drop("heavy_facts").join(facts.where(F.col("n_rows") <= limit).drop("n_rows"), key)
    return hot.unionByName(rest.select(*hot.columns))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n_rows"))
    return join_facts(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
    near = join_facts(edges, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return near.unionByName(least.select("u", F.col("m").alias("v")))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node. Loops,
    repeated edges and edges with a null end are ignored."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    edges = checkpointed(edges)
    before = _sum(edges)
    while True:
        starred = checkpointed(_large_star(edges, before[0]).distinct())
        edges = checkpointed(_small_star(starred, before[0]).distinct())
        now = _sum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
