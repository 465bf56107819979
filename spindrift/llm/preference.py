"""Preference formatting of conversations.

Conversations that open with the same turn answer the same request, so they can be preferred over
one another. Within such a group, distinct conversations are ordered by ``reward`` (by default the
characters of their assistant turns, ties to the smaller id) and each is chosen over the next one,
so a group of n gives n - 1 pairs and not all pairs. The longest common turn prefix of a pair is
rendered once as ``prompt``; what follows is rendered as the ``chosen`` and ``rejected``
completions, with ``*_mask`` listing the character spans (code points, end exclusive) of assistant
text, on which a loss is taken. A conversation without a partner gives one row without rejected
columns, whose prompt ends before its last assistant turn.

Scale: groups and conversations are compared by hashes in aggregates that combine before the
shuffle. The order is cut into ranges of group, reward and id, and the last row of a range is linked
to the first of the next, so the order of a group is exact and no task holds a large group. Only a
caller that names a ``bucket`` has groups over it split by a hash of the conversation's id into
parts of about that size, with pairs inside a part. A conversation over ``part_turns``
turns is rendered in several rows (``part`` 0, 1, ..., whose texts follow one another), so no task
gathers an unbounded conversation.

Defined cases: rows with a null conversation or turn number have no place and are left out; a null
role counts as ``user`` and a null text as empty; repeated rows count once, and of different rows
with the same conversation and turn the one with the smaller hash counts; exact copies of a
conversation form one, under the smallest id, with ``n_copies``; an empty table gives an empty
result; only the four named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.where("conv is not null and turn is not null").withColumn("h", F.xxhash64("role", "text"))


def preference_pairs(turns: DataFrame, bucket: int | None = None) -> DataFrame:
    """``chosen``, ``rejected`` (or null), ``n_copies`` of the chosen one and ``cut``, the first
    turn number that isn't prompt."""
    once = turns.groupBy("conv", "turn").agg(F.min(F.struct("h", F.when(F.col("role") == "assistant", F.length("text")).alias("said"))).alias("x"))
    once = once.select("conv", "turn", "x.h", "x.said")
    talks = once.groupBy("conv").agg(
        F.min(F.struct("turn", "h")).alias("opening"),
        F.count("*").alias("n"),
        F.sum(F.xxhash64("turn", "h").cast("decimal(20,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("h", "turn")).alias("xor"),
        F.coalesce(F.sum("said"), F.lit(0)).alias("reward"),
        F.max(F.when(F.col("said").isNotNull(), F.col("turn"))).alias("last_reply"),
    )
    distinct = talks.groupBy(F.xxhash64("opening.turn", "opening.h").alias("group"), "n", "sum", "xor", "reward", "last_reply").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    if bucket:
        sizes = distinct.groupBy("group").agg(F.ceil(F.count("*") / bucket).alias("parts"))
        distinct = distinct.join(sizes, "group").withColumn("group", F.xxhash64("group", F.pmod(F.xxhash64("conv"), F.col("parts")))).drop("parts")
    spread = checkpointed(distinct.repartitionByRange("group", F.desc("reward"), "conv").withColumn("range", F.spark_partition_id()))
    place = F.struct("group", (-F.col("reward")).alias("down"), "conv")
    # one row a range: bounded by the number of partitions
    ends = spread.groupBy("range").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    ranges = Window.orderBy("range")
    ends = ends.select("range", F.lead("low").over(ranges).alias("after"), F.lag("high").over(ranges).alias("before"))
    order = Window.partitionBy("range").orderBy("group", F.desc("reward"), "conv")
    linked = spread.withColumns({"next": F.lead(place).over(order), "last": F.lag(place).over(order)}).join(F.broadcast(ends), "range")
    after, before = F.coalesce("next", "after"), F.coalesce("last", "before")
    first = ~before["group"].eqNullSafe(F.col("group"))
    pairs = linked.select("conv", "n_copies", "last_reply", F.when(after["group"] == F.col("group"), after["conv"]).alias("rejected"), first.alias("first"))
    # the last of an order has been rejected already; it stands alone only if it is the only one
    pairs = pairs.where("rejected is not null or first").withColumnRenamed("conv", "chosen")
    # the first turn at which the two differ, from hashes alone
    left = pairs.select("chosen", "rejected").where("rejected is not null")
    mine = left.join(once.select(F.col("conv").alias("chosen"), "turn", F.col("h").alias("a")), "chosen")
    other = left.join(once.select(F.col("conv").alias("rejected"), "turn", F.col("h").alias("b")), "rejected").select("chosen", "turn", "b")
    cut = mine.select("chosen", "turn", "a", F.lit(None).cast("bigint").alias("b")).unionByName(other.withColumn("a", F.lit(None).cast("bigint")))
    cut = cut.groupBy("chosen", "turn").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("not (a <=> b)").groupBy("chosen").agg(F.min("turn").alias("cut"))
    return pairs.join(cut, "chosen", "left").select("chosen", "rejected", "n_copies", F.coalesce("cut", F.when(F.col("rejected").isNull(), F.coalesce("last_reply", F.lit((1 << 63) - 1)))).alias("cut"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _spans(side: Column) -> Column:
    """Spans of assistant text in the rendered ``side``: 'start-end' joined by commas."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("spans"))

    def step(a, t):
        begin = a["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"])
        span = F.concat(F.when(a["spans"] != "", F.lit(",")).otherwise(F.lit("")), begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 8).cast("bigint").alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(side, start, step, lambda a: a["spans"])


def format_preferences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bucket: int | None = None, part_turns: int = 4096) -> DataFrame:
    """One row a pair (and part): prompt, both completions, their masks and turn counts."""
    turns = _turns(df, conv, turn, role, text)
    pairs = preference_pairs(turns, bucket)
    body = turns.withColumnRenamed("conv", "owner")
    chosen = body.join(pairs, body["owner"] == pairs["chosen"]).withColumn("side", F.when(F.col("turn") < F.col("cut"), 0).otherwise(1))
    # the rejected side's prompt is the same as the chosen side's: only its completion is carried
    rejected = body.join(pairs, (body["owner"] == pairs["rejected"]) & (body["turn"] >= pairs["cut"])).withColumn("side", F.lit(2))
    rows = chosen.unionByName(rejected)
    parts = rows.groupBy("chosen", "rejected", "n_copies", F.floor(F.col("turn") / part_turns).alias("part")).agg(F.sort_array(F.collect_set(F.struct("side", "turn", "h", "role", "text"))).alias("turns"))
    before = lambda t, i: F.get("turns", i - 1)
    single = F.filter("turns", lambda t, i: (i == 0) | ~((before(t, i)["side"] == t["side"]) & (before(t, i)["turn"] == t["turn"])))
    parts = parts.withColumn("turns", single)
    side = lambda k: F.filter("turns", lambda t: t["side"] == k)
    sides = parts.select("chosen", "rejected", "part", "n_copies", side(0).alias("p"), side(1).alias("c"), side(2).alias("r"))
    text_of = lambda c: F.array_join(F.transform(c, lambda t: rendered_turn(t["role"], t["text"])), "")
    if_pair = lambda x: F.when(F.col("rejected").isNotNull(), x)
    return sides.select(
        F.col("chosen").alias("chosen_id"),
        F.col("rejected").alias("rejected_id"),
        "part",
        "n_copies",
        F.size("p").cast("bigint").alias("prompt_turns"),
        F.size("c").cast("bigint").alias("chosen_turns"),
        if_pair(F.size("r").cast("bigint")).alias("rejected_turns"),
        text_of("p").alias("prompt"),
        text_of("c").alias("chosen"),
        if_pair(text_of("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_mask"),
        if_pair(_spans(F.col("r"))).alias("rejected_mask"),
    )
