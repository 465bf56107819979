"""Near copies by exact similarity: SimHash links first, then every other pair that can reach it.

Two texts are near copies if the sets of their 5-word shingles (words and hashes as in ``simhash``;
fewer words make one shingle) have a Jaccard similarity of 0.8 or more. Groups are what such pairs
connect. SimHash alone loses pairs at any radius that can be indexed, so it only proposes:

1. Texts with the same set are one node from here on. One pass over the texts writes each node's
   size, fingerprint, prefix and parity bits.
2. Prefixes. Put all shingles in one order: of n shingles, a near copy shares one of the first
   n - ceil(0.8 n) + 1 with it, so texts without a shared shingle there are never compared, and no
   near copy is lost. The order is rarest first by the counts of one text in ``SHARE``, as rare
   shingles are shared by few; it may be any, so the counts decide the cost and not the result.
3. First candidates: SimHash links, the two texts of a shingle that only two share, and of more
   each with the smallest of about its own size. This joins large groups at a linear cost.
4. Then all pairs that share a prefix shingle of more than two texts and are not connected yet. The
   rows of shingles that hold the same smallest root are compared together, so that a pair that
   shares many shingles is met once; over ``CLUSTER`` rows are dealt in blocks of nodes, each two of
   which meet in a task. Shingles whose nodes are all connected are left out, which doesn't change
   groups.

Every candidate must pass two bounds that no near copy fails: the sizes, and the parity bits (bit b
is the parity of the number of shingles that hash to b): two sets differ in at least as many
shingles as their parities differ in bits. There are four bits a shingle or more; a list is folded
to half its size by adding its halves, to compare it with a shorter one. The exact similarity of the
sets decides the rest.

Defined cases: texts without words are one node; a null text has no words; repeated rows give
repeated results; an empty table gives an empty result; a text of any length is read whole, alone
in its slice; only the two named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_slices, release
from .components import components, join_facts
from .simhash import fingerprints_of, linked_fingerprints, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: One text in so many is counted for the order; common shingles that are told apart (16 bytes each).
SHARE = 16
COMMON = 500_000
#: Words of 64 parity bits of the smallest sets, and of the largest.
PARITY, MOST_PARITY = 16, 2048
#: Rows of open shingles that are compared in one task, rows held and pairs made at once.
CLUSTER = 1 << 15
HELD = 1 << 15
PAIRS = 1 << 18
#: Ratio of sizes within a band: those of a band can reach the similarity.
BAND = 1.25
#: Rows of 8- or 16-byte keys that may be broadcast.
MAX_BROADCAST = 1_000_000


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of a set, rarest first, one of which every near copy has in its own prefix."""
    most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    if not len(common):
        return hashes[:most]
    place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[place] == hashes, counts[place], 0)))[:most]]


def parity_words(n: np.ndarray) -> np.ndarray:
    """Words of parity bits of sets of ``n`` shingles: a power of two, 64 bits for 16 shingles."""
    words = 1 << np.ceil(np.log2(np.maximum(n, 1) / 16)).clip(0).astype(np.int64)
    return words.clip(PARITY, MOST_PARITY)


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The parity bits of each set, by a part of its shingles' hashes."""
    words = parity_words(np.fromiter(map(len, sets), np.int64, len(sets)))
    out = []
    for hashes, n in zip(sets, words.tolist(), strict=True):
        odd = np.bincount((hashes >> np.uint64(7)).astype(np.int64) % (64 * n), minlength=64 * n).astype(np.uint8) & 1
        out.append(np.packbits(odd, bitorder="little").view(np.int64))
    return out


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _nodes(df: DataFrame, key: str, text: str, size: int, common=None, counts=None, similarity: float = SIMILARITY) -> DataFrame:
    """(node, s) a text: a hash of its set of shingles, and the set. With ``common`` and ``counts``
    its key, the set's size ``n``, fingerprint ``fp``, prefix ``s`` and parity bits as well."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            each = [shingle_hashes(t, size) if t else [] for t in batch.column(1).to_pylist()]
            sets = [np.unique(np.array(x, np.uint64)) for x in each]
            out = {"key": batch.column(0), "node": pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))}
            if common is None:
                return out | {"s": _lists(sets)}
            shown = [prefix(s, common, counts, similarity) for s in sets]
            return out | {"s": _lists(shown), "n": pa.array([len(s) for s in sets], pa.int32()), "fp": pa.array(fingerprints_of(each).view(np.int64)), "odd": _lists(parities(sets))}

        return step

    picked = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    more = "" if common is None else ", n int, fp bigint, odd array<bigint>"
    return map_slices(picked, "text", make, f"key {df.schema[key].dataType.simpleString()}, node bigint, s array<bigint>{more}", 1 << 18)


def _common(df: DataFrame, key: str, text: str, size: int, share: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the counted texts share, sorted, and how many do; the most frequent
    ``most`` of them."""
    some = _nodes(df.where(F.pmod(F.xxhash64(F.lit(3), key), F.lit(share)) == 0), key, text, size)
    often = some.select(F.explode("s").alias("s")).groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(most).toPandas()
    hashes = often["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], often["count"].to_numpy(np.int64)[order]


def _folded(odd: Column, words: Column) -> Column:
    """Parity bits in ``words`` words: of a longer list, the sum of its halves."""
    half = F.zip_with(F.slice(odd, F.lit(1), words), F.slice(odd, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(odd) > words, half).otherwise(odd)


def _may_reach(similarity: float, na: Column, nb: Column, a: Column, b: Column) -> Column:
    """The two bounds. Sets of that similarity differ in (1 - s) / (1 + s) of their sizes at most;
    the sizes of their lists then differ by a factor of two at most."""
    words = F.least(F.size(a), F.size(b))
    apart = F.aggregate(F.zip_with(_folded(a, words), _folded(b, words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9) & (apart <= (na + nb) * (1 - similarity) / (1 + similarity) + 1e-9)


def _shortened(odd: Column) -> Column:
    """Parity bits in ``PARITY`` words."""
    at = lambda i: F.aggregate(F.filter(odd, lambda _, k: k % PARITY == i), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(odd) > PARITY, F.transform(F.sequence(F.lit(0), F.lit(PARITY - 1)), at)).otherwise(odd)


def compared(rows: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (a < b) of two roots that share a task and shingle and pass the bounds. Rows
    have ``task``, ``s``, ``node``, ``root``, ``n``, ``own`` and ``other`` (blocks) and ``odd``."""
    names, first, which = np.unique(rows["node"], return_index=True, return_inverse=True)
    n, odd = rows["n"][first].astype(np.int64), rows["odd"][first].view(np.uint64)
    order = np.lexsort((rows["s"], rows["task"]))
    task, s = rows["task"][order], rows["s"][order]
    begin = np.flatnonzero((np.diff(task, prepend=task[0] - 1) != 0) | (np.diff(s, prepend=s[0] - 1) != 0))
    ends = np.append(begin[1:], len(order))
    after = np.repeat(ends, ends - begin) - np.arange(len(order)) - 1  # later rows of its shingle
    upto, at, found = np.cumsum(after), 0, []
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        x = np.repeat(np.arange(at, to), after[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
        x, y, at = order[x], order[y], to
        keep = (rows["root"][x] != rows["root"][y]) & (rows["own"][x] == rows["other"][y]) & (rows["own"][y] == rows["other"][x])
        x, y = which[x[keep]], which[y[keep]]
        pair = np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y))
        a, b = pair // len(names), pair % len(names)
        keep = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[keep], b[keep]
        apart = np.zeros(len(a), np.int64)
        for word in range(odd.shape[1]):
            apart += np.bitwise_count(odd[a, word] ^ odd[b, word])
        keep = apart <= (n[a] + n[b]) * (1 - similarity) / (1 + similarity) + 1e-9
        found.append(a[keep] * len(names) + b[keep])
    pair = np.unique(np.concatenate(found))
    a, b = names[pair // len(names)], names[pair % len(names)]
    return np.minimum(a, b), np.maximum(a, b)


def _open_pairs(open_: DataFrame, similarity: float, cluster: int) -> DataFrame:
    """(a, b) of nodes under different roots that share a shingle and pass the bounds. ``open_``:
    (s, low, node, root, n, odd)."""
    sizes = open_.groupBy("low").agg(F.count("*").alias("n_rows")).withColumn("blocks", F.ceil(F.col("n_rows") / cluster).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = join_facts(open_, sizes, "low", open_.count()).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("low", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(task.alias("task"), "s", "node", "root", "n", "own", "other", "odd").repartition("task").sortWithinPartitions("task", "s")

    def run(batches):
        def plain(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "odd"}
            return out | {"odd": batch.column("odd").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARITY)}

        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(plain(batch))
            if sum(len(x["s"]) for x in held) < HELD:
                continue
            rows = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
            last = (rows["task"] == rows["task"][-1]) & (rows["s"] == rows["s"][-1])  # may go on in the next batch
            held = [{c: v[last] for c, v in rows.items()}]
            if not last.all():
                a, b = compared({c: v[~last] for c, v in rows.items()}, similarity)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
        if held:
            a, b = compared({c: np.concatenate([x[c] for x in held]) for c in held[0]}, similarity)
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(df: DataFrame, key: str, text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, share: int = SHARE, common: int = COMMON, cluster: int = CLUSTER) -> DataFrame:
    """(key, root): one row a text; near copies have the same root. ``key`` names rows and is never
    null; rows with equal keys have equal texts."""
    rows = checkpointed(_nodes(df, key, text, size, *_common(df, key, text, size, share, common), similarity))
    nodes = checkpointed(rows.groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("odd").alias("odd")))
    sized = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("odd").alias(f"o{side}"))
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) that pass the bounds, those of the similarity."""
        pairs = checkpointed(pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"))
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        used = checkpointed(nodes.join(used, "node", "left_semi").select(F.col("key").alias("used")))
        texts = df.join(F.broadcast(used) if used.count() <= MAX_BROADCAST else used, df[key] == F.col("used"), "left_semi")
        sets = _nodes(texts, key, text, size).groupBy("node").agg(F.first("s").alias("s"))
        side = lambda p: sets.select(F.col("node").alias(p), F.col("s").alias(f"s{p}"))
        shared = F.size(F.array_intersect("sa", "sb"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", shared.alias("shared"))
        return checkpointed(both.where(F.col("shared") >= similarity * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select("a", "b"))

    firsts = rows.select("node", "n", F.explode("s").alias("s"))
    shared = firsts.groupBy("s").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.min("n").alias("nx"), F.max("n").alias("ny"), F.count("*").alias("rows"))
    # a pair that several shingles share alone is one row from here on
    shared = checkpointed(shared.where("x < y").select(F.when(F.col("rows") > 2, F.col("s")).alias("s"), *(F.when(F.col("rows") == 2, F.col(c)).alias(c) for c in ("x", "y", "nx", "ny"))).distinct())
    release(df.sparkSession)
    many = shared.where("s is not null").select("s")
    keyed = checkpointed(firsts.join(F.broadcast(many) if many.count() <= MAX_BROADCAST else many, "s").distinct())
    band = F.floor(F.log("n") / math.log(BAND))
    stars = keyed.join(keyed.groupBy("s", band.alias("band")).agg(F.min("node").alias("x")).withColumnRenamed("s", "star"), (F.col("s") == F.col("star")) & (band == F.col("band"))).select("x", F.col("node").alias("y"))

    prints = nodes.groupBy("fp").agg(F.min("node").alias("a"))
    links = linked_fingerprints(checkpointed(prints.select("fp"))).distinct()
    linked = links.join(prints.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    two = shared.where(F.col("s").isNull() & fits(F.col("nx"), F.col("ny"))).select("x", "y")
    same = nodes.join(prints, "fp").select(F.col("a").alias("x"), F.col("node").alias("y"))
    proposed = linked.select("x", "y").unionByName(same).unionByName(two).unionByName(stars)
    proposed = checkpointed(proposed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
    may = _may_reach(similarity, F.col("na"), F.col("nb"), F.col("oa"), F.col("ob"))
    proposed = checkpointed(proposed.join(sized("a"), "a").join(sized("b"), "b").where(may).select("a", "b"))
    edges = verified(proposed)

    roots = checkpointed(components(edges, "a", "b"))
    release(df.sparkSession)
    rooted = checkpointed(keyed.join(roots, "node", "left").select("s", "node", "n", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    short = nodes.select("node", _shortened(F.col("odd")).alias("odd"))
    open_ = checkpointed(rooted.join(mixed.select("s", "low"), "s").join(short, "node"))
    apart = _open_pairs(open_, similarity, cluster).join(proposed, ["a", "b"], "left_anti")
    apart = checkpointed(apart.join(sized("a"), "a").join(sized("b"), "b").where(may).select("a", "b"))
    edges = edges.unionByName(verified(apart))
    roots = components(edges, "a", "b")
    return rows.join(roots, "node", "left").select(F.col("key").alias(key), F.coalesce("root", "node").alias("root"))
