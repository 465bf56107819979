"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of
the text's 4-word shingles, repeats included. Words are cut at ASCII white space after lower-casing
A-Z; fewer than four words make one shingle, none the fingerprint zero, which links like any other.

Candidates: with B blocks of bits and radius r at least B - r blocks agree, so two fingerprints
within the radius share a key made of some B - r blocks. B is 5 to 8, larger the more distinct
fingerprints there are; every choice finds all pairs, it only trades copies for bucket size. Equal
fingerprints are one row before that. A bucket over ``bucket`` rows is split into groups, each pair
of groups being compared in a task of its own.

Comparison: up to 64 fingerprints of a bucket are stored as 64 bit planes of one machine word. The
distances of a fingerprint to all of them are counted at once, by carry-save adders over the
planes, and a block is abandoned once all its distances exceed the radius. A bucket gives at most
one edge a fingerprint (a spanning forest), and components are joined by star rounds.

Defined cases: a null text has no words; a text of any length is read whole, alone in its slice; a
bit that is set in just half of the hashes is 0; repeated rows give repeated results; a null id is
carried and never names a component unless all ids of it are null; an empty table gives an empty
result; only the two named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_slices
from .components import components, join_facts

SHINGLE = 4
RADIUS = 4
BUCKET = 8192
#: Expected rows of a bucket beyond which keys get more blocks.
CROWDED = 512
#: Rows that are laid out in planes at once.
COMPARED = 1 << 15

_LANES = np.array([sum(((byte >> bit) & 1) << (8 * bit) for bit in range(8)) for byte in range(256)], np.uint64)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined, width = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Fingerprints of all texts (uint64)."""
    return fingerprints_of([shingle_hashes(t, size) if t else [] for t in texts])


def fingerprints_of(each: list[list[int]]) -> np.ndarray:
    """Fingerprints of lists of shingle hashes. Eight 8-bit counters are added in one word."""
    counts = np.fromiter(map(len, each), np.int64, len(each))
    out = np.zeros(len(each), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    hashes = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    # a lane holds 255 at most: cut every text's hashes into runs of 255
    runs = -(-counts[some] // 255)
    first = np.cumsum(counts[some]) - counts[some]
    run_of = np.repeat(np.arange(len(some)), runs)
    nth = np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs)
    sums = np.add.reduceat(lanes, first[run_of] + 255 * nth, axis=0)
    wide = sums.view(np.uint8).reshape(len(run_of), 64).astype(np.int64)
    totals = np.add.reduceat(wide, np.cumsum(runs) - runs, axis=0)
    set_bits = 2 * totals > counts[some][:, None]
    out[some] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


# --- comparison ----------------------------------------------------------------------------


def _add(total, a, b):
    """Carry-save adder of one-bit lanes: the new total and the carry."""
    half = total ^ a
    return half ^ b, (total & a) | (half & b)


def _exceeds(ones, twos, fours, over, radius: int):
    """Lanes whose count (over: 8 or more) is above the radius."""
    above, equal = over.copy(), ~over
    for plane, bit in ((fours, radius >> 2 & 1), (twos, radius >> 1 & 1), (ones, radius & 1)):
        if bit:
            equal = equal & plane
        else:
            above |= equal & plane
            equal = equal & ~plane
    return above


def near_lanes(prints: np.ndarray, planes: np.ndarray, row: np.ndarray, chunk: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Compare ``prints[row[k]]`` with the 64 lanes of ``planes[:, chunk[k]]`` for every k; returns
    the places k that have any lane within the radius, and those lanes as bits."""
    alive, q = np.arange(len(row)), prints[row]
    ones, twos, fours, over = (np.zeros(len(row), np.uint64) for _ in range(4))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for bit in range(0, 64, 4):
        diff = [planes[bit + k, chunk] ^ ((q >> np.uint64(bit + k) & np.uint64(1)) * full) for k in range(4)]
        ones, a = _add(ones, diff[0], diff[1])
        ones, b = _add(ones, diff[2], diff[3])
        twos, c = _add(twos, a, b)
        over |= fours & c
        fours ^= c
        if bit >= 12 and bit % 8 == 4:
            keep = np.flatnonzero(_exceeds(ones, twos, fours, over, radius) != full)
            if len(keep) < len(alive):
                alive, q, chunk = alive[keep], q[keep], chunk[keep]
                ones, twos, fours, over = ones[keep], twos[keep], fours[keep], over[keep]
            if not len(alive):
                break
    return alive, ~_exceeds(ones, twos, fours, over, radius) if len(alive) else ones


def bucket_forest(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (places in ``prints``) that connect, within each bucket (sorted numbers), just what
    links within the radius connect."""
    n = len(prints)
    fresh = np.diff(bucket, prepend=bucket[0] - 1) != 0
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    lane_no = np.arange(n) - first
    starts_chunk = fresh | (lane_no % 64 == 0)
    chunk_of = np.cumsum(starts_chunk) - 1
    chunk_first = np.flatnonzero(starts_chunk)
    lane = (lane_no % 64).astype(np.uint64)
    planes = np.zeros((64, len(chunk_first)), np.uint64)
    for bit in range(64):
        planes[bit] = np.add.reduceat((prints >> np.uint64(bit) & np.uint64(1)) << lane, chunk_first)
    used = np.diff(np.append(chunk_first, n))
    valid = np.where(used == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (used % 64).astype(np.uint64)) - np.uint64(1))
    # every row meets the chunks of its bucket up to its own: each pair is met once or twice
    meets = chunk_of - chunk_of[first] + 1
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    at, limit = 0, 1 << 15
    ends = np.cumsum(meets)
    while at < n:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        rows = np.repeat(np.arange(at, to), meets[at:to])
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(meets[at:to]) - meets[at:to], meets[at:to])
        chunks = chunk_of[first[rows]] + nth
        places, bits = near_lanes(prints, planes, rows, chunks, radius)
        if len(places):
            rows, chunks = rows[places], chunks[places]
            bits = bits & valid[chunks]
            own = chunk_of[rows] == chunks
            bits = np.where(own, bits & ((np.uint64(1) << lane[rows]) - np.uint64(1)), bits)  # itself and later ones
            some = np.flatnonzero(bits)
            for part in range(0, len(some), 4096):
                s = some[part : part + 4096]
                word, place = np.nonzero(np.unpackbits(bits[s].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a, b = rows[s][word], chunk_first[chunks[s][word]] + place
                while len(a):
                    for x, y in zip(a[:2048].tolist(), b[:2048].tolist(), strict=True):
                        p, q = find(x), find(y)
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            forest.append((x, y))
                    a, b = a[2048:], b[2048:]
                    if len(a):
                        while not np.array_equal(up := root[root], root):
                            root[:] = up
                        apart = root[a] != root[b]
                        a, b = a[apart], b[apart]
        at = to
    return forest


# --- the operator --------------------------------------------------------------------------


def fingerprint_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): one row a text, fp as a signed long. Map only."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"id": batch.column(0), "fp": pa.array(fingerprints(batch.column(1).to_pylist(), size).view(np.int64))}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(picked, "text", make, f"id {kind}, fp bigint", 1 << 18)


def _keys(count: int, radius: int) -> list[int]:
    """Masks of the bits that a key is made of, for about ``count`` distinct fingerprints."""
    for blocks in range(radius + 1, 2 * radius + 1):
        agree = blocks - radius
        if count / 2 ** (64 * agree // blocks) <= CROWDED or blocks == 2 * radius:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect what the radius links."""
    masks = _keys(distinct.count(), radius)
    keys = F.array(*(F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for i, m in enumerate(masks)))
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.key")
    sizes = checkpointed(keyed.groupBy("key").count().where(F.col("count") > 1))  # lone fingerprints have no candidate
    hot = sizes.where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("groups"))
    dealt = keyed.join(sizes.select("key"), "key", "left_semi").join(hot, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
    tasks = F.when(F.col("groups").isNull(), F.array(F.col("key"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.xxhash64("key", F.least(g, own), F.greatest(g, own))))
    rows = dealt.select(F.explode(tasks).alias("task"), "fp").repartition("task").sortWithinPartitions("task")

    def run(batches):
        rest_task, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def compared(task, fp):
            forest = bucket_forest(fp.view(np.uint64), np.unique(task, return_inverse=True)[1], radius)
            ends = np.array(forest, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": fp[ends[:, 0]], "b": fp[ends[:, 1]]})

        for batch in batches:
            if not batch.num_rows:
                continue
            task = np.concatenate([rest_task, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(task, task[-1])) if len(task) >= COMPARED else 0
            if cut:  # the last task may go on in the next batch
                yield compared(task[:cut], fp[:cut])
            rest_task, rest_fp = task[cut:], fp[cut:]
        if len(rest_task):
            yield compared(rest_task, rest_fp)

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row a text: ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that
    links reach."""
    prints = checkpointed(fingerprint_column(df, id_col, text_col, size))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_rows")))
    roots = components(linked_fingerprints(distinct, radius, bucket), "a", "b")
    rooted = checkpointed(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root")))
    # a large component, and a fingerprint of many texts, don't meet in one task
    totals = rooted.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).collect()[0]
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows"))
    named = join_facts(rooted.select("fp", "root", F.col("n_rows").alias("texts")), names, "root", totals[0])
    named = checkpointed(named.select("fp", F.col("texts").alias("n_rows"), "component_id"))
    out = join_facts(prints, named, "fp", totals[1])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
