"""First candidates of classes without a row a pair: keys are dealt in tiles, pairs live in arrays.

A pair is met once, under the first of the blocks (``makers``) that make it: blocks whose key holds the
whole key of another block without a cap make no further pairs and only count as evidence. A hot key
is cut into tiles of both sides. A tile scores all its pairs, as ``scoring.base_score`` does, and
returns each source-1 class's best ones with the blocks that made them, as bits."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import similarity
from spindrift.sources.files import written_once

from . import blocking
from .scoring import BASE_CLIPPED, BASE_WEIGHTS, C, S1

#: Classes of a side of a tile, about; pairs of classes for one task, about; pairs held in arrays at once.
TILE, TASK_PAIRS, CHUNK = 2048, 2_000_000, 1 << 15
#: Rows of keys that may be broadcast.
MAX_KEYS = 200_000
NORMS = ("name_norm", "address_norm", "country_norm")


def makers(specs) -> list[int]:
    """Numbers of the blocks that together make all pairs."""

    def whole(s):
        return {*s.parts(), *([("country_norm", None, 0)] if s.country else [])}

    def covers(a, b):
        return a.cap is None and a.only in (None, b.only) and set(a.least) <= set(b.least) and whole(a) <= whole(b)

    return [i for i, b in enumerate(specs) if not any(covers(a, b) and (not covers(b, a) or j < i) for j, a in enumerate(specs) if j != i)]


def plain(spec) -> list[str] | None:
    """The whole fields whose equality is the block's, or None where its key has to be compared."""
    if spec.cap is not None or spec.least or spec.only or any(cut or f not in NORMS for f, cut, _ in spec.parts()):
        return None
    return [f for f, _, _ in spec.parts()] + (["country_norm"] if spec.country else [])


# --- a task's share ------------------------------------------------------------------------


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 digits, halves up, as SQL rounds a double's decimal form."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class Texts:
    """The distinct texts of both sides as numbers, with their characters as small numbers."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        number, names = pd.factorize(np.concatenate([left, right]))
        self.left, self.right = number[: len(left)].astype(np.int32), number[len(left) :].astype(np.int32)
        self.texts = [str(x) for x in names]
        self.length = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.fits = self.length <= 64
        short = [t if ok else "" for t, ok in zip(self.texts, self.fits, strict=True)]
        letters = np.unique(np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32))
        width = int(self.length[self.fits].max(initial=0))
        self.word = np.uint32 if width <= 32 else np.uint64
        self.size = len(letters) + 1
        chars = similarity._codes(short, np.where(self.fits, self.length, 0), letters, width) if width else np.zeros((len(short), 0), np.uint8)
        self.columns = np.ascontiguousarray(chars.T).astype(np.int32)
        masks = np.zeros((len(short), self.size), self.word)
        for j in range(width):
            np.bitwise_or.at(masks, (np.arange(len(short)), chars[:, j]), self.word(1) << self.word(j))
        masks[:, 0] = 0
        self.masks = masks.ravel()

    def equal(self, li, ri) -> np.ndarray:
        l, r = self.left[li], self.right[ri]  # noqa: E741
        return (l == r) & (self.length[l] > 0)

    def length_ratio(self, li, ri) -> np.ndarray:
        m, n = self.length[self.left[li]], self.length[self.right[ri]]
        ratio = np.minimum(m, n) / np.maximum(np.maximum(m, n), 1)
        return rounded(np.where((m == 0) | (n == 0), 0.0, ratio))

    def similarity(self, li, ri, equal) -> np.ndarray:
        """``similarity.indel`` of pairs, rounded."""
        out = equal.astype(float)
        l, r = self.left[li], self.right[ri]  # noqa: E741
        other = np.flatnonzero(~equal & (self.length[l] > 0) & (self.length[r] > 0))
        fits = self.fits[l[other]] & self.fits[r[other]]
        if len(long := other[~fits]):
            out[long] = similarity.indels([self.texts[i] for i in l[long]], [self.texts[i] for i in r[long]])
        if len(quick := other[fits]):
            a, b = l[quick], r[quick]
            m, n, one = self.length[a], self.length[b], self.word(1)
            full = np.where(m == self.word().nbytes * 8, ~self.word(0), (one << (m % (self.word().nbytes * 8)).astype(self.word)) - one).astype(self.word)
            base, state = a * np.int32(self.size) if len(self.masks) < 1 << 31 else a.astype(np.int64) * self.size, full.copy()
            for column in self.columns[: int(n.max())]:
                match = self.masks[base + column[b]]
                match &= state
                rest = state - match
                state += match
                state |= rest
            out[quick] = 2.0 * (m - np.bitwise_count(state & full)) / (m + n)
        return rounded(out)


def scores(texts: dict[str, Texts], equal: dict[str, np.ndarray], li, ri, files, exacts) -> np.ndarray:
    """``scoring.base_score`` of pairs, by the same steps."""
    of = {f"{c.removesuffix('_norm')}_exact": x for c, x in equal.items()}
    for c in NORMS[:2]:
        field = c.removesuffix("_norm")
        of[f"{field}_similarity"], of[f"{field}_length_ratio"] = texts[c].similarity(li, ri, equal[c]), texts[c].length_ratio(li, ri)
    of["evidence_file_count"], of["exact_key_count"] = files, np.minimum(exacts, 5)
    out = np.zeros(len(li))
    for c, w in BASE_WEIGHTS.items():
        out = out + of[c] * w
    for c, (w, most) in BASE_CLIPPED.items():
        out = out + np.minimum(of[c], most) * w
    return rounded(out)


def best_of(rows: pd.DataFrame, specs, made: list[int], most: int) -> pa.Table:
    """The ``most`` best pairs of each source-1 class and tile among ``rows`` of both sides."""
    rows = rows.assign(tile=pd.factorize(pd.MultiIndex.from_frame(rows[["maker", "key", "cl", "cr"]]))[0])
    left, right = (rows[rows["side"] == i].sort_values(["tile", "entity_id"], kind="stable") for i in (0, 1))
    tiles = int(rows["tile"].max()) + 1 if len(rows) else 0
    size = np.bincount(right["tile"], minlength=tiles)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if tiles else np.zeros(0, int)
    n = size[left["tile"].to_numpy()] if len(left) else np.zeros(0, int)
    texts = {c: Texts(left[c].to_numpy(object), right[c].to_numpy(object)) for c in NORMS}
    keys, whole = {}, {i: fields for i, s in enumerate(specs) if (fields := plain(s))}
    for i in range(len(specs)):
        if i in whole:
            continue
        number = pd.factorize(pd.concat([left[f"k{i}"], right[f"k{i}"]]))[0].astype(np.int32)
        l, r = number[: len(left)], number[len(left) :]  # noqa: E741
        keys[i] = np.where(l < 0, -1, l), np.where(r < 0, -2, r)
    exact = np.int64(sum(1 << i for i, s in enumerate(specs) if s.exact))
    maker = left["maker"].to_numpy()
    before = np.array([sum(1 << j for j in made if j < i) for i in range(len(specs))], np.int64)[maker] if len(left) else np.zeros(0, np.int64)
    first, ends, found = start[left["tile"].to_numpy()] if len(left) else n, np.cumsum(n), []
    at = 0
    while at < len(left):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        mine = n[at:end]
        li = np.repeat(np.arange(at, end), mine)
        ri = np.arange(len(li)) - np.repeat(np.cumsum(mine) - mine, mine) + first[li]
        bits, equal = np.zeros(len(li), np.int64), {c: texts[c].equal(li, ri) for c in NORMS}
        for i, (l, r) in keys.items():  # noqa: E741
            bits |= (l[li] == r[ri]).astype(np.int64) << i
        for i, fields in whole.items():
            bits |= np.logical_and.reduce([equal[c] for c in fields]).astype(np.int64) << i
        new = (bits & before[li]) == 0
        if not new.all():
            li, ri, bits, equal = li[new], ri[new], bits[new], {c: x[new] for c, x in equal.items()}
        if len(li):
            score = scores(texts, equal, li, ri, np.bitwise_count(bits), np.bitwise_count(bits & exact))
            # candidates come in the order of their ids
            if most == 1:
                runs = np.flatnonzero(np.diff(li, prepend=-1))
                top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, runs), np.diff([*runs, len(li)])))
                take = top[np.flatnonzero(np.diff(li[top], prepend=-1))]
            else:
                order = np.lexsort((-score, li))
                runs = np.flatnonzero(np.diff(li[order], prepend=-1))
                take = order[np.arange(len(order)) - np.repeat(runs, np.diff([*runs, len(order)])) < most]
            found.append((li[take], ri[take], bits[take]))
        at = end
    li, ri, bits = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    return pa.table({S1: pa.array(left["entity_id"].to_numpy(object)[li], pa.string()), C: pa.array(right["entity_id"].to_numpy(object)[ri], pa.string()), "bits": pa.array(bits, pa.int64())})


# --- the plan ------------------------------------------------------------------------------


def evidence_of(bits: Column, specs) -> list[Column]:
    """The columns of ``evidence.aggregated`` of pairs whose blocks are bits."""
    exact, n = sum(1 << i for i, s in enumerate(specs) if s.exact), F.bit_count(bits).cast("bigint")
    named = sorted((s.name, i) for i, s in enumerate(specs))
    names = F.concat_ws(",", *(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for name, i in named))
    exacts = F.least(F.lit(5), F.bit_count(bits.bitwiseAND(F.lit(exact)))).cast("bigint")
    return [n.alias("evidence_rows"), n.alias("evidence_file_count"), exacts.alias("exact_key_count"), names.alias("block_names")]


def best_pairs(left: DataFrame, right: DataFrame, specs, most: int) -> DataFrame:
    """``evidence.aggregated``, written once, of the pairs that can be among the ``most`` first ones of a source-1
    class by base score and candidate's id. Both sides are classes with ``k0``, ``k1``, ..., their key
    of every block, null where they have none."""
    made, ks = makers(specs), [f"k{i}" for i, s in enumerate(specs) if not plain(s)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("maker"), F.col(f"k{i}").alias("key")) for i in made))).alias("x")
    sides = [df.select("entity_id", *NORMS, *ks, each).select("x.*", "entity_id", *NORMS, *ks).where("key is not null") for df in (left, right)]
    l_n, r_n = (df.groupBy("maker", "key").agg(F.count("*").alias(name)) for df, name in zip(sides, ("nl", "nr"), strict=True))
    cut = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    counts = written_once(l_n.join(r_n, ["maker", "key"]).select("maker", "key", cut("nl").alias("al"), cut("nr").alias("ar"), (F.col("nl") * F.col("nr")).alias("pairs")))
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    counts = counts.drop("pairs")
    counts = F.broadcast(counts) if n <= MAX_KEYS else counts
    tasks = 1 + min(total // TASK_PAIRS, 100_000)
    rows = []
    for side, (df, mine, other, a, b) in enumerate(((sides[0], "cl", "cr", "al", "ar"), (sides[1], "cr", "cl", "ar", "al"))):
        dealt = df.join(counts, ["maker", "key"]).withColumn(mine, F.pmod(F.xxhash64("entity_id"), F.col(a)).cast("int"))
        dealt = dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(b) - 1)))
        rows.append(dealt.select(F.lit(side).alias("side"), "maker", "key", "cl", "cr", "entity_id", *NORMS, *ks))
    rows = rows[0].unionByName(rows[1]).repartition(int(tasks), "maker", "key", "cl", "cr")
    specs = tuple(specs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from best_of(pa.Table.from_batches(held).to_pandas(), specs, made, most).to_batches()

    found = written_once(rows.mapInArrow(run, f"{S1} string, {C} string, bits bigint"))
    return found.select(S1, C, *evidence_of(F.col("bits"), specs))
