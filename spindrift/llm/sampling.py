"""SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

Every segmentation of a text is a path of its lattice of pieces, with a probability proportional to
the product of its pieces' probabilities (see ``unigram``). Perturbing each path's log-probability
by its own Gumbel noise and taking the k largest samples k distinct segmentations without
replacement. They are found by A-star search without visiting the others: a node of the search is
a set of paths that share a prefix and avoid some next pieces; its bound is the largest perturbed
value within it, which is a Gumbel truncated at its parent's. Popping the best node draws its best
path from the lattice's conditional distributions and splits the rest of the node by where a path
leaves that one.

The lattice's units (see ``unigram.units``) are independent, so backward scores are worked out
once for each distinct rest of a unit and paths are drawn for all units and texts of a slice in
step. Noise
is a hash of the row key, sample and place: results don't depend on partitions or retries.

``log_inclusion`` is the log of the probability that a segmentation is among those above the
threshold, the (k + 1)-th largest perturbed value; 0 if there are at most k segmentations. Its
exponential's inverse weights a sample (Horvitz-Thompson).

Defined cases: a null text gives no row, an empty text has the one empty segmentation; a text with
fewer than k segmentations gives them all; equal keys and texts give equal rows, so repeated rows
give repeated results; a null key has a noise stream of its own; an empty table gives an empty
result; equal perturbed values go to the earlier path and place; only the two named columns are read,
so extra columns cannot clash. A text of any length is read whole; memory grows with the longest
single text, not with a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unigram
from .common import Powers, map_slices

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
POWERS = Powers(0xD6E8FEB86659FD93)
#: Rests over this many characters are hashed by more than a polynomial modulo 2**64, which some long
#: sequences (Thue-Morse) defeat: also modulo two primes.
LONG = 100
PRIMES = tuple((p, b, pow(b, -1, p)) for p, b in ((2147483647, 1103515245), (2147483629, 69069069)))
_SPACE, _LINE = (unigram.code_points(c)[0][0] for c in " \n")


def uniform(key: np.ndarray, place: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) by hashing (key, place, stream): splitmix64."""
    x = key + (place.astype(np.uint64) + np.uint64((stream << 40) + 1)) * _GOLDEN
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, modulus)) % np.uint64(modulus)
        filled += step
    return out


def _rest_hashes(values: np.ndarray, modulus: int, base: int, inverse: int) -> np.ndarray:
    """Of every rest of ``values``: its polynomial hash modulo a prime below 2**31."""
    m = np.uint64(modulus)
    terms = values % m * _powers(base, modulus, len(values)) % m
    return np.cumsum(terms[::-1])[::-1] % m * _powers(inverse, modulus, len(values)) % m


_KEPT: dict = {}


def kept_lattice(model: dict, max_nodes: int) -> Lattice:
    """This worker's lattice for the model: later tasks find the units of earlier ones."""
    key = (len(model["names"]), model["byte_lp"], max_nodes)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Lattice(model, max_nodes)
    return _KEPT[key]


class Lattice:
    """Conditional distributions of the next piece at every place of the units of texts.

    What may follow depends on the rest of the unit alone, so a node stands for one distinct rest,
    found by its 64-bit hash, however many units end in it. ``cum[node]`` has the cumulated
    probabilities of pieces of 1, 2, ... characters, ``ids[node]`` their ids (-1: none, or for one
    character its bytes), ``beta[node]`` the log of the summed probability of all segmentations of
    the rest. Nodes are kept for later texts up to ``max_nodes``; results don't depend on that."""

    SLOTS = 21

    def __init__(self, model: dict, max_nodes: int = 250_000):
        self.lexicon, self.max_nodes = unigram.Lexicon(model), max_nodes
        self.width = max(16, self.lexicon.longest)
        self.lp_of = np.full(len(model["names"]) + 1, 0.0)
        for i, lp in model["pieces"].values():
            self.lp_of[i] = lp
        self.id_kind = np.int16 if len(model["names"]) < 1 << 15 else np.int32
        self._clear()

    def _clear(self) -> None:
        self.used = 0
        self.slots = np.full(1 << self.SLOTS, -1, np.int32)
        self.cum = np.zeros((0, self.width), np.float32)
        self.ids = np.zeros((0, self.width), self.id_kind)
        self.beta, self.left, self.n_bytes, self.edges, self.keys = (np.zeros(0, kind) for kind in (np.float64, np.int32, np.int8, np.int8, np.uint64))

    def _room(self, names: tuple[str, ...], used: int, more: int) -> None:
        for name in names:
            old = getattr(self, name)
            if used + more > len(old):
                new = np.zeros((max(used + more, 2 * len(old)), *old.shape[1:]), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _GOLDEN >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of keys, -1 for new ones."""
        slot = self._slot(keys)
        node = self.slots[slot]
        if not self.used:
            return node
        going = np.flatnonzero((node >= 0) & (self.keys[node] != keys))
        while len(going):
            slot[going] = (slot[going] + 1) & (1 << self.SLOTS) - 1
            node[going] = self.slots[slot[going]]
            going = going[(node[going] >= 0) & (self.keys[node[going]] != keys[going])]
        return node

    def _enter(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of distinct new keys: the next numbers, in the keys' order."""
        number = self.used + np.arange(len(keys))
        self.keys[number] = keys
        self.used += len(keys)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.slots[slot[open_]] < 0]
            self.slots[slot[free]] = number[free]  # of several keys for a slot one wins
            open_ = open_[self.slots[slot[open_]] != number[open_]]
            slot[open_] = (slot[open_] + 1) & (1 << self.SLOTS) - 1
        return number

    def places(self, joined: str, text_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of every character of joined texts, and where units begin."""
        characters, size = unigram.code_points(joined)
        cut = (characters == _SPACE) | (characters == _LINE)
        cut[text_begin] = True
        begin = np.flatnonzero(cut)
        length = np.diff(begin, append=len(characters))
        end = begin + length
        rest = np.repeat(end, length) - np.arange(len(characters))
        up, down = POWERS(len(characters) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(characters * up[: len(characters)])])
        keys = (np.repeat(total[end], length) - total[:-1]) * down[: len(characters)] + rest.astype(np.uint64) * _GOLDEN
        for b in np.flatnonzero(length > LONG).tolist():
            a, z = int(begin[b]), int(end[b])
            for modulus, base, inverse in PRIMES:
                keys[a : z - LONG] += _rest_hashes(characters[a:z], modulus, base, inverse)[: z - LONG - a] * _GOLDEN
        if self.used > self.max_nodes:
            self._clear()
        node = self._found(keys)
        new = np.flatnonzero(node < 0)
        if len(new):
            distinct, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            while self.used + len(distinct) > 1 << self.SLOTS - 1:  # a huge text: keep half of the slots free
                self.SLOTS += 1
                old, self.slots = self.keys[: self.used].copy(), np.full(1 << self.SLOTS, -1, np.int32)
                self.used = 0
                self._enter(old)
            self._room(("cum", "ids", "beta", "left", "n_bytes", "edges", "keys"), self.used, len(distinct))
            node[new] = self._enter(distinct)[which]
            at = new[first]
            at = at[np.argsort(rest[at], kind="stable")]
            self.left[node[at]], self.n_bytes[node[at]] = rest[at], size[at]
            edge = np.flatnonzero(np.diff(rest[at], prepend=0, append=0))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                self._score(node, at[a:b], int(rest[at[a]]), characters, size)
        return node, begin

    def _score(self, path: np.ndarray, at: np.ndarray, rest: int, characters: np.ndarray, size: np.ndarray) -> None:
        lex, node, most = self.lexicon, path[at], min(rest, self.lexicon.longest)
        values = np.full((len(at), most), -np.inf)
        ids = np.full((len(at), most), -1, np.int32)
        begun, h = np.arange(len(at)), np.zeros(len(at), np.uint64)  # places where a longer piece may begin
        for n in range(1, most + 1):
            here = at[begun]
            h = h * unigram._BASE + characters[here + n - 1]
            row = lex.find(h)
            value = lex.lp[row]
            if n == 1:
                value = np.where(np.isneginf(value), size[at] * lex.byte_lp, value)
            values[begun, n - 1] = value + self.beta[path[here + n]] if n < rest else value
            ids[begun, n - 1] = lex.ids[row]
            longer = lex.more[row]
            begun, h = begun[longer], h[longer]
            if not len(begun):
                break
        top = values.max(1)
        share = np.exp(values - top[:, None])
        total = share.sum(1)
        cum = np.cumsum(share, 1) / total[:, None]
        some = share > 0
        last = most - 1 - some[:, ::-1].argmax(1)
        cum[np.arange(most) >= last[:, None]] = 2.0
        self.cum[node, :most], self.cum[node, most:] = cum, 2.0
        self.ids[node, :most], self.ids[node, most:] = ids, -1
        self.beta[node], self.edges[node] = top + np.log(total), some.sum(1)

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Characters of the next piece."""
        passed = np.packbits(self.cum[node] <= u.astype(np.float32)[:, None], axis=1)
        return np.bitwise_count(passed).sum(1, dtype=np.int64) + 1

    def log_p(self, node: np.ndarray, at: np.ndarray, take: np.ndarray) -> np.ndarray:
        """Log of the conditional probability of the pieces that begin at ``at`` of ``node``."""
        here = node[at]
        ids = self.ids[here, take - 1]
        score = np.where(ids >= 0, self.lp_of[ids], self.n_bytes[here] * self.lexicon.byte_lp)
        after = np.where(take < self.left[here], self.beta[node[np.minimum(at + take, len(node) - 1)]], 0.0)
        return np.minimum(score + after - self.beta[here], 0.0)


def top_k(lattice: Lattice, texts: list[str], keys: np.ndarray, k: int) -> tuple[str, list[list[tuple[np.ndarray, float, float, float]]], np.ndarray, np.ndarray]:
    """The joined texts, for each text its samples in falling order of perturbed log-probability
    (characters of the pieces, log-probability, perturbed log-probability, log-inclusion), the node
    of each character and the place of each text."""
    per_text = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_begin = np.cumsum(per_text) - per_text
    joined = "".join(" " + t for t in texts)
    node, begin = lattice.places(joined, text_begin)
    total, n = len(node), len(texts)
    text_of_unit = np.searchsorted(text_begin, begin, side="right") - 1
    local = begin - text_begin[text_of_unit]  # places count from the start of their text
    owner, character = np.repeat(np.arange(n), per_text), np.arange(total)

    def draw(take: np.ndarray, at: np.ndarray, place: np.ndarray, key: np.ndarray, stream: int) -> None:
        """Go on drawing pieces at ``at`` until the ends of the units."""
        while len(at):
            here = node[at]
            step = lattice.pick(here, uniform(key, place, stream))
            take[at] = step
            more = np.flatnonzero(step < lattice.left[here])
            at, place, key = at[more] + step[more], place[more] + step[more], key[more]

    paths: list[dict] = []
    samples: list[list] = [[] for _ in texts]

    def expand(take: np.ndarray, g: np.ndarray, deviation: np.ndarray, avoid: np.ndarray, live: np.ndarray) -> None:
        """Score a new path of every live text and split what is left of its search node."""
        at = np.flatnonzero(take)
        text = owner[at]
        log_p = lattice.log_p(node, at, take[at])
        first = np.searchsorted(text, np.arange(n))
        ends = np.append(first[1:], len(at))
        upto = np.empty(len(at))
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):  # a text's sums don't see its neighbours
            np.cumsum(log_p[a:b], out=upto[a:b])
        so_far = upto - log_p
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            others = np.log(-np.expm1(log_p))
            others[lattice.edges[node[at]] < 2] = -np.inf
            # at the deviation itself the pieces avoided before are gone as well
            d = np.flatnonzero(at == deviation[text])
            if len(d):
                probability = np.diff(lattice.cum[node[at[d]]].astype(np.float64).clip(max=1), axis=1, prepend=0)
                gone = (avoid[text[d]][:, None] >> np.arange(lattice.width)) & 1
                rest = (probability * (1 - gone)).sum(1)
                others[d] = np.where(gone.sum(1) < lattice.edges[node[at[d]]], np.log(rest), -np.inf)
            mass = so_far + others
            bound = g[text]
            noise = uniform(keys[text], at - text_begin[text], 2 * len(paths) + 1)
            value = mass - np.log(np.exp(mass - bound) - np.log(noise))
        value[np.isneginf(mass) | (at < deviation[text]) | ~live[text]] = -np.inf
        whole = upto[ends - 1]
        for t in np.flatnonzero(live):
            samples[t].append((take[text_begin[t] : text_begin[t] + per_text[t]], float(whole[t]), float(g[t])))
        paths.append({"take": take, "at": at, "value": value, "first": first, "ends": ends, "deviation": deviation, "avoid": avoid})

    def best(done: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every text the best bound, its path and its place; it is popped unless ``done``."""
        top, path, place = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for number, p in enumerate(paths):
            some = np.flatnonzero(p["ends"] > p["first"])  # the others had no further sample
            value = np.full(n, -np.inf)
            value[some] = np.maximum.reduceat(p["value"], p["first"][some])
            better = np.flatnonzero(value > top)
            top[better], path[better] = value[better], number
        for number, p in enumerate(paths):
            mine = np.flatnonzero((path == number) & (top > -np.inf))
            if len(mine):
                equal = np.flatnonzero(p["value"] == np.repeat(top, np.diff(np.append(p["first"], len(p["at"])))))
                where = equal[np.searchsorted(equal, p["first"][mine])]
                place[mine] = p["at"][where]
                if not done:
                    p["value"][where] = -np.inf
        return top, path, place

    take = np.zeros(total, np.int8)
    draw(take, begin, local, keys[text_of_unit], 0)
    everyone = np.ones(n, bool)
    g = -np.log(-np.log(uniform(keys, np.zeros(n, np.int64), (1 << 20) - 1)))
    expand(take, g, np.full(n, -1), np.zeros(n, np.int64), everyone)
    for sample in range(1, k):
        g, path, place = best(done=False)
        live = g > -np.inf
        if not live.any():
            break
        take = np.zeros(total, np.int8)
        avoid = np.zeros(n, np.int64)
        cut = np.where(live, place, np.iinfo(np.int64).max)
        for number, p in enumerate(paths):
            same = np.flatnonzero((path[owner] == number) & (character < cut[owner]))
            take[same] = p["take"][same]
            mine = np.flatnonzero((path == number) & live)
            again = p["deviation"][mine] == place[mine]
            avoid[mine] = np.where(again, p["avoid"][mine], 0) | 1 << (p["take"][place[mine]].astype(np.int64) - 1)
        t = np.flatnonzero(live)
        at = place[t]
        cum = lattice.cum[node[at]].astype(np.float64).clip(max=1)
        share = np.diff(cum, axis=1, prepend=0) * (1 - ((avoid[t][:, None] >> np.arange(lattice.width)) & 1))
        u = uniform(keys[t], at - text_begin[t], 2 * sample)
        running = np.cumsum(share, 1)
        step = np.minimum((running <= (u * running[:, -1])[:, None]).sum(1), lattice.width - 1) + 1
        take[at] = step
        avoid[t] |= 1 << (step - 1)
        more = step < lattice.left[node[at]]
        fresh = np.flatnonzero((begin > cut[text_of_unit]) & live[text_of_unit])
        at = np.concatenate([at[more] + step[more], begin[fresh]])
        owner_text = np.concatenate([t[more], text_of_unit[fresh]])
        draw(take, at, at - text_begin[owner_text], keys[owner_text], 2 * sample)
        expand(take, g, np.where(live, place, -1), avoid, live)
    threshold, _, _ = best(done=True)
    out = []
    for t in range(n):
        rows = []
        for pieces, log_prob, perturbed in samples[t]:
            x = log_prob - threshold[t]
            rate = np.exp(min(x, 700.0))
            inclusion = 0.0 if np.isneginf(threshold[t]) else float(x - rate / 2 if x < -18 else np.log(-np.expm1(-rate)))
            rows.append((pieces, log_prob, perturbed, inclusion))
        out.append(rows)
    return joined, out, node, text_begin


def piece_ids(lattice: Lattice, node: np.ndarray, takes: list[np.ndarray], begins: list[int], joined: str, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many samples, one after the other, and each sample's number of ids. A sample's
    ``take`` has its pieces' characters at their first one, ``begin`` the place of its text among
    the nodes of the ``joined`` texts."""
    sizes = np.fromiter(map(len, takes), np.int64, len(takes))
    take = np.concatenate(takes)
    at = np.flatnonzero(take)
    sample = np.repeat(np.arange(len(takes)), sizes)[at]
    place = at + np.repeat(np.array(begins, np.int64) - np.cumsum(sizes) + sizes, sizes)[at]
    ids = lattice.ids[node[place], take[at] - 1].astype(np.int32)
    counts = np.bincount(sample, minlength=len(takes))
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, counts
    raw = [joined[i].encode() for i in place[bare].tolist()]
    more = np.ones(len(ids), np.int64)
    more[bare] = list(map(len, raw))
    ids = np.repeat(ids, more)
    ids[ids < 0] = byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(sample, weights=more, minlength=len(takes)).astype(np.int64)


def piece_bytes(model: dict) -> list[bytes]:
    """What each id stands for."""
    out = [name.replace(unigram.SPACE, " ").encode() for name in model["names"]]
    for byte, i in enumerate(model["bytes"]):
        out[i] = bytes([byte])
    return out


def decode(ids, meaning: list[bytes]) -> str:
    return b"".join(map(meaning.__getitem__, ids)).decode()[1:]


def decoded(ids: np.ndarray, counts: np.ndarray, meaning: pa.BinaryArray) -> list[bytes]:
    """What samples spell (with the leading space of a text), from all their ids at once."""
    spelled = meaning.take(pa.array(ids))
    ends = np.frombuffer(spelled.buffers()[1], np.int32, len(ids) + 1)[np.concatenate([[0], np.cumsum(counts)])].tolist()
    data = memoryview(spelled.buffers()[2] or b"")
    return [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 42, model: str = unigram.MODEL, max_nodes: int = 250_000, verify: bool = False) -> DataFrame:
    """One row a text and sample: ``sample`` (1 is the best), ``ids`` (array of int), ``log_prob``,
    ``perturbed`` and ``log_inclusion``; with ``verify`` also ``exact``, whether decoding gives the
    text back."""
    shared = df.sparkSession.sparkContext.broadcast(unigram.load(model))

    def make():
        lattice, meaning = kept_lattice(shared.value, max_nodes), pa.array(piece_bytes(shared.value), pa.binary())
        byte_ids = np.array(shared.value["bytes"], np.int32)

        def step(batch: pa.RecordBatch) -> dict:
            every = batch.column(1).to_pylist()
            there = [i for i, t in enumerate(every) if t is not None]
            texts, rows = [every[i] for i in there], []
            names = batch.column(0).cast(pa.string()).to_pylist()
            keys = np.array([xxhash.xxh64_intdigest(b"\1" if names[i] is None else b"\0" + names[i].encode(), seed) for i in there], np.uint64)
            flat, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
            if texts:
                joined, found, node, begins = top_k(lattice, texts, keys, k)
                every = [(n, i, number, *x) for n, (i, samples) in enumerate(zip(there, found, strict=True)) for number, x in enumerate(samples, 1)]
                flat, sizes = piece_ids(lattice, node, [x[3] for x in every], [int(begins[x[0]]) for x in every], joined, byte_ids)
                same = [a == b" " + texts[x[0]].encode() for x, a in zip(every, decoded(flat, sizes, meaning), strict=True)] if verify else [True] * len(every)
                rows = [(i, number, log_prob, perturbed, inclusion, ok) for (_, i, number, _, log_prob, perturbed, inclusion), ok in zip(every, same, strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            return {"id": batch.column(0).take(pa.array(columns[0], pa.int64())), "sample": pa.array(columns[1], pa.int32()), "ids": ids, "log_prob": pa.array(columns[2], pa.float64()), "perturbed": pa.array(columns[3], pa.float64()), "log_inclusion": pa.array(columns[4], pa.float64()), **({"exact": pa.array(columns[5], pa.bool_())} if verify else {})}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_slices(picked, "text", make, f"id {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double{', exact boolean' if verify else ''}", 1 << 19)
    return out.withColumnRenamed("id", id_col)


def decode_samples(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = unigram.MODEL) -> DataFrame:
    """``df`` with ``text_col``, the text that ``ids_col`` spells (null for null)."""
    meaning = df.sparkSession.sparkContext.broadcast(piece_bytes(unigram.load(model)))
    rest = [c for c in df.columns if c != text_col]

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode(x, meaning.value) for x in batch.column(batch.schema.names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    picked = df.select(*rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return picked.mapInArrow(run, f"{fields}, `{text_col}` string")
