"""Substring dedup: suffix automata of reference shards, streamed for matching statistics.

A window is ``window`` consecutive words of one text. Every word covered by a window whose words
also start earlier (smaller id, or same id and earlier start) is removed.

1. Routing. Each window belongs to its minimizer, the least hash of its runs of ``GRAM`` words.
   Neighbouring windows with the same minimizer place form a segment (15 windows at most). Equal
   windows have equal minimizers, so only segments with equal minimizer hashes can repeat one
   another, and no window occurs twice in one segment. Segments with equal words within a slice of
   input are combined before the shuffle, and with those that a task has met repeatedly before, so a
   passage in very many texts leaves a row a task; those in the same task after it are combined as
   well: the later ones are repeats as a whole.
2. Reference shards. Distinct segments whose minimizer hash has other distinct segments are dealt
   to shards by that hash. A shard's segments are streamed in order through the shard's suffix
   automaton and then added to it: the matching statistic at a word is the length of the longest
   run of words ending there that occurs in earlier segments, and where it reaches ``window`` a
   window repeats an earlier one. The maximal spans of such windows are removed.
3. A minimizer hash with over ``heavy`` distinct segments would outgrow a shard. Its segments are
   cut into single windows, which are dealt by their own hash, so each meets only its equals.

Texts are shuffled once, by id, for both uses of their words. Equality of words is exact within a
shard; segments are combined on 128 bits of hash, two independent halves of which words over 64
bytes get from XXH64, so that no structure of a word makes it collide.

Defined cases: a null or empty text has no words; a text with fewer words than a window keeps all;
a text of any length is read whole, alone in its slice; repeated rows are treated alike; rows of one
id with other texts are texts of their own, in the order of a 32-bit hash of the text; rows with a null id
keep all words and start nothing; an empty table gives an empty result; only the two named columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, checkpointed, map_slices

WINDOW = 20
GRAM = 6
#: Segments of a shard, and distinct segments of a minimizer hash that still go to one shard.
SHARD, HEAVY = 1500, 4000
#: Rows that may be broadcast.
MAX_BROADCAST = 200_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.uint64(24)


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
_BYTES2, _WORDS2 = Powers(0xC2B2AE3D27D4EB4F), Powers(0x165667B19E3779F9)
#: Bytes of a word beyond which a polynomial modulo 2**64 could be defeated (by Thue-Morse words).
LONG_WORD = 64
#: Words whose places are told apart at once, below 2**24.
CHUNK = 1 << 23
#: Repeated segments that a task remembers.
SEEN = 20_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX1
    x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of all texts, and each text's number of words."""
    joined = b" " + b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    both = []
    for powers in (_BYTES, _BYTES2):
        up, down = powers(len(raw) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        both.append(_mixed((total[end] - total[start]) * down[start]))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = joined[start[i] : end[i]]
        both[0][i], both[1][i] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
    text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(start, text_end)
    return both[0], both[1], np.diff(upto, prepend=0)


def _run_hashes(hashes: np.ndarray, start: np.ndarray, length, powers: Powers = _WORDS) -> np.ndarray:
    up, down = powers(len(hashes) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[: len(hashes)])])
    return _mixed((total[start + length] - total[start]) * down[start])


def _minimizers(grams: np.ndarray, span: int) -> np.ndarray:
    """For every window of ``span`` grams the place of the least (of equal ones the first)."""
    parts = []
    for at in range(0, len(grams) - span + 1, CHUNK):
        part = grams[at : at + CHUNK + span - 1]
        key = (part >> _PLACE << _PLACE) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        parts.append((key & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64) + at)
    return np.concatenate(parts)


def segments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of all texts: ``text`` (number), ``start`` (word), ``n`` windows, ``h`` (minimizer
    hash) and ``words`` (hash of all its words)."""
    hashes, others, counts = word_hashes(texts)
    names = ("text", "start", "n", "h", "words")
    span = window - gram + 1  # grams in a window
    if len(hashes) < window:
        return {k: np.zeros(0, np.int64) for k in names}
    grams = _run_hashes(hashes, np.arange(len(hashes) - gram + 1), gram)
    place = _minimizers(grams, span)  # by window start
    first_word = np.cumsum(counts) - counts
    text_of = np.repeat(np.arange(len(texts)), np.maximum(counts - window + 1, 0))
    at = np.arange(len(text_of)) - np.repeat(np.cumsum(np.maximum(counts - window + 1, 0)) - np.maximum(counts - window + 1, 0), np.maximum(counts - window + 1, 0))
    begin = first_word[text_of] + at
    place = place[begin]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text_of[1:] != text_of[:-1])
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(begin)))
    return {"text": text_of[head], "start": at[head], "n": n, "h": grams[place[head]].view(np.int64), "words": _run_hashes(others, begin[head], n + window - 1, _WORDS2).view(np.int64)}


# --- suffix automaton ----------------------------------------------------------------------


class SuffixAutomaton:
    """Of many word sequences; ``stream`` returns matching statistics and then adds the sequence."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the longest string that ``p`` and ``word`` make, cut out of ``q``."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def stream(self, words: list[int]) -> list[int]:
        """For each word, the longest run ending at it that occurs in sequences added before (or
        ends earlier in this one)."""
        follow, link, length = self.next, self.link, self.length
        last, out = 0, []
        for at, word in enumerate(words, 1):
            q = follow[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                out.append(at)
                continue
            new, p = self._state(length[last] + 1, 0, {}), last
            while p >= 0 and word not in follow[p]:
                follow[p][word] = new
                p = link[p]
            if p >= 0:
                q = follow[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            out.append(length[link[new]])
            last = new
        return out


def repeated_windows(statistics: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs (first, count) of window starts whose window occurs earlier."""
    out: list[list[int]] = []
    for end, matched in enumerate(statistics):
        if matched >= window:
            start = end - window + 1
            if out and out[-1][0] + out[-1][1] == start:
                out[-1][1] += 1
            else:
                out.append([start, 1])
    return [(a, b) for a, b in out]


# --- the operator --------------------------------------------------------------------------


def _segment_rows(texts: DataFrame, window: int, kind: str) -> DataFrame:
    """(k, words, id, th, start, n, later) of all segments; ``later`` ones repeat one of their slice
    or one that their task has met before."""

    def make():
        seen: dict[tuple[int, int], tuple] = {}
        keys = np.zeros(0, np.int64)

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal keys
            ids, hashes = batch.column(0), batch.column(2)
            seg = segments([(t or "").encode() for t in batch.column(1).to_pylist()], window)
            names = list(zip(ids.to_pylist(), hashes.to_pylist(), strict=True))
            rank = np.empty(batch.num_rows, np.int64)  # texts in order; equal rows share a rank
            value, last = -1, None
            for i in sorted(range(batch.num_rows), key=names.__getitem__):
                if value < 0 or names[i] != last:
                    value, last = value + 1, names[i]
                rank[i] = value
            text, start = seg["text"], seg["start"]
            order = np.lexsort((start, rank[text], seg["words"], seg["h"]))
            h, words, r, s = seg["h"][order], seg["words"][order], rank[text][order], start[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (words[1:] != words[:-1])
            heads = np.flatnonzero(fresh)
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            later = np.zeros(len(order), bool)
            later[order] = (r != r[head]) | (s != s[head])
            place = lambda i: (*names[text[order[i]]], int(s[i]))
            for i in heads[np.isin(words[heads], keys)].tolist() if seen else ():
                key = int(h[i]), int(words[i])
                if key in seen:
                    later[order[i]] = seen[key] < place(i)
                    seen[key] = min(seen[key], place(i))
            if len(seen) < SEEN:
                for i in heads[np.diff(heads, append=len(order)) > 1].tolist():
                    seen.setdefault((int(h[i]), int(words[i])), place(i))
                keys = np.array([w for _, w in seen], np.int64)
            # later ones have no use for their keys: any key spreads them
            k = np.where(later, seg["words"] ^ (text * 7919 + start), seg["h"])
            return {"k": pa.array(k), "words": pa.array(np.where(later, 0, seg["words"])), "id": ids.take(pa.array(text)), "th": hashes.take(pa.array(text)), "start": pa.array(start), "n": pa.array(seg["n"].astype(np.int32)), "later": pa.array(later)}

        return step

    return map_slices(texts.select("id", "text", "th"), "text", make, f"k bigint, words bigint, id {kind}, th bigint, start bigint, n int, later boolean")


def _with_words(texts: DataFrame, wanted: DataFrame, window: int, kind: str, single: bool) -> DataFrame:
    """``wanted`` (id, th, start, n, k) with their words; ``single``: each window for itself, with the
    two halves of its hash instead."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "k")).alias("wanted"))
    joined = texts.join(lists.hint("shuffle_hash"), ["id", "th"]).select("id", "text", "wanted", "th")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"id": [], "start": [], "n": [], "k": [], "words": []}
            for row, (text, wanted) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = text.encode().split()
                if single:
                    hashes, _, _ = word_hashes([text.encode()])
                for x in wanted:
                    at, n = x["start"], x["n"]
                    if at + n + window - 1 > len(words):
                        continue  # of another text with this id
                    if single:
                        begin = np.arange(at, at + n)
                        out["id"] += [row] * n
                        out["start"] += begin.tolist()
                        out["n"] += [1] * n
                        out["k"] += _run_hashes(hashes, begin, window).view(np.int64).tolist()
                        out["words"] += [b" ".join(words[i : i + window]).decode() for i in begin.tolist()]
                    else:
                        out["id"].append(row)
                        out["start"].append(at)
                        out["n"].append(n)
                        out["k"].append(x["k"])
                        out["words"].append(b" ".join(words[at : at + n + window - 1]).decode())
            row = pa.array(out["id"], pa.int64())
            return {"id": batch.column(0).take(row), "th": batch.column(3).take(row), "start": pa.array(out["start"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "k": pa.array(out["k"], pa.int64()), "words": pa.array(out["words"], pa.string())}

        return step

    return map_slices(joined, "text", make, f"id {kind}, th bigint, start bigint, n int, k bigint, words string")


def _streamed(shards: DataFrame, window: int, kind: str) -> DataFrame:
    """Stream each shard's segments (sorted by shard, id, th, start) through its automaton."""

    def run(batches):
        automaton, numbers, shard, last = SuffixAutomaton(), {}, None, None
        for batch in batches:
            rows, starts, counts = [], [], []
            for row, (s, i, h, at, words) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "th", "start", "words")), strict=True)):
                if s != shard:
                    automaton, numbers, shard, last = SuffixAutomaton(), {}, s, None
                if (i, h, at) == last:
                    continue
                last = i, h, at
                sequence = [numbers.setdefault(w, len(numbers)) for w in words.split(" ")]
                for first, count in repeated_windows(automaton.stream(sequence), window):
                    rows.append(row)
                    starts.append(at + first)
                    counts.append(count)
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(row), "th": batch.column("th").take(row), "start": pa.array(starts, pa.int64()), "n": pa.array(counts, pa.int32())})

    return shards.mapInArrow(run, f"id {kind}, th bigint, start bigint, n int")


def _removed_windows(texts: DataFrame, by_id: DataFrame, window: int, shard: int, heavy: int, kind: str) -> DataFrame:
    """(id, th, start, n): runs of windows that also start earlier. ``by_id``: texts dealt by id."""
    rows = _segment_rows(texts, window, kind).repartition("k")
    same = Window.partitionBy("k", "later", "words").orderBy("id", "th", "start")
    rows = rows.withColumn("first", F.rank().over(same) == 1)
    firsts = F.sum(F.col("first").cast("int")).over(Window.partitionBy("k", "later"))
    rows = rows.withColumn("firsts", firsts)
    rows = rows.select("id", "th", "start", "n", "k", (F.col("later") | ~F.col("first")).alias("repeat"), "firsts")
    rows = checkpointed(rows.where("repeat or firsts > 1"))  # the rest has no equal
    found = rows.where("repeat").select("id", "th", "start", "n")
    unsure = rows.where("not repeat").select("id", "th", "start", "n", "k", "firsts")
    counts = {r.heavy: r["count"] for r in unsure.groupBy((F.col("firsts") > heavy).alias("heavy")).count().collect()}
    if counts.get(True):
        ids = unsure.where(F.col("firsts") > heavy).select("id", "th").distinct()
        few = texts.join(F.broadcast(ids), ["id", "th"], "left_semi") if counts[True] <= MAX_BROADCAST else by_id
        windows = checkpointed(_with_words(few, unsure.where(F.col("firsts") > heavy).select("id", "th", "start", "n", "k"), window, kind, True))
        first = windows.groupBy("k", "words").agg(F.min(F.struct("id", "th", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
        again = windows.join(first, ["k", "words"]).where(F.struct("id", "th", "start") != F.col("first"))
        found = found.unionByName(again.select("id", "th", "start", "n"))
    if counts.get(False):
        dealt = _with_words(by_id, unsure.where(F.col("firsts") <= heavy).select("id", "th", "start", "n", "k"), window, kind, False)
        shards = max(1, math.ceil(counts[False] / shard))
        dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards))).select("shard", "id", "th", "start", "words")
        dealt = dealt.repartition("shard").sortWithinPartitions("shard", "id", "th", "start")
        found = found.unionByName(_streamed(dealt, window, kind))
    return found


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, heavy: int = HEAVY) -> DataFrame:
    """One row a text: ``n_words``, ``removed`` (maximal spans of removed words: start, end) and
    ``kept``, the other words joined by one space."""
    kind = df.schema[id_col].dataType.simpleString()
    every = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = every.where("id is not null").withColumn("th", F.pmod(F.xxhash64("text"), F.lit(1 << 32)))
    by_id = texts.repartition("id", "th")
    spans = _removed_windows(texts, by_id, window, shard, heavy, kind).groupBy("id", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = by_id.join(spans.hint("shuffle_hash"), ["id", "th"], "left").select("id", "text", "spans")
    nameless = every.where("id is null").select("id", "text", F.lit(None).cast("array<struct<start:bigint,n:int>>").alias("spans"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            n_words, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                n_words.append(len(words))
                merged: list[dict] = []
                for x in sorted(spans or (), key=lambda x: x["start"]):
                    start, end = x["start"], min(x["start"] + x["n"] + window - 1, len(words))
                    if merged and start <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], end)
                    elif start < end:
                        merged.append({"start": start, "end": end})
                removed.append(merged)
                for x in reversed(merged):
                    del words[x["start"] : x["end"]]
                kept.append(b" ".join(words).decode())
            return {"id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string())}

        return step

    out = map_slices(joined.unionByName(nameless), "text", make, f"id {kind}, n_words bigint, removed array<struct<start:bigint,end:bigint>>, kept string")
    return out.withColumnRenamed("id", id_col)


def dedup_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return dedup_substrings(df, id_col, text_col).select(id_col, "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
