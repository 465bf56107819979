"""URL filters: allow and block rules by host and path, then a character language-model ratio.

A rule decides a url that it fits; the longest rule wins. Other urls are judged by two smoothed
variable-order Markov models of characters, one of accepted and one of rejected urls: the
log-likelihood difference, divided by the length, is compared with a threshold that is calibrated
on held-out labelled urls.

The models count all distinct urls that the rules label, whatever their number and length, but every
fifth of a class in the order of their hashes; all of those calibrate the threshold. Counts of
characters in their longest contexts are added up by Spark, shorter contexts follow from them. The
driver and the executors hold one number a distinct character and context, so the models grow with the
variety of the urls, not with their number.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the
verdict of ``default``; so has any url if a class has no labelled url. A url of any length is read
whole; a score equal to the threshold allows; two rules never fit with the same length. Repeated
rows give repeated results, an empty table gives an empty result. Output columns replace same-named input columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_slices

ORDER = 4
#: Byte symbols, the start of a url and its end, as digits of a gram; characters judged at once.
START, END, BASE = 256, 257, 258
PIECE = 1 << 17
#: Distinct scores of held-out urls that one task adds up, about.
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule's pattern, or null. The rules are a parameter of the plan."""
    chosen = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.lit(r.pattern)).otherwise(chosen)
    return chosen


def grams(urls: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(url's place, gram) of all characters and ends, in order and in pieces: a character with the
    ``order`` before it, as digits of one number."""
    texts = [u.encode() for u in urls]
    last = np.cumsum([len(t) + 1 for t in texts])
    s = np.full(last[-1] + order * len(texts) if texts else 0, START, np.uint16)
    at = 0
    for t in texts:
        s[at + order : at + order + len(t)] = np.frombuffer(t, np.uint8)
        s[at + order + len(t)] = END
        at += order + len(t) + 1
    for a in range(0, last[-1] if texts else 0, PIECE):
        place = np.arange(a, min(a + PIECE, last[-1]))
        url = np.searchsorted(last, place, "right")
        ends, gram = place + (url + 1) * order, np.zeros(len(place), np.int64)
        for back in range(order, -1, -1):
            gram = gram * BASE + s[ends - back]
        yield url, gram


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Markov:
    """Character model with Witten-Bell interpolation of all orders up to ``order`` (6 at most).

    In a context seen n times with t distinct successors, a successor seen c times gets
    (c + t * p) / (n + t), where p comes from the context one character shorter, and at the end
    from an even spread over 257 byte symbols."""

    def __init__(self, urls, order: int = ORDER):
        found = [g for _, g in grams(list(urls), order)]
        keys = np.concatenate(found) if found else np.zeros(0, np.int64)
        self._count(keys, np.ones(len(keys), np.int64), order)

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, order: int) -> Markov:
        """From grams of the longest context and their counts."""
        model = cls.__new__(cls)
        model._count(keys, n, order)
        return model

    def _count(self, keys, n, order):
        self.order, self.levels = order, []
        for back in range(order, -1, -1):
            keys, n = summed(keys % BASE ** (back + 1), n)
            contexts, first, kinds = np.unique(keys // BASE, return_index=True, return_counts=True)
            self.levels.append((keys, n, contexts, np.add.reduceat(n, first) if len(first) else n, kinds))
        self.levels.reverse()

    def log_likelihoods(self, urls: list[str]) -> np.ndarray:
        out = np.zeros(len(urls))
        for url, gram in grams(urls, self.order):
            p = np.full(len(gram), 1 / 257)
            for back, (keys, seen, contexts, total, kinds) in enumerate(self.levels):
                if not len(keys):
                    break
                key = gram % BASE ** (back + 1)
                i = np.minimum(np.searchsorted(contexts, key // BASE), len(contexts) - 1)
                j = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                p = np.where(contexts[i] == key // BASE, (np.where(keys[j] == key, seen[j], 0) + kinds[i] * p) / (total[i] + kinds[i]), p)
            np.add.at(out, url, np.log(p))
        return out

    def log_likelihood(self, url: str) -> float:
        return float(self.log_likelihoods([url])[0])


@dataclass
class Ratio:
    """``score``: the length-normalised log-likelihood difference; at least ``threshold`` allows."""

    accepted: Markov
    rejected: Markov
    threshold: float

    def scores(self, urls: list[str]) -> np.ndarray:
        return (self.accepted.log_likelihoods(urls) - self.rejected.log_likelihoods(urls)) / np.array([len(u.encode()) + 1 for u in urls], float)

    def score(self, url: str) -> float:
        return float(self.scores([url])[0])


def fit_ratio(accepted: list[str], rejected: list[str], order: int = ORDER) -> Ratio | None:
    """Fit on four fifths; the threshold has the best balanced accuracy on the rest, nearest 0."""
    if not accepted or not rejected:
        return None
    split = lambda urls: ([u for i, u in enumerate(urls) if i % 5 or len(urls) < 10], urls[::5])
    (fit_a, held_a), (fit_r, held_r) = split(accepted), split(rejected)
    ratio = Ratio(Markov(fit_a, order), Markov(fit_r, order), 0.0)
    marks = sorted([(ratio.score(u), 1) for u in held_a] + [(ratio.score(u), 0) for u in held_r])
    good, bad = len(held_a), 0  # allowed accepted ones, blocked rejected ones, at threshold -inf
    options = []
    for i, (s, kind) in enumerate(marks):
        if i == 0 or s > marks[i - 1][0]:
            middle = s - 1 if i == 0 else (s + marks[i - 1][0]) / 2
            options.append((-(good / len(held_a) + bad / len(held_r)), abs(middle), middle))
        good, bad = good - kind, bad + (1 - kind)
    options.append((-(good / len(held_a) + bad / len(held_r)), abs(marks[-1][0] + 1), marks[-1][0] + 1))
    ratio.threshold = min(options)[2]
    return ratio


def labelled_urls(df: DataFrame, url_col: str, label: Column) -> DataFrame:
    """(u, accepted, held, fit) of all distinct labelled urls: every fifth of a class by its hash is
    held out, and fitted too in a class of fewer than ten; the same ones however the table is
    partitioned."""
    h = F.xxhash64("u")
    rows = df.select(F.col(url_col).alias("u"), (label == "allow").alias("accepted")).where("accepted is not null").distinct()
    rows = checkpointed(rows.select("u", "accepted", h.alias("h"), F.shiftright(h, 48).alias("range")))
    counts = rows.groupBy("accepted", "range").agg(F.count("*").alias("n"))  # 65,536 ranges at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("accepted").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("accepted", "range", before.alias("before"), F.sum("n").over(Window.partitionBy("accepted")).alias("all"))
    place = F.row_number().over(Window.partitionBy("accepted", "range").orderBy("h", "u")) - 1 + F.col("before")
    rows = rows.join(F.broadcast(counts), ["accepted", "range"])
    return checkpointed(rows.select("u", "accepted", "all", (place % 5 == 0).alias("held")).select("u", "accepted", "held", (~F.col("held") | (F.col("all") < 10)).alias("fit")))


def fit_on(labelled: DataFrame, order: int) -> Ratio | None:
    """``fit_ratio`` of ``labelled_urls``: counted, scored and calibrated by Spark."""

    def count(batch: pa.RecordBatch) -> dict:
        found = [summed(g, np.ones(len(g), np.int64)) for _, g in grams(batch.column("u").to_pylist(), order)]
        keys, n = summed(*map(np.concatenate, zip(*found, strict=True)))
        return {"gram": pa.array(keys), "n": pa.array(n)}

    models = []
    for which in ("accepted", "not accepted"):
        counted = map_slices(labelled.where("fit").where(which).select("u"), "u", lambda: count, "gram bigint, n bigint")
        counted = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        if not counted.num_rows:
            return None
        models.append(Markov.of(counted["gram"].to_numpy(), counted["n"].to_numpy(), order))
    ratio = Ratio(*models, 0.0)
    shared = labelled.sparkSession.sparkContext.broadcast(ratio)

    def score(batch: pa.RecordBatch) -> dict:
        return {"s": pa.array(shared.value.scores(batch.column("u").to_pylist())), "accepted": batch.column("accepted")}

    held = map_slices(labelled.where("held").select("u", "accepted"), "u", lambda: score, "s double, accepted boolean")
    ratio.threshold = best_threshold(held)
    return ratio


def best_threshold(held: DataFrame) -> float:
    """The threshold with the best balanced accuracy on (s, accepted), the one nearest 0 of equal ones,
    halfway between scores. Ranges of scores are added up apart and then offset."""
    marks = checkpointed(held.groupBy("s").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")))
    n, goods, bads, highest = marks.agg(F.count("*"), F.sum("good"), F.sum("bad"), F.max("s")).first()
    ranges = 1 + n // RANGE_ROWS
    cuts = sorted(set(marks.approxQuantile("s", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    spread = marks.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x <= F.col("s"))))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within, over = Window.partitionBy("range").orderBy("s"), Window.orderBy("range")  # the latter has one row a range
    ends = spread.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("s").alias("end"))
    ends = ends.select("range", F.coalesce(F.sum("g").over(so_far(over)), F.lit(0)).alias("g0"), F.coalesce(F.sum("b").over(so_far(over)), F.lit(0)).alias("b0"), F.lag("end").over(over).alias("end"))
    local = spread.select("s", "range", F.coalesce(F.sum("good").over(so_far(within)), F.lit(0)).alias("g"), F.coalesce(F.sum("bad").over(so_far(within)), F.lit(0)).alias("b"), F.lag("s").over(within).alias("last"))
    rows = local.join(F.broadcast(ends), "range").select("s", (F.lit(goods) - F.col("g") - F.col("g0")).alias("allowed"), (F.col("b") + F.col("b0")).alias("blocked"), F.coalesce("last", "end").alias("last"))
    middle = F.coalesce((F.col("s") + F.col("last")) / 2, F.col("s") - 1)
    options = rows.select((-(F.col("allowed") / goods + F.col("blocked") / bads)).alias("cost"), middle.alias("middle"))
    best = options.orderBy("cost", F.abs("middle"), "middle").limit(1).first()
    return min((best.cost, abs(best.middle), best.middle), (-1.0, abs(highest + 1), highest + 1))[2]


def url_verdicts(df: DataFrame, url_col: str = "url", rules=RULES, default: str = "allow", order: int = ORDER) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``score`` (null where a rule decides) and
    ``verdict``."""
    added = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in df.columns if c not in added]
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rule = rule_of(host, path, rules)
    label = F.lit(None).cast("string")
    for r in rules:
        label = F.when(rule == r.pattern, F.lit(r.verdict)).otherwise(label)
    urls = df.select(url.alias(url_col))
    ratio = fit_on(labelled_urls(urls, url_col, label), order)
    ruled = df.select(*kept, host.alias("host"), path.alias("path"), rule.alias("rule"), label.alias("verdict"))
    if ratio is None:
        return ruled.select(*kept, "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
    shared = df.sparkSession.sparkContext.broadcast(ratio)
    names = ruled.columns

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            columns = dict(zip(names, batch.columns, strict=True))
            urls, verdicts = columns[url_col].to_pylist(), columns["verdict"].to_pylist()
            judged = [i for i, (u, v) in enumerate(zip(urls, verdicts, strict=True)) if v is None and u is not None and "://" in u]
            scores = [None] * len(urls)
            for i, x in zip(judged, model.scores([urls[i] for i in judged]).tolist(), strict=True):
                scores[i], verdicts[i] = x, "allow" if x >= model.threshold else "block"
            verdicts = [v or default for v in verdicts]
            return {**{k: columns[k] for k in (*kept, "host", "path", "rule")}, "score": pa.array(scores, pa.float64()), "verdict": pa.array(verdicts, pa.string())}

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ruled.drop("verdict").schema)
    return map_slices(ruled, url_col, make, f"{fields}, score double, verdict string")
