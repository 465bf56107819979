"""Language ID by Bayesian evidence fusion.

The posterior of a language multiplies four kinds of evidence:

* the text: hashed byte trigrams of the whole lower-cased text under one smoothed model a language;
  their log-likelihood is tempered to count as ``worth`` trigrams at most, since neighbours are not
  independent. A hypothesis ``und`` (no known language) spreads evenly over all trigrams;
* the declared markup language: it is right with probability 1 - ``declared_noise``;
* the address suffix: if it names a language's country, right with 1 - ``suffix_noise``;
* the host's prior: languages that the texts of the same host speak for, counted by a grouped
  aggregation over all rows and smoothed towards the host's suffix and that towards all rows.

A declaration counts by its primary subtag in lower case (``de-DE`` is ``de``) if that has two or
three letters; others are no evidence. The trigram models are fitted on a bounded sample of labelled
rows: for each declared language the ``per_language`` rows with the smallest hash of their id; a
language needs ``least`` rows to be one. Everything else covers all rows. A row is accepted if its best hypothesis is a
language with a posterior of ``accept`` or more.

Defined cases: a null or empty text is no evidence and is rejected as ``und``; a text of one or two
bytes has no trigram and is decided by the other evidence; a null declaration,
suffix or host is no evidence (its prior is that of all rows); a text of any length is read whole,
alone in its slice; of equal posteriors the first language in alphabetical order wins, ``und`` last;
repeated rows give repeated results; an empty table, or one without any declaration, gives only
``und``. Only named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_slices

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Shares (of 8 bytes, one a host and language) that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_SHARES = 2_000_000
# Address suffixes of countries with one main language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv"}


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts, one after the other, and each text's count."""
    raw = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8).astype(np.uint32)
    bucket = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761) >> np.uint32(17)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(sizes - 2, 0)
    inside = np.ones(int(sizes.sum()), bool)
    ends = np.cumsum(sizes)
    for back in (1, 2):  # a trigram may not run over the end of its text
        last = ends - back
        inside[last[sizes >= back]] = False
    return bucket[: len(inside)][inside].astype(np.int64), counts


def _lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode() for t in column.to_pylist()]


def primary_subtag(tag: Column) -> Column:
    """Two or three letters in lower case, or null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def labelled_sample(df: DataFrame, id_col: str, declared_col: str, per_language: int, least: int) -> DataFrame:
    """Ids and languages of the bounded sample (see above)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(declared_col).alias("language")).where("language is not null and id is not null")
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("id"), "id"))
    few = rows.withColumn("n", rank).where(F.col("n") <= max(per_language, least))
    known = few.where(F.col("n") == least).select("language")
    return few.where(F.col("n") <= per_language).join(known, "language", "left_semi").select("id", "language")


def fit(df: DataFrame, id_col: str, text_col: str, declared_col: str, per_language: int = 300, least: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probabilities of their trigram buckets; only counts are collected."""
    sample = checkpointed(labelled_sample(df, id_col, declared_col, per_language, least).distinct())
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").select("language", "text")

    def make():
        def step(batch: pa.RecordBatch):
            names, lowered = batch.column(0).to_pylist(), _lowered(batch.column(1))
            for name in dict.fromkeys(names):
                bucket, _ = trigrams([t for t, n in zip(lowered, names, strict=True) if n == name])
                counts = np.bincount(bucket, minlength=BUCKETS)
                seen = np.flatnonzero(counts)
                yield {"language": pa.array([name] * len(seen), pa.string()), "bucket": pa.array(seen, pa.int64()), "n": pa.array(counts[seen], pa.int64())}

        return step

    rows = map_slices(texts, "text", make, "language string, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["language"].unique())
    counts = np.full((len(languages) + 1, BUCKETS), 0.5)
    counts[-1] = 1.0  # und
    counts[np.searchsorted(languages, rows["language"].to_numpy().astype(str)) if len(rows) else [], rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy(np.float64)
    return [*languages, UNKNOWN], np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def text_evidence(df: DataFrame, id_col: str, text_col: str, others: list[str], table: np.ndarray, worth: int) -> DataFrame:
    """Tempered log-likelihoods by hypothesis, and the text's own best hypothesis."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def make():
        models = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            bucket, counts = trigrams(_lowered(batch.column("text")))
            some = np.flatnonzero(counts)
            out = np.zeros((batch.num_rows, len(models)))
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                for k, model in enumerate(models):
                    out[some, k] = np.add.reduceat(model[bucket], starts, dtype=np.float64)
            out *= np.minimum(1, worth / np.maximum(counts, 1))[:, None]
            columns = {c: batch.column(c) for c in ("id", *others)}
            best = np.where(counts > 0, out.argmax(1), len(models) - 1)
            return {**columns, "evidence": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(models)).cast(pa.list_(pa.float64())), "n": pa.array(counts), "heard": pa.array(best, pa.int32())}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), *others, F.col(text_col).cast("string").alias("text"))
    return map_slices(picked, "text", make, f"id {kind}, {', '.join(f'{c} string' for c in others)}, evidence array<double>, n bigint, heard int")


def _smoothed(counts: Column, total: Column, parent: Column, strength: float) -> Column:
    return F.zip_with(counts, parent, lambda n, p: (n + strength * p) / (total + strength))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | str | None = "lang", host: Column | str | None = "source", suffix: Column | None = None, *, worth: int = 60, declared_noise: float = 0.1, suffix_noise: float = 0.3, strength: float = 20.0, accept: float = 0.5, per_language: int = 300, least: int = 1) -> DataFrame:
    """One row an input row: ``language``, ``posterior`` and ``accepted``."""

    def given(x):
        return F.lit(None).cast("string") if x is None else (F.col(x) if isinstance(x, str) else x).cast("string")

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), primary_subtag(given(declared)).alias("declared"), given(host).alias("host"), given(suffix).alias("suffix")).withColumn("some", F.when(F.length("text") > 0, "some"))
    names, table = fit(rows, "id", "text", "declared", per_language, least)
    size = len(names)
    # written once: the text is read once, and the priors and the result read this small table
    heard = checkpointed(text_evidence(rows, "id", "text", ["declared", "host", "suffix", "some"], table, worth))

    counted = heard.where("n > 0").groupBy("host", "suffix", "heard").agg(F.count("*").alias("rows"))
    overall = {r.heard: r.rows for r in counted.groupBy("heard").agg(F.sum("rows").alias("rows")).collect()}
    total = sum(overall.values())
    root = F.array(*(F.lit((overall.get(k, 0) + 1 / size) / (total + 1)) for k in range(size)))

    def shares(*by: str) -> DataFrame:
        """Rows by language, in the order of the languages, and their sum."""
        said = counted.groupBy(*by, "heard").agg(F.sum("rows").alias("rows")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("heard", "rows"))).alias("by_language"), F.sum("rows").alias("total"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("by_language", k), F.lit(0)).cast("double"))
        return said.select(*by, counts.alias("counts"), "total")

    by_suffix = shares("suffix").where("suffix is not null").select("suffix", _smoothed(F.col("counts"), F.col("total"), root, strength).alias("parent"))
    by_host = shares("host", "suffix").where("host is not null").join(by_suffix, "suffix", "left")
    by_host = by_host.select("host", F.col("suffix").alias("host_suffix"), _smoothed(F.col("counts"), F.col("total"), F.coalesce("parent", root), strength).alias("prior"))
    by_host = checkpointed(by_host)
    if by_host.count() * size <= MAX_BROADCAST_SHARES:
        by_host = F.broadcast(by_host)
    joined = heard.join(by_host, (heard["host"] == by_host["host"]) & heard["suffix"].eqNullSafe(by_host["host_suffix"]), "left").drop(by_host["host"])

    languages = F.array(*map(F.lit, names))

    def channel(said: Column, noise: float):
        known = F.coalesce(F.array_position(languages, said), F.lit(0)).between(1, size - 1)
        return lambda name: F.when(~known, F.lit(0.0)).when(said == name, F.lit(float(np.log(1 - noise)))).otherwise(F.lit(float(np.log(noise / max(1, size - 1)))))

    tld = F.try_element_at(F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair)), F.coalesce("suffix", F.lit("")))
    declaration, address = channel(F.col("declared"), declared_noise), channel(tld, suffix_noise)
    # a declaration as such only speaks between languages: it neither helps nor harms "und"
    spoken = F.transform(languages, lambda name: F.when(name == UNKNOWN, F.lit(0.0)).otherwise(declaration(name) + address(name)))
    likely = F.zip_with("evidence", F.coalesce("prior", root), lambda e, p: e + F.log(p))
    top = F.array_max("logs")
    out = joined.select("id", "some", F.zip_with(likely, spoken, lambda a, b: a + b).alias("logs"))
    best = F.array_position("logs", top) - 1
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = out.select("id", F.when(F.col("some").isNotNull(), F.element_at(languages, (best + 1).cast("int"))).otherwise(UNKNOWN).alias("language"), F.when(F.col("some").isNotNull(), posterior).otherwise(0.0).alias("posterior"))
    return out.select(F.col("id").alias(id_col), "language", F.round("posterior", 6).alias("posterior"), ((F.col("language") != UNKNOWN) & (F.col("posterior") >= accept)).alias("accepted"))


def declared_in(html: Column) -> Column:
    """The language that a page's html tag declares, or null."""
    said = F.regexp_extract(html, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.lower(F.nullif(said, F.lit("")))


def suffix_in(url: Column) -> Column:
    """The last label of the url's host, or null."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1))
    return F.nullif(F.substring_index(host, ".", -1), F.lit(""))


def host_in(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1)), F.lit(""))
