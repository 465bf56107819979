"""A corpus pipeline of five training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the
columns of ``documents`` (the last one: samples of token ids). Rows are followed by the MD5 of id and
text, 128 bits, so null and repeated ids don't mix rows up.

Defined cases: null and empty texts go in the first stage; a text of any length is read whole; of
equal rows, and of near copies with equal ids, one stays; other ties go to the smaller id, then the
smaller key; a null id is an id of its own; an empty table gives an empty result; other columns pass
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, language_id, near_copies, sampling, secrets, unigram
from spindrift.llm.common import checkpointed, read

#: Rows of 16-byte keys that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


def _key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row key under a name that clashes with no column."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    parts = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))
    return docs.withColumn(name, F.unhex(F.md5(parts.cast("binary")))), name


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    gone = checkpointed(gone.select(key).distinct())
    return keyed.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone, key, "left_anti").drop(key)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, or in none with a posterior of a half, go."""
    keyed, key = _key(docs)
    return _without(keyed, key, language_id.identify(keyed, key).where("not accepted"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with
    the smallest id stays, once."""
    keyed, key = _key(docs)
    copies = checkpointed(near_copies.near_copies(keyed, key))
    named = keyed.select("doc_id", key).distinct().join(copies.distinct(), key)
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", key)).alias("least")).select("root", F.col(f"least.{key}").alias("least"))
    groups = checkpointed(copies.join(least, "root").select(key, (F.col(key) == F.col("least")).alias("stays")))
    repeated = groups.where("stays").groupBy(key).count().where(F.col("count") > 1)
    if repeated.limit(1).count():  # equal rows, id included
        keyed = keyed.dropDuplicates([key])
    return _without(keyed, key, groups.where("not stays"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    keyed, key = _key(docs)
    return _without(keyed, key, decontaminate.contaminated(keyed, read(spark, sf_dir, "benchmark"), key))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return secrets.redact_column(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations a document, as token ids."""
    return sampling.encode_samples(docs, model=unigram.model_path(spark))


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, sampled segmentations and language models have no SQL form.
ORACLE_SQL = None
