"""Sources and sinks: delimited records, Parquet tables, result files, manifests, resumable stages."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.normalize import missing_tokens_to_null

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
CANDIDATE = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("candidate_entity_id", T.StringType()), T.StructField("block_name", T.StringType()), T.StructField("is_exact", T.IntegerType())])


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Tab-separated records, all strings, missing-value tokens to null."""
    return missing_tokens_to_null(spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(source1_entity_id, matched_entity_id, label) from comma lists."""
    raw = spark.read.schema("source1_entity_id string, matched_entity_ids string").option("sep", "\t").option("header", True).csv(path)
    return truth_pairs(raw)


def truth_pairs(raw: DataFrame) -> DataFrame:
    each = raw.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("m"))
    return each.select("source1_entity_id", F.trim("m").alias("matched_entity_id"), F.lit(1).alias("label")).where("matched_entity_id <> ''")


def read_tables(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files, folders or globs, named one by one so that no stale file is swept in."""
    return spark.read.parquet(*paths)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def candidate_tables(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` whose schema has both id columns."""
    return [p for p in paths if {"source1_entity_id", "candidate_entity_id"} <= set(spark.read.parquet(p).columns)]


def discover_candidates(spark: SparkSession, folder: str) -> list[str]:
    """All Parquet files under ``folder``, at any depth, whose schema has both id columns; any file
    system that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.endswith(".parquet"):
            found.append(path)
    return candidate_tables(spark, sorted(found))


def empty(spark: SparkSession, schema: T.StructType = CANDIDATE) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, compression: str = "zstd", partition_by: list[str] = ()) -> None:
    writer = df.write.mode("error").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_results(df: DataFrame, path: str, order: str = "source1_entity_id", sep: str = "\t", files: int | None = 1) -> None:
    """An ordered delimited file with a header; an empty list is an empty field without quotes.
    ``files`` None keeps the sorted ranges as several files, for results too large for one task."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if files is None else df.orderBy(order).coalesce(files)
    rows.write.mode("error").option("sep", sep).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_submissions(ranked: DataFrame, folder: str, rank: str, ks=(1, 5, 10, 20), columns: tuple[str, ...] = ("source1_entity_id", "candidate_entity_id"), files: int | None = 1) -> dict[int, str]:
    """For each k a comma-separated file of the pairs up to that rank, by record and rank; the paths
    by k."""
    paths = {k: f"{folder}/top_{k}" for k in ks}
    for k, path in paths.items():
        rows = ranked.where(F.col(rank) <= k).select(*columns, F.col(rank).alias("rank"))
        order = [columns[0], "rank"]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if files is None else rows.orderBy(*order).coalesce(files)
        rows.write.mode("error").option("header", True).option("emptyValue", "").csv(path)
    return paths


def read_results(spark: SparkSession, path: str, columns: tuple[str, str], sep: str = "\t") -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).option("sep", sep).option("header", True).csv(path)


def manifest(metrics: DataFrame, **more) -> str:
    """One metric row and further facts as JSON."""
    return json.dumps({**metrics.limit(1).collect()[0].asDict(recursive=True), **more}, sort_keys=True, default=str)


def written_once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, for tables that several
    parts of a plan read. The folder is ``spark.checkpoint.dir``; one of our own is set only where
    that is unset and all tasks run on this machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, folder: str, name: str, config: dict) -> DataFrame:
    """Write a stage's result once for each configuration and read it back: a later run with the
    same configuration resumes from it, another one writes its own."""
    spark = df.sparkSession
    key = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
