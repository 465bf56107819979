"""Incremental matching: a stream of new source-1 records against a table of targets.

Each micro-batch runs the same blocking and scoring plan as a batch job. The sink writes one folder
a batch id, so a batch that is retried replaces its own output and nothing is matched twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.functions.normalize import derived_fields, normalized_records
from spindrift.operators import blocking, evidence, scoring


def match_stream(records: DataFrame, targets: DataFrame, specs, out: str, checkpoint: str, threshold: float = 0.0, available_now: bool = True) -> StreamingQuery:
    """``records``: a streaming frame of raw records; ``targets``: normalised with derived fields."""

    def match(batch: DataFrame, number: int) -> None:
        left = derived_fields(normalized_records(batch))
        pairs = evidence.aggregated(blocking.block_pairs(left, targets, specs))
        best = scoring.scored(pairs, left, targets).where((F.col("base_rank") == 1) & (F.col("base_score") >= threshold))
        best.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = records.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts of an event stream with a watermark, as a monitor of input rates."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
