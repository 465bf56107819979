"""What the training-data operators share: bounded Arrow slices and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13.
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Text bytes that a Python worker turns into objects at once (a longer text goes alone).
SLICE_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small: bytes bound them, not only rows. Spark reads these
    settings when a plan runs, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def slices(batches: Iterator[pa.RecordBatch], by: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the string column ``by`` holds about ``most`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            total += int(n) + 16
            if total >= most:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def _trim() -> None:
    """Give freed memory back: workers are used again, and their stages' peaks would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def map_slices(df: DataFrame, by: str, make: Callable, schema, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over bounded slices. ``make()`` runs once a task and returns a function
    from a RecordBatch to a RecordBatch, a dict of columns or an iterator of either."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches, by, most):
            out = step(part)
            for x in [out] if isinstance(out, (dict, pa.RecordBatch)) else out:
                yield pa.RecordBatch.from_pydict(x) if isinstance(x, dict) else x
        _trim()

    return df.mapInArrow(run, schema)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 20)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]))
        return self.up[:n], self.down[:n]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that checkpoints have cut off: it does so when the
    driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    The folder is the cluster's ``spark.checkpoint.dir``; one of our own is set only where that is
    unset and all tasks run on this machine, as in local tests."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spindrift-"))
    return df.checkpoint(eager=True)
