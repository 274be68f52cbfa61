"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about so many bytes, so that work arrays stay small.
SLICE_BYTES = 1 << 17
#: Spark's limit to the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (single-machine tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read back: lineage ends there.

    An executor lost later costs a re-read, not the work above.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *named: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the named ones under reserved names, and a function that gives a result the old names and order.

    Whatever an operator adds or uses inside, columns that it doesn't know pass through as they are.
    """
    inside = [c if c in named else f"__column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inside), lambda out: out.select(*inside).toDF(*docs.columns)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; batches are cut to a bounded number of text bytes first."""
    return map_tasks(df, lambda: (fn, lambda: None), schema)


def map_tasks(df: DataFrame, make: Callable[[], tuple[Callable[[pa.RecordBatch], pa.RecordBatch | None], Callable[[], pa.RecordBatch | None]]], schema: str) -> DataFrame:
    """Like map_batches, with a pair of functions that `make` gives each task: one of a batch, and one for the task's end.

    Spark's own batches are bounded in bytes too, unless the session says otherwise: ten thousand long texts would be too much for one.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, "67108864b") == "67108864b":
        conf.set(BATCH_BYTES, str(2 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, last = make()
        try:
            for batch in batches:
                for part in bounded(batch):
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out
            out = last()
            if out is not None and out.num_rows:
                yield out
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives a worker's free memory back to the system: workers stay, idle, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded(batch: pa.RecordBatch, most: int = 8 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes, or one row if that is longer."""
    size = batch.nbytes
    if size <= most or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    width = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
            width += np.diff(offsets)
        else:
            width += 8
    ends = np.cumsum(width)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows as one uint8 array, and the rows' offsets into it; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes, or one row if that is longer."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def held_out(doc_id="doc_id"):
    """True for the rows that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
