"""Helpers that the training-data operators share: cutting lineage, shared folders and Arrow tasks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of an Arrow task holds at a time. Work inside a task is cut at whole
#: documents once this much text is gathered, so memory follows it and not the batch's row count.
CHUNK_BYTES = 2 << 20
#: Bytes of one Arrow batch between Spark and a Python worker, at most.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one named in spark.checkpoint.dir, or the one set
    by setCheckpointDir. Without either, a master on this machine alone (tests) gets a temporary folder; any other is refused."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tidemill-{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so that a lost executor costs one stage at most."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_tidemill_{want}"
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: with long texts, the bound by rows alone lets a batch take
    tens of MB, several times over, outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: a worker is used again by other tasks, and what its allocators
    keep would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes in `column` (a single longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
    release()


def text_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than it has rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another, and where each begins; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = text_offsets(column)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, column: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Apply f to slices of about `limit` bytes of `column`; f gives one batch back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, column, limit):
            yield f(part)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: White space that ends a word in the operators on word shingles; bytes.split() cuts at just these.
ASCII_SPACE = " \t\n\x0b\x0c\r"
