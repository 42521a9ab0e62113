"""Incremental loads: new rows of a growing input, appended to a table partitioned by period."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.folders import fresh


def rolling_periods(as_of: date, back: int = 3) -> list[str]:
    """yyyyMM of the month of as_of and of `back` months before it, oldest first."""
    month = as_of.year * 12 + as_of.month - 1
    return [f"{m // 12}{m % 12 + 1:02d}" for m in range(month - back, month + 1)]


def stream_to_periods(spark: SparkSession, path: str, time: str, folder: str | None = None) -> DataFrame:
    """Read a Parquet file or folder as a stream and append it to a table partitioned by yyyyMM of `time`.

    The file sink's log and the checkpoint make each row arrive once, whatever executors are lost. Runs
    until all that is there now is read, and returns the table."""
    folder = folder or fresh(spark, "stream")
    schema = spark.read.parquet(path).schema
    dated = _source(spark, path, schema).withColumn("period", F.date_format(time, "yyyyMM"))
    writer = dated.writeStream.format("parquet").partitionBy("period").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(dated.schema).parquet(f"{folder}/table")


def reload_stream(spark: SparkSession, path: str, time: str, folder: str | None = None, late: str = "add", files: int | None = None, after: Callable[[int], None] | None = None) -> DataFrame:
    """The period load as a stream: each batch rewrites the periods (yyyyMM of `time`) that its rows are of, and no others.

    late: "add" keeps a period's earlier rows beside the batch's; "replace" deletes them, as a reload of whole extracts does.
    Rows carry the number of their batch (`_batch`), and a batch that comes again after a failure takes the place of its own
    rows, so each row is there once whenever the stream is killed and started again on the same `folder`. A period is put together in the shared
    folder first and then overwritten in one commit. files: input files of a batch at most; after: called with a batch's number once
    it is written. Runs until all that is there now is read, and returns the table."""
    if late not in ("add", "replace"):
        raise ValueError(f"late {late!r}: add or replace")
    folder = folder or fresh(spark, "stream")
    table, schema = f"{folder}/table", spark.read.parquet(path).schema
    source = _source(spark, path, schema, files).withColumn("period", F.date_format(time, "yyyyMM"))
    full = T.StructType([*source.schema.fields[:-1], T.StructField("_batch", T.LongType()), source.schema.fields[-1]])

    def load(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = batch.select("*", F.lit(number).cast("long").alias("_batch")).select(*[f.name for f in full])
        if late == "add" and _exists(own, table):
            old = own.read.schema(full).parquet(table).where(F.col("_batch") != number)
            rows = rows.unionByName(old.join(batch.select("period").distinct(), "period", "left_semi").select(*rows.columns))
        at = fresh(own, "batch")
        rows.write.parquet(at)
        own.read.schema(full).parquet(at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(table)
        if after:
            after(number)

    source.writeStream.foreachBatch(load).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(full).parquet(table)


def _source(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    parent, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", name).parquet(parent)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
