"""Folders that the driver and all executors see, plans cut through them, and rows dealt over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or given to setCheckpointDir. Without either, a master on this
    machine alone (tests) gets a temporary one; any other is refused, as a machine's own folder would lose rows."""
    context = spark.sparkContext
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/tidemill-{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """checkpoint() of what is made of rows dealt by columns that all its joins, groups and windows have among their keys: the rows
    stay where they are, here and for what reads the result. Adaptive plans forget how their rows are dealt, so this one is none."""
    conf, own = df.sparkSession.conf, {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: conf.get(k) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        return checkpoint(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def dealt(df: DataFrame, *by: str, rows: int = 5_000) -> DataFrame:
    """df dealt by a hash of columns over tasks of about `rows` rows each: a file of one row group is else read, and its rows worked on, by one task."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def spread(df: DataFrame, *by: str, rows: int = 5_000) -> DataFrame:
    """dealt(), but df as it is where no task has many more rows than that. What makes long rows of short ones deals those first:
    the task that reads a row group else makes, and holds while it deals them, all of its long rows."""
    of_tasks = df.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    return dealt(df, *by, rows=rows) if of_tasks.where(F.col("count") > rows * 3 // 2).take(1) else df


def unestimated(df: DataFrame) -> DataFrame:
    """df without an estimate of its size. Where tasks turn a row into many, the plan's estimate stays that of the rows read, and
    a join would send what it takes for small through the driver; without one, adaptive execution goes by the sizes it measures."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want
