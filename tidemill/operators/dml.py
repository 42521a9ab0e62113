"""INSERT, UPDATE, DELETE and history of versions as functions from tables to tables.

Parquet tables know no UPDATE or MERGE, so each change is a plan that gives the table's new rows; the
writers are in sources.tables. Nothing here depends on the time of the run: pass dates in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.folders import free_name

from .select import first_per_key


def insert_select(target: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT INTO target SELECT: by position, in the target's names and types; columns that rows lacks
    at the end are null."""
    if len(rows.columns) > len(target.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(target.columns)} columns")
    named = rows.toDF(*target.columns[: len(rows.columns)])
    fields = target.schema.fields
    return target.union(named.select(*[F.col(f.name).cast(f.dataType) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]))


def map_columns(rows: DataFrame, target: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Destination mapping, input column -> target column; target columns without one are null."""
    back = {t: s for s, t in mapping.items()}
    return rows.select(*[(F.col(back[f.name]) if f.name in back else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], set_: Mapping[str, str], order: Sequence[Column]) -> DataFrame:
    """UPDATE target SET t = source.s FROM source ON keys. Of several matching source rows the first by
    order counts; rows without a match stay as they are."""
    key, new = ({c: free_name(target, f"_{mark}_{c}") for c in names} for mark, names in (("k", keys), ("s", set(set_.values()))))
    hit = free_name(target, "_hit")
    best = first_per_key(source, list(keys), order).select(*[F.col(k).alias(n) for k, n in key.items()], *[F.col(s).alias(n) for s, n in new.items()], F.lit(True).alias(hit))
    both = target.join(best, [F.col(k) == F.col(n) for k, n in key.items()], "left")
    return both.select(*[F.when(F.col(hit), F.col(new[set_[c]]).cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in target.columns])


def replace_period(target: DataFrame, rows: DataFrame, period: str, periods: Sequence[object] | None = None) -> DataFrame:
    """Delete the periods and insert their new rows. periods: those given, else those that rows has."""
    if periods is not None:
        rows = rows.where(F.col(period).isin(*periods))
        stay = target.where(~F.col(period).isin(*periods) | F.col(period).isNull())
    else:
        stay = target.join(rows.select(period).distinct(), period, "left_anti").select(*target.columns)
    return stay.unionByName(rows.select(*target.columns))


def scd2(current: DataFrame, staged: DataFrame, keys: Sequence[str], tracked: Sequence[str], patched: Sequence[str] = (), flag: str = "is_current", ended: Mapping[str, Column] | None = None) -> DataFrame:
    """Type-2 history: rows whose key and tracked columns are all in staged (null equals blank) stay
    current and take staged's patched columns; other current rows expire; of staged keys without such a row one
    version is inserted as current. Ended rows get the columns in `ended`.

    Null and blank are equal in keys and tracked columns throughout: staged rows and current rows that are equal so are one
    version. Of such staged rows the one with the least columns (nulls first, in the table's order) counts; of such
    current rows the least stays current and the others expire. A key staged in several versions keeps the one that is current, if it
    is staged, else gets the least one; the others are not taken."""
    norm = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = lambda df: [F.col(c).asc_nulls_first() for c in df.columns]
    v, hit, turn, had = (free_name(current, free_name(staged, n)) for n in ("_version", "_hit", "_turn", "_had"))
    version = F.array(*[norm(c) for c in [*keys, *tracked]]).alias(v)
    live, past = current.where(F.col(flag) == 1), current.where(F.coalesce(F.col(flag), F.lit(0)) != 1)
    live = live.select("*", version, F.row_number().over(Window.partitionBy(version).orderBy(*order(current))).alias(turn))
    once = first_per_key(staged.select("*", version), [v], order(staged))
    tagged = once.join(live.select(F.col(v), F.lit(True).alias(had)).distinct(), v, "left")
    # the version that is current comes before others of its key
    chosen = first_per_key(tagged, [norm(c) for c in keys], [F.col(had).asc_nulls_last(), *order(staged)])
    both = live.join(chosen.select(v, *[F.col(c).alias(f"{hit}_{c}") for c in patched], F.lit(True).alias(hit)), v, "left")
    stays, ended = F.col(hit).isNotNull() & (F.col(turn) == 1), {flag: F.lit(0), **(ended or {})}

    def after(f: T.StructField) -> Column:
        kept = F.col(f"{hit}_{f.name}") if f.name in patched else F.col(f.name)
        return F.when(stays, kept.cast(f.dataType)).otherwise(ended.get(f.name, F.col(f.name)).cast(f.dataType)).alias(f.name)

    fields = current.schema.fields
    new = chosen.where(F.col(had).isNull()).withColumn(flag, F.lit(1))
    fill = [(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    return past.unionByName(both.select(*map(after, fields))).unionByName(new.select(*fill))


def run_log(job: str, rows: DataFrame, started: Column, ended: Column) -> DataFrame:
    """One row: job, status S, rows written, start and end."""
    return rows.agg(F.count("*").alias("row_count")).select(F.lit(job).alias("job"), F.lit("S").alias("status"), "row_count", started.alias("started"), ended.alias("ended"))


LOG = "job string, run string, status string, row_count long, started date, ended date"


def logged(job: str, run: str, rows: DataFrame, write: Callable[[DataFrame], object], log: str, started: Column, ended: Column) -> int:
    """Write rows and keep the log table at `log` (Parquet, see LOG): a row with status R before the write, and one with S and the
    number of rows, or F, after it. The rows are counted as they are written: the plan runs once. A failed write is logged and raised."""
    spark = rows.sparkSession

    def say(status: str, count: int | None, end: Column) -> None:
        one = spark.range(1).select(F.lit(job).alias("job"), F.lit(run).alias("run"), F.lit(status).alias("status"), F.lit(count).cast("long").alias("row_count"), started.cast("date").alias("started"), end.cast("date").alias("ended"))
        one.coalesce(1).write.mode("append").parquet(log)

    seen = Observation()
    say("R", None, F.lit(None))
    try:
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    except Exception:
        say("F", None, ended)
        raise
    count = int(seen.get["rows"])
    say("S", count, ended)
    return count


def job_status(log: DataFrame) -> DataFrame:
    """Of each job and run its last row: S or F where the run is over, else R."""
    over = F.when(F.col("status") == "R", 0).otherwise(1)
    return first_per_key(log, ["job", "run"], [over.desc(), F.asc("status")])
