"""Operators on the rows of one input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.folders import free_name, fresh


def derive(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Derived columns: all are computed from the input, none from one another."""
    return df.withColumns(dict(columns))


def derive_in_stages(df: DataFrame, *stages: Mapping[str, Column]) -> DataFrame:
    """Each stage may use the columns of those before; the optimizer collapses them into one projection."""
    for stage in stages:
        df = df.withColumns(dict(stage))
    return df


def convert(df: DataFrame, types: Mapping[str, tuple[str, str]], on_error: str = "fail") -> DataFrame:
    """Data conversion: new column -> (source column, type). on_error: fail, or ignore (null)."""
    if on_error not in ("fail", "ignore"):
        raise ValueError(f"on_error {on_error!r}: fail or ignore")
    return df.withColumns({n: F.col(c).cast(t) if on_error == "fail" else F.col(c).try_cast(t) for n, (c, t) in types.items()})


def redirect_errors(df: DataFrame, column: str, type_: str, output: str) -> tuple[DataFrame, DataFrame]:
    """Rows that convert, with `output`, and those that do not, with error_column. The input is read once: rows are
    tagged and written to the shared folder by tag, and each result reads its part."""
    bad = free_name(df, "_bad")
    value = F.col(column).try_cast(type_)
    tried = df.withColumns({output: value, bad: value.isNull() & F.col(column).isNotNull()})
    at = fresh(df.sparkSession, "rows")
    tried.write.partitionBy(bad).parquet(at)
    done = df.sparkSession.read.schema(tried.schema).parquet(at)
    return done.where(~F.col(bad)).drop(bad), done.where(bad).drop(bad, output).withColumn("error_column", F.lit(column))


def split(df: DataFrame, cases: Sequence[tuple[str, Column]], default: str = "default", column: str = "_output") -> DataFrame:
    """Conditional split: names the first case whose condition holds. Filter on the column for one output."""
    out = None
    for name, condition in cases:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return df.withColumn(column, F.lit(default) if out is None else out.otherwise(default))


def ordered(keys: Mapping[str, int]) -> list[Column]:
    """Sort keys by position: the number's size is the key's place, its sign the direction; 0 is no key."""
    chosen = sorted((abs(p), c, p) for c, p in keys.items() if p)
    return [F.col(c).asc_nulls_first() if p > 0 else F.col(c).desc_nulls_last() for _, c, p in chosen]


def sort(df: DataFrame, keys: Mapping[str, int], drop_duplicates: bool = False, tie_break: Sequence[str] = ()) -> DataFrame:
    """Sort; with drop_duplicates one row of each key stays, the first by tie_break."""
    order = ordered(keys)
    if drop_duplicates:
        df = first_per_key(df, [c for c, p in keys.items() if p], [F.col(c).asc_nulls_first() for c in tie_break])
    return df.orderBy(*order)


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """row_number() <= n over (partition by keys order by order): planned with a group limit before the
    shuffle, so a hot key sends n rows of each task and not all of them. order should end in a unique column."""
    window, place = Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)])), free_name(df, "_rn")
    return df.withColumn(place, F.row_number().over(window)).where(F.col(place) <= n).drop(place)


#: Operations of the aggregate transformation.
AGGREGATES = {"count": F.count, "count distinct": F.count_distinct, "sum": F.sum, "average": F.avg, "minimum": F.min, "maximum": F.max}


def aggregate(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Aggregate transformation: new column -> (operation, source column; "*" counts rows). Null keys are one group."""
    return df.groupBy(*keys).agg(*[(F.count(F.lit(1)) if (op, c) == ("count", "*") else AGGREGATES[op](F.col(c))).alias(n) for n, (op, c) in measures.items()])


def union_by_position(first: DataFrame, *others: DataFrame, distinct: bool = False) -> DataFrame:
    """Union All matches columns by ordinal and takes the first input's names."""
    for other in others:
        first = first.union(other.toDF(*first.columns))
    return first.distinct() if distinct else first
