"""Operators on two inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.folders import free_name

from .select import first_per_key

#: A side is broadcast on request only if the optimizer's estimate of it is at most this.
BROADCAST_BYTES = 64 << 20
#: Join types of the merge join by their number in package files.
MERGE_TYPES = {0: "full", 1: "left", 2: "inner"}


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is within the limit, else df as it is (then the join
    is a shuffled one, which adaptive execution splits where a key is hot)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def _on(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], null_equal: bool) -> Column:
    pairs = [left[a].eqNullSafe(right[b]) if null_equal else left[a] == right[b] for a, b in keys]
    out = pairs[0]
    for p in pairs[1:]:
        out = out & p
    return out


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str | int = "inner", nulls_equal: bool = True) -> DataFrame:
    """Merge join. Inputs need no sort before: the plan sorts both by the join keys itself."""
    return left.hint("merge").join(right, _on(left, right, keys, nulls_equal), MERGE_TYPES.get(how, how))


def lookup(df: DataFrame, reference: DataFrame, keys: Sequence[tuple[str, str]], columns: Sequence[str], order: Sequence[Column], no_match: str = "null") -> DataFrame:
    """Reference columns of the first match of each row. no_match: null, drop, or fail. A reference column that is named like
    one of df is refused: rename it first."""
    clash = {c.lower() for c in columns} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input has columns named {', '.join(sorted(clash))} already")
    taken = df.select("*", *[F.lit(None).alias(c) for c in columns])
    key = {b: free_name(taken, f"_key_{b}") for _, b in keys}
    found = free_name(taken, "_found")
    own = first_per_key(reference, [b for _, b in keys], order).select(*[F.col(b).alias(k) for b, k in key.items()], *columns, F.lit(True).alias(found))
    on = [F.col(a) == F.col(key[b]) for a, b in keys]
    out = df.join(small(own), on, "inner" if no_match == "drop" else "left").drop(*key.values())
    if no_match == "fail":
        out = out.withColumn(found, F.when(F.col(found).isNull(), F.raise_error(F.lit("lookup: a row has no match")).cast("boolean")).otherwise(True)).where(F.col(found))
    return out.drop(found)


def blank_equal(pairs: Sequence[tuple[Column, Column]], blank: str = "") -> Column:
    """ISNULL(a, '') = ISNULL(b, '') for all pairs: null and blank are equal (so this is not <=>)."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & (F.coalesce(a, F.lit(blank)) == F.coalesce(b, F.lit(blank)))
    return out


def latest_of(df: DataFrame, other: DataFrame, keys: Sequence[tuple[str, str]], order: Sequence[Column], how: str = "left") -> DataFrame:
    """Join to the first row of each key of other by order."""
    best = first_per_key(other, [b for _, b in keys], order)
    return df.join(best, _on(df, best, keys, False), how)


#: Join types that a salted join can do; of the others, an unmatched right row would come out once for each salt.
SALTED = ("inner", "left", "leftouter", "left_outer", "semi", "leftsemi", "left_semi", "anti", "leftanti", "left_anti")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join with equal key names where a few keys of left are hot and adaptive execution cannot split them:
    left rows are dealt over `salts` sub-keys by a hash of their columns, right rows repeated for each. how: inner, left,
    semi, anti; others are refused. Rows that only differ in maps get one sub-key. The repeated rows are never broadcast: the
    optimizer takes them for as few as there were before."""
    if how.lower() not in SALTED:
        raise ValueError(f"a salted join cannot be {how!r}: inner, left, semi or anti")
    salt = free_name(left, "_salt")
    while free_name(right, salt) != salt:
        salt = free_name(left, free_name(right, salt))
    hashed = [F.col(f"`{f.name}`") for f in left.schema if _hashable(f.dataType)] or [F.lit(0)]
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    spread = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread.hint("merge"), [*keys, salt], how).drop(salt)
