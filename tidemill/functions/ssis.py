"""Constructs of the package expression language as Column builders, and its variables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_VARIABLE = re.compile(r"@\[\s*(?:([\w ]+)::)?([\w ]+)\s*\]")

# Cast operators of the language and the Spark types that they stand for.
CASTS = {"DT_I2": "smallint", "DT_I4": "int", "DT_I8": "bigint", "DT_R8": "double", "DT_CY": "decimal(19,4)", "DT_BOOL": "boolean", "DT_DATE": "date", "DT_DBDATE": "date", "DT_DBTIMESTAMP": "timestamp_ntz"}


def ternary(condition: Column, a: Column, b: Column) -> Column:
    """condition ? a : b."""
    return F.when(condition, a).otherwise(b)


def text(x: Column, size: int) -> Column:
    """(DT_STR, size, ...) and (DT_WSTR, size): fails where the text is longer, as FailComponent does."""
    s = x.cast("string")
    return F.when(F.length(s) <= size, s).when(s.isNotNull(), F.raise_error(F.concat(F.lit(f"text is longer than {size}: "), s)).cast("string"))


def cast(x: Column, kind: str) -> Column:
    return x.cast(CASTS[kind])


def null(kind: str) -> Column:
    """NULL(kind): a typed null."""
    return F.lit(None).cast(CASTS[kind])


def datepart(part: str, d: Column) -> Column:
    return {"yyyy": F.year, "mm": F.month, "dd": F.dayofmonth}[part.lower()](d)


def dateadd(part: str, n: int, d: Column) -> Column:
    d = d.cast("date")
    return F.date_add(d, n) if part.lower() in ("d", "dd", "day") else F.add_months(d, n * (12 if part.lower() in ("yyyy", "yy", "year") else 1))


def right(s: Column, n: int) -> Column:
    """RIGHT(s, n): the last n characters; zero padding is RIGHT("0" + s, 2)."""
    return F.right(s, F.lit(n))


def resolve_variables(text_: str, values: Mapping[str, str]) -> str:
    """Replace @[Namespace::Name] by its value; keys are 'Namespace::Name', a bare name means User.

    Values may hold variables themselves; an unknown one stays as it is, a cycle is an error."""

    def of(match: re.Match, open_: tuple[str, ...] = ()) -> str:
        key = f"{(match[1] or 'User').strip()}::{match[2].strip()}"
        if key in open_:
            raise ValueError(f"variables refer to each other: {' -> '.join((*open_, key))}")
        value = values.get(key)
        return match[0] if value is None else _VARIABLE.sub(lambda m: of(m, (*open_, key)), value)

    return _VARIABLE.sub(of, text_)
