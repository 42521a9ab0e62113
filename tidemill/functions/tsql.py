"""T-SQL scalar semantics as Column builders. All stay in the JVM and inside whole-stage codegen.

The traps that these cover: ISNULL keeps the first argument's type, DATEDIFF counts the boundaries
crossed, SUBSTRING may start before 1, LEN ignores trailing spaces, ROUND with a third argument
truncates, int / int truncates, and CONVERT with style 112 cuts to the target's length."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinel dates that the workloads use for "never" at either end.
EARLIEST, LATEST = date(1900, 1, 1), date(2050, 1, 1)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def isnull(x: Column | str, other: Column, type_: str) -> Column:
    """ISNULL(x, other): coalesce in the type of x, which is given."""
    return F.coalesce(_c(x).cast(type_), other.cast(type_))


def length(s: Column | str) -> Column:
    """LEN(s): trailing spaces do not count."""
    return F.length(F.rtrim(_c(s)))


def charindex(part: str | Column, s: Column | str) -> Column:
    """CHARINDEX(part, s): 0 where absent."""
    return F.instr(_c(s), part) if isinstance(part, str) else F.locate(part, _c(s))


def substring(s: Column | str, start: Column | int, n: Column | int) -> Column:
    """SUBSTRING(s, start, n): characters before 1 count towards n but do not exist."""
    start = start if isinstance(start, Column) else F.lit(start)
    n = n if isinstance(n, Column) else F.lit(n)
    from_ = F.greatest(start, F.lit(1))
    return F.substring(_c(s), from_, F.greatest(start + n - from_, F.lit(0)))


def concat(*parts: Column | str) -> Column:
    """'+' on strings: null if any part is."""
    return F.concat(*map(_c, parts))


def datediff(part: str, a: Column | str, b: Column | str) -> Column:
    """DATEDIFF(part, a, b): boundaries of days, months or years between a and b."""
    a, b = _c(a), _c(b)
    if part == "day":
        return F.datediff(b, a)
    years = F.year(b) - F.year(a)
    if part == "year":
        return years
    if part == "month":
        return years * 12 + F.month(b) - F.month(a)
    raise ValueError(f"DATEDIFF part {part!r}: day, month or year")


def dateadd(part: str, n: Column | int, d: Column | str) -> Column:
    """DATEADD(part, n, d) on dates; a day past the month's end becomes its last day."""
    n = n if isinstance(n, Column) else F.lit(n)
    d = _c(d).cast("date")
    if part == "day":
        return F.date_add(d, n)
    if part in ("month", "year"):
        return F.add_months(d, n * (12 if part == "year" else 1))
    raise ValueError(f"DATEADD part {part!r}: day, month or year")


def convert_text(x: Column | str, size: int | None = 30) -> Column:
    """CONVERT(varchar(size), x): cut to size, which is 30 where none is given; null size is varchar(max)."""
    text = _c(x).cast("string")
    return text if size is None else F.substring(text, 1, size)


def month_start(d: Column | str) -> Column:
    """DATEADD(month, DATEDIFF(month, 0, d), 0)."""
    return F.trunc(_c(d), "MM")


def date_text(d: Column | str, n: int = 8) -> Column:
    """CONVERT(varchar(n), d, 112): yyyyMMdd, cut to n characters."""
    return F.substring(F.date_format(_c(d), "yyyyMMdd"), 1, n)


def date_key(d: Column | str) -> Column:
    """YEAR * 10000 + MONTH * 100 + DAY as an int."""
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def key_date(k: Column | str) -> Column:
    """CONVERT(date, key, 112): a yyyyMMdd number or text as a date."""
    return F.to_date(_c(k).cast("string"), "yyyyMMdd")


def format_date(d: Column | str, pattern: str) -> Column:
    """FORMAT(d, pattern), for patterns of y, M, d and literal digits."""
    return F.date_format(_c(d), pattern)


def divide(a: Column | str, b: Column | str) -> Column:
    """int / int truncates towards zero; null where b is 0 (the guarded form)."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, F.try_divide(a - a % b, b).cast("long"))


def truncate(x: Column | str, digits: int = 0) -> Column:
    """ROUND(x, digits, 1): towards zero."""
    x, scale = _c(x), 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def annuity(principal: Column | str, rate: Column | str, periods: Column | str) -> Column:
    """Payment a period: principal * rate / (1 - POWER(1 + rate, -periods))."""
    rate = _c(rate).cast("double")
    return _c(principal).cast("double") * rate / (1 - F.pow(1 + rate, -_c(periods).cast("double")))


def like_ci(x: Column | str, pattern: str) -> Column:
    """LIKE under a case-insensitive collation."""
    return _c(x).ilike(pattern)


def band(x: Column | str, limits: list[tuple[float, str]], otherwise: str, null: str | None = None) -> Column:
    """Searched CASE: the first limit that x reaches (descending limits, first match wins)."""
    x = _c(x)
    out = F.when(x.isNull(), F.lit(null))
    for limit, name in limits:
        out = out.when(x >= limit, name)
    return out.otherwise(otherwise)
