from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemill.functions import ssis, tsql


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize("start,n,expected", [(0, 3, "ab"), (-1, 3, "a"), (1, 2, "ab"), (3, 10, "cdef"), (7, 2, ""), (-5, 3, ""), (2, 0, "")])
def test_substring(spark, start, n, expected):
    assert one(spark, tsql.substring("s", start, n), s="abcdef") == (expected,)


def test_datediff_counts_boundaries(spark):
    a, b = F.lit(date(2024, 12, 31)), F.lit(date(2025, 1, 1))
    assert one(spark, *[tsql.datediff(p, a, b) for p in ("day", "month", "year")]) == (1, 1, 1)
    with pytest.raises(ValueError):
        tsql.datediff("hour", a, b)


def test_dateadd_clamps_and_month_start(spark):
    d = F.lit(date(2024, 1, 31))
    assert one(spark, tsql.dateadd("month", 1, d), tsql.dateadd("year", 1, F.lit(date(2024, 2, 29))), tsql.dateadd("day", -31, d), tsql.month_start(d)) == (date(2024, 2, 29), date(2025, 2, 28), date(2023, 12, 31), date(2024, 1, 1))


def test_len_charindex_concat(spark):
    assert one(spark, tsql.length("s"), tsql.charindex("b", "s"), tsql.charindex("z", "s"), tsql.concat("s", F.lit(None).cast("string")), s="ab  ") == (2, 2, 0, None)


def test_round_modes_and_division(spark):
    got = one(spark, F.round(F.lit(2.5)), F.round(F.lit(-2.5)), tsql.truncate(F.lit(-2.79), 1), tsql.divide(F.lit(7), F.lit(2)), tsql.divide(F.lit(-7), F.lit(2)), tsql.divide(F.lit(7), F.lit(0)))
    assert got == (3.0, -3.0, -2.7, 3, -3, None)


def test_isnull_keeps_the_first_type(spark):
    df = spark.range(1).select(tsql.isnull(F.lit(None).cast("int"), F.lit("5"), "int").alias("x"))
    assert df.dtypes == [("x", "int")] and df.first()[0] == 5


def test_date_keys(spark):
    d = F.lit(date(2026, 1, 9))
    assert one(spark, tsql.date_key(d), tsql.date_text(d, 6), tsql.key_date(tsql.date_key(d)), tsql.format_date(d, "yyyyMM01"), tsql.format_date(d, "MMM-yy")) == (20260109, "202601", date(2026, 1, 9), "20260101", "Jan-26")


def test_bands_take_the_first_match(spark):
    df = spark.createDataFrame([(9.0,), (5.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(tsql.band("x", [(9, "a"), (5, "b")], "c", null="n")).collect()] == ["a", "b", "c", "n"]


def test_annuity_and_like(spark):
    assert abs(one(spark, tsql.annuity(F.lit(1000.0), F.lit(0.01), F.lit(12)))[0] - 88.8488) < 1e-4
    assert one(spark, tsql.like_ci("s", "%my CAR%"), s="Is MY car red") == (True,)


def test_package_expressions(spark):
    s = F.lit("abc")
    assert one(spark, ssis.text(s, 3), ssis.right(F.lit("07"), 2), ssis.ternary(F.lit(True), s, F.lit("x")), ssis.cast(F.lit("5"), "DT_I4"), ssis.null("DT_DATE"), ssis.datepart("mm", F.lit(date(2024, 5, 6))), ssis.dateadd("M", -1, F.lit(date(2024, 3, 31)))) == ("abc", "07", "abc", 5, None, 5, date(2024, 2, 29))
    with pytest.raises(Exception, match="longer than 2"):
        one(spark, ssis.text(s, 2))


def test_variables():
    values = {"User::a": "1", "User::b": "@[User::a]+@[a]", "System::a": "s"}
    assert ssis.resolve_variables("x @[User::b] @[System::a] @[User::none]", values) == "x 1+1 s @[User::none]"
    with pytest.raises(ValueError):
        ssis.resolve_variables("@[User::p]", {"User::p": "@[User::q]", "User::q": "@[User::p]"})


def test_convert_text(spark):
    got = spark.createDataFrame([("x" * 40,), (None,)], "s string").select(tsql.convert_text("s"), tsql.convert_text("s", 5), tsql.convert_text("s", None)).collect()
    assert [len(x) for x in got[0]] == [30, 5, 40] and list(got[1]) == [None] * 3
