"""Expressions from their text, and names of tables in SQL text."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.functions.expressions import Text, derive, evaluate, expression, split, texts_of
from tidemill.operators import dml, joins
from tidemill.sources import packages
from tidemill.sources.tables import Tables

DAY = dt.date(2001, 3, 31)
CASES = [
    ("i + 1", 2, -6),
    ("i / 2", 0, -3),
    ("-i % 4 - 1", -2, 2),
    ("1 + 2 * 3 - (4 - 1)", 4, 4),
    ("8 / 4 / 2", 1, 1),
    ('s + "-" + (DT_WSTR,4)i', "ab-1", None),
    ('[ISNULL](n) ? "none" : n', "none", "zz"),
    ("!ISNULL(s) && i > 0 || b", True, False),
    ("i == 1 || i == 2 && FALSE", True, False),
    ('DATEADD("M",-1,d)', dt.date(2001, 2, 28), None),
    ('DATEADD("d",1,d)', dt.date(2001, 4, 1), None),
    ('DATEADD("hh",5,d)', dt.datetime(2001, 3, 31, 5), None),
    ('(DT_WSTR,4)[DATEPART]("yyyy",d) + [RIGHT]("0" + (DT_WSTR,2)MONTH(d),2) + "01"', "20010301", None),
    ("NULL(DT_DATE)", None, None),
    ("b ? 1 : i == 3 ? 2 : 0.5", 1.0, 0.5),
    ("(DT_I4)x", 3, None),
    ("(DT_NUMERIC,10,2)x * 2", Decimal("5.00"), None),
    ("#{P\\F\\C.Outputs[o].Columns[i]} * 10", 10, -70),
    ("@[User::V] + 1", 5, 5),
    ("@W", "401", "401"),
    ('FINDSTRING("abcabc","c",2) + FINDSTRING("abc","z",1)', 6, 6),
    ('SUBSTRING(s,1,1) == "a"', True, None),
    ("i & 3 | 8", 9, 9),
    ('"a\\"b\\n"', 'a"b\n', 'a"b\n'),
    ('DATEDIFF("month",d,GETDATE())', 5, None),
    ('DATEDIFF("wk",d,GETDATE())', 18, None),
    ("(DT_STR,5,1252)b", "True", "False"),
    ('REPLACENULL(n,"q") != "q"', False, True),
    ("[some].[i] + I", 2, -14),
]
WRONG = ["FOO(1)", "i + s", "nope", "1 +", "(DT_XX)1", "@[User::Z]", "i ? 1 : 2", "1 2", "@[User::A]", "LEN(i)", 's ? 1 : 2', 'i == "a"', "(1", "#{x} + 1", 'DATEADD(s,1,d)', 'DATEADD("zz",1,d)', "m", "1 § 2"]
VARIABLES = {"User::V": 4, "User::W": Text('(DT_WSTR,6)@[User::V] + "01"'), "User::A": Text("@[User::B]"), "User::B": Text("@[User::A]")}


def frame(spark):
    rows = [(1, "ab", DAY, 2.5, True, None, {"k": 1}), (-7, None, None, None, False, "zz", None)]
    return spark.createDataFrame(rows, "i int, s string, d date, x double, b boolean, n string, m map<string,int>")


def test_expressions(spark):
    df = frame(spark)
    columns = [expression(t, df.schema, VARIABLES, {"P\\F\\C.Outputs[o].Columns[i]": "i"}, dt.date(2001, 8, 1)).alias(f"c{k}") for k, (t, _, _) in enumerate(CASES)]
    a, b = df.select(*columns).collect()
    for k, (t, x, y) in enumerate(CASES):
        assert (a[k], b[k]) == (x, y), t


@pytest.mark.parametrize("text", WRONG)
def test_what_cannot_be_read_is_an_error(spark, text):
    with pytest.raises(ValueError):
        expression(text, frame(spark).schema, VARIABLES)


def test_no_clock(spark):
    with pytest.raises(ValueError, match="now"):
        expression("GETDATE()", frame(spark).schema)


def test_derive_split_and_variables(spark):
    df = frame(spark)
    got = derive(df, {"i": "i + 1", "before": "i"}).select("i", "before").collect()
    assert [tuple(r) for r in got] == [(2, 1), (-6, -7)]
    assert [r.o for r in split(df, [("one", "i == 1"), ("blank", "ISNULL(s)")], "rest", output="o").collect()] == ["one", "blank"]
    values = {"User::S": dt.date(2001, 5, 31), "User::P": Text('YEAR(DATEADD("M",-1,@[User::S])) * 100 + MONTH(DATEADD("M",-1,@[User::S]))'), "User::Q": Text('(DT_WSTR,6)@[User::P] + "01"')}
    assert evaluate(spark, values) == {"User::S": dt.date(2001, 5, 31), "User::P": 200104, "User::Q": "20010401"}


def test_a_package_s_own_expressions(spark):
    from tidemill.plans.metadata import THIRD_PACKAGE

    found = packages.catalogs(spark.createDataFrame([("p", THIRD_PACKAGE.replace("§", ""))], "package string, text string"))
    derived = found["components"].where("class like '%DerivedColumn%'").select("ref_id").collect()
    for r in derived:
        texts, ids = texts_of(found, "p", r.ref_id)
        assert texts and all(ids.values()) or not ids


def test_tables_with_one_last_part_stay_apart(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    t.register("dw.dbo.t", lambda: spark.range(3))
    t.register("archive.dbo.t", lambda: spark.range(5))
    t.register("#temp", lambda: spark.range(7).withColumnRenamed("id", "the id"))
    names = ["dw.dbo.t", "archive.dbo.t"]
    assert t.query("select count(*) n from dw.dbo.t", names).first().n == 3
    assert t.query("select count(*) n from (select id from [dw].[dbo].[t] union all select archive.dbo.t.id from archive.dbo.t) x", names).first().n == 8
    assert t.query("select count(*) n from archive.dbo.t a join dw.dbo.t b on a.id = b.id where a.id > ?", names, [0]).first().n == 2
    assert t.query("select [the id] as k, 'from dw.dbo.t' as s from #temp where [the id] = 6", ["#temp"]).first() == (6, "from dw.dbo.t")
    assert t.query("with t as (select 1 as one) select t.one from t", ["dw.dbo.t"]).first() == (1,)
    with pytest.raises(ValueError, match="may be"):
        t.query("select * from t", names)
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("tidemill_")]


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "x", 2)], "k int, _found string, _key_k int")
    ref = spark.createDataFrame([(1, "n")], "k int, name string")
    assert [tuple(r) for r in joins.lookup(df, ref, [("k", "k")], ["name"], [F.asc("name")]).collect()] == [(1, "x", 2, "n")]
    with pytest.raises(ValueError, match="k"):
        joins.lookup(df, ref, [("k", "k")], ["k"], [F.asc("name")])
    target = spark.createDataFrame([(1, "h", 5)], "k int, _hit string, _s_v int")
    source = spark.createDataFrame([(1, 9)], "k int, v int")
    assert [tuple(r) for r in dml.update_from(target, source, ["k"], {"_s_v": "v"}, [F.asc("v")]).collect()] == [(1, "h", 9)]


def test_salted_join_of_maps_and_refused_types(spark):
    left = spark.createDataFrame([(1, {"a": 1}), (2, {"b": 2})], "k int, m map<string,int>")
    right = spark.createDataFrame([(1, "r")], "k int, r string")
    assert [(r.k, r.r) for r in joins.salted_join(left, right, ["k"], "left").orderBy("k").collect()] == [(1, "r"), (2, None)]
    for how in ("full", "right", "cross"):
        with pytest.raises(ValueError, match="salted"):
            joins.salted_join(left, right, ["k"], how)
