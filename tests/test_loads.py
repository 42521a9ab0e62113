"""Written tables, the run log and the period load as a stream, also where writes fail and streams are killed."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import dml, scopes, sqltext
from tidemill.sources.tables import Tables
from tidemill.streaming import reload


def test_written_tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    assert t.select_into("dw.dbo.[T]", spark.range(3)).count() == 3 and t("t").count() == 3
    with pytest.raises(ValueError, match="already"):
        t.select_into("DW.dbo.t", spark.range(1))
    # a table may be made anew from itself
    t.select_into("dw.dbo.t", t("t").unionByName(spark.range(2)), replace=True)
    assert t("t").count() == 5 and t.query("select count(*) n from dw.dbo.t", ["dw.dbo.t"]).first().n == 5
    bad = spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        t.select_into("dw.dbo.t", bad, replace=True)
    assert t("t").count() == 5
    old = t("t")
    t.drop("dw.dbo.t")
    assert old.count() == 5 and not t.exists("dw.dbo.t")
    with pytest.raises(ValueError):
        t.drop("dw.dbo.t")
    t.drop("dw.dbo.t", if_exists=True)


def test_the_run_log(spark, tmp_path):
    log, runs = str(tmp_path / "log"), spark.sparkContext.accumulator(0)

    def counted(x):
        runs.add(1)
        return x

    plus = F.udf(counted, "long")
    day = lambda n: F.lit(date(2001, 1, n))
    rows = spark.range(10).repartition(2).select(plus("id").alias("id"))
    assert dml.logged("load", "1", rows, lambda x: x.write.parquet(str(tmp_path / "t")), log, day(1), day(2)) == 10
    assert runs.value == 10  # the plan ran once
    with pytest.raises(Exception, match="already exists"):
        dml.logged("load", "2", rows, lambda x: x.write.parquet(str(tmp_path / "t")), log, day(3), day(4))
    dml.logged("other", "1", spark.range(0), lambda x: x.write.parquet(str(tmp_path / "u")), log, day(1), day(1))
    said = spark.read.parquet(log)
    assert sorted(tuple(r) for r in said.groupBy("status").count().collect()) == [("F", 1), ("R", 3), ("S", 2)]
    got = sorted((r.job, r.run, r.status, r.row_count, r.ended) for r in dml.job_status(said).collect())
    assert got == [("load", "1", "S", 10, date(2001, 1, 2)), ("load", "2", "F", None, date(2001, 1, 4)), ("other", "1", "S", 0, date(2001, 1, 1))]


def _files(spark, folder, rows):
    spark.createDataFrame(rows, "i long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("late", ["add", "replace"])
def test_a_stream_that_is_killed_after_each_batch(spark, tmp_path, late):
    at, folder = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda m: datetime(2001, m, 5)
    for rows in ([(1, day(1)), (2, day(2))], [(3, day(1))], [(4, day(3)), (5, day(1))]):
        _files(spark, at, rows)
    killed = set()

    def kill(number):
        if number not in killed:
            killed.add(number)
            raise RuntimeError("killed")

    tries = 0
    while True:
        tries += 1
        try:
            got = reload.reload_stream(spark, at, "ts", folder, late, files=1, after=kill)
            break
        except Exception as e:
            assert "killed" in str(e)
    assert tries == 4 and killed == {0, 1, 2}
    result = sorted((r.i, r.period) for r in got.collect())
    if late == "add":
        assert result == [(1, "200101"), (2, "200102"), (3, "200101"), (4, "200103"), (5, "200101")]
    else:
        # each period has the rows of the last batch that touched it, whichever order the files came in
        assert {p for _, p in result} == {"200101", "200102", "200103"}
        assert all(len({r._batch for r in got.where(F.col("period") == p).collect()}) == 1 for p in ("200101", "200102", "200103"))
    # nothing new: nothing changes
    again = reload.reload_stream(spark, at, "ts", folder, late, files=1)
    assert sorted((r.i, r.period) for r in again.collect()) == result
    _files(spark, at, [(9, day(2))])
    more = {(r.i, r.period) for r in reload.reload_stream(spark, at, "ts", folder, late).collect()}
    assert (9, "200102") in more and ((2, "200102") in more) == (late == "add")


def test_exec_as_a_source(spark):
    stated = sqltext.statements(spark.createDataFrame([("a", "exec dbo.p 1"), ("b", "insert into t (x, y) exec @r = [dbo].[q q]"), ("c", "exec(@sql)")], "script string, sql string"))
    catalog = spark.createDataFrame([("DBO.Q Q", "A", 1), ("DBO.Q Q", "B", 2)], "table string, column string, position int")
    got = sorted((r.script, r.position, r.alias, r.source_table, r.source_column) for r in scopes.resolve(stated, catalog=catalog).collect())
    assert got == [("a", 0, "*", "DBO.P", "*"), ("b", 0, "A", "DBO.Q Q", "A"), ("b", 1, "B", "DBO.Q Q", "B")]


def test_a_package_that_reads_a_procedure(spark):
    from tidemill.operators.flows import package_lineage
    from tidemill.plans.metadata import PACKAGE
    from tidemill.sources import packages

    text = PACKAGE.replace("§", "")
    start = text.index('name="SqlCommand">') + len('name="SqlCommand">')
    text = text[:start] + "EXEC dbo.usp_rows 1" + text[text.index("<", start) :]
    rows = package_lineage(packages.catalogs(spark.createDataFrame([("a", text)], "package string, text string"))).collect()
    assert rows and {r.source_table for r in rows} == {"DBO.USP_ROWS"}
