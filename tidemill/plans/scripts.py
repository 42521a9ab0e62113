"""Queries over scripts whose text and truth follow the rows of the given tables: each customer has a script of its own, with names
and numbers of steps from its key, and the SQL twins work out the sources from the key alone."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.folders import checkpoint, dealt, fresh
from tidemill.functions import expressions
from tidemill.operators import dml, scopes, sqltext, steps, surface
from tidemill.sources.tables import Tables
from tidemill.streaming import reload

from .registry import Registry, table

query = Registry()


def _scripts(spark: SparkSession, sf_dir: str, *text: str | Column) -> DataFrame:
    """One script for each customer; `k` is its key."""
    k = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k").withColumn("n", 2 + F.col("k") % 4)
    sql = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in text))
    return k.select(F.concat(F.lit("s"), "k").alias("script"), sql.alias("sql"))


def _stated(spark: SparkSession, sf_dir: str, *text: str | Column) -> DataFrame:
    return sqltext.statements(_scripts(spark, sf_dir, *text))


def _nested() -> tuple[str | Column, ...]:
    k = F.col("k")
    arch = F.when(k % 2 == 1, F.concat(F.lit(" union all select g.a1, g.b1, g.c1, 0, g.d1 from dbo.arch"), k.cast("string"), F.lit(" g"))).otherwise("")
    first = ("with first as (select s.c", k % 7, " as u, s.d", k % 5, " v, s.key_ from dbo.base", k, " s), second(m, n, k) as (select u + 1, max(v), key_ from first f group by key_), ")
    third = ("third as (select x.*, y.extra from second x join (select e.w", k % 5, " as extra, e.k from dbo.extra e) y on y.k = x.k) ")
    return (*first, *third, "select t.m as p, t.n, (select min(z.q", k % 7, ") from dbo.low z where z.k = t.k) as q, t.extra, 'x' as mark from third t", arch)


@query("""
with k as (select c_custkey as k from customer)
select 's' || k as script, 1 as number, a as alias, t as source_table, c as source_column, 'exact' as confidence, l as levels from (
  select k, 'P' as a, 'DBO.BASE' || k as t, 'C' || (k % 7) as c, 3 as l from k union all select k, 'N', 'DBO.BASE' || k, 'D' || (k % 5), 3 from k
  union all select k, 'Q', 'DBO.LOW', 'Q' || (k % 7), 1 from k union all select k, 'EXTRA', 'DBO.EXTRA', 'W' || (k % 5), 2 from k
  union all select k, a, 'DBO.ARCH' || k, c, 0 from k, (values ('P', 'A1'), ('N', 'B1'), ('Q', 'C1'), ('MARK', 'D1')) v(a, c) where k % 2 = 1
  union all select k, 'MARK', null, null, null from k where k % 2 = 0)
""".replace("'exact' as confidence", "case when t is not null then 'exact' end as confidence"))
def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTEs three deep, a derived table, a scalar subquery, a `*` of a CTE and a union."""
    return scopes.resolve(_stated(spark, sf_dir, *_nested())).drop("position")


@query("""
with k as (select c_custkey as k from customer)
select 's' || k as script, 1 as number, t as "table", a as alias, 'table' as kind from k, lateral (
  select 'DBO.BASE' || k as t, 'S' as a union all select 'DBO.EXTRA', 'E' union all select 'DBO.LOW', 'Z' union all select 'DBO.ARCH' || k, 'G' where k % 2 = 1)
""")
def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The physical tables of the same scripts: no CTE and no derived table is among them."""
    return scopes.physical_tables(_stated(spark, sf_dir, *_nested()))


@query("""
with k as (select c_custkey as k, c_custkey % 5 as j from customer),
a as (select k, i - 1 as p, 'C' || i as a, 'DBO.T' || j as t, 'C' || i as c, 0 as l from k, lateral (select unnest(range(1, j + 3)) as i)),
r as (select * from a union all select k, j + 2, '*', 'DBO.U', '*', 1 from k union all select k, j + 3, 'ONE', null, null, null from k
  union all select k, p + j + 4, a, t, c, 1 from a join k using (k))
select 's' || k as script, 1 as number, cast(p as int) as "position", a as alias, t as source_table, c as source_column, case when t is not null then 'exact' end as confidence, l as levels from r
""")
def wildcard_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`a.*` by a catalog of columns, `*` of a derived table over a table that no catalog knows, and both in order."""
    j = F.col("c_custkey") % 5
    tables = table(spark, sf_dir, "customer").select(j.alias("j")).distinct()
    catalog = tables.select(F.concat(F.lit("DBO.T"), "j").alias("table"), F.explode(F.sequence(F.lit(1), (F.col("j") + 2).cast("int"))).alias("position"))
    catalog = catalog.select("table", F.concat(F.lit("C"), "position").alias("column"), "position")
    k = F.col("k")
    text = ("select a.*, b.*, 1 as one, d.* from dbo.t", k % 5, " a join (select * from dbo.u) b on b.i = a.c1 cross join (select * from dbo.t", k % 5, ") d")
    return scopes.resolve(_stated(spark, sf_dir, *text), catalog=catalog)


def _chain() -> tuple[str | Column, ...]:
    k, n = F.col("k"), F.col("n")
    i = lambda x: x.cast("string")
    links = F.concat_ws("", F.transform(F.sequence(F.lit(2), n), lambda x: F.concat(F.lit("select t.c"), i(x - 1), F.lit(" as c"), i(x), F.lit(" into #t"), i(x), F.lit(" from #t"), i(x - 1), F.lit(" t; "))))
    wiped = F.when(k % 2 == 1, F.concat(F.lit("truncate table #t"), i(n), F.lit("; insert into dbo.out"))).otherwise("insert into dbo.out (total)")
    return ("select b.c0 as c1 into #t1 from dbo.base", k, " b; ", links, "update x set x.c", n, " = s.w from #t", n, " x join dbo.side s on s.i = x.c", n, "; ", wiped, " select z.c", n, " from #t", n, " z")


#: What each step sets and takes, what is wiped out, and which writes a read sees.
_REACH = """
with recursive k as (select c_custkey as k, 2 + c_custkey % 4 as n from customer),
w as (select k, 1 as number, '#T1' as t, 'C1' as c, 'DBO.BASE' || k as st, 'C0' as sc from k
  union all select k, i, '#T' || i, 'C' || i, '#T' || (i - 1), 'C' || (i - 1) from k, lateral (select unnest(range(2, n + 1)) as i)
  union all select k, n + 1, '#T' || n, 'C' || n, 'DBO.SIDE', 'W' from k
  union all select k, n + 2 + k % 2, 'DBO.OUT', case when k % 2 = 0 then 'TOTAL' else 'C' || n end, '#T' || n, 'C' || n from k),
wiped as (select k, n + 2 as number, '#T' || n as t from k where k % 2 = 1),
reads as (select k, number, st as t from w union select k, n + 1, '#T' || n from k),
reach as (select distinct r.k, r.number as reader, r.t, w.number as writer from reads r join w on w.k = r.k and w.t = r.t and w.number < r.number
  left join wiped p on p.k = r.k and p.t = r.t and p.number > w.number and p.number < r.number where p.k is null)
"""


@query(_REACH + """select 's' || k as script, cast(writer as int) as writer, cast(reader as int) as number, t as "table" from reach""")
def script_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of temporary tables of 2 to 5 steps, an update from a join, a truncate in every other script."""
    return steps.step_edges(_stated(spark, sf_dir, *_chain()))


@query(_REACH + """,
walk as (select k, number, t, c, number as reader, st, sc, 0 as hops from w
  union all select walk.k, walk.number, walk.t, walk.c, w.number, w.st, w.sc, hops + 1 from walk join reach on reach.k = walk.k and reach.reader = walk.reader and reach.t = walk.st join w on w.k = walk.k and w.number = reach.writer and w.t = walk.st and w.c = walk.sc),
open_ as (select walk.* from walk left join (reach join w on w.k = reach.k and w.number = reach.writer) on reach.k = walk.k and reach.reader = walk.reader and reach.t = walk.st and w.t = walk.st and w.c = walk.sc where reach.k is null)
select distinct 's' || k as script, cast(number as int) as number, t as "table", c as "column", st as source_table, sc as source_column, 'exact' as confidence, hops from open_
""")
def script_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the columns that these steps write come from in the end."""
    return steps.end_to_end(_stated(spark, sf_dir, *_chain()))


@query("""select 's' || k as script, n + 2 + k % 2 as statements, n + 3 as reads, n + 1 as columns from (select c_custkey as k, 2 + c_custkey % 4 as n from customer)""")
def facts_from_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of these scripts, what they read and list, by table functions in lateral joins."""
    surface.register(spark)
    scripts, stated = (f"{x}_{uuid.uuid4().hex}" for x in ("scripts", "stated"))
    _scripts(spark, sf_dir, *_chain()).createOrReplaceTempView(scripts)
    try:
        # scripts are cut once for all that reads their statements, and counts are added up, not joined
        checkpoint(spark.sql(f"select q.script, x.statement from {scripts} q, lateral split_statements(q.sql) x")).createOrReplaceTempView(stated)
        return spark.sql(f"""
          select script, sum(s) as statements, sum(r) as reads, sum(c) as columns from (
            select script, 1 as s, 0 as r, 0 as c from {stated}
            union all select q.script, 0, 1, 0 from {stated} q, lateral statement_tables(q.statement)
            union all select q.script, 0, 0, 1 from {stated} q, lateral select_list(q.statement)) group by script""")
    finally:
        spark.catalog.dropTempView(scripts)
        spark.catalog.dropTempView(stated)


# --- expressions from their text, names in SQL ----------------------------------------------------------

_TEXTS = {
    "period": '![ISNULL](#{Package\\Load\\Join.Outputs[Out].Columns[o_custkey]}) && o_orderstatus != "F" ? (DT_WSTR,4)[DATEPART]("yyyy",o_orderdate) + [RIGHT]("0" + (DT_WSTR,2)[DATEPART]("mm",o_orderdate),2) + "01" : NULL(DT_WSTR,8)',
    "closed": 'o_orderstatus == "F" ? (DT_DBDATE)((DT_WSTR,4)YEAR(o_orderdate) + "-" + RIGHT("0" + (DT_WSTR,2)MONTH(o_orderdate),2) + "-" + RIGHT("0" + (DT_WSTR,2)DAY(o_orderdate),2)) : NULL(DT_DBDATE)',
    "date_key": "YEAR(o_orderdate) * 10000 + MONTH(o_orderdate) * 100 + DAY(o_orderdate)",
    "month_before": 'DATEADD("d", -DAY(DATEADD("M",-1,(DT_DBDATE)o_orderdate)) + 1, DATEADD("M",-1,(DT_DBDATE)o_orderdate))',
    "months": 'DATEDIFF("month", o_orderdate, @[User::AsOf])',
    "mark": 'UPPER(SUBSTRING(o_orderpriority, 3, 3)) + "/" + (DT_WSTR,2)(o_orderkey % 7) + @[User::Suffix]',
    "sevenths": "-(o_orderkey / 7) + 2 * 3 - 1",
    "odd": "(o_orderkey & 1) == 1 || o_totalprice > 2.5e5",
}
_VARIABLES = {"User::AsOf": date(2001, 8, 1), "User::Year": expressions.Text("YEAR(@[User::AsOf])"), "User::Suffix": expressions.Text('"-" + (DT_WSTR,4)(@[User::Year] - 10)')}


@query("""select o_orderkey, case when o_custkey is not null and o_orderstatus <> 'F' then strftime(o_orderdate, '%Y%m') || '01' end as period, case when o_orderstatus = 'F' then cast(o_orderdate as date) end as closed,
  cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int) as date_key, cast(date_trunc('month', o_orderdate - interval 1 month) as date) as month_before,
  cast((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) as int) as months, upper(substr(o_orderpriority, 3, 3)) || '/' || (o_orderkey % 7) || '-1991' as mark, -(o_orderkey // 7) + 5 as sevenths, o_orderkey % 2 = 1 or o_totalprice > 250000 as odd from orders""")
def derived_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Derived Column transformation and its variables run from their own texts."""
    ids = {"Package\\Load\\Join.Outputs[Out].Columns[o_custkey]": "o_custkey"}
    return expressions.derive(table(spark, sf_dir, "orders"), _TEXTS, _VARIABLES, ids).select("o_orderkey", *_TEXTS)


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice >= 200000 then 'large' when year(o_orderdate) % 2 = 0 or o_orderpriority is null then 'even' else 'rest' end as output from orders""")
def split_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Conditional Split from the texts of its conditions: the first that holds names the output."""
    cases = [("large", 'o_orderstatus == "F" && o_totalprice >= 200000'), ("even", "YEAR(o_orderdate) % 2 == 0 || ISNULL(o_orderpriority)")]
    return expressions.split(table(spark, sf_dir, "orders"), cases, "rest", output="output").select("o_orderkey", "output")


@query("""select o_orderkey, o_custkey, 'now' as origin from orders where year(o_orderdate) >= 1995 and o_orderstatus = 'F'
  union all select o_orderkey, o_custkey, 'then' from orders where year(o_orderdate) < 1995 and o_orderstatus = 'F'""")
def current_and_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with one last name part, under names of three and four parts in one text."""
    both = Tables(spark, sf_dir)
    orders, new = table(spark, sf_dir, "orders"), F.year("o_orderdate") >= 1995
    both.register("dw.dbo.agreement", lambda: orders.where(new))
    both.register("old.archive.dbo.agreement", lambda: orders.where(~new))
    sql = """select [agreement].o_orderkey, dw.dbo.agreement.o_custkey, 'now' as origin from [dw].[dbo].[agreement] where o_orderstatus = ?
      union all select a.o_orderkey, a.o_custkey, 'then' from old.archive.dbo.agreement as a where a.o_orderstatus = ?"""
    return both.query(sql, ["dw.dbo.agreement", "old.archive.dbo.agreement"], ["F", "F"])


def _calls() -> tuple[str | Column, ...]:
    k = F.col("k")
    return ("exec [dbo].[usp_load", k % 3, "] ", k, ", 'x'; insert into dbo.got (a, b) exec dbo.usp_load", k % 3, "; exec dbo.usp_other")


@query("""
with k as (select c_custkey as k, c_custkey % 3 as j from customer)
select 's' || k as script, cast(n as int) as number, cast(p as int) as "position", a as alias, t as source_table, a as source_column, 'exact' as confidence, 0 as levels from k, lateral (
  select n, i - 1 as p, 'R' || i as a, 'DBO.USP_LOAD' || j as t from (select unnest([1, 2]) as n), (select unnest(range(1, j + 2)) as i) union all select 3, 0, '*', 'DBO.USP_OTHER')
""")
def procedure_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXEC as a source: the columns that a catalog has of the procedure, one `*` where it has none."""
    j = F.col("c_custkey") % 3
    calls = table(spark, sf_dir, "customer").select(j.alias("j")).distinct()
    catalog = calls.select(F.concat(F.lit("DBO.USP_LOAD"), "j").alias("table"), F.explode(F.sequence(F.lit(1), (F.col("j") + 1).cast("int"))).alias("position"))
    return scopes.resolve(_stated(spark, sf_dir, *_calls()), catalog=catalog.select("table", F.concat(F.lit("R"), "position").alias("column"), "position"))


# --- written tables, the run log, the period load as a stream -------------------------------------------


@query("""select job, 'S' as status, n as row_count, date '2001-08-01' as started, date '2001-08-02' as ended from (
  select 'load_open' as job, count(*) as n from orders where o_orderstatus = 'O' union all select 'load_shut', count(*) from orders where o_orderstatus = 'F')""")
def logged_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written tables, one of them put together from its own former state, and the status that their log ends with."""
    both, log, orders = Tables(spark, sf_dir), fresh(spark, "log"), table(spark, sf_dir, "orders")
    day = lambda n: F.lit(date(2001, 8, n))
    both.select_into("dbo.#open", orders.limit(0))
    dml.logged("load_open", "1", orders.where("o_orderstatus = 'O'").unionByName(both("#open")), lambda x: both.select_into("dbo.#open", x, replace=True), log, day(1), day(2))
    dml.logged("load_shut", "1", orders.where("o_orderstatus = 'F'"), lambda x: both.select_into("dbo.#shut", x), log, day(1), day(2))
    counted = both("#open").count() + both("#shut").count()
    return dml.job_status(spark.read.parquet(log)).where(F.lit(counted) > 0).drop("run")


@query("select strftime(ts, '%Y%m') as period, event_type, count(*) as n, min(event_id) as first_id, max(event_id) as last_id from events group by all")
def streamed_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that rewrites the periods its batches touch; each row is there once."""
    at = reload.reload_stream(spark, f"{sf_dir}/events.parquet", "ts")
    return at.groupBy("period", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
