"""Queries for scalar semantics, changes to tables, error rows, streams, and the flagship."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import ssis, tsql
from tidemill.operators import dml, joins, select
from tidemill.streaming import reload

from .registry import Registry, table

query = Registry()
#: Stands for the run's date: nothing reads the clock.
AS_OF = date(2001, 8, 1)


@query("""select c_custkey, c_name, o_orderkey, o_totalprice, case when o_totalprice is null then 'none' when o_totalprice >= 300000 then 'high' when o_totalprice >= 100000 then 'middle' else 'low' end as band,
  cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int) as date_key, cast(datediff('month', cast(o_orderdate as date), date '2001-08-01') as int) as months
  from customer left join (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) o on c_custkey = o_custkey and rn = 1""")
def flagship_customer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    both = joins.latest_of(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], order)
    return select.derive(
        both,
        {"band": tsql.band("o_totalprice", [(300000, "high"), (100000, "middle")], "low", null="none"), "date_key": tsql.date_key("o_orderdate"), "months": tsql.datediff("month", "o_orderdate", F.lit(AS_OF))},
    ).select("c_custkey", "c_name", "o_orderkey", "o_totalprice", "band", "date_key", "months")


@query("""select o_orderkey, strftime(o_orderdate, '%Y%m%d') as text8, strftime(o_orderdate, '%Y%m') as text6, strftime(o_orderdate, '%b-%y') as mon_yy, strftime(o_orderdate, '%Y%m01') as month_key,
  cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int) as date_key, cast(o_orderdate as date) as back from orders""")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", tsql.date_text(d).alias("text8"), tsql.date_text(d, 6).alias("text6"), tsql.format_date(d, "MMM-yy").alias("mon_yy"), tsql.format_date(d, "yyyyMM01").alias("month_key"), tsql.date_key(d).alias("date_key"), tsql.key_date(tsql.date_key(d)).alias("back"))


@query("""select o_orderkey, cast(datediff('day', d, date '2001-08-01') as int) as days, cast(datediff('month', d, date '2001-08-01') as int) as months, cast(datediff('year', d, date '2001-08-01') as int) as years, cast(date_trunc('month', d) as date) as month_start, cast(year(d) as int) as y, cast(month(d) as int) as m
  from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def datediff_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = F.col("o_orderdate").cast("date"), F.lit(AS_OF)
    return table(spark, sf_dir, "orders").select("o_orderkey", *[tsql.datediff(p, d, now).alias(f"{p}s") for p in ("day", "month", "year")], tsql.month_start(d).alias("month_start"), F.year(d).alias("y"), F.month(d).alias("m"))


@query("""select o_orderkey, cast(d + interval 3 day as date) as plus_days, cast(d - interval 1 month as date) as minus_month, cast(d + interval 1 year as date) as plus_year, cast(d - 5 as date) as minus_5
  from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def dateadd_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "o_orderdate"
    return table(spark, sf_dir, "orders").select("o_orderkey", tsql.dateadd("day", 3, d).alias("plus_days"), tsql.dateadd("month", -1, d).alias("minus_month"), tsql.dateadd("year", 1, d).alias("plus_year"), F.date_sub(F.col(d).cast("date"), 5).alias("minus_5"))


@query("""select p_partkey, substring(p_name, 0, 3) as from0, cast(instr(p_name, ' ') as int) as space_at, substring(p_name, 1, instr(p_name, ' ') - 1) as first_word, cast(length(rtrim(p_name || '  ')) as int) as len_, replace(p_brand, 'Brand#', 'B') as brand,
  upper(p_name) as up, lower(p_type) as low, trim('  ' || p_type || ' ') as trimmed, p_type || '-' || nullif(p_brand, 'Brand#1') as joined from part""")
def string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    space = tsql.charindex(" ", name)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        tsql.substring(name, 0, 3).alias("from0"),
        space.alias("space_at"),
        tsql.substring(name, 1, space - 1).alias("first_word"),
        tsql.length(F.concat(name, F.lit("  "))).alias("len_"),
        F.replace(brand, F.lit("Brand#"), F.lit("B")).alias("brand"),
        F.upper(name).alias("up"),
        F.lower("p_type").alias("low"),
        F.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
        tsql.concat("p_type", F.lit("-"), F.nullif(brand, F.lit("Brand#1"))).alias("joined"),
    )


@query("""select o_orderkey, coalesce(nullif(o_custkey % 10, 0), -1) as k, cast(o_custkey as varchar) as as_text, cast(floor(o_totalprice) as bigint) as whole, o_orderkey // 7 as sevenths, cast(round(o_totalprice, 0) as double) as rounded from orders""")
def isnull_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select("o_orderkey", tsql.isnull(F.nullif(c("o_custkey") % 10, F.lit(0)), F.lit(-1), "bigint").alias("k"), c("o_custkey").cast("string").alias("as_text"), F.floor("o_totalprice").cast("bigint").alias("whole"), tsql.divide("o_orderkey", F.lit(7)).alias("sevenths"), F.round("o_totalprice", 0).alias("rounded"))


@query("""select o_orderkey, case when o_custkey is not null and not (o_orderstatus = 'F') then strftime(o_orderdate, '%Y') || right('0' || cast(month(o_orderdate) as varchar), 2) else cast(null as varchar) end as period,
  case when o_orderstatus = 'F' then cast(o_orderdate as date) else cast(null as date) end as done, cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int) as date_key, cast(o_orderdate as date) + 1 as next_day from orders""")
def ssis_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    year, month = ssis.datepart("yyyy", c("o_orderdate")), ssis.datepart("mm", c("o_orderdate"))
    period = F.concat(ssis.text(year, 4), ssis.right(F.concat(F.lit("0"), ssis.text(month, 2)), 2))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ssis.ternary(c("o_custkey").isNotNull() & ~(c("o_orderstatus") == "F"), period, F.lit(None).cast("string")).alias("period"),
        ssis.ternary(c("o_orderstatus") == "F", ssis.cast(c("o_orderdate"), "DT_DATE"), ssis.null("DT_DATE")).alias("done"),
        tsql.date_key("o_orderdate").alias("date_key"),
        ssis.dateadd("d", 1, c("o_orderdate")).alias("next_day"),
    )


@query("select l_returnflag, cast(ceil(l_extendedprice / 10) * 10 as bigint) as bucket, count(*) as n from lineitem group by 1, 2")
def ceiling_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.ceil(F.col("l_extendedprice") / 10) * 10).alias("bucket")).agg(F.count("*").alias("n"))


# --- changes --------------------------------------------------------------------------------------------


@query("""select c_custkey, c_name, coalesce(o_totalprice, c_acctbal) as c_acctbal from customer left join
  (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders where o_orderstatus = 'F') on c_custkey = o_custkey and rn = 1""")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return dml.update_from(target, source, ["c_custkey"], {"c_acctbal": "o_totalprice"}, [F.desc("o_orderdate"), F.asc("o_orderkey")])


@query("""with cur as (select c_custkey, c_mktsegment, cast(c_nationkey as bigint) as c_nationkey, 1 as is_current from customer),
  st as (select c_custkey, case when c_acctbal > 5000 then 'PRIME' else c_mktsegment end as c_mktsegment, cast(c_nationkey as bigint) + 100 as c_nationkey from customer where c_acctbal > 0)
  select cur.c_custkey, cur.c_mktsegment, st.c_nationkey, 1 as is_current from cur join st on cur.c_custkey = st.c_custkey and cur.c_mktsegment = st.c_mktsegment
  union all select c_custkey, c_mktsegment, c_nationkey, 0 from cur where not exists (select 1 from st where st.c_custkey = cur.c_custkey and st.c_mktsegment = cur.c_mktsegment)
  union all select c_custkey, c_mktsegment, c_nationkey, 1 from st where not exists (select 1 from cur where st.c_custkey = cur.c_custkey and st.c_mktsegment = cur.c_mktsegment)""")
def scd2_expire_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    current = c.select("c_custkey", "c_mktsegment", "c_nationkey", F.lit(1).alias("is_current"))
    staged = c.where("c_acctbal > 0").select("c_custkey", F.when(F.col("c_acctbal") > 5000, "PRIME").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return dml.scd2(current, staged, ["c_custkey"], ["c_mktsegment"], patched=["c_nationkey"])


@query("""select o_orderkey, strftime(o_orderdate, '%Y%m') as period, o_totalprice from orders where strftime(o_orderdate, '%Y%m') not in ('199801', '199802')
  union all select o_orderkey, strftime(o_orderdate, '%Y%m'), o_totalprice * 2 from orders where strftime(o_orderdate, '%Y%m') in ('199801', '199802') and o_orderstatus = 'F'""")
def delete_insert_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "orders").select("o_orderkey", tsql.date_text("o_orderdate", 6).alias("period"), "o_totalprice")
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", tsql.date_text("o_orderdate", 6).alias("period"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return dml.replace_period(target, new, "period", ["199801", "199802"])


@query("""select o_orderkey, strftime(o_orderdate, '%Y%m') as period, case when strftime(o_orderdate, '%Y%m') in ('200105', '200106', '200107', '200108') then 'new' else 'old' end as state from orders""")
def rolling_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tsql.date_text("o_orderdate", 6).alias("period"))
    target = rows.withColumn("state", F.lit("old"))
    months = reload.rolling_periods(AS_OF, back=3)
    return dml.replace_period(target, rows.withColumn("state", F.lit("new")), "period", months)


@query("""select o_custkey as k, o_orderpriority as name, cast(null as double) as amount from orders where o_orderstatus = 'P'
  union all select c_custkey, c_mktsegment, c_acctbal from customer""")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("amount"))
    return dml.insert_select(target, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority"))


@query("select p_partkey as id, p_name as title, cast(null as double) as price, cast(null as date) as updated from part")
def destination_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = spark.createDataFrame([], "id long, title string, price double, updated date")
    return dml.map_columns(table(spark, sf_dir, "part"), shape, {"p_partkey": "id", "p_name": "title"})


@query("""select event_id, try_cast(regexp_extract(props, '"k": ([^}]*)', 1) || case when value > 15 then 'x' else '' end as int) as k, case when value > 15 then 'raw' else null end as error_column from events""")
def error_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.regexp_extract("props", r'"k": ([^}]*)', 1), F.when(F.col("value") > 15, "x").otherwise(""))
    good, bad = select.redirect_errors(table(spark, sf_dir, "events").withColumn("raw", raw), "raw", "int", "k")
    return good.select("event_id", "k", F.lit(None).cast("string").alias("error_column")).unionByName(bad.select("event_id", F.lit(None).cast("int").alias("k"), "error_column"))


@query("select event_id, cast(trunc(value) as int) as whole, cast(event_id as varchar) as id_text, try_cast(event_type as int) as no_number from events")
def data_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = select.convert(table(spark, sf_dir, "events"), {"whole": ("value", "int"), "id_text": ("event_id", "string")})
    return select.convert(df, {"no_number": ("event_type", "int")}, on_error="ignore").select("event_id", "whole", "id_text", "no_number")


@query("select 'load_orders' as job, 'S' as status, count(*) as row_count, date '2001-08-01' as started, date '2001-08-02' as ended from orders")
def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.run_log("load_orders", table(spark, sf_dir, "orders"), F.lit(AS_OF), tsql.dateadd("day", 1, F.lit(AS_OF)))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 250000.0")
def bound_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import Tables

    return Tables(spark, sf_dir).query("select o_orderkey, o_totalprice from orders where o_orderstatus = ? and o_totalprice > ?", ["[dbo].[Orders]"], ["F", 250000.0])


@query("select event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1")
def stream_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, reloaded by period into a table in the shared folder, then summed."""
    at = reload.stream_to_periods(spark, f"{sf_dir}/events.parquet", "ts")
    return at.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
