"""Queries for projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import tsql
from tidemill.operators import joins, select

from .registry import Registry, table

query = Registry()
_MONEY = "decimal(18,2)"


def _total(column: str):
    return F.sum(F.col(column).cast(_MONEY)).cast("double")


# --- windows --------------------------------------------------------------------------------------------


@query("""select o_custkey, o_orderkey, cast(o_orderdate as date) as o_date, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1""")
def latest_order_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_date"), "o_totalprice")


@query("""select l_orderkey, l_linenumber, l_partkey from (
  select *, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn from lineitem) where rn = 1""")
def first_line_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return select.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by
  case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end, o_orderkey) rn from orders) where rn = 1""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return select.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [rank.asc(), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""select k, o_orderkey from (select coalesce(nullif(o_custkey % 7, 0), o_custkey) k, o_orderkey,
  row_number() over (partition by coalesce(nullif(o_custkey % 7, 0), o_custkey), o_orderpriority
  order by o_orderdate desc, o_totalprice desc, o_custkey desc, o_orderkey desc) rn from orders) where rn = 1""")
def multi_key_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.nullif(F.col("o_custkey") % 7, F.lit(0)), F.col("o_custkey"))
    df = table(spark, sf_dir, "orders").withColumn("k", key)
    return select.first_per_key(df, ["k", "o_orderpriority"], [F.desc(c) for c in ("o_orderdate", "o_totalprice", "o_custkey", "o_orderkey")]).select("k", "o_orderkey")


@query("""select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) r2 from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r1 from events) where r1 = 1) where r2 = 1""")
def nested_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = select.first_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return select.first_per_key(inner, ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


# --- projections and filters ----------------------------------------------------------------------------


@query("""select c_custkey, case when c_acctbal is null then 'UNKNOWN' when c_acctbal >= 7500 then 'A' when c_acctbal >= 2500 then 'B' else 'C' end as band,
  case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end as segment_code,
  case when c_acctbal > 0 then case when c_nationkey < 10 then 'low' else 'high' end else 'debt' end as nested from customer""")
def risk_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        tsql.band("c_acctbal", [(7500, "A"), (2500, "B")], "C", null="UNKNOWN").alias("band"),
        F.when(c("c_mktsegment") == "BUILDING", 1).when(c("c_mktsegment") == "MACHINERY", 2).otherwise(0).alias("segment_code"),
        F.when(c("c_acctbal") > 0, F.when(c("c_nationkey") < 10, "low").otherwise("high")).otherwise("debt").alias("nested"),
    )


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(net, 2) as double) as net, cast(round(net + fee, 2) as double) as due, cast(floor(cast(net + fee as double) / l_quantity) as bigint) as unit_due from (
  select *, net * 0.025 as fee from (select *, cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as net from lineitem)) where l_quantity > 0""")
def staged_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    staged = select.derive_in_stages(
        table(spark, sf_dir, "lineitem").where(c("l_quantity") > 0),
        {"raw": c("l_extendedprice").cast(_MONEY) * (1 - c("l_discount").cast("decimal(4,2)"))},
        {"fee": c("raw") * F.lit(Decimal("0.025"))},
        {"total": c("raw") + c("fee")},
        {"net": F.round("raw", 2).cast("double"), "due": F.round("total", 2).cast("double"), "unit_due": F.floor(c("total").cast("double") / c("l_quantity"))},
    )
    return staged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "due", "unit_due")


@query("select o_orderkey, round(o_totalprice * 0.01 / (1 - pow(1 + 0.01, -cast(36 as double))), 4) as payment from orders")
def annuity_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(tsql.annuity("o_totalprice", F.lit(0.01), F.lit(36)), 4).alias("payment"))


@query("select l_orderkey, l_linenumber, l_partkey, cast(sign(x) * floor(abs(x) * 10) / 10 as double) as cut, cast(round(x, 1) as double) as rounded from (select *, cast(l_extendedprice as decimal(18,2)) - 20000 as x from lineitem)")
def round_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice").cast(_MONEY) - 20000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tsql.truncate(x, 1).cast("double").alias("cut"), F.round(x, 1).cast("double").alias("rounded"))


@query("""select o_orderkey from orders where (o_orderstatus = 'F' or o_orderstatus = 'P') and (o_totalprice > 300000 or o_orderpriority in ('1-URGENT', '2-HIGH'))""")
def or_groups_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").where(((c("o_orderstatus") == "F") | (c("o_orderstatus") == "P")) & ((c("o_totalprice") > 300000) | c("o_orderpriority").isin("1-URGENT", "2-HIGH"))).select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'F' or o_orderpriority = '5-LOW' and o_totalprice < 50000")
def precedence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").where((c("o_orderstatus") == "F") | (c("o_orderpriority") == "5-LOW") & (c("o_totalprice") < 50000)).select("o_orderkey")


@query("""select p_partkey, p_name from part where p_name ilike '%RED%' and p_size between 5 and 40 and p_type in ('ECONOMY', 'SMALL', 'PROMO')
  and p_brand not in ('Brand#1', 'Brand#2') and p_retailprice is not null and not (p_name is null)""")
def in_notin_between_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keep = tsql.like_ci("p_name", "%RED%") & c("p_size").between(5, 40) & c("p_type").isin("ECONOMY", "SMALL", "PROMO") & ~c("p_brand").isin("Brand#1", "Brand#2") & c("p_retailprice").isNotNull() & c("p_name").isNotNull()
    return table(spark, sf_dir, "part").where(keep).select("p_partkey", "p_name")


@query("select _output as output, count(*) as n, min(o_orderkey) as first_key from (select *, case when o_totalprice > 400000 then 'large' when o_orderstatus = 'O' then 'open' else 'default' end as _output from orders) group by _output")
def conditional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = select.split(table(spark, sf_dir, "orders"), [("large", F.col("o_totalprice") > 400000), ("open", F.col("o_orderstatus") == "O")])
    return routed.groupBy(F.col("_output").alias("output")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("select o_orderkey from orders where o_orderdate >= timestamp '1998-01-01' and cast(substr(o_orderpriority, 1, 1) as int) = cast('1' as int)")
def implicit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.substring("o_orderpriority", 1, 1).cast("int") == F.lit("1").cast("int"))).select("o_orderkey")


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate, o_orderpriority, 1 as is_current, cast(null as varchar) as note, 13.5 / 100  as rate from orders")
def star_and_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").alias("a").select("a.*")
    return df.withColumns({"o_orderdate": F.col("o_orderdate").cast("date"), "is_current": F.lit(1), "note": F.lit(None).cast("string"), "rate": F.lit(0.135)})


# --- joins ----------------------------------------------------------------------------------------------


@query("""with l as (select nullif(o_custkey % 50, 0) k, count(*) n from orders where o_orderstatus = 'F' group by 1),
  r as (select nullif(o_custkey % 60, 0) k, count(*) m from orders where o_orderstatus = 'O' group by 1)
  select l.k as k, n, m from l left join r on l.k is not distinct from r.k""")
def merge_join_null_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    left = orders.where("o_orderstatus = 'F'").groupBy(F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("k")).agg(F.count("*").alias("n"))
    right = orders.where("o_orderstatus = 'O'").groupBy(F.nullif(F.col("o_custkey") % 60, F.lit(0)).alias("k2")).agg(F.count("*").alias("m"))
    return joins.merge_join(left, right, [("k", "k2")], how=1).select("k", "n", "m")


@query("select o_orderkey, count(l_orderkey) as n_returned from orders left join lineitem on o_orderkey = l_orderkey and l_returnflag = 'R' group by o_orderkey")
def left_join_on_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_returnflag") == "R"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_returned"))


@query("""select a.l_orderkey, a.l_partkey, cast(a.l_quantity as double) as l_quantity, b.total from lineitem a join
  (select l_partkey, l_suppkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as total from lineitem group by 1, 2) b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey""")
def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    total = li.groupBy("l_partkey", "l_suppkey").agg(_total("l_quantity").alias("total"))
    return li.join(total, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_quantity", "total")


@query("""select l_orderkey, l_linenumber, l_suppkey, l_partkey, p_name from lineitem left join (select * from (select p_partkey % 1500 as k, p_name,
  row_number() over (partition by p_partkey % 1500 order by p_partkey) rn from part) where rn = 1) r on l_partkey = r.k""")
def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 1500)
    return joins.lookup(table(spark, sf_dir, "lineitem"), reference, [("l_partkey", "k")], ["p_name"], [F.asc("p_partkey")]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "p_name")


@query("select c_custkey, n_name from customer join nation on cast(ceil(c_acctbal / 1000) as bigint) * 2 = case when n_regionkey < 3 then n_nationkey else -1 end")
def computed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").withColumn("k", F.ceil(F.col("c_acctbal") / 1000) * 2)
    right = table(spark, sf_dir, "nation").withColumn("nk", F.when(F.col("n_regionkey") < 3, F.col("n_nationkey")).otherwise(-1).cast("long"))
    return left.join(joins.small(right), F.col("k") == F.col("nk")).select("c_custkey", "n_name")


@query("""select a.o_custkey, a.o_orderkey as a_key, b.o_orderkey as b_key from orders a join orders b
  on a.o_custkey = b.o_custkey and cast(a.o_orderdate as date) - 1 = cast(b.o_orderdate as date)""")
def shifted_date_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.select("o_custkey", F.col("o_orderkey").alias("a_key"), tsql.dateadd("day", -1, "o_orderdate").alias("d"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("b_key"), F.col("o_orderdate").cast("date").alias("d"))
    return a.join(b, ["o_custkey", "d"]).select("o_custkey", "a_key", "b_key")


@query("""with a as (select o_custkey % 40 g, min(nullif(o_orderstatus, 'P')) s, count(*) n from orders group by o_custkey % 40, o_orderstatus),
  b as (select o_custkey % 30 g, case when o_orderstatus = 'P' then '' else o_orderstatus end s, count(*) m from orders group by 1, 2)
  select a.g as g, coalesce(a.s, '') as s, n, m from a join b on coalesce(cast(a.g as varchar), '') = coalesce(cast(b.g as varchar), '') and coalesce(a.s, '') = coalesce(b.s, '')""")
def coalesce_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, status = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    a = o.groupBy((F.col("o_custkey") % 40).alias("g"), "o_orderstatus").agg(F.min(F.nullif(status, F.lit("P"))).alias("s"), F.count("*").alias("n"))
    b = o.groupBy((F.col("o_custkey") % 30).alias("g2"), F.when(status == "P", "").otherwise(status).alias("s2")).agg(F.count("*").alias("m"))
    on = joins.blank_equal([(F.col("g").cast("string"), F.col("g2").cast("string")), (F.col("s"), F.col("s2"))])
    return a.join(b, on).select("g", F.coalesce("s", F.lit("")).alias("s"), "n", "m")


@query("select c_custkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' and o_totalprice > 400000 where o_orderkey is null")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""select c_custkey, coalesce(n, 0) as n, total from customer left join (select o_custkey, count(*) n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) total from orders group by 1) on c_custkey = o_custkey""")
def agg_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), _total("o_totalprice").alias("total"))
    return table(spark, sf_dir, "customer").join(total, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query("select o.o_custkey, o.o_orderkey, o.o_totalprice from orders o join (select o_custkey, max(o_totalprice) m from orders group by 1) x on o.o_custkey = x.o_custkey and o.o_totalprice = x.m")
def argmax_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    most = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return o.join(most, ["o_custkey", "o_totalprice"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select a.n_name as customer_nation, b.n_name as supplier_nation, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey join nation a on c_nationkey = a.n_nationkey join nation b on s_nationkey = b.n_nationkey group by 1, 2""")
def role_playing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = lines.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.join(joins.small(a), "c_nationkey").join(joins.small(b), "s_nationkey").groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"))


@query("select o_orderkey, l_linenumber, l_partkey, l_suppkey from orders left join lineitem on o_orderkey = l_orderkey where l_quantity > 45")
def outer_to_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").where("l_quantity > 45").select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as most from customer")
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    return table(spark, sf_dir, "customer").join(most, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "most")


@query("select l_returnflag, p_type, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2")
def salted_hot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_orderkey", "l_linenumber")
    both = joins.salted_join(li, table(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_partkey"])
    return both.groupBy("l_returnflag", "p_type").agg(F.count("*").alias("n"))


# --- aggregates -----------------------------------------------------------------------------------------


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total from lineitem group by 1")
def sum_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(_total("l_extendedprice").alias("total"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, count(nullif(o_custkey % 3, 0)) as n_key from orders group by 1, 2")
def count_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count(F.nullif(F.col("o_custkey") % 3, F.lit(0))).alias("n_key"))


@query("select o_custkey, count(distinct o_orderpriority) as kinds from orders group by 1 having count(distinct o_orderpriority) >= 4")
def count_distinct_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds")).where("kinds >= 4")


@query("""select o_custkey, min(coalesce(case when o_orderstatus = 'F' then cast(o_orderdate as date) end, date '2050-01-01')) as first_done,
  max(case when o_orderstatus = 'F' then cast(o_orderdate as date) end) as last_done from orders group by 1""")
def sentinel_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.coalesce(done, F.lit(tsql.LATEST))).alias("first_done"), F.max(done).alias("last_done"))


@query("""select o_custkey, max(case when o_orderstatus = 'F' then o_totalprice end) as max_f, max(case when o_orderstatus = 'O' then o_totalprice end) as max_o,
  max(case when o_orderstatus = 'P' then o_totalprice end) as max_p from orders group by 1""")
def max_case_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(f"max_{s.lower()}") for s in "FOP"])


@query("select l_suppkey, cast(sum(coalesce(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(18,2)) end, 0)) as double) as returned from lineitem group by 1")
def sum_isnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice").cast(_MONEY))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(tsql.isnull(x, F.lit(0), _MONEY)).cast("double").alias("returned"))


@query("""select o_orderkey, cast(coalesce(sum(cast(l_extendedprice as decimal(18,2))) - paid, sum(cast(l_extendedprice as decimal(18,2)))) as double) as due from
  (select o_orderkey, cast(case when o_orderstatus = 'F' then o_totalprice end as decimal(18,2)) as paid from orders) join lineitem on o_orderkey = l_orderkey group by o_orderkey, paid""")
def agg_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).cast(_MONEY).alias("paid"))
    total = F.sum(F.col("l_extendedprice").cast(_MONEY))
    return o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "paid").agg(F.coalesce(total - F.col("paid"), total).cast("double").alias("due")).select("o_orderkey", "due")


@query("select coalesce(max(o_orderkey), -1) as most, count(*) as n from orders where o_orderstatus = 'X'")
def global_agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'X'").agg(F.coalesce(F.max("o_orderkey"), F.lit(-1)).alias("most"), F.count("*").alias("n"))


@query("select o_custkey, o_orderpriority from orders group by 1, 2")
def group_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()


@query("select o_orderpriority, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderpriority, o_orderstatus order by o_orderkey) rn from orders) where rn = 1")
def sort_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.sort(table(spark, sf_dir, "orders"), {"o_orderstatus": -2, "o_orderpriority": 1, "o_orderkey": 0}, drop_duplicates=True, tie_break=["o_orderkey"])
    return out.select("o_orderpriority", "o_orderstatus", "o_orderkey")


# --- sets and sorts -------------------------------------------------------------------------------------


@query("select o_custkey, o_orderpriority from orders where o_orderstatus = 'F' union select o_custkey, o_orderpriority from orders where o_orderstatus = 'O'")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    a, b = (o.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FO")
    return select.union_by_position(a, b, distinct=True)


@query("select o_orderkey as id, o_totalprice as amount from orders where o_orderstatus = 'F' union all select l_orderkey, l_extendedprice from lineitem where l_returnflag = 'A'")
def union_all_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    return select.union_by_position(a, table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_extendedprice"))


@query("select k, o_orderkey from (select nullif(o_custkey % 5, 0) as k, o_orderkey from orders) order by k nulls first, o_orderkey limit 100")
def sorted_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k"), "o_orderkey")
    return select.sort(df, {"k": 1, "o_orderkey": 2}).limit(100)  # TOP 100 is what the query asks for
