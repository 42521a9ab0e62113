"""Queries over graphs whose edges follow from the rows' numbers: twelve nodes for each supplier, edges by its key, for every fifth
a cycle besides. The SQL twins walk the same graphs by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import lineage

from .registry import Registry, table

query = Registry()

#: The edges, by supplier s and node i, for both sides.
_NEXT = ("i + 1 + (s * 7 + i) % 3", "i + 2 + (s + i * i) % 4")
_GRAPH = f"""
with recursive sup as (select s_suppkey as s from supplier), node as (select s, i from sup, lateral (select unnest(range(12)) as i)),
e as (select distinct s, i, j from (select s, i, {_NEXT[0]} as j from node union all select s, i, {_NEXT[1]} from node) where j < 12)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    return sup.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))


def _flow(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat(F.lit("p"), "s").alias("package"), F.lit("f").alias("flow"), *(F.expr(c) for c in columns))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _nodes(spark, sf_dir).select("s", "i", F.explode(F.array(*map(F.expr, _NEXT))).alias("j"))
    return both.where("j < 12").distinct()


@query(_GRAPH + """,
walk as (select s, i as n, 0 as depth from node where not exists (select 1 from e where e.s = node.s and e.j = node.i)
  union select e.s, e.j, depth + 1 from walk join e on e.s = walk.s and e.i = walk.n)
select 'p' || s as package, 'n' || n as node, cast(max(depth) as int) as level from walk group by s, n
union all select 'p' || s, unnest(['c0', 'c1', 'c2']), null from sup where s % 5 = 0
""")
def generated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest way to each node; nodes on a cycle and behind one have none."""
    nodes = _flow(_nodes(spark, sf_dir), "concat('n', i) as node")
    edges = _flow(_edges(spark, sf_dir), "concat('n', i) as source", "concat('n', j) as target")
    fifth = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("s"))
    ring = fifth.select("s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("c0", "c1"), ("c1", "c0"), ("c1", "c2"))))).alias("x"))
    nodes = nodes.unionByName(_flow(ring.select("s", F.explode(F.array("x.a", "x.b")).alias("node")), "node"))
    edges = edges.unionByName(_flow(ring, "x.a as source", "x.b as target"))
    return lineage.levels(nodes, edges).select("package", "node", "level")


_REACHED = _GRAPH + """,
reach as (select s, i as seed, i as n from node where i < 3 union select e.s, seed, e.j from reach join e on e.s = reach.s and e.i = reach.n)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _flow(_nodes(spark, sf_dir).where("i < 3"), "concat('n', i) as lineage_id", "concat('T', i) as source_table", "concat('C', i) as source_column", "'column' as expression")
    links = _flow(_edges(spark, sf_dir), "concat('n', i) as from_id", "concat('n', j) as to_id", "if(j % 2 = 0, '', concat('S', j)) as step")
    return lineage.propagate(seeds, links)


@query(_REACHED + "select 'p' || s as package, 'n' || n as lineage_id, 'T' || seed as source_table, 'C' || seed as source_column from reach")
def generated_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every node, over however many ways."""
    return _found(spark, sf_dir).select("package", "lineage_id", "source_table", "source_column")


@query(_REACHED + """,
target as (select s, 'R' || i % 2 as t, 'K' || i as c, 'n' || i as id from node where i >= 5 union all select s, 'R0', 'C1', 'gone' from sup union all select s, 'R1', 'NEW', 'new' from sup),
known as (select t.s, t, c, coalesce(bool_or(r.s is not null), false) or c = 'C1' as yes from target t left join reach r on r.s = t.s and 'n' || r.n = t.id group by t.s, t, c)
select 'p' || s as package, t as target_table, count(*) as columns, count(*) filter (yes) as mapped, round(count(*) filter (yes) / count(*), 4) as coverage from known group by s, t
""")
def generated_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the columns of two tables that have a source: by id, by name where the id is unknown, or not at all."""
    nodes = _nodes(spark, sf_dir)
    targets = _flow(nodes.where("i >= 5"), "concat('R', i % 2) as target_table", "concat('K', i) as target_column", "concat('n', i) as lineage_id")
    for t, c, i in (("R0", "C1", "gone"), ("R1", "NEW", "new")):
        targets = targets.unionByName(_flow(nodes.where("i = 0"), f"'{t}' as target_table", f"'{c}' as target_column", f"'{i}' as lineage_id"))
    by_name = _flow(nodes.where("i < 3"), "concat('C', i) as name", "concat('T', i) as source_table", "concat('C', i) as source_column")
    return lineage.coverage(lineage.destinations(targets, _found(spark, sf_dir), by_name)).select("package", "target_table", "columns", "mapped", "coverage")
