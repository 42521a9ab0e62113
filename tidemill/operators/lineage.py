"""Column lineage over data-flow graphs as joins: edges, levels, propagation, gaps.

All tables carry (package, flow), so equal names in other flows do not mix. Loops run once for each
level of the graphs, over all packages together, and cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.folders import checkpoint as _checkpoint

FLOW = ("package", "flow")


def edges(ports: DataFrame, paths: DataFrame) -> DataFrame:
    """package, flow, source, target: components joined by paths between their ports."""
    out = ports.select(*FLOW, F.col("ref_id").alias("start_ref"), F.col("component").alias("source"))
    in_ = ports.select(*FLOW, F.col("ref_id").alias("end_ref"), F.col("component").alias("target"))
    return paths.join(out, [*FLOW, "start_ref"]).join(in_, [*FLOW, "end_ref"]).select(*FLOW, "source", "target").distinct()


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(package, flow, node) -> with level: the longest way from a node without inputs. Nodes on a
    cycle, or behind one, have none."""
    keys = [*FLOW, "node"]
    todo = _checkpoint(nodes.select(*keys).distinct())
    open_ = _checkpoint(edges.select(*FLOW, "source", F.col("target").alias("node")).distinct())
    done, level = None, 0
    while True:
        ready = _checkpoint(todo.join(open_, keys, "left_anti"))
        if ready.isEmpty():
            break
        placed = ready.withColumn("level", F.lit(level))
        done = placed if done is None else done.unionByName(placed)
        todo = _checkpoint(todo.join(ready, keys, "left_anti"))
        open_ = _checkpoint(open_.join(ready.withColumnRenamed("node", "source"), [*FLOW, "source"], "left_anti"))
        level += 1
    rest = todo.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """seeds(package, flow, lineage_id, source_table, source_column, expression) and
    links(package, flow, from_id, to_id, step) -> sources of every lineage id.

    A source counts once for each id, with the expression of its first way there; an empty step is a
    column that passes through."""
    source = ["source_table", "source_column"]
    found = _checkpoint(seeds.groupBy(*FLOW, "lineage_id", *source).agg(F.min("expression").alias("expression")))
    front = found
    while True:
        step = F.when(F.coalesce("step", F.lit("")) == "", F.col("expression")).otherwise(F.concat_ws(" -> ", "expression", "step"))
        nxt = front.join(links, [front[c] == links[c] for c in FLOW] + [front["lineage_id"] == links["from_id"]]).select(*[front[c] for c in FLOW], links["to_id"].alias("lineage_id"), *source, step.alias("expression"))
        nxt = nxt.groupBy(*FLOW, "lineage_id", *source).agg(F.min("expression").alias("expression"))
        known = found.select(*FLOW, "lineage_id", *source)
        front = _checkpoint(nxt.join(known, [nxt[c].eqNullSafe(known[c]) for c in known.columns], "left_anti"))
        if front.isEmpty():
            return found
        found = _checkpoint(found.unionByName(front))


def destinations(targets: DataFrame, sources: DataFrame, by_name: DataFrame | None = None) -> DataFrame:
    """targets(package, flow, target_table, target_column, lineage_id) with their sources: confidence exact;
    inferred where the id is unknown and by_name(package, flow, name, source_table, source_column) has the
    column's name, under its expression if it has that column; none without a source."""
    keys = [*FLOW, "lineage_id"]
    exact = targets.join(sources, keys).select(*FLOW, "target_table", "target_column", "source_table", "source_column", "expression", F.lit("exact").alias("confidence"))
    left = targets.join(sources.select(*keys).distinct(), keys, "left_anti")
    if by_name is None:
        by_name = sources.select(*FLOW, F.col("source_column").alias("name"), "source_table", "source_column").limit(0)
    if "expression" not in by_name.columns:
        by_name = by_name.withColumn("expression", F.lit(None).cast("string"))
    name = F.upper("target_column") == F.upper("name")
    guess = left.join(by_name, [left[c] == by_name[c] for c in FLOW] + [name], "left")
    found = F.col("source_table").isNotNull()
    rest = guess.select(*[left[c] for c in FLOW], "target_table", "target_column", "source_table", "source_column", "expression", F.when(found, "inferred").otherwise("none").alias("confidence"))
    return exact.unionByName(rest)


def last_sources(lineage: DataFrame, order: str = "ordinal") -> DataFrame:
    """Of each target column the source that comes last by `order` (a unique number): one row each."""
    keys = [*FLOW, "target_table", "target_column"]
    rest = [c for c in lineage.columns if c not in keys]
    return lineage.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def unused_columns(source_columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """source_columns(package, flow, source_table, source_column) that no destination uses, for each table:
    number and sorted list."""
    used = lineage.select(*FLOW, "source_table", "source_column").where(F.col("source_table").isNotNull()).distinct()
    free = source_columns.join(used, [*FLOW, "source_table", "source_column"], "left_anti")
    return free.groupBy(*FLOW, "source_table").agg(F.count("*").alias("unused"), F.array_join(F.array_sort(F.collect_set("source_column")), ", ").alias("columns"))


def coverage(lineage: DataFrame) -> DataFrame:
    """Share of each target table's columns that have a table source."""
    columns = lineage.groupBy(*FLOW, "target_table", "target_column").agg(F.max(F.col("source_table").isNotNull().cast("int")).alias("known"))
    return columns.groupBy(*FLOW, "target_table").agg(F.count("*").alias("columns"), F.sum("known").alias("mapped")).withColumn("coverage", F.round(F.col("mapped") / F.col("columns"), 4))
