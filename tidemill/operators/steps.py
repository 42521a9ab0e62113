"""Lineage over the statements of a script: which step reads what another wrote, and where a written column comes from in the end.

A read of a table is reached by the writes before it that nothing has wiped out since: TRUNCATE, DROP, CREATE and
SELECT INTO wipe a table out (the last one writes it too), INSERT and UPDATE add to what is there, as does DELETE take from it.
Steps are rows, reads meet writes by joins on the table's name and the statement's number, and sources are followed through tables by one
join for each step of the longest chain. A step reads only what earlier ones wrote, so chains end.

Defined results: names match as written, in capitals and without brackets; a table that no earlier step wrote is a
source as it is; a column that a reaching write does not set is the table's own; a script without writes has no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.folders import checkpoint

from . import scopes

WIPES = ("TRUNCATE", "DROP", "CREATE TABLE", "SELECT INTO")
WRITES = ("INSERT", "UPDATE", "SELECT INTO", "CREATE VIEW", "CREATE TABLE", "MERGE")


def _reaching(reads: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """reads (key, number, table) with `writer`: the numbers of the writes that reach each."""
    wiped = targets.where(F.col("operation").isin(*WIPES)).select(key, F.col("table"), F.col("number").alias("_wipe"))
    last = reads.select(key, "number", "table").distinct().join(wiped, [key, "table"]).where("_wipe < number").groupBy(key, "number", "table").agg(F.max("_wipe").alias("_wipe"))
    wrote = targets.where(F.col("operation").isin(*WRITES)).select(key, "table", F.col("number").alias("writer"))
    both = reads.join(last, [key, "number", "table"], "left").join(wrote, [key, "table"])
    return both.where((F.col("writer") < F.col("number")) & (F.col("writer") >= F.coalesce("_wipe", F.lit(0)))).drop("_wipe")


def _facts(stated: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    found = checkpoint(scopes.facts(stated, key))
    targets = found.where("fact = 'target'").select(key, "number", F.col("name").alias("table"), F.col("alias").alias("operation"), "names")
    return found, checkpoint(targets)


def step_edges(stated: DataFrame, key: str = "script") -> DataFrame:
    """key, writer, number, table: statement `number` reads of `table` what statement `writer` wrote."""
    found, targets = _facts(stated, key)
    reads = scopes.tables_of(found, key).where("kind = 'table'").select(key, "number", "table").distinct()
    return _reaching(reads, targets, key).select(key, "writer", "number", "table")


def written_columns(found: DataFrame, targets: DataFrame, key: str, catalog: DataFrame | None = None) -> DataFrame:
    """key, number, table, column, source_table, source_column, confidence of each column that a step writes, from its own statement."""
    rows = scopes.resolve_facts(found, key, catalog).join(targets.where(F.col("operation").isin(*WRITES)), [key, "number"])
    # INSERT names its columns by place: by its own list, else by the table's columns where they are known
    column = F.coalesce(F.get("names", F.col("position")), "alias")
    if catalog is not None:
        known = catalog.select("table", (F.col("position") - 1).alias("position"), F.col("column").alias("_known"))
        rows = rows.join(known, ["table", "position"], "left")
        column = F.when((F.col("operation") == "INSERT") & F.col("names").isNull(), F.coalesce("_known", "alias")).otherwise(column)
    return rows.select(key, "number", "table", column.alias("column"), "source_table", "source_column", "confidence").distinct()


def end_to_end(stated: DataFrame, key: str = "script", catalog: DataFrame | None = None) -> DataFrame:
    """key, number, table, column, source_table, source_column, confidence, hops of each column that a step writes, where the
    source is one that no earlier step of the script wrote; hops: the steps between.

    Without a source (constants) there is no row. Of several ways to one source the surest counts, then the shortest."""
    found, targets = _facts(stated, key)
    own = checkpoint(written_columns(found, targets, key, catalog).where("source_column is not null").withColumn("sure", F.array_position(F.array(*map(F.lit, scopes.SURE)), F.col("confidence")).cast("int")).drop("confidence"))
    reads = own.select(key, "number", F.col("source_table").alias("table")).where("`table` is not null").distinct()
    reach = checkpoint(_reaching(reads, targets, key).select(key, F.col("number").alias("_at"), F.col("table").alias("source_table"), F.col("writer")))
    wrote = own.select(key, F.col("number").alias("writer"), F.col("table").alias("source_table"), F.col("column").alias("source_column"), F.col("source_table").alias("_table"), F.col("source_column").alias("_column"), F.col("sure").alias("_sure"))
    # what a statement takes of a table: the columns that reaching writes set, each with its source
    sets = reach.join(wrote, [key, "writer", "source_table"])
    node = [key, "number", "table", "column"]
    front = own.select(*node, F.col("number").alias("_at"), "source_table", "source_column", "sure")
    hops, ends = 0, None
    while True:
        on = [key, "_at", "source_table", "source_column"]
        both = checkpoint(front.join(sets, on, "left"))
        done = both.where("writer is null").select(*node, "source_table", "source_column", "sure", F.lit(hops).alias("hops"))
        ends = done if ends is None else ends.unionByName(done)
        front = both.where("writer is not null").select(*node, F.col("writer").alias("_at"), F.col("_table").alias("source_table"), F.col("_column").alias("source_column"), F.greatest("sure", "_sure").alias("sure")).distinct()
        hops += 1
        if front.isEmpty():
            break
    best = ends.groupBy(*node, "source_table", "source_column").agg(F.min(F.struct("sure", "hops")).alias("b"))
    return best.select(*node, "source_table", "source_column", F.element_at(F.array(*map(F.lit, scopes.SURE)), F.col("b.sure")).alias("confidence"), F.col("b.hops").alias("hops"))
