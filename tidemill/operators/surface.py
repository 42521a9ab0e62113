"""Facts of SQL text from SQL itself: table functions for lateral joins.

    surface.register(spark)
    spark.sql("select s.script, x.* from scripts s, lateral split_statements(s.sql) x")

Each reads its text once. What relates facts to one another (columns to their sources, steps to steps) is joins over whole
tables: operators.scopes and operators.steps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import sqltext


class SplitStatements:
    """number, statement, operation, target of a script's statements; a null script has none."""

    def eval(self, sql: str | None) -> Iterator[tuple]:
        yield from sqltext.stated_rows(sql or "")


class StatementTables:
    """table, alias of what a statement reads after FROM, JOIN and APPLY; CTEs are no tables."""

    def eval(self, sql: str | None) -> Iterator[tuple]:
        yield from dict.fromkeys(sqltext.read_tables(sqltext.scan(sql or "")))


class JoinPairs:
    """join_type, left_alias, left_column, operator, right_alias, right_column of the comparisons in ON parts."""

    def eval(self, sql: str | None) -> Iterator[tuple]:
        yield from dict.fromkeys(sqltext.join_pairs(sql or ""))


class SelectList:
    """position, alias, expression, kind of the columns of the outermost SELECT."""

    def eval(self, sql: str | None) -> Iterator[tuple]:
        yield from sqltext.list_rows(sql or "")


FUNCTIONS = {
    "split_statements": (SplitStatements, "number int, statement string, operation string, target string"),
    "statement_tables": (StatementTables, "table string, alias string"),
    "join_pairs": (JoinPairs, "join_type string, left_alias string, left_column string, operator string, right_alias string, right_column string"),
    "select_list": (SelectList, "position int, alias string, expression string, kind string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session under their names."""
    for name, (handler, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=columns))
