"""What keeps work and memory from growing with one task or the driver: rows dealt over tasks, sizes that are not guessed."""

from __future__ import annotations

import io
import os
from contextlib import redirect_stdout
from glob import glob

from pyspark.sql import functions as F

from tidemill import folders
from tidemill.folders import kept, shared_root
from tidemill.operators import joins, scopes, sqltext
from tidemill.plans import metadata, scripts
from tidemill.sources import packages


def size(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_repeated_rows_of_a_salted_join_are_not_broadcast(spark):
    left, right = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    assert "Broadcast" in plan(left.join(right, "k"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in plan(joins.salted_join(left, right, ["k"], how))
    assert joins.salted_join(left, right, ["k"]).count() == 10


def test_select_lists_leave_out_called_procedures(spark):
    stated = sqltext.statements(spark.createDataFrame([("s", "select a.x from t a; exec dbo.p; insert into u exec dbo.q")], "script string, sql string"))
    sources = lambda **kw: sorted((r.number, r.source_table, r.source_column) for r in scopes.column_sources(stated, **kw).collect())
    assert sources(called=False) == [(1, "T", "X")]
    assert sources() == [(1, "T", "X"), (2, "DBO.P", "*"), (3, "DBO.Q", "*")]


def test_texts_are_dealt_over_tasks(spark):
    few = spark.range(12_000).coalesce(1).selectExpr("id as script", "concat('select a.x from t', id, ' a; exec p') as sql")
    stated = sqltext.statements(few)
    at = stated.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in at) == 24_000 and len(at) >= 3 and max(r["count"] for r in at) < 12_000


def test_facts_of_texts_have_no_guessed_size(spark):
    # a row of text becomes many, which a plan's estimate does not see
    stated = sqltext.statements(spark.createDataFrame([("s", "select a.x from t a join u b on a.i = b.i")], "script string, sql string"))
    for made in (sqltext.tables(stated), scopes.facts(stated), sqltext.join_conditions(stated)):
        assert size(made) > 1 << 40


def test_alias_of_several_tables_and_unknown_alias_in_joins(spark):
    sql = "select 1 from b x join a x on x.i = z.i join c y on y.j = x.j and y.j = x.j"
    stated = sqltext.statements(spark.createDataFrame([(None, sql), (None, sql)], "script string, sql string"))
    got = sorted((r.left_table, r.left_column, r.right_table) for r in sqltext.join_conditions(stated).collect())
    assert got == [("A", "I", "Z"), ("C", "J", "A")]
    assert sorted((r.alias, r.table, r.column) for r in sqltext.join_keys(stated, mode="all_refs").collect()) == [("X", "A", "I"), ("X", "A", "J"), ("Y", "C", "J"), ("Z", "Z", "I")]


def test_packages_are_dealt_and_their_catalogs_have_no_guessed_size(spark):
    few = spark.range(4_100).coalesce(1).selectExpr("concat(id, '.dtsx') as package", "'<a>' as text")
    found = packages.catalogs(few)
    assert size(found["columns"]) > 1 << 40
    info = found["package_info"]
    assert info.count() == 4_100 and len(info.groupBy("package").count().where("count > 1").take(1)) == 0
    written = max(glob(f"{shared_root(spark).removeprefix('file:')}/tidemill-catalogs-*"), key=os.path.getmtime)
    assert len(glob(f"{written}/catalog=package_info/*.parquet")) >= 2


def test_statements_scan_a_script_once(monkeypatch):
    seen, scan = [], sqltext.scan
    monkeypatch.setattr(sqltext, "scan", lambda sql, blanks=False: seen.append(len(sql)) or scan(sql, blanks))
    sql = "select a.x, b.y as z from t a join u b on a.i = b.i;\nexec p\nGO\nupdate t set x = 1"
    assert [(r[0], r[2], r[3]) for r in sqltext.stated_rows(sql)] == [(1, "SELECT", None), (2, "EXEC", "P"), (3, "UPDATE", "T")]
    assert sum(seen) == len(sql)
    # what the text before leaves open, and what a cut at the ends changes, is scanned anew
    assert [r[2:] for r in sqltext.stated_rows("select (1;exec p; insert into[ \nGO\n")] == [("SELECT", None), ("EXEC", "P"), ("INSERT", " \nGO")]
    seen.clear()
    assert [r[2] for r in sqltext.list_rows("select a.x + 1 as y, 'z' from t a")] == ["A.X + 1", "'Z'"]
    assert len(seen) == 1


def test_table_functions_cut_scripts_once(spark):
    made = scripts.facts_from_sql(spark, "/root/testdata/sf0.001")
    shown = plan(made)
    assert "split_statements" not in shown and "Join" not in shown.replace("lateral", "")


def test_rows_of_a_statement_are_dealt_once(spark):
    rows = spark.range(40).selectExpr("cast(id % 7 as string) as a", "id % 3 as b", "id as c").repartition(5, "a", "b")
    at = kept(rows)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    both = kept(at.join(at.select("a", "b", "c", F.lit(1).alias("one")), ["a", "b", "c"], "left"))
    for made in (at, both):
        assert made.rdd.getNumPartitions() == 5 and "Exchange" not in plan(made.groupBy("a", "b", "c").count())
    assert both.count() == 40
    assert before == (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition"))


def test_columns_of_statements_come_without_shuffles_but_the_first(spark):
    few = spark.range(300).selectExpr("concat('s', id) as script", "'select a.*, b.y as z from t a join (select * from u) b on a.i = b.i; exec p' as sql")
    catalog = spark.createDataFrame([("T", "X", 1), ("T", "Y", 2)], "table string, column string, position int")
    found = scopes.resolve(sqltext.statements(few), catalog=catalog)
    assert "Exchange" not in plan(found.groupBy("script", "number", "position").count())
    got = {tuple(r) for r in found.where("script = 's7'").select("number", "position", "source_table", "source_column", "confidence").collect()}
    assert got == {(1, 0, "T", "X", "exact"), (1, 1, "T", "Y", "exact"), (1, 2, "U", "Y", "assumed"), (2, 0, "P", "*", "exact")}
    assert found.count() == 1_200


def test_packages_are_made_of_keys_that_are_dealt(spark, tmp_path, monkeypatch):
    # what a task of the scan writes for a shuffle, it holds: texts there would grow with the row group
    spark.range(2_100).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    given = []
    monkeypatch.setattr(packages, "spread", lambda df, *by, **kw: given.append(df) or folders.spread(df, *by, **kw))
    assert metadata.package_connections(spark, str(tmp_path)).count() == 2 * 2_100
    shown = plan(given[0])
    assert shown.count("Exchange") == 1 and "Executable" not in shown[shown.index("Exchange") :]


def test_rows_that_lie_well_are_not_dealt_again(spark):
    assert "Exchange" not in plan(folders.spread(spark.range(0, 400, 1, 4), "id", rows=100))
    assert "Exchange" in plan(folders.spread(spark.range(0, 400, 1, 2), "id", rows=100))
    assert folders.spread(spark.range(0, 400, 1, 2), "id", rows=100).rdd.getNumPartitions() == 4


def test_scripts_are_made_of_keys_that_are_dealt(spark, tmp_path):
    spark.range(30_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    at = str(tmp_path)
    for made in (metadata.statements(spark, at), metadata.refined_sql(spark, at), scripts._stated(spark, at, "select a.x from t", F.col("k"), " a")):
        shown = plan(made)
        assert shown.count("Exchange") == 1 and "select" not in shown[shown.index("Exchange") :]
