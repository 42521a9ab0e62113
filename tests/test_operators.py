from __future__ import annotations

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import dml, joins, lineage, scopes, select, sqltext
from tidemill.sources import packages, tables
from tidemill.streaming import reload


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_per_key_uses_a_group_limit(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 1, "c"), (None, 1, "d")], "k int, t int, v string")
    got = select.first_per_key(df, ["k"], [F.desc("t"), F.asc("v")])
    assert rows(got) == [(1, 3, "b"), (2, 1, "c"), (None, 1, "d")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_split_takes_the_first_case(spark):
    df = select.split(spark.range(6), [("small", F.col("id") < 2), ("even", F.col("id") % 2 == 0)])
    assert rows(df) == [(0, "small"), (1, "small"), (2, "even"), (3, "default"), (4, "even"), (5, "default")]


def test_sort_keys_have_sign_and_position(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, "a")], "n int, s string")
    assert [r.n for r in select.sort(df, {"n": -2, "s": 1, "other": 0}).collect()] == [1, 4, 3, 2]


def test_error_rows(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    good, bad = select.redirect_errors(df, "s", "int", "n")
    assert rows(good) == [("1", 1), (None, None)] and rows(bad) == [("x", "s")]
    with pytest.raises(Exception):
        select.convert(df, {"n": ("s", "int")}).collect()
    assert rows(select.convert(df, {"n": ("s", "int")}, "ignore")) == [("1", 1), ("x", None), (None, None)]


def test_merge_join_nulls(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(1, "x"), (None, "n")], "j int, v string")
    got = joins.merge_join(a, b, [("k", "j")], "left")
    assert rows(got) == [(1, 1, "x"), (None, None, "n")]
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(joins.merge_join(a, b, [("k", "j")], 2, nulls_equal=False)) == [(1, 1, "x")]


def test_lookup_modes(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    ref = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "r int, v string, o int")
    assert rows(joins.lookup(df, ref, [("k", "r")], ["v"], [F.asc("o")])) == [(1, "a"), (2, None)]
    assert rows(joins.lookup(df, ref, [("k", "r")], ["v"], [F.asc("o")], "drop")) == [(1, "a")]
    with pytest.raises(Exception, match="no match"):
        joins.lookup(df, ref, [("k", "r")], ["v"], [F.asc("o")], "fail").collect()


def test_broadcast_needs_a_small_side(spark):
    df = spark.range(1000)
    assert "broadcast" in joins.small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.small(df, limit=10)._jdf.queryExecution().logical().toString().lower()


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 99)), max_size=25))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_semi_and_anti_make_up_the_input(spark, pairs):
    left = spark.createDataFrame(pairs, "k int, v int")
    right = spark.createDataFrame([(1,), (3,)], "k int")
    semi, anti = joins.salted_join(left, right, ["k"], "left_semi", 3), joins.salted_join(left, right, ["k"], "left_anti", 3)
    assert rows(semi.union(anti)) == rows(left)
    assert rows(joins.salted_join(left, right, ["k"], "inner", 3)) == rows(semi)


def test_update_from_picks_one_match(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    s = spark.createDataFrame([(1, 9.0, 1), (1, 8.0, 2), (3, 7.0, 1)], "k int, w double, o int")
    assert rows(dml.update_from(t, s, ["k"], {"v": "w"}, [F.desc("o")])) == [(1, "a", 8.0), (2, "b", 2.0)]
    null = spark.createDataFrame([(1, None, 3)], "k int, w double, o int")
    assert rows(dml.update_from(t, null, ["k"], {"v": "w"}, [F.desc("o")])) == [(1, "a", None), (2, "b", 2.0)]


def test_scd2_twice_changes_nothing_more(spark):
    cur = spark.createDataFrame([(1, "x", 1, 1), (2, "y", 2, 1), (3, None, 3, 1), (9, "old", 0, 0)], "k int, a string, p int, is_current int")
    new = spark.createDataFrame([(1, "x", 10), (2, "z", 20), (3, "", 30), (4, "n", 40)], "k int, a string, p int")
    once = dml.scd2(cur, new, ["k"], ["a"], ["p"])
    expected = [(1, "x", 10, 1), (2, "y", 2, 0), (2, "z", 20, 1), (3, None, 30, 1), (4, "n", 40, 1), (9, "old", 0, 0)]
    assert rows(once) == sorted(expected, key=str)
    assert rows(dml.scd2(once, new, ["k"], ["a"], ["p"])) == sorted(expected, key=str)


def brute_scd2(current, staged):
    """k, a tracked, p patched, current: by the rule as it is stated, null like blank."""
    norm = lambda *x: tuple("" if v is None else str(v) for v in x)
    least = lambda rows: min(rows, key=lambda r: tuple((v is not None, v) for v in r))
    versions, live = {}, {}
    for r in staged:
        versions.setdefault(norm(*r[:2]), []).append(r)
    for r in current:
        if r[3] == 1:
            live.setdefault(norm(*r[:2]), []).append(r)
    once = {v: least(x) for v, x in versions.items()}
    chosen = {}
    for v, r in once.items():
        rank = (v not in live, tuple((x is not None, x) for x in r))
        if v[0] not in chosen or rank < chosen[v[0]][0]:
            chosen[v[0]] = (rank, v, r)
    picked = {v: r for _, v, r in chosen.values()}
    out = [r for r in current if r[3] != 1]
    for v, x in live.items():
        for n, r in enumerate(sorted(x, key=lambda r: tuple((y is not None, y) for y in r))):
            out.append((*r[:2], picked[v][2], 1) if n == 0 and v in picked else (*r[:3], 0))
    return out + [(*r, 1) for v, r in picked.items() if v not in live]


@given(st.lists(st.tuples(st.sampled_from([None, "", "k", "l"]), st.sampled_from([None, "", "x", "y"]), st.integers(0, 2), st.sampled_from([0, 1, 1, None])), max_size=7), st.lists(st.tuples(st.sampled_from([None, "", "k", "l"]), st.sampled_from([None, "", "x", "y"]), st.integers(3, 5)), max_size=7))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_scd2_against_the_rule(spark, current, staged):
    cur = spark.createDataFrame(current, "k string, a string, p int, is_current int")
    new = spark.createDataFrame(staged, "k string, a string, p int")
    got = rows(dml.scd2(cur, new, ["k"], ["a"], ["p"]))
    assert got == sorted(brute_scd2(current, staged), key=str)
    keys = [k or "" for k, _, _, c in got if c == 1]
    assert len(keys) == len(set(keys)) or any(r[3] == 1 for r in current)


def test_names_of_helper_columns_are_the_users(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 4, 5)], "k int, _rn int, _salt int")
    assert rows(select.first_per_key(df, ["k"], [F.desc("_rn")])) == [(1, 4, 5)]
    assert rows(joins.salted_join(df, spark.createDataFrame([(1,)], "k int"), ["k"], "left_semi")) == [(1, 2, 3), (1, 4, 5)]
    good, bad = select.redirect_errors(spark.createDataFrame([("1", "u"), ("x", "v")], "s string, _bad string"), "s", "int", "n")
    assert rows(good) == [("1", "u", 1)] and rows(bad) == [("x", "v", "s")]


def test_aggregate_transformation(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 4)], "g string, v int")
    got = select.aggregate(df, ["g"], {"n": ("count", "*"), "nv": ("count", "v"), "d": ("count distinct", "v"), "s": ("sum", "v"), "m": ("average", "v"), "lo": ("minimum", "v"), "hi": ("maximum", "v")})
    assert rows(got) == sorted([("a", 3, 2, 1, 2, 1.0, 1, 1), (None, 1, 1, 1, 4, 4.0, 4, 4)], key=str)


def test_writers_and_single_rows(spark, tmp_path):
    at = str(tmp_path / "w.parquet")
    tables.append(spark.range(2), at)
    tables.append(spark.range(2, 5), at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [0, 1, 2, 3, 4]
    tables.truncate_load(spark.range(7, 9), at)
    assert sorted(r.id for r in spark.read.parquet(at).collect()) == [7, 8]
    t = tables.Tables(spark, str(tmp_path))
    assert t.exists("dbo.[W]") and not t.exists("dbo.absent")
    assert t.bind("select max(id) as m, count(*) as n from w", ["w"], {"User::top": "m", "User::rows": "n"}) == {"User::top": 8, "User::rows": 2}
    for sql in ("select id from w", "select id from w where id < 0"):
        with pytest.raises(ValueError):
            t.bind(sql, ["w"], {"User::x": "id"})
    assert rows(t.command("User::sql", {"User::sql": "select id from w where id > @[User::least]", "User::least": "7"}, ["w"])) == [(8,)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tidemill import folders

    assert folders.fresh(spark, "x") != folders.fresh(spark, "x")
    assert folders.checkpoint(spark.range(3)).count() == 3


def test_periods(spark, tmp_path):
    t = spark.createDataFrame([("202401", 1), ("202402", 2), (None, 3)], "p string, v int")
    n = spark.createDataFrame([("202402", 20), ("202403", 30)], "p string, v int")
    assert rows(dml.replace_period(t, n, "p")) == sorted([("202401", 1), ("202402", 20), ("202403", 30), (None, 3)], key=str)
    assert rows(dml.replace_period(t, n, "p", ["202402"])) == sorted([("202401", 1), ("202402", 20), (None, 3)], key=str)
    assert reload.rolling_periods(date(2024, 2, 10), 3) == ["202311", "202312", "202401", "202402"]
    at = str(tmp_path / "t")
    tables.reload_periods(t.where("p is not null"), at, "p")
    tables.reload_periods(n.where("p = '202402'"), at, "p")
    assert sorted(r.v for r in spark.read.parquet(at).collect()) == [1, 20]


def test_insert_and_mapping(spark):
    t = spark.createDataFrame([(1, "a", 1.0)], "k int, n string, v double")
    assert rows(dml.insert_select(t, spark.createDataFrame([(2, 7)], "x long, y int"))) == [(1, "a", 1.0), (2, "7", None)]
    with pytest.raises(ValueError):
        dml.insert_select(t, spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int"))
    assert rows(dml.map_columns(spark.createDataFrame([(5, "z")], "s1 int, s2 string"), t, {"s1": "k"})) == [(5, None, None)]


def graph(spark, pairs, columns):
    kind = ", ".join(f"{c} string" for c in columns.split())
    return spark.createDataFrame(pairs, kind).select(F.lit("p").alias("package"), F.lit("f").alias("flow"), "*")


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] < e[1]), max_size=10))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_levels_of_random_graphs(spark, pairs):
    nodes = graph(spark, [(str(i),) for i in range(7)], "node")
    got = {int(r.node): r.level for r in lineage.levels(nodes, graph(spark, [(str(a), str(b)) for a, b in pairs], "source target")).collect()}
    level = {i: 0 for i in range(7)}
    for i in range(7):
        level[i] = max([level[a] + 1 for a, b in pairs if b == i], default=0)
    assert got == level


def test_propagation_stops_on_cycles(spark):
    seeds = graph(spark, [("a", "t", "c", "column")], "lineage_id source_table source_column expression")
    links = graph(spark, [("a", "b", "S"), ("b", "a", "S"), ("b", "c", "")], "from_id to_id step")
    got = {r.lineage_id: r.expression for r in lineage.propagate(seeds, links).collect()}
    assert got == {"a": "column", "b": "column -> S", "c": "column -> S"}


def test_package_catalogs_and_lineage(spark):
    from tidemill.plans.metadata import PACKAGE, package_lineage

    found = packages.catalogs(spark.createDataFrame([("a.dtsx", PACKAGE.replace("§", "")), ("bad.dtsx", "<a>"), ("none.dtsx", None)], "package string, text string"))
    assert {n: df.count() for n, df in found.items()} == {"package_info": 3, "connections": 1, "variables": 1, "executables": 2, "constraints": 1, "components": 3, "properties": 3, "ports": 4, "columns": 6, "external_columns": 2, "paths": 2}
    text = found["connections"].first().connection_string
    assert "u1" not in text and "p1" not in text and "host1" in text
    assert rows(package_lineage(found).select("target_column", "source_table", "source_column")) == [("ID", "S", "ID"), ("TOTAL", "S", "AMOUNT")]
    assert found["package_info"].where("error is not null").count() == 2


def test_package_lineage_with_the_properties_that_real_packages_have(spark):
    from tidemill.plans.metadata import SECOND_PACKAGE, package_lineage

    found = packages.catalogs(spark.createDataFrame([("w.dtsx", SECOND_PACKAGE.replace("§", ""))], "package string, text string"))
    got = package_lineage(found).select("target_table", "target_column", "source_table", "source_column", "confidence")
    expected = [("DAY", "DBO.DAY", "d"), ("KIND", "DBO.KIND", "LABEL"), ("MERGED", "DBO.DAY", "d"), ("RATE", "RATES", "rate"), ("WEEK", "DBO.WEEK", "W_ID")]
    assert rows(got) == [("DBO.SUMMARY", *e, "exact") for e in expected]


def test_package_folder(spark, tmp_path):
    from tidemill.plans.metadata import PACKAGE

    (tmp_path / "z").mkdir()
    (tmp_path / "x.dtsx").write_text(PACKAGE)
    (tmp_path / "z" / "x.Dtsx").write_text(PACKAGE, encoding="utf-16")
    (tmp_path / "b.XML").write_bytes(b"<a>\xff</a>")
    (tmp_path / "x.txt").write_text("no")
    got = packages.read_packages(spark, str(tmp_path)).collect()
    assert [r.package for r in got] == ["b.XML", "x.dtsx", "z/x.Dtsx"] and got[0].text is None and "Daily" in got[2].text
    assert [r.package for r in packages.read_packages(spark, "file://" + str(tmp_path), ["z/x.Dtsx"]).collect()] == ["z/x.Dtsx"]
    uploaded = spark.createDataFrame([("u.dtsx", bytearray(PACKAGE.encode()))], "package string, content binary")
    assert packages.catalogs(packages.decode_packages(uploaded))["package_info"].first().name == "Daily"


def test_a_thousand_packages(spark):
    from tidemill.operators import flows
    from tidemill.plans.metadata import THIRD_PACKAGE

    texts = spark.range(1000).repartition(8).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("package"), F.replace(F.lit(THIRD_PACKAGE), F.lit("§"), F.col("id").cast("string")).alias("text"))
    got = flows.package_lineage(packages.catalogs(texts))
    assert got.count() == 10_000
    assert rows(got.where("package = 'p77' and target_column = 'WHY'").select("source_table", "source_column")) == [("DBO.ONE77", "Y"), ("DBO.TWO", "v")]


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("select 1; select 'a;b' -- c; d\n; ", ["select 1", "select 'a;b'"]),
        ("a\nGO\nb /* x; */ c", ["a", "b   c"]),
        ("select 'it''s; ok'", ["select 'it''s; ok'"]),
        ("/* a /* b; */ c; d */ select 1 from t", ["select 1 from t"]),
        ("select 'open; to the end", ["select 'open; to the end"]),
        ("go\n[a;b]; gone", ["[a;b]", "gone"]),
        ("", []),
        (None, []),
    ],
)
def test_statements(spark, sql, expected):
    got = sqltext.statements(spark.createDataFrame([("s", sql)], "script string, sql string"))
    assert [r.statement for r in got.orderBy("number").collect()] == expected


LONG = {
    "one": ("select a from t; " * 20_000, 20_000),
    "list": ("select " + "a.b, " * 60_000 + "c from t", 1),
    "quotes": ("select '" + "''" * 500_000 + "'", 1),
    "comment": ("/*" * 300_000 + " select 1", 0),
    "word": ("x" * 1_000_000, 1),
    "blank": (" " * 1_000_000, 0),
    "joins": ("select * from a " + "join b on a.x = b.y " * 10_000, 1),
}


@pytest.mark.parametrize("name", LONG)
def test_scripts_of_a_megabyte(spark, name):
    sql, n = LONG[name]
    stated = sqltext.statements(spark.createDataFrame([(1, sql)], "script int, sql string"))
    assert stated.count() == n
    for facts in (sqltext.tables, sqltext.select_list, scopes.column_sources, sqltext.join_conditions):
        facts(stated).count()
    assert spark.createDataFrame([(sql,)], "sql string").select(F.length(sqltext.refine(F.col("sql")))).first()[0] == len(sql)


def facts(spark, f, sql, *columns):
    stated = sqltext.statements(spark.createDataFrame([("s", sql)], "script string, sql string"))
    return rows(f(stated).select(*columns))


def test_select_lists_and_sources(spark):
    sql = "with q as (select i from base) select distinct top (3) 'a, b' as k, (select max(u.x) from u where u.i = q.i) m, q.i, y = -1, (r.z), [a b].c as [d e], null n from q join r on q.i = r.i"
    got = facts(spark, sqltext.select_list, sql, "position", "alias", "kind")
    assert got == [(0, "K", "LITERAL"), (1, "M", "SUBQUERY"), (2, "I", "COLUMN"), (3, "Y", "LITERAL"), (4, "Z", "COLUMN"), (5, "D E", "COLUMN"), (6, "N", "LITERAL")]
    assert ("M", "U", "X", "exact") in facts(spark, scopes.column_sources, sql, "alias", "source_table", "source_column", "confidence")
    union = "select a.x, a.y as z from t1 a union all select b.p, q from t2 b union select 1, 2 except select c.e, c.f from t3 c"
    assert facts(spark, scopes.column_sources, union, "alias", "source_table", "source_column") == [("X", "T1", "X"), ("X", "T2", "P"), ("Z", "T1", "Y"), ("Z", "T2", "Q")]
    assert facts(spark, sqltext.select_list, "select @v = a from t", "alias") == []
    assert facts(spark, scopes.column_sources, "select a", "source_table", "source_column", "confidence") == [(None, "A", "ambiguous")]


def test_joins_of_all_kinds(spark):
    sql = "select 1 from a left outer join b on a.x = b.y and a.z < b.w full join c c2 on (isnull(c2.i, 0) = a.i) and c2.k = a.k where a.p = a.q"
    got = facts(spark, sqltext.join_conditions, sql, "join_type", "left_table", "left_column", "operator", "right_table", "right_column")
    assert got == [("FULL", "C", "K", "=", "A", "K"), ("LEFT", "A", "X", "=", "B", "Y"), ("LEFT", "A", "Z", "<", "B", "W")]
    refs = lambda mode: facts(spark, lambda s: sqltext.join_keys(s, mode=mode), sql, "alias", "column")
    assert refs("pairs") == [("A", "K"), ("A", "X"), ("B", "Y"), ("C2", "K")]
    assert refs("all_refs") == [("A", "I"), ("A", "K"), ("A", "X"), ("A", "Z"), ("B", "W"), ("B", "Y"), ("C2", "I"), ("C2", "K")]


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("update t set\n a = 1,\n b = x\nwhere\n status = 'A'", "UPDATE t SET\n a = 1,\n b = x\nWHERE\n status = 'A'"),
        ("select [order], a = (select b = max(x) from u) -- select from\nfrom t /* where */", "SELECT [order], (SELECT max(x) AS b FROM u) AS a -- select from\nFROM t /* where */"),
        ("select @v = x from t where y = 'it''s null'", "SELECT @v = x FROM t WHERE y = 'it''s null'"),
    ],
)
def test_refine_changes_select_lists_only(spark, sql, expected):
    assert spark.createDataFrame([(sql,), (None,)], "sql string").select(sqltext.refine(F.col("sql"))).collect()[0][0] == expected


def test_explicit_aliases_and_display(spark):
    df = spark.createDataFrame([("select t.a, b, c d, t.*, max(e) from t where f in (select g from u)",)], "sql string")
    got = df.select(sqltext.explicit_aliases(F.col("sql")), sqltext.display(F.col("sql")), sqltext.identifier(F.lit("a-b.c d"))).first()
    assert got[0] == "SELECT t.a AS a, b AS b, c d, t.*, max(e) FROM t WHERE f IN (SELECT g FROM u)"
    assert got[1] == "select t.a, b, c d, t.*, max(e) from t where f ..." and got[2] == "a_b_c_d"


def test_refine(spark):
    df = spark.createDataFrame([("select a.x,\n  total = a.y + 1,\n  'from where' z\nfrom t a",)], "sql string")
    assert df.select(sqltext.refine(F.col("sql"))).first()[0] == "SELECT a.x,\n  a.y + 1 AS total,\n  'from where' z\nFROM t a"


def test_names_and_exports(spark, tmp_path):
    t = tables.Tables(spark, str(tmp_path))
    t.register("srv.[Db].dbo.[T]", lambda: spark.range(2))
    t.procedure("dbo.usp", lambda tables_, n: spark.range(n))
    assert t("db..t").count() == 2 and t.execute("[dbo].[usp]", n=3).count() == 3
    lines = [r.line for r in tables.markdown(spark.createDataFrame([("a|b", None)], "x string, y int"), "T").collect()]
    assert lines[2:] == ["| x | y |", "| --- | --- |", "| a\\|b | N/A |"]
    dot = [r.line for r in tables.dot(spark.createDataFrame([("a", "b")], "f string, t string"), "f", "t").collect()]
    assert dot == ["digraph lineage {", '  "a" -> "b";', "}"]
    tables.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "c"))
    assert rows(tables.read_csv(spark, str(tmp_path / "c"), "a int, b string")) == [(1, "x")]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
