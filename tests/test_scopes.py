"""Scopes and steps of SQL text against statements whose truth is known by the way they are made."""

from __future__ import annotations

import random

from tidemill.operators import scopes, sqltext, steps


def _resolved(spark, scripts, catalog=None):
    stated = sqltext.statements(spark.createDataFrame(list(scripts.items()), "script string, sql string"))
    known = spark.createDataFrame(catalog, "table string, column string, position int") if catalog else None
    out: dict[str, list] = {k: [] for k in scripts}
    for r in scopes.resolve(stated, catalog=known).orderBy("script", "position", "source_table", "source_column").collect():
        out[r.script].append((r.alias, r.source_table, r.source_column, r.confidence))
    return out


CASES = {
    "derived": ("select d.z, total from (select q.id as z, sum(q.v) total from dbo.q q group by q.id) d", [("Z", "DBO.Q", "ID", "exact"), ("TOTAL", "DBO.Q", "V", "exact")]),
    "cte": ("with x as (select a.id k from dbo.a a where a.z > 1) select x.k from x", [("K", "DBO.A", "ID", "exact")]),
    "names of a cte": ("with x(p, q) as (select a.id, a.v from dbo.a a) select q, p from x", [("Q", "DBO.A", "V", "exact"), ("P", "DBO.A", "ID", "exact")]),
    "a later cte hides the table of its name": ("with x as (select t.a from t), t as (select u.b as a from u) select x.a, t.a as c from x join t on 1 = 1", [("A", "T", "A", "exact"), ("C", "U", "B", "exact")]),
    "itself": ("with r as (select id, up from emp union all select e.id, r.up from emp e join r on r.id = e.up) select id, up from r", [("ID", "EMP", "ID", "exact"), ("UP", "EMP", "UP", "exact")]),
    "union": ("select a.x, a.y as z from t1 a union all (select b.p, q from t2 b) union select 1, 2 except select c.e, c.f from t3 c", [("X", "T1", "X", "exact"), ("X", "T2", "P", "exact"), ("Z", "T1", "Y", "exact"), ("Z", "T2", "Q", "exact")]),
    "apply": ("select o.k, f.val, g.v2 from orders o cross apply dbo.fn(o.k) f outer apply (select top 1 l.v2, o.k from lines l where l.k = o.k) g", [("K", "ORDERS", "K", "exact"), ("VAL", "DBO.FN", "VAL", "exact"), ("V2", "LINES", "V2", "exact")]),
    "values": ("select v.a, t.b from (values (1), (2)) v(a), t with (nolock)", [("A", None, None, None), ("B", "T", "B", "exact")]),
    "update": ("update b set b.price = s.p + 1, qty = s.q from dbo.book b inner join (select id, max(pp) p, q from stage group by id, q) s on s.id = b.id", [("PRICE", "STAGE", "PP", "exact"), ("QTY", "STAGE", "Q", "exact")]),
    "update alone": ("update dbo.t set a = b + c.d", [("A", "C", "D", "unresolved"), ("A", "DBO.T", "B", "exact")]),
    "several": ("select x, w.y from t1 join t2 on t1.i = t2.i", [("X", "T1", "X", "assumed"), ("Y", "W", "Y", "unresolved")]),
    "around": ("select (select max(b) from u where u.k = t.k) m, (select t.c) n from t", [("M", "U", "B", "assumed"), ("N", "T", "C", "exact")]),
    "none": ("select a", [("A", None, "A", "ambiguous")]),
    "unknown star": ("select d.foo from (select * from far) d", [("FOO", "FAR", "FOO", "assumed")]),
    "lacking": ("select d.nope from (select a from t) d", [("NOPE", "D", "NOPE", "unresolved")]),
    "joins in parentheses": ("select a.x, b.y from ((select i, x from ta) a join tb b on a.i = b.i)", [("X", "TA", "X", "exact"), ("Y", "TB", "Y", "exact")]),
    "exists": ("select case when exists (select 1 from z where z.i = t.i) then t.p end as k from dbo.t t", [("K", "DBO.T", "P", "exact")]),
    "stars": ("select z.*, y.* from (select p.*, 1 as one from tc p) z join far y on y.i = z.a", [("A", "TC", "A", "exact"), ("B", "TC", "B", "exact"), ("ONE", None, None, None), ("*", "FAR", "*", "exact")]),
    "catalog": ("select b, q from tc join far2 f on f.i = tc.a", [("B", "TC", "B", "exact"), ("Q", "FAR2", "Q", "exact")]),
    "catalog lacks": ("select tc.c from tc", [("C", "TC", "C", "unresolved")]),
    "text": ("select 'from x' as a, [b c].[d e] as f from [s].[t u] [b c] -- join y", [("A", None, None, None), ("F", "S.T U", "D E", "exact")]),
}


def test_resolved_sources(spark):
    got = _resolved(spark, {k: sql for k, (sql, _) in CASES.items()}, [("TC", "A", 1), ("TC", "B", 2)])
    for k, (_, expected) in CASES.items():
        assert sorted(got[k], key=str) == sorted(expected, key=str), k


def _random_select(r: random.Random, depth: int, names: list[str], ctes: list[tuple[str, dict]]) -> tuple[str, dict[str, set]]:
    """A SELECT with columns of the given names, and the physical columns that each comes from."""
    sources = []
    for k in range(r.randint(1, 3)):
        alias = f"{r.choice('abcd')}{r.randrange(1000)}_{k}"
        kind = r.random()
        if depth and kind < 0.5:
            columns = [f"k{i}" for i in r.sample(range(20), r.randint(1, 3))]
            sql, truth = _random_select(r, depth - 1, columns, ctes)
            if r.random() < 0.3:
                more, second = _random_select(r, depth - 1, columns, ctes)
                sql, truth = f"{sql} union all {more}", {c: truth[c] | second[c] for c in columns}
            sources.append((f"({sql}) {alias}", alias, truth))
        elif ctes and kind < 0.8:
            name, truth = r.choice(ctes)
            sources.append((f"{name} as {alias}", alias, truth))
        else:
            table = f"dbo.t{r.randrange(9)}"
            sources.append((f"{table} {alias}", alias, {c: {(table.upper(), c.upper())} for c in ("p", "q", "r")}))
    listed, truth = [], {}
    for name in names:
        found: set = set()
        parts = []
        for _ in range(r.randint(0, 2)):
            _, alias, columns = r.choice(sources)
            column = r.choice(sorted(columns))
            parts.append(f"{alias}.{column}")
            found |= columns[column]
        if depth and r.random() < 0.15:
            sql, inner = _random_select(r, 0, ["one"], ctes)
            parts.append(f"(select max(one) from ({sql}) i)")
            found |= inner["one"]
        listed.append(f"coalesce({', '.join([*parts, '0'])}) as {name}")
        truth[name] = found
    joined = sources[0][0] + "".join(f" join {s} on 1 = 1" for s, _, _ in sources[1:])
    return f"select {', '.join(listed)} from {joined}", truth


def test_random_statements_have_their_sources(spark):
    scripts, truths = {}, {}
    for seed in range(60):
        r = random.Random(seed)
        ctes: list[tuple[str, dict]] = []
        texts = []
        for k in range(r.randint(0, 3)):
            columns = ["u", "v", "w"][: r.randint(1, 3)]
            sql, truth = _random_select(r, 1, columns, ctes)
            texts.append(f"c{k} as ({sql})")
            ctes.append((f"c{k}", truth))
        sql, truth = _random_select(r, r.randint(0, 3), ["x", "y", "z"], ctes)
        scripts[str(seed)] = ("with " + ", ".join(texts) + " " if texts else "") + sql
        truths[str(seed)] = {(n.upper(), *s, "exact") for n, found in truth.items() for s in found}
    got = _resolved(spark, scripts)
    for k, expected in truths.items():
        assert {x for x in got[k] if x[1]} == expected, scripts[k]


def test_tables_without_ctes(spark):
    sql = "with x as (select 1 a from dbo.p), y(b) as (select a from x) select * from y join q on 1 = 1 cross apply dbo.f(q.i) z"
    stated = sqltext.statements(spark.createDataFrame([("s", sql)], "script string, sql string"))
    assert {r.table for r in sqltext.tables(stated).collect()} == {"DBO.P", "Q", "DBO.F"}
    assert {(r.table, r.kind) for r in scopes.physical_tables(stated).collect()} == {("DBO.P", "table"), ("Q", "table"), ("DBO.F", "function")}


STEPS = """select a.id, a.v * 2 as v2 into #t1 from dbo.src a;
select t.id, sum(t.v2) s into #t2 from #t1 t group by t.id;
insert into dbo.out (k, total) select x.id, x.s from #t2 x;
update o set o.total = o.total + n.w from dbo.out o join dbo.extra n on n.k = o.k;
drop table #t1;
select q.z as id into #t1 from dbo.other q;
insert into dbo.final select id, (select max(o.total) from dbo.out o) m from #t1;
truncate table dbo.out;
insert into dbo.last (a) select total from dbo.out"""


def test_steps(spark):
    stated = sqltext.statements(spark.createDataFrame([("s", STEPS), ("empty", ""), ("reads", "select a from t")], "script string, sql string"))
    edges = [(r.writer, r.number, r.table) for r in steps.step_edges(stated).orderBy("number", "writer").collect()]
    assert edges == [(1, 2, "#T1"), (2, 3, "#T2"), (3, 4, "DBO.OUT"), (3, 7, "DBO.OUT"), (4, 7, "DBO.OUT"), (6, 7, "#T1")]
    ends = {(r.number, r.column, r.source_table, r.source_column, r.hops) for r in steps.end_to_end(stated).collect()}
    assert ends == {
        (1, "ID", "DBO.SRC", "ID", 0),
        (1, "V2", "DBO.SRC", "V", 0),
        (2, "ID", "DBO.SRC", "ID", 1),
        (2, "S", "DBO.SRC", "V", 1),
        (3, "K", "DBO.SRC", "ID", 2),
        (3, "TOTAL", "DBO.SRC", "V", 2),
        (4, "TOTAL", "DBO.SRC", "V", 3),
        (4, "TOTAL", "DBO.EXTRA", "W", 0),
        (6, "ID", "DBO.OTHER", "Z", 0),
        (7, "ID", "DBO.OTHER", "Z", 1),
        (7, "M", "DBO.SRC", "V", 3),
        (7, "M", "DBO.EXTRA", "W", 1),
        (9, "A", "DBO.OUT", "TOTAL", 0),
    }


def test_facts_from_sql(spark):
    from tidemill.operators import surface

    surface.register(spark)
    spark.createDataFrame([("a", "select x.i, y.n as m from t x left join dbo.u y on x.i = y.j; exec p"), ("b", None)], "k string, text string").createOrReplaceTempView("texts_of_a_test")
    rows = lambda sql: sorted(tuple(r) for r in spark.sql(sql).collect())
    said = rows("select t.k, s.number, s.operation, s.target from texts_of_a_test t, lateral split_statements(t.text) s")
    assert said == [("a", 1, "SELECT", None), ("a", 2, "EXEC", "P")]
    assert rows("select s.* from texts_of_a_test t, lateral statement_tables(t.text) s") == [("DBO.U", "Y"), ("T", "X")]
    assert rows("select s.* from texts_of_a_test t, lateral join_pairs(t.text) s") == [("LEFT", "X", "I", "=", "Y", "J")]
    assert rows("select s.position, s.alias from texts_of_a_test t, lateral select_list(t.text) s") == [(0, "I"), (1, "M")]
    spark.catalog.dropTempView("texts_of_a_test")
