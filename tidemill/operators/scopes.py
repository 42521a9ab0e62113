"""Scopes of SQL statements: where each column of a statement comes from, through derived tables, CTEs, unions and `*`.

Tasks turn a statement's tokens into rows in one pass: an interval for each SELECT with those around it, what its
FROM names, its select list, and the names that each expression uses. All that relates those rows is joins: CTE names
to their definitions, `*` to the columns it stands for, names to the sources of the nearest scope that has them, and
outputs of inner selects to those of outer ones, once for each level of nesting.

confidence of a source column
* exact: its owner says which table it is of, or only one source can have it.
* assumed: several sources can have it (the first is named), or it comes through a `*` of unknown columns.
* unresolved: its owner is no source there, or the source is known not to have such a column; the owner is named.
* ambiguous: it has no owner and there is no source at all.
EXEC p gives the columns that the catalog has of p, else one `*`. A CTE that reads itself adds no source by that; constants, VALUES and variables have none."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.folders import checkpoint, dealt, kept

from .sqltext import _NO_ALIAS, _NO_COLUMN, Select, Token, _each, _kind, _text, items, name_at, operation_of, scan, selects, table_places

_FACTS = "fact string, scope int, set_id int, branch int, position int, name string, alias string, owner string, place int, last int, names array<string>, around array<int>"
_FIELDS = [c.split()[0] for c in _FACTS.split(", ")]
# Hints that stand in parentheses behind a table's name.
HINTS = frozenset("NOLOCK READPAST ROWLOCK TABLOCK TABLOCKX UPDLOCK XLOCK HOLDLOCK READUNCOMMITTED INDEX FORCESEEK NOWAIT PAGLOCK SERIALIZABLE".split())
#: Facts of statements that a task relates, about.
_TOGETHER = 50_000
#: Confidence by rank: a path is as sure as its least sure step.
SURE = ("exact", "assumed", "unresolved", "ambiguous")


def _plain(word: str) -> str:
    return word.strip("[]\"'")


class _Statement:
    """The tokens of a statement, its selects and matching parentheses."""

    def __init__(self, sql: str):
        self.sql, self.tokens = sql, scan(sql)
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "mark" and t.word == "(":
                open_.append(k)
            elif t.kind == "mark" and t.word == ")" and open_:
                self.close[open_.pop()] = k
        self.opened = {b: a for a, b in self.close.items()}
        self.found = selects(self.tokens)
        self.update = self._update()
        self.place = {s.at: k for k, s in enumerate(self.found)}
        self.around, self.sets, self.branch = self._nest()

    def is_(self, k: int, *words: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind != "text" and self.tokens[k].word in words

    def _update(self) -> int | None:
        """UPDATE ... SET ... FROM is a scope too, whose list is what it sets; its number."""
        t = self.tokens
        if operation_of(t)[0] != "UPDATE":
            return None
        at = next(k for k, x in enumerate(t) if x.kind == "name" and x.word == "UPDATE" and x.depth == 0)
        first = next((k + 1 for k in range(at, len(t)) if self.is_(k, "SET") and t[k].depth == 0), len(t))
        end = next((k for k in range(first, len(t)) if self.is_(k, "FROM", "WHERE", "OPTION", "OUTPUT") and t[k].depth == 0), len(t))
        self.found.append(Select(at, first, end, len(t), 0, False))
        self.found.sort()
        return next(k for k, s in enumerate(self.found) if s.at == at)

    def _nest(self) -> tuple[list[list[int]], list[int], list[int]]:
        """The scopes around each one (itself first), its set (the first select of its union) and its place in that."""
        around, sets, branch, open_, last = [], [], [], [], {}
        for k, s in enumerate(self.found):
            while open_ and self.found[open_[-1]].end <= s.at:
                open_.pop()
            parent = open_[-1] if open_ else -1
            around.append([k, *(around[parent] if open_ else [])])
            left = last.get(parent)
            joined = s.joined and left is not None
            sets.append(sets[left] if joined else k)
            branch.append(branch[left] + 1 if joined else 0)
            last[parent] = k
            open_.append(k)
        return around, sets, branch

    def cte(self, k: int) -> tuple[str, int, int, list[str] | None] | None:
        """Name, first and last place, column names of the CTE that scope k defines."""
        p = self.found[k].at - 1
        if not self.is_(p, "("):
            return None
        while self.is_(p - 1, "("):
            p -= 1
        opened, q, names = p, p - 2, None
        if not self.is_(p - 1, "AS"):
            return None
        if self.is_(q, ")"):
            start = self.opened.get(q, q)
            names, q = [_plain(t.word) for t in self.tokens[start + 1 : q] if t.kind in ("name", "text")], start - 1
        if q < 0 or self.tokens[q].kind != "name" or not (self.is_(q - 1, "WITH") or self.is_(q - 1, ",")):
            return None
        return _plain(self.tokens[q].word), q, self.close.get(opened, len(self.tokens)), names

    def seen(self, k: int, apart: set[int]) -> list[int]:
        """The scopes whose sources scope k sees, itself first. A set in `apart` (a derived table that no APPLY calls) sees none around it."""
        end = next((n for n, x in enumerate(self.around[k]) if self.sets[x] in apart), len(self.around[k]))
        return self.around[k][: end + 1]

    def sources(self, s: Select) -> Iterator[tuple[str, str, str, int | None, int, list[str] | None, bool]]:
        """kind, name, alias, set, place, column names, called by APPLY of what a scope's FROM, JOIN, APPLY and commas name."""
        k = s.list_end
        while k < s.end:
            if k in self.place and k != s.at:
                k = max(self.found[self.place[k]].end, k + 1)
                continue
            if not (self.tokens[k].kind == "name" and self.tokens[k].word in ("FROM", "JOIN", "APPLY")):
                k += 1
                continue
            listed, applied, k = self.tokens[k].word == "FROM", self.tokens[k].word == "APPLY", k + 1
            while k < s.end:
                one, k = self._source(k)
                if one is None:
                    break
                if one:
                    yield (*one, applied)
                    if not (listed and self.is_(k, ",")):
                        break
                    k += 1

    def _source(self, k: int) -> tuple[tuple | None, int]:
        """The source at k and the place after it; an empty one for a parenthesis around joins; None for none."""
        inner = k
        while self.is_(inner, "("):
            inner += 1
        kind, name, set_id, place = "table", "", None, k
        if inner > k:
            if inner not in self.place and not self.is_(inner, "VALUES"):
                return (), k + 1
            kind, set_id = ("derived", self.sets[self.place[inner]]) if inner in self.place else ("values", None)
            opened = inner - 1
            while opened > k and self.is_(self.close.get(opened, -1) + 1, ")"):
                opened -= 1
            if opened > k:
                return (), k + 1
            after = self.close.get(opened, len(self.tokens)) + 1
        else:
            name, after = name_at(self.tokens, k)
            if not name or name in _NO_ALIAS:
                return None, k
            if self.is_(after, "(") and not (after + 1 < len(self.tokens) and self.tokens[after + 1].word in HINTS):
                kind, after = "function", self.close.get(after, len(self.tokens)) + 1
        alias, names = name.rpartition(".")[2], None
        after += self.is_(after, "AS")
        if after < len(self.tokens) and self.tokens[after].kind == "name" and self.tokens[after].word not in _NO_ALIAS:
            alias, after = _plain(self.tokens[after].word), after + 1
            if kind != "table" and self.is_(after, "("):
                names = [_plain(t.word) for t in self.tokens[after + 1 : self.close.get(after, after)] if t.kind in ("name", "text")]
                after = self.close.get(after, len(self.tokens)) + 1
        after += self.is_(after, "WITH") and self.is_(after + 1, "(")
        if self.is_(after, "(") and after + 1 < len(self.tokens) and self.tokens[after + 1].word in HINTS:
            after = self.close.get(after, len(self.tokens)) + 1
        return (kind, name, alias, set_id, place, names), after

    def target(self, name: str, read: list[list[tuple]]) -> tuple[str, list[str] | None]:
        """The table that a statement writes (an UPDATE or DELETE may name it by its alias), and the columns that INSERT lists."""
        own = read[self.update] if self.update is not None else [("table", t, a) for t, a, _ in table_places(self.tokens)]
        table = next((x[1] for x in own if x[0] == "table" and x[2] == name), name) if operation_of(self.tokens)[0] in ("UPDATE", "DELETE") else name
        at = next((k for k in range(len(self.tokens)) if self.is_(k, "INTO")), None)
        if at is None:
            return table, None
        _, after = name_at(self.tokens, at + 1)
        if not self.is_(after, "(") or after + 1 in self.place:
            return table, None
        return table, [name_at(self.tokens, k)[0].rpartition(".")[2] for k in range(after + 1, self.close.get(after, after)) if self.tokens[k].kind == "name" and not self.is_(k - 1, ".")]

    def procedure(self) -> str | None:
        """What the first EXEC of a statement without a select calls (after `@x =`, where that stands), if it is no text."""
        at = next((k + 1 for k in range(len(self.tokens)) if self.is_(k, "EXEC", "EXECUTE") and self.tokens[k].kind == "name"), None)
        if at is None:
            return None
        if self.is_(at + 1, "="):
            at += 2
        name, _ = name_at(self.tokens, at)
        return name if name and not name.startswith("@") else None

    def refs(self, a: int, b: int) -> Iterator[tuple[str | None, str | None, int | None]]:
        """Owner and name, or the set of a subquery, of all that an expression uses."""
        k = a
        while k < b:
            t = self.tokens[k]
            if k in self.place:
                inner = self.place[k]
                if not (self.is_(k - 1, "(") and self.is_(k - 2, "EXISTS")):
                    yield None, None, self.sets[inner]
                k = max(self.found[inner].end, k + 1)
                continue
            if t.kind != "name":
                k += 1
                continue
            name, end = name_at(self.tokens, k)
            owner, _, column = name.rpartition(".")
            called, typed = self.is_(end, "("), self.is_(k - 1, "AS") and k > a
            k = max(end, k + 1)
            if column and not called and not typed and (owner or not (column in _NO_COLUMN or column.startswith("@"))):
                yield owner or None, column, None

    def listed(self, n: int) -> Iterator[tuple[str, int, int, list[Token]]]:
        """alias, first and last token, tokens of each column of scope n."""
        s = self.found[n]
        if n != self.update:
            for x in items(self.tokens, s):
                yield x.alias or _text(self.sql, self.tokens, x.start, x.end).upper(), x.start, x.end, self.tokens[x.start : x.end]
            return
        edges = [k for k in range(s.first, s.list_end) if self.is_(k, ",") and self.tokens[k].depth == 0]
        for a, b in zip([s.first, *[k + 1 for k in edges]], [*edges, s.list_end]):
            equals = next((k for k in range(a, b) if self.is_(k, "=")), None)
            if equals is not None and not self.tokens[a].word.startswith("@"):
                yield name_at(self.tokens, a)[0].rpartition(".")[2], equals + 1, b, self.tokens[equals + 1 : b]


def _facts(sql: str, procedures: bool = True) -> Iterator[tuple]:
    s = _Statement(sql)
    if procedures and not s.found and (called := s.procedure()):
        # the rows of EXEC are those of a procedure: `*` of it
        yield ("scope", 0, 0, 0, None, None, None, "main", None, None, None, [0])
        yield ("source", 0, None, None, 0, called, called.rpartition(".")[2], "function", 0, None, None, None)
        yield ("item", 0, 0, 0, 0, "*", "*", None, None, None, None, None)
    ctes = {k: s.cte(k) for k in range(len(s.found)) if s.sets[k] == k}
    inside = {k for k in range(len(s.found)) if any(ctes.get(s.sets[x]) for x in s.around[k])}
    free = [k for k in range(len(s.found)) if k not in inside]
    main = s.sets[min(free, key=lambda k: (s.found[k].depth, k))] if free else None

    read = [list(s.sources(x)) for x in s.found]
    apart = {set_id for own in read for _, _, _, set_id, _, _, applied in own if set_id is not None and not applied}

    def row(fact: str, **f: object) -> tuple:
        return (fact, *map(f.get, _FIELDS[1:]))

    operation, target = operation_of(s.tokens)
    if target and operation != "EXEC":
        written, names = s.target(target, read)
        yield row("target", name=written, alias=operation, names=names)
    for k, x in enumerate(s.found):
        at = {"scope": k, "set_id": s.sets[k], "branch": s.branch[k]}
        cte = ctes.get(k)
        more = {"name": cte[0], "place": cte[1], "last": cte[2], "names": cte[3]} if cte else {}
        yield row("scope", **at, **more, owner="main" if s.sets[k] == main else None, around=s.seen(k, apart))
        own = read[k]
        if k == s.update and not own:
            target, _ = name_at(s.tokens, x.at + 1)
            own = [("table", target, target.rpartition(".")[2], None, x.at, None, False)]
        for n, (kind, name, alias, set_id, place, names, _) in enumerate(own):
            yield row("source", scope=k, set_id=set_id, position=n, name=name or None, alias=alias or None, owner=kind, place=place, names=names)
        for n, (alias, a, b, tokens) in enumerate(s.listed(k)):
            star = tokens and tokens[-1].word == "*" and tokens[-1].kind == "mark" and _kind(tokens) == "COLUMN"
            if star:
                yield row("item", **at, position=n, alias=alias, name="*", owner="".join(_plain(t.word) for t in tokens[:-2]) or None)
                continue
            yield row("item", **at, position=n, alias=alias)
            for owner, column, set_id in dict.fromkeys(s.refs(a, b)):
                yield row("ref", scope=k, position=n, owner=owner, name=column, set_id=set_id)


def facts(stated: DataFrame, key: str = "script", called: bool = True) -> DataFrame:
    """key, number and the facts of each statement: scopes, sources, items of select lists, names that items use. called: EXEC
    is a source too."""
    return _each(stated, key, _FACTS, lambda s: _facts(s, called))


def _sources(found: DataFrame, on: list[str]) -> DataFrame:
    """Sources with the set that each reads: a derived table's own, or that of the last CTE of its name before it."""
    ctes = found.where("fact = 'scope' and name is not null").select(*on, F.col("name").alias("_cte"), F.struct(F.col("place").alias("start"), "last", F.col("set_id").alias("to"), F.col("names").alias("named")).alias("c"))
    own = found.where("fact = 'source'").select(*on, "scope", F.col("position").alias("ordinal"), "name", "alias", F.col("owner").alias("kind"), F.col("set_id").alias("derived"), "place", "names")
    keys = [*on, "scope", "ordinal", "name", "alias", "kind", "derived", "place", "names"]
    both = own.join(ctes.withColumnRenamed("_cte", "name"), [*on, "name"], "left")
    both = both.groupBy(*keys).agg(F.max(F.when(F.col("c.start") < F.col("place"), F.col("c"))).alias("c"))
    itself = F.coalesce(F.col("place") < F.col("c.last"), F.lit(False))
    kind = F.when(itself, "self").when(F.col("c").isNotNull(), "cte").otherwise(F.col("kind"))
    to = F.when(~itself, F.coalesce("c.to", "derived"))
    table = F.when(kind.isin("table", "function"), F.col("name"))
    return both.select(*on, "scope", "ordinal", "name", "alias", kind.alias("kind"), to.alias("to_set"), table.alias("table"), F.coalesce("names", "c.named").alias("names"))


def _called(own: DataFrame, on: list[str]) -> DataFrame:
    """Sources by each name that an owner may use, the alias or the whole name; of equal names in a scope the first source."""
    names = own.select("*", F.explode(F.array_distinct(F.array_compact(F.array("alias", "name")))).alias("called"))
    first = F.min("ordinal").over(Window.partitionBy(*on, "scope", "called"))
    return names.withColumn("_first", first).where("ordinal = _first").drop("_first")


def _listed(own: DataFrame, catalog: DataFrame | None, on: list[str]) -> DataFrame:
    """The catalog's columns of the tables that each statement reads, with the statement."""
    if catalog is None:
        columns = "table string, column string, position int"
        return own.sparkSession.createDataFrame([], f"{', '.join(f'`{c}` {own.schema[c].dataType.simpleString()}' for c in on)}, {columns}")
    read = own.where("`table` is not null").select(*on, "table").distinct()
    return kept(checkpoint(read.join(catalog.select("table", "column", "position"), "table")).repartition(own.rdd.getNumPartitions(), *on))


def _expand(found: DataFrame, own: DataFrame, columns: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items and references with each `*` replaced by the columns it stands for, innermost sets first; by one
    item `*` where a source's columns are unknown. `wild` marks those."""
    path = F.array("position", F.lit(0), F.lit(0))
    all_ = found.where("fact = 'item'").select(*on, "scope", "set_id", "branch", path.alias("path"), "alias", (F.col("name") == "*").alias("star"), "owner")
    all_ = all_.withColumn("star", F.coalesce("star", F.lit(False)))
    refs = found.where("fact = 'ref'").select(*on, "scope", path.alias("path"), "owner", F.col("name").alias("column"), "set_id")
    done = all_.where("not star").select(*on, "scope", "set_id", "branch", "path", "alias", F.lit(False).alias("wild"))
    open_ = all_.where("star")
    open_ = kept(open_)
    meant = own.withColumnRenamed("alias", "s_alias")
    called = kept(_called(own, on).withColumnRenamed("alias", "s_alias").withColumnRenamed("called", "owner"))
    while not open_.isEmpty():
        rows = open_.where("owner is null").join(meant, [*on, "scope"], "left")
        rows = rows.unionByName(open_.where("owner is not null").join(called, [*on, "scope", "owner"], "left"))
        item = [*on, "scope", "set_id", "branch", "path"]
        waits = rows.join(open_.select(*on, F.col("set_id").alias("to_set"), F.lit(True).alias("busy")).distinct(), [*on, "to_set"], "left")
        waits = kept(waits.withColumn("busy", F.max(F.coalesce("busy", F.lit(False))).over(Window.partitionBy(*item))))
        rows = waits.where("not busy")
        lists = done.where("branch = 0").select(*on, F.col("set_id").alias("to_set"), F.col("path").alias("p"), F.col("alias").alias("column"), F.col("wild").alias("w"))
        place = F.row_number().over(Window.partitionBy(*on, "to_set").orderBy("p"))
        lists = lists.withColumn("n", place).drop("p")
        known = columns.select(*on, "table", F.col("column").alias("c_column"), F.col("position").alias("c_n"))
        rows = rows.join(lists, [*on, "to_set"], "left").join(known, [*on, "table"], "left")
        column = F.coalesce(F.get("names", F.coalesce("n", "c_n") - 1), "c_column", "column", F.lit("*"))
        made = rows.select(*item, "ordinal", "s_alias", column.alias("column"), F.coalesce("n", "c_n", F.lit(1)).alias("n"), (F.coalesce("w", F.lit(False)) | (column == "*")).alias("wild"))
        made = kept(made.withColumn("path", F.array(F.get("path", 0), F.col("ordinal") + 1, F.col("n"))))
        done = done.unionByName(made.select(*item, F.col("column").alias("alias"), "wild"))
        refs = refs.unionByName(made.select(*on, "scope", "path", F.col("s_alias").alias("owner"), "column", F.lit(None).cast("int").alias("set_id")))
        open_ = waits.where("busy").select(*open_.columns).distinct()
    place = F.row_number().over(Window.partitionBy(*on, "scope").orderBy("path")) - 1
    done = kept(done.withColumn("position", place))
    return done, refs.join(done.select(*on, "scope", "path", "position"), [*on, "scope", "path"]).drop("path")


def _steps(found: DataFrame, own: DataFrame, done: DataFrame, refs: DataFrame, columns: DataFrame, on: list[str]) -> DataFrame:
    """Of each output (scope, position) what it takes: an output of another set, or a table's column."""
    names = found.where("fact = 'scope' and branch = 0").select(*on, "set_id", F.col("names").alias("given"))
    outputs = kept(done.where("branch = 0").join(names, [*on, "set_id"], "left").select(*on, F.col("set_id").alias("to_set"), F.col("position").alias("to_position"), F.coalesce(F.get("given", F.col("position")), "alias").alias("out"), "wild"))
    open_sets = outputs.where("wild").groupBy(*on, "to_set").agg(F.min("to_position").alias("wild_position"))
    by_set = own.where("to_set is not null").join(outputs, [*on, "to_set"]).select(*on, F.col("scope").alias("at"), "ordinal", F.coalesce(F.get("names", F.col("to_position")), "out").alias("column"), "to_position")
    by_table = own.join(columns, [*on, "table"]).select(*on, F.col("scope").alias("at"), "ordinal", "column", F.lit(-1).alias("to_position"))
    by_list = own.where("to_set is null and names is not null").select(*on, F.col("scope").alias("at"), "ordinal", F.explode("names").alias("column"), F.lit(-1).alias("to_position"))
    # an output's name may recur; the first one counts
    offered = kept(by_set.unionByName(by_table).unionByName(by_list).groupBy(*on, "at", "ordinal", "column").agg(F.min("to_position").alias("to_position")))
    listed = columns.select(*on, "table").distinct().withColumn("listed", F.lit(True))
    around = found.where("fact = 'scope'").select(*on, "scope", F.posexplode("around").alias("distance", "at"))
    named = kept(refs.where("set_id is null").drop("set_id").join(around, [*on, "scope"]))
    may = F.col("wild_position").isNotNull() | (F.col("kind").isin("table", "function") & F.col("listed").isNull()) | (F.col("kind").isin("values", "self") & F.col("names").isNull())
    sources = kept(own.join(open_sets, [*on, "to_set"], "left").join(listed, [*on, "table"], "left").withColumn("may", F.coalesce(may, F.lit(False))).withColumnRenamed("scope", "at"))
    field = ["ordinal", "kind", "to_set", "table", "alias", "wild_position"]
    source = F.struct(*field).alias("s")
    owned, bare = named.where("owner is not null"), named.where("owner is null")
    # by owner; by the only lists that have the name; by the sources whose columns are unknown; by those that lack it
    called = _called(sources.withColumnRenamed("at", "scope"), on).withColumnRenamed("scope", "at")
    mine = owned.join(called.select(*on, "at", F.col("called").alias("owner"), "ordinal", source, F.col("may").alias("s_may")), [*on, "at", "owner"])
    mine = mine.join(offered, [*on, "at", "ordinal", "column"], "left").drop("ordinal")
    mine = mine.withColumns({"rank": F.when(F.col("to_position").isNotNull(), 0).when(F.col("s_may") | (F.col("column") == "*"), 1).otherwise(2), "alike": F.lit(1).cast("long")}).drop("s_may")
    offers = bare.join(offered, [*on, "at", "column"]).join(sources.select(*on, "at", "ordinal", source), [*on, "at", "ordinal"]).drop("ordinal")
    ref = [*on, "scope", "position", "owner", "column"]
    offers = offers.withColumns({"rank": F.lit(0), "alike": F.count("*").over(Window.partitionBy(*ref, "distance"))})
    each = sources.groupBy(*on, "at").agg(F.min(F.when(F.col("may"), source)).alias("s1"), F.count(F.when(F.col("may"), 1)).alias("n1"), F.min(source).alias("s2"), F.count("*").alias("n2"))
    rest = bare.join(each, [*on, "at"]).withColumn("x", F.explode(F.array(F.struct(F.col("s1").alias("s"), F.lit(1).alias("rank"), F.col("n1").alias("alike")), F.struct(F.col("s2").alias("s"), F.lit(2).alias("rank"), F.col("n2").alias("alike")))))
    rest = rest.select(*named.columns, "x.*").where("s is not null").withColumn("to_position", F.lit(None).cast("int"))
    none = named.where("distance = 0").withColumns({"s": F.lit(None).cast(mine.schema["s"].dataType), "rank": F.lit(3), "alike": F.lit(1).cast("long"), "to_position": F.lit(None).cast("int")})
    rows = none.unionByName(mine).unionByName(offers).unionByName(rest).select(*named.columns, "rank", "alike", "to_position", "s.*")
    # a name is of the nearest scope with a source that has it or may have it
    far = F.when(F.col("rank") < 2, F.col("distance")).otherwise(1_000_000)
    first = Window.partitionBy(*ref).orderBy(far, "rank", "distance", "ordinal")
    beyond = F.max(F.when(F.col("rank") < 2, F.col("distance"))).over(Window.partitionBy(*ref))
    rows = rows.withColumns({"beyond": beyond, "turn": F.row_number().over(first)}).where("turn = 1")
    sole = F.col("owner").isNotNull() | ((F.col("alike") == 1) & ((F.col("rank") == 0) | (F.col("beyond") == F.col("distance"))))
    through = F.col("to_set").isNotNull() & (F.col("rank") == 1)
    # a set without the name but with a `*`: its first unknown `*`
    sure = F.when((F.col("rank") >= 2) & F.col("owner").isNotNull(), 2).when(F.col("rank") == 3, 3).when(F.col("rank") == 2, 2).when(through & (F.col("column") != "*"), 1).when(sole, 0).otherwise(1)
    to = F.when(F.col("rank") < 2, F.col("to_set"))
    to_position = F.when(to.isNotNull(), F.when(F.col("rank") == 0, F.col("to_position")).otherwise(F.col("wild_position")))
    table = F.when(F.col("rank") == 3, F.col("owner")).otherwise(F.coalesce("table", F.when(F.col("rank") == 2, F.coalesce("owner", "alias"))))
    constant = F.col("kind").isin("values", "self") & (F.col("rank") < 2)
    steps = rows.where(~F.coalesce(constant, F.lit(False))).select(*on, "scope", "position", to.alias("to_set"), to_position.alias("to_position"), table.alias("source_table"), F.col("column").alias("source_column"), sure.alias("sure"))
    # a subquery gives all its columns
    inner = refs.where("set_id is not null").select(*on, "scope", "position", F.col("set_id").alias("to_set")).join(outputs.select(*on, "to_set", "to_position"), [*on, "to_set"])
    steps = steps.unionByName(inner.select(*on, "scope", "position", "to_set", "to_position", *(F.lit(None).cast("string").alias(c) for c in ("source_table", "source_column")), F.lit(0).alias("sure")))
    sets = found.where("fact = 'scope'").select(*on, "scope", "set_id")
    return kept(steps.join(sets, [*on, "scope"]).drop("scope").distinct())


def resolve(stated: DataFrame, key: str = "script", catalog: DataFrame | None = None, called: bool = True) -> DataFrame:
    """key, number, position, alias, source_table, source_column, confidence, levels of the outermost select's columns (for
    UPDATE ... SET: of the columns it sets), in all branches of a UNION; branches meet by position, under the first one's aliases.

    A column without a source has one row whose `source_table` and `source_column` are null. levels: inner selects between the
    column and its source. catalog (table, column, position from 1, upper case) gives tables' columns, for `*` and for
    columns without an owner; a `*` whose columns are unknown is a source_column `*`. called: procedures that EXEC calls
    are sources too."""
    return resolve_facts(checkpoint(facts(stated, key, called)), key, catalog)


def resolve_facts(found: DataFrame, key: str, catalog: DataFrame | None = None) -> DataFrame:
    """resolve() of facts at hand."""
    on = [key, "number"]
    # all joins are within a statement: its rows are dealt once, and stay together
    found = kept(dealt(found, *on, rows=_TOGETHER))
    own = kept(_sources(found, on))
    columns = _listed(own, catalog, on)
    done, refs = _expand(found, own, columns, on)
    steps = _steps(found, own, done, refs, columns, on)
    main = found.where("fact = 'scope' and owner = 'main'").select(*on, "scope")
    roots = done.where("branch = 0").join(main, [*on, "scope"], "left_semi").select(*on, F.col("position").alias("root"), "alias", "set_id", "position")
    front = roots.select(*on, "root", "set_id", "position", F.lit(0).alias("sure"), F.lit(None).cast("string").alias("carried"))
    level, reached = 0, None
    while True:
        hop = front.join(steps.withColumnRenamed("sure", "_sure"), [*on, "set_id", "position"])
        # a name that an unknown `*` must hold goes on under its own name
        column = F.when((F.col("source_column") == "*") & F.col("carried").isNotNull(), F.col("carried")).otherwise(F.col("source_column"))
        hop = kept(hop.select(*on, "root", "to_set", "to_position", "source_table", column.alias("source_column"), F.greatest("sure", "_sure").alias("sure"), "carried").distinct())
        ends = hop.where("to_set is null").select(*on, "root", "source_table", "source_column", "sure", F.lit(level).alias("levels"))
        reached = ends if reached is None else reached.unionByName(ends)
        front = hop.where("to_set is not null").select(*on, "root", F.col("to_set").alias("set_id"), F.col("to_position").alias("position"), "sure", F.coalesce("carried", F.when(F.col("sure") > 0, F.col("source_column"))).alias("carried")).distinct()
        level += 1
        if front.isEmpty():
            break
    # one source on several ways: the surest, then the shortest
    best = reached.groupBy(*on, "root", "source_table", "source_column").agg(F.min(F.struct("sure", "levels")).alias("b"))
    sure = F.element_at(F.array(*map(F.lit, SURE)), F.col("b.sure") + 1)
    best = best.select(*on, "root", "source_table", "source_column", sure.alias("confidence"), F.col("b.levels").alias("levels"))
    return kept(roots.select(*on, "root", "alias").join(best, [*on, "root"], "left").withColumnRenamed("root", "position"))


def column_sources(stated: DataFrame, key: str = "script", catalog: DataFrame | None = None, called: bool = True) -> DataFrame:
    """key, number, alias, source_table, source_column, confidence of the columns that have a source: see resolve."""
    return resolve(stated, key, catalog, called).where("source_column is not null").select(key, "number", "alias", "source_table", "source_column", "confidence").distinct()


def physical_tables(stated: DataFrame, key: str = "script") -> DataFrame:
    """key, number, table, alias, kind (table, function) of what a statement's selects read; CTEs and derived tables are not listed."""
    # both sides of the join read what each text gives once
    return tables_of(checkpoint(facts(stated, key).where("(fact = 'source') or (fact = 'scope' and name is not null)")), key)


def tables_of(found: DataFrame, key: str) -> DataFrame:
    """physical_tables() of facts at hand."""
    return _sources(found, [key, "number"]).where("`table` is not null").select(key, "number", "table", "alias", "kind").distinct()
