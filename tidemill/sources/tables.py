"""Tables by name, and the writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.folders import fresh
from tidemill.functions.ssis import resolve_variables
from tidemill.operators import sqltext


class Tables:
    """Parquet tables of a folder, and views and procedures under names of one, two, three or four parts.

    Names match without regard to case, brackets and empty parts (db..t); the last part alone is enough
    where it is unique."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.views: dict[str, Callable[[], DataFrame]] = {}
        self.procedures: dict[str, Callable[..., DataFrame]] = {}

    @staticmethod
    def key(name: str) -> str:
        return ".".join(p.strip("[]\"` ").lower() for p in name.split(".") if p.strip("[]\"` "))

    def register(self, name: str, make: Callable[[], DataFrame]) -> None:
        self.views[self.key(name)] = make

    def procedure(self, name: str, run: Callable[..., DataFrame]) -> None:
        self.procedures[self.key(name)] = run

    def __call__(self, name: str) -> DataFrame:
        key = self.key(name)
        if key in self.views:
            return self.views[key]()
        near = [k for k in self.views if k.rpartition(".")[2] == key.rpartition(".")[2]]
        if len(near) == 1:
            return self.views[near[0]]()
        return self.spark.read.parquet(f"{self.folder}/{key.rpartition('.')[2]}.parquet")

    def select_into(self, name: str, rows: DataFrame, replace: bool = False) -> DataFrame:
        """CREATE TABLE AS, SELECT INTO: rows are written once to a folder of their own in the shared folder, and only then does the
        name stand for them. A name that is taken is an error unless `replace`; until a new table is whole, and where
        its write fails, the old one stays readable (rows may read it, too)."""
        key = self.key(name)
        if key in self.views and not replace:
            raise ValueError(f"{name} is there already")
        at = fresh(self.spark, "table")
        rows.write.parquet(at)
        schema = rows.schema
        self.views[key] = lambda: self.spark.read.schema(schema).parquet(at)
        return self.views[key]()

    def drop(self, name: str, if_exists: bool = False) -> None:
        """DROP TABLE, of a registered or written name; what reads its files already may go on."""
        if self.views.pop(self.key(name), None) is None and not if_exists:
            raise ValueError(f"there is no {name}")

    def exists(self, name: str) -> bool:
        """OBJECT_ID(name) IS NOT NULL."""
        key = self.key(name)
        if key in self.views or key in self.procedures or sum(k.rpartition(".")[2] == key.rpartition(".")[2] for k in self.views) == 1:
            return True
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key.rpartition('.')[2]}.parquet")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def bind(self, sql: str, names: Iterable[str], variables: Mapping[str, str], args: Sequence[object] | Mapping[str, object] | None = None) -> dict[str, object]:
        """A task with a single-row result: variable -> value of the column that it names. No row or several are errors."""
        rows = self.query(sql, names, args).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"a single row was expected, there are {'none' if not rows else 'several'}")
        return {v: rows[0][c] for v, c in variables.items()}

    def command(self, variable: str, variables: Mapping[str, str], names: Iterable[str], args: Sequence[object] | Mapping[str, object] | None = None) -> DataFrame:
        """A SQL command that a variable holds; variables in it are replaced by their values."""
        return self.query(resolve_variables(f"@[{variable}]", variables), names, args)

    def execute(self, name: str, **arguments: object) -> DataFrame:
        """The result of a stored procedure: a registered function."""
        return self.procedures[self.key(name)](self, **arguments)

    def query(self, sql: str, names: Iterable[str], args: Sequence[object] | Mapping[str, object] | None = None) -> DataFrame:
        """A SQL command over the named tables, with ? or :name parameters bound as values.

        Names of one to four parts, brackets and temporary tables (#t) may stand in the text as they are: each table is a view of its
        own to this call, so tables whose last parts are equal stay apart. The last part alone means a table where only one of
        `names` has it, and is an error where several do. A column may be qualified by an alias, the last part or the whole name."""
        views = {self.key(n): f"tidemill_{uuid.uuid4().hex}" for n in names}
        text = _renamed(sql, views)
        try:
            for n, view in views.items():
                self(n).createOrReplaceTempView(view)
            return self.spark.sql(text, args=list(args) if isinstance(args, (list, tuple)) else args)
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)


def _meant(name: str, views: Mapping[str, str]) -> str | None:
    """The key among `views` that a name in a text means."""
    key = Tables.key(name)
    if key in views:
        return key
    near = [k for k in views if k.rpartition(".")[2] == key] if "." not in key else [k for k in views if k.endswith("." + key)]
    if len(near) > 1:
        raise ValueError(f"{name} may be {' or '.join(sorted(near))}")
    return near[0] if near else None


def _renamed(sql: str, views: Mapping[str, str]) -> str:
    """The text with its tables' names replaced by views, each under the alias it has or its last part; brackets become back quotes."""
    tokens = sqltext.scan(sql)
    ctes = sqltext.cte_names(tokens)
    places = {place: (name, alias) for name, alias, place in sqltext.table_places(tokens) if name not in ctes}
    out, at, k = [], 0, 0

    def put(until: int, new: str, after: int) -> None:
        nonlocal at
        out.extend((sql[at:until], new))
        at = after

    while k < len(tokens):
        if tokens[k].kind != "name":
            k += 1
            continue
        name, end = sqltext.name_at(tokens, k)
        start, stop = tokens[k].start, tokens[end - 1].end
        if k in places:
            if key := _meant(name, views):
                named = any(t.kind == "name" and t.word == "AS" for t in tokens[end : end + 1]) or places[k][1] != name.rpartition(".")[2]
                put(start, views[key] if named else f"{views[key]} AS `{_bare(sql[tokens[end - 1].start : stop])}`", stop)
            else:
                _quoted(sql, tokens[k:end], put)
        elif name.count(".") > 1 and Tables.key(name.rpartition(".")[0]) in views:
            # whole name and column: the last part stands for the table
            put(start, "`" + _bare(name.split(".")[-2]) + "`.", tokens[end - 1].start)
            _quoted(sql, tokens[end - 1 : end], put)
        else:
            _quoted(sql, tokens[k:end], put)
        k = end
    return "".join(out) + sql[at:]


def _bare(word: str) -> str:
    return word.strip('[]"`').replace("`", "``")


def _quoted(sql: str, tokens: Sequence[sqltext.Token], put: Callable[[int, str, int], None]) -> None:
    for t in tokens:
        word = sql[t.start : t.end]
        if word[0] == "[" and word[-1] == "]" and not word[1:-1].isdigit():
            put(t.start, f"`{_bare(word)}`", t.end)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    """A flat file: the schema is given, never inferred; a row that does not fit is an error."""
    return spark.read.schema(schema).option("header", header).option("sep", delimiter).option("mode", "FAILFAST").csv(path)


def append(df: DataFrame, path: str) -> None:
    """Fast load: one atomic job."""
    df.write.mode("append").parquet(path)


def truncate_load(df: DataFrame, path: str) -> None:
    """TRUNCATE TABLE, then load."""
    df.write.mode("overwrite").parquet(path)


def reload_periods(df: DataFrame, path: str, period: str) -> None:
    """Delete the periods that df has and insert their rows: other periods' files are not touched."""
    df.repartition(period, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def markdown(df: DataFrame, title: str, missing: str = "N/A") -> DataFrame:
    """The lines of a Markdown table in order, as (line_no, line). Row order is that of all columns."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit(missing)), r"([|\\])", r"\\$1") for c in df.columns]
    body = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).withColumn("part", F.lit(1))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    spark = df.sparkSession
    top = spark.createDataFrame([(x, 0, i) for i, x in enumerate(head)], "line string, part int, n int")
    return top.unionByName(body.withColumn("n", F.lit(0))).orderBy("part", "n", "line").select("line")


def markdown_by(df: DataFrame, key: str, title: str, missing: str = "N/A") -> DataFrame:
    """key, line_no from 1, line: a Markdown table of each key's rows, sorted by their lines."""
    shown = [c for c in df.columns if c != key]
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit(missing)), r"([|\\])", r"\\$1"), r"\s*\n\s*", " ")
    body = df.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, shown)), F.lit(" |")).alias("line"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line")) + 4
    head = [f"## {title}", "", "| " + " | ".join(shown) + " |", "|" + " --- |" * len(shown)]
    top = df.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, head))).alias("n", "line"))
    return top.select(key, (F.col("n") + 1).alias("line_no"), "line").unionByName(body.select(key, place.alias("line_no"), "line"))


def dot(edges: DataFrame, a: str, b: str, name: str = "lineage") -> DataFrame:
    """DOT text of an edge table, a row for each line."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    body = edges.select(F.concat(F.lit("  "), quote(a), F.lit(" -> "), quote(b), F.lit(";")).alias("line")).distinct().withColumn("part", F.lit(1))
    spark = edges.sparkSession
    ends = spark.createDataFrame([(f"digraph {name} {{", 0), ("}", 2)], "line string, part int")
    return ends.unionByName(body).orderBy("part", "line").select("line")
