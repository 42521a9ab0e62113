"""Expressions of packages, from their text to one native Column.

    column = expression('(DT_WSTR,4)YEAR(d) + RIGHT("0" + (DT_WSTR,2)MONTH(d), 2)', df.schema)

The text is read once by precedence; the result is Spark's own expression tree, so it runs in the JVM like one written by hand.
Each part has a kind (text, whole, number, logic, date, moment), known from the schema, literals and casts: `+` joins texts and adds numbers, and
a mix of both is an error, as in the language itself. Unknown functions, types, columns and variables are errors too.

Values: `variables` maps Namespace::Name to a Python value, or to Text for one that is an expression itself (those are put in
where they are used; a cycle is an error). `ids` maps the lineage ids that #{...} names to columns. GETDATE() is `now`, a
parameter: nothing reads the clock. Null in, null out; && and || are three-valued; whole / whole truncates; comparisons of texts heed case."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ssis


class Text(str):
    """A variable's value that is an expression."""


class Typed(NamedTuple):
    column: Column
    kind: str


_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|\#\{(?P<id>[^}]*)\}|@\[(?P<variable>[^\]]*)\]|@(?P<bare>\w+(?:::\w+)?)|\[(?P<quoted>[^\]]*)\]|(?P<name>[A-Za-z_]\w*)|(?P<mark>&&|\|\||==|!=|<=|>=|[-+*/%<>!~&|^?:(),.]))""")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}
#: Binary operators by how tightly they bind.
_BINDS = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
# The language's types by kind, and its names of date parts.
_TYPES = {"text": "DT_STR DT_WSTR DT_TEXT DT_NTEXT".split(), "whole": "DT_I1 DT_I2 DT_I4 DT_I8 DT_UI1 DT_UI2 DT_UI4 DT_UI8".split(), "number": "DT_R4 DT_R8 DT_CY DT_NUMERIC DT_DECIMAL".split(), "logic": ["DT_BOOL"], "date": "DT_DATE DT_DBDATE".split(), "moment": "DT_DBTIMESTAMP DT_DBTIMESTAMP2".split()}
_SPARK = {**ssis.CASTS, "DT_I1": "tinyint", "DT_UI1": "smallint", "DT_UI2": "int", "DT_UI4": "bigint", "DT_UI8": "decimal(20,0)", "DT_R4": "float", "DT_TEXT": "string", "DT_NTEXT": "string", "DT_STR": "string", "DT_WSTR": "string", "DT_DBTIMESTAMP2": "timestamp_ntz"}
_PARTS = {"year": "year yyyy yy", "quarter": "quarter qq q", "month": "month mm m", "dayofyear": "dayofyear dy y", "day": "day dd d", "week": "week wk ww", "weekday": "weekday dw w", "hour": "hour hh", "minute": "minute mi n", "second": "second ss s"}
_PART = {name: part for part, names in _PARTS.items() for name in names.split()}
_NUMERIC, _DATES = ("whole", "number"), ("date", "moment")


def _kind_of(type_: T.DataType) -> str:
    if isinstance(type_, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(type_, T.IntegralType):
        return "whole"
    if isinstance(type_, T.NumericType):
        return "number"
    if isinstance(type_, T.BooleanType):
        return "logic"
    if isinstance(type_, T.DateType):
        return "date"
    if isinstance(type_, (T.TimestampType, T.TimestampNTZType)):
        return "moment"
    raise ValueError(f"no expression can use a column of type {type_.simpleString()}")


def _literal(value: object) -> Typed:
    for types, kind in ((bool, "logic"), (int, "whole"), (str, "text"), (dt.datetime, "moment"), (dt.date, "date")):
        if isinstance(value, types):
            return Typed(F.lit(value), kind)
    return Typed(F.lit(value), "number")


def _part(name: str) -> str:
    if name.lower() not in _PART:
        raise ValueError(f"no date part {name!r}")
    return _PART[name.lower()]


def _datepart(part: str, d: Column) -> Column:
    of = {"year": F.year, "quarter": F.quarter, "month": F.month, "dayofyear": F.dayofyear, "day": F.dayofmonth, "week": F.weekofyear, "weekday": F.dayofweek, "hour": F.hour, "minute": F.minute, "second": F.second}
    return of[_part(part)](d)


def _dateadd(part: str, n: Column, d: Column, kind: str) -> Typed:
    """A date stays one, but for parts of a day; the time of day stays; a day past the month's end becomes its last."""
    part, n = _part(part), n.cast("int")
    if part in ("day", "dayofyear", "weekday", "week") and kind == "date":
        return Typed(F.date_add(d, n * (7 if part == "week" else 1)), kind)
    if part in ("year", "quarter", "month"):
        n, zero = n * {"year": 12, "quarter": 3, "month": 1}[part], F.lit(0)
        return Typed(d + F.make_ym_interval(zero, n), kind)
    if part in ("hour", "minute", "second"):
        spans = {"hour": F.lit(0), "minute": F.lit(0), "second": F.lit(0), part: n}
        moment = d.cast("timestamp_ntz") if kind == "date" else d
        return Typed(moment + F.make_dt_interval(F.lit(0), spans["hour"], spans["minute"], spans["second"].cast("decimal(18,6)")), "moment")
    return Typed(d + F.make_dt_interval(n * (7 if part == "week" else 1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)")), kind)


def _datediff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of the part between a and b."""
    part = _part(part)
    if part in ("day", "dayofyear", "weekday"):
        return F.datediff(b, a)
    if part == "week":
        return F.floor(F.datediff(F.date_trunc("week", F.date_add(b, 1)), F.date_trunc("week", F.date_add(a, 1))) / 7).cast("int")
    if part in ("year", "quarter", "month"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return {"year": F.year(b) - F.year(a), "quarter": (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a), "month": months}[part]
    unit = {"hour": 3600, "minute": 60, "second": 1}[part]
    at = lambda x: F.floor(F.unix_seconds(x.cast("timestamp_ntz").cast("timestamp")) / unit)
    return (at(b) - at(a)).cast("int")


#: Functions: kinds of the arguments (any: x), kind of the result (=: of the first argument), builder.
_FUNCTIONS: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {
    "ISNULL": (("x",), "logic", lambda x: x.isNull()),
    "REPLACENULL": (("x", "x"), "=", F.coalesce),
    "LEN": (("text",), "whole", F.length),
    "LEFT": (("text", "whole"), "text", F.left),
    "RIGHT": (("text", "whole"), "text", F.right),
    "SUBSTRING": (("text", "whole", "whole"), "text", F.substring),
    "UPPER": (("text",), "text", F.upper),
    "LOWER": (("text",), "text", F.lower),
    "TRIM": (("text",), "text", F.trim),
    "LTRIM": (("text",), "text", F.ltrim),
    "RTRIM": (("text",), "text", F.rtrim),
    "REVERSE": (("text",), "text", F.reverse),
    "REPLACE": (("text", "text", "text"), "text", F.replace),
    "REPLICATE": (("text", "whole"), "text", lambda s, n: F.repeat(s, n.cast("int"))),
    "FINDSTRING": (("text", "text", "whole"), "whole", lambda s, part, n: F.when(F.size(F.split(s, F.concat(F.lit(r"\Q"), part, F.lit(r"\E")))) > n, F.length(F.call_function("substring_index", s, part, n)) + 1).otherwise(0)),
    "CODEPOINT": (("text",), "whole", F.ascii),
    "ABS": (("n",), "=", F.abs),
    "CEILING": (("n",), "=", F.ceil),
    "FLOOR": (("n",), "=", F.floor),
    "SIGN": (("n",), "whole", lambda x: F.signum(x).cast("int")),
    "SQUARE": (("n",), "number", lambda x: F.pow(x, F.lit(2))),
    "SQRT": (("n",), "number", F.sqrt),
    "EXP": (("n",), "number", F.exp),
    "LN": (("n",), "number", F.ln),
    "LOG": (("n",), "number", F.log10),
    "POWER": (("n", "n"), "number", F.pow),
    "ROUND": (("n", "whole"), "=", F.round),
    "YEAR": (("date",), "whole", F.year),
    "MONTH": (("date",), "whole", F.month),
    "DAY": (("date",), "whole", F.dayofmonth),
}


class _Reader:
    def __init__(self, text: str, kinds: Mapping[str, str], names: Mapping[str, str], variables: Mapping[str, object], ids: Mapping[str, str], now: object, open_: tuple[str, ...]):
        self.text, self.kinds, self.names, self.variables, self.ids, self.now, self.open = text, kinds, names, variables, ids, now, open_
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"{text[at : at + 20]!r} cannot be read in {text!r}")
            self.tokens.append((found.lastgroup or "", found[found.lastgroup or 0]))
            at = found.end()
        self.k = 0

    def next_is(self, *marks: str) -> bool:
        return self.k < len(self.tokens) and self.tokens[self.k][0] == "mark" and self.tokens[self.k][1] in marks

    def take(self, mark: str) -> None:
        if not self.next_is(mark):
            raise ValueError(f"{mark!r} is missing in {self.text!r}")
        self.k += 1

    def whole(self) -> Typed:
        out = self.choice()
        if self.k < len(self.tokens):
            raise ValueError(f"{self.tokens[self.k][1]!r} is one too many in {self.text!r}")
        return out

    def choice(self) -> Typed:
        condition = self.binary(1)
        if not self.next_is("?"):
            return condition
        self.need(condition, "logic")
        self.take("?")
        a = self.choice()
        self.take(":")
        b = self.choice()
        kind = a.kind if a.kind == b.kind else "number" if {a.kind, b.kind} <= {*_NUMERIC} else "moment" if {a.kind, b.kind} <= {*_DATES} else None
        if kind is None:
            raise ValueError(f"{a.kind} and {b.kind} are the two results of a choice in {self.text!r}")
        return Typed(ssis.ternary(condition.column, a.column, b.column), kind)

    def need(self, x: Typed, *kinds: str) -> Column:
        if x.kind not in kinds and not (x.kind in _DATES and "date" in kinds):
            raise ValueError(f"{' or '.join(kinds)} is needed, there is {x.kind}, in {self.text!r}")
        return x.column

    def binary(self, least: int) -> Typed:
        left = self.unary()
        while self.k < len(self.tokens) and self.tokens[self.k][0] == "mark" and _BINDS.get(self.tokens[self.k][1], 0) >= least:
            mark = self.tokens[self.k][1]
            self.k += 1
            left = self.combine(mark, left, self.binary(_BINDS[mark] + 1))
        return left

    def combine(self, mark: str, a: Typed, b: Typed) -> Typed:
        x, y = a.column, b.column
        if mark in ("&&", "||"):
            p, q = self.need(a, "logic"), self.need(b, "logic")
            return Typed(p & q if mark == "&&" else p | q, "logic")
        if mark in ("==", "!=", "<", ">", "<=", ">="):
            if a.kind != b.kind and not ({a.kind, b.kind} <= {*_NUMERIC} or {a.kind, b.kind} <= {*_DATES}):
                raise ValueError(f"{a.kind} {mark} {b.kind} in {self.text!r}")
            return Typed({"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[mark], "logic")
        if mark == "+" and "text" in (a.kind, b.kind):
            return Typed(F.concat(self.need(a, "text"), self.need(b, "text")), "text")
        self.need(a, *_NUMERIC)
        self.need(b, *_NUMERIC)
        both = "whole" if a.kind == b.kind == "whole" else "number"
        if mark in "&|^":
            if both != "whole":
                raise ValueError(f"{mark!r} needs whole numbers in {self.text!r}")
            return Typed({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[mark](y), both)
        if mark == "/" and both == "whole":
            return Typed(F.call_function("div", x, y), both)
        return Typed({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[mark], both)

    def unary(self) -> Typed:
        if self.next_is("!"):
            self.k += 1
            return Typed(~self.need(self.unary(), "logic"), "logic")
        if self.next_is("-", "~"):
            mark = self.tokens[self.k][1]
            self.k += 1
            x = self.unary()
            self.need(x, *(_NUMERIC if mark == "-" else ("whole",)))
            return Typed(-x.column if mark == "-" else F.bitwise_not(x.column), x.kind)
        if self.next_is("(") and self.k + 1 < len(self.tokens) and self.tokens[self.k + 1][0] == "name" and self.tokens[self.k + 1][1].upper().startswith("DT_"):
            self.k += 1
            kind, sizes = self.type_()
            self.take(")")
            return self.cast(self.unary(), kind, sizes)
        return self.primary()

    def type_(self) -> tuple[str, list[int]]:
        kind = self.tokens[self.k][1].upper()
        if kind not in _SPARK and kind not in ("DT_NUMERIC", "DT_DECIMAL"):
            raise ValueError(f"no type {kind} in {self.text!r}")
        self.k += 1
        sizes = []
        while self.next_is(","):
            self.k += 1
            sizes.append(int(self.tokens[self.k][1]))
            self.k += 1
        return kind, sizes

    @staticmethod
    def spark_type(kind: str, sizes: Sequence[int]) -> str:
        if kind in ("DT_NUMERIC", "DT_DECIMAL"):
            return f"decimal({sizes[0]},{sizes[1]})" if len(sizes) > 1 else f"decimal(29,{sizes[0] if sizes else 0})"
        return _SPARK[kind]

    def cast(self, x: Typed, kind: str, sizes: Sequence[int]) -> Typed:
        to = next(k for k, names in _TYPES.items() if kind in names)
        if kind in ("DT_STR", "DT_WSTR"):
            shown = F.initcap(x.column.cast("string")) if x.kind == "logic" else x.column
            return Typed(ssis.text(shown, sizes[0]), to)
        if x.kind == "number" and to == "whole":
            return Typed(F.round(x.column, 0).cast(self.spark_type(kind, sizes)), to)
        return Typed(x.column.cast(self.spark_type(kind, sizes)), to)

    def primary(self) -> Typed:
        if self.k >= len(self.tokens):
            raise ValueError(f"{self.text!r} ends too soon")
        kind, word = self.tokens[self.k]
        self.k += 1
        if kind == "text":
            return Typed(F.lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), word[1:-1], flags=re.S)), "text")
        if kind == "number":
            return Typed(F.lit(int(word)), "whole") if word.isdigit() else Typed(F.lit(float(word)), "number")
        if kind == "mark" and word == "(":
            out = self.choice()
            self.take(")")
            return out
        if kind in ("variable", "bare"):
            return self.variable(word)
        if kind == "id":
            if word not in self.ids:
                raise ValueError(f"no column is known for the id {word!r}")
            return self.named(self.ids[word])
        if kind in ("name", "quoted"):
            if self.next_is("("):
                return self.call(word.strip().upper())
            if kind == "name" and word.upper() in ("TRUE", "FALSE"):
                return Typed(F.lit(word.upper() == "TRUE"), "logic")
            if self.next_is("."):  # [component].[column]
                self.k += 2
                word = self.tokens[self.k - 1][1]
            return self.named(word)
        raise ValueError(f"{word!r} is one too many in {self.text!r}")

    def named(self, name: str) -> Typed:
        own = self.names.get(name, self.names.get(name.lower()))
        if own is None:
            raise ValueError(f"no column {name!r} for {self.text!r}")
        return Typed(F.col("`" + own.replace("`", "``") + "`"), self.kinds[own])

    def variable(self, word: str) -> Typed:
        key = word.strip() if "::" in word else f"User::{word.strip()}"
        if key not in self.variables:
            raise ValueError(f"no variable {key} for {self.text!r}")
        value = self.variables[key]
        if not isinstance(value, Text):
            return _literal(value)
        if key in self.open:
            raise ValueError(f"variables refer to each other: {' -> '.join((*self.open, key))}")
        return _Reader(value, self.kinds, self.names, self.variables, self.ids, self.now, (*self.open, key)).whole()

    def call(self, name: str) -> Typed:
        self.take("(")
        if name == "NULL":
            kind, sizes = self.type_()
            self.take(")")
            return Typed(F.lit(None).cast(self.spark_type(kind, sizes)), next(k for k, names in _TYPES.items() if kind in names))
        args: list[Typed] = []
        raw: list[str | None] = []
        while not self.next_is(")"):
            if args:
                self.take(",")
            token = self.tokens[self.k] if self.k < len(self.tokens) else ("", "")
            args.append(self.choice())
            raw.append(token[1][1:-1] if token[0] == "text" else None)
        self.take(")")
        if name == "GETDATE":
            if self.now is None:
                raise ValueError("GETDATE() needs the parameter now")
            return _literal(self.now)
        if name in ("DATEADD", "DATEDIFF", "DATEPART"):
            wanted, build = {"DATEADD": (("whole", "date"), _dateadd), "DATEDIFF": (("date", "date"), _datediff), "DATEPART": (("date",), _datepart)}[name]
            if len(args) != len(wanted) + 1 or raw[0] is None:
                raise ValueError(f"{name} needs a date part in quotes and {len(wanted)} more in {self.text!r}")
            given = [self.need(x, k) for x, k in zip(args[1:], wanted)]
            return _dateadd(raw[0], *given, args[2].kind) if name == "DATEADD" else Typed(build(raw[0], *given), "whole")
        if name not in _FUNCTIONS:
            raise ValueError(f"no function {name} in {self.text!r}")
        wanted, kind, build = _FUNCTIONS[name]
        if len(args) != len(wanted):
            raise ValueError(f"{name} takes {len(wanted)} arguments, there are {len(args)}, in {self.text!r}")
        given = [x.column if k == "x" else self.need(x, *(_NUMERIC if k == "n" else (k,))) for x, k in zip(args, wanted)]
        return Typed(build(*given), args[0].kind if kind == "=" else kind)


def expression(text: str, schema: T.StructType | None = None, variables: Mapping[str, object] | None = None, ids: Mapping[str, str] | None = None, now: dt.date | dt.datetime | None = None) -> Column:
    """The Column that an expression's text means over a DataFrame of the schema."""
    fields = schema.fields if schema else []
    kinds = {}
    for f in fields:
        try:
            kinds[f.name] = _kind_of(f.dataType)
        except ValueError:
            continue  # an error only where it is named
    names = {**{n.lower(): n for n in kinds}, **{n: n for n in kinds}}
    return _Reader(text, kinds, names, variables or {}, ids or {}, now, ()).whole().column


def derive(df: DataFrame, texts: Mapping[str, str], variables: Mapping[str, object] | None = None, ids: Mapping[str, str] | None = None, now: dt.date | dt.datetime | None = None) -> DataFrame:
    """A Derived Column transformation: all texts see the input's columns, new ones are added, others replaced."""
    return df.withColumns({name: expression(text, df.schema, variables, ids, now) for name, text in texts.items()})


def split(df: DataFrame, cases: Sequence[tuple[str, str]], default: str, variables: Mapping[str, object] | None = None, ids: Mapping[str, str] | None = None, output: str = "_output") -> DataFrame:
    """A Conditional Split: `output` names the first case whose condition holds, or the default."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in cases:
        chosen = chosen.when(expression(text, df.schema, variables, ids), F.lit(name))
    return df.withColumn(output, chosen.otherwise(F.lit(default)))


def evaluate(spark: SparkSession, variables: Mapping[str, object], now: dt.date | dt.datetime | None = None) -> dict[str, object]:
    """The values of all variables, those that are expressions worked out, in one row."""
    own = {k: expression(v, None, variables, now=now) for k, v in variables.items() if isinstance(v, Text)}
    row = spark.range(1).select(*(c.alias(str(n)) for n, c in enumerate(own.values()))).first() if own else ()
    return {**variables, **dict(zip(own, row))}


def texts_of(found: Mapping[str, DataFrame], package: str, component: str) -> tuple[dict[str, str], dict[str, str]]:
    """From packages' catalogs: column -> expression text of one component, and id -> column name for the ids in them (the part in the
    id's last brackets)."""
    columns = found["columns"].where((F.col("package") == package) & (F.col("component") == component)).select("flow", F.col("ref_id").alias("owner"), "name", "position")
    texts = found["properties"].where((F.col("package") == package) & (F.col("name") == "Expression")).select("flow", "owner", "value")
    # the columns of one component
    rows = columns.join(texts, ["flow", "owner"]).orderBy(F.col("position").cast("int"), "name").collect()
    out = {r["name"]: r["value"] for r in rows}
    ids = {i: i.rpartition("[")[2].rstrip("]") for text in out.values() for i in re.findall(r"#\{([^}]*)\}", text)}
    return out, ids
