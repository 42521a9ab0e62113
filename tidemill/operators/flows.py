"""Packages' data flows: what components read and write, column lineage, listings, the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources import packages, tables

from . import lineage, scopes, sqltext
from .select import first_per_key

FLOW = lineage.FLOW
COMPONENT = (*FLOW, "component")
# Classes of transformations, and what stands for a source where a column has none.
TRANSFORMATIONS = "DerivedColumn MergeJoin Sort Lookup ConditionalSplit UnionAll DataConvert DataConversion Aggregate".split()
NO_SOURCE = ("Transformation", "Variable/Expression", "Derived / Transformation")
_BLANK = " \t\r\n"


def _filled(c: str):
    return F.nullif(F.trim(c, F.lit(_BLANK)), F.lit(""))


def commands(found: dict[str, DataFrame]) -> DataFrame:
    """package, flow, component, sql, rowset: what a component reads or writes. Real packages have both
    properties, and those of variables, on each component, and leave empty what its AccessMode does not use."""
    names = ("SqlCommand", "OpenRowset", "SqlCommandVariable", "OpenRowsetVariable", "AccessMode")
    p = found["properties"].where(F.col("name").isin(*names)).groupBy(*FLOW, F.col("owner").alias("component"))
    props = p.agg(*[F.max(F.when(F.col("name") == n, _filled("value"))).alias(n) for n in names])
    kinds = found["components"].select(*FLOW, F.col("ref_id").alias("component"), "class")
    props = props.join(kinds, [*COMPONENT], "left")
    variables = found["variables"].where("name is not null").select("package", "namespace", "name", F.coalesce(_filled("value"), F.col("expression")).alias("_text"))
    # by namespace and name, or by the name alone; one text of each, for names that several scopes have
    keys = F.explode(F.array_distinct(F.array(F.concat_ws("::", "namespace", "name"), F.col("name"))))
    texts = variables.select("package", keys.alias("_name"), "_text").groupBy("package", "_name").agg(F.min("_text").alias("_text"))
    for n, to in (("SqlCommandVariable", "_sql"), ("OpenRowsetVariable", "_rowset")):
        props = props.withColumn("_name", F.col(n)).join(texts.withColumnRenamed("_text", to), ["package", "_name"], "left").drop("_name")
    # AccessMode: 0 rowset, 1 rowset from a variable, 2 command; 3 and 4 are 0 and 1 with fast load in a
    # destination, 3 is a command from a variable in a source
    mode, target = F.coalesce(F.col("AccessMode").cast("int"), F.lit(-1)), F.coalesce(F.col("class").contains("Destination"), F.lit(False))
    sql = F.coalesce(F.when(~target & (mode == 3), F.col("_sql")), "SqlCommand")
    rowset = F.coalesce(F.when((mode == 1) | (target & (mode == 4)), F.col("_rowset")), "OpenRowset")
    by_rowset = rowset.isNotNull() & (sql.isNull() | mode.isin(0, 1) | (target & (mode != 2)))
    return props.select(*COMPONENT, "class", F.when(~by_rowset, sql).alias("sql"), F.when(by_rowset, rowset).alias("rowset"))


def _links(found: dict[str, DataFrame], out: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between lineage ids, and rows that stand for the source of output columns without any.

    By the ids that properties name; a Union All's columns by OutputColumnLineageID, else by position; columns of Merge
    Join, Sort and Aggregate by name; a derived column's by the names in its expression."""
    p = found["properties"]
    is_ = lambda pattern: F.col("class").rlike(pattern)
    kind = F.regexp_extract("class", r"([^.]*)$", 1)
    step = F.when(is_("UnionAll"), F.concat(F.lit("Union("), "component_name", F.lit(")"))).otherwise(F.concat(kind, F.lit("("), F.col("component_name"), F.lit(")")))
    made = out.select(*COMPONENT, "ref_id", "name", "position", "class", "component_name", F.col("lineage_id").alias("to_id"), step.alias("step"))
    refs = p.where(F.col("name").isin("SourceInputColumnLineageID", "InputColumnID", "SortColumnId", "Expression")).select(*FLOW, F.col("owner").alias("ref_id"), F.explode(F.regexp_extract_all("value", F.lit(r"#\{([^}]*)\}"), 1)).alias("from_id"))
    # joins and sorts name the input column, whose lineage id is that of the column it takes
    inputs = found["columns"].where("lineage_id is not null").select(*FLOW, F.col("ref_id").alias("from_id"), F.col("lineage_id").alias("_taken"))
    refs = refs.join(inputs, [*FLOW, "from_id"], "left").withColumn("from_id", F.coalesce("_taken", "from_id")).drop("_taken")
    exact = made.join(refs, [*FLOW, "ref_id"]).select(*FLOW, "from_id", "to_id", "step")
    given = p.where("name = 'OutputColumnLineageID'").select(*FLOW, F.col("owner").alias("in_ref"), F.regexp_extract("value", r"#\{([^}]*)\}", 1).alias("to_id"))
    exact = exact.unionByName(taken.join(given, [*FLOW, "in_ref"]).join(made.where(is_("UnionAll")), [*COMPONENT, "to_id"]).select(*FLOW, "from_id", "to_id", "step"))
    open_ = made.join(exact.select(*FLOW, "to_id").distinct(), [*FLOW, "to_id"], "left_anti")
    by_place = open_.where(is_("UnionAll")).join(taken.withColumnRenamed("in_position", "position"), [*COMPONENT, "position"])
    named = open_.where(is_("MergeJoin|Sort|Aggregate")).join(taken, [*COMPONENT]).where(F.upper("name") == F.upper("in_name"))
    # the name as it is comes before other cases of it
    named = first_per_key(named, [*FLOW, "to_id"], [(F.col("name") == F.col("in_name")).desc(), F.asc("from_id")])
    formula = p.where(F.col("name").isin("FriendlyExpression", "Expression")).groupBy(*FLOW, F.col("owner").alias("ref_id")).agg(F.coalesce(F.max(F.when(F.col("name") == "FriendlyExpression", F.col("value"))), F.max("value")).alias("formula"))
    derived = open_.where(is_("DerivedColumn")).join(formula, [*FLOW, "ref_id"], "left")
    bare = F.regexp_replace(F.coalesce("formula", F.lit("")), r'"(?:[^"\\]|\\.)*+"|@\[[^\]]*\]|@?\w+::\w+|\(DT_\w+(?:,[^)]*)?\)', " ")
    words = F.transform(F.regexp_extract_all(bare, F.lit(r"(\[[^\]]+\]|\b[A-Za-z_]\w*\b)"), 1), lambda x: F.upper(F.regexp_replace(x, r"[\[\]]", "")))
    words = derived.withColumn("word", F.explode(F.array_distinct(words)))
    spelt = words.join(taken, [*COMPONENT]).where(F.col("word") == F.upper("in_name"))
    links = exact
    for more in (by_place, named, spelt):
        links = links.unionByName(more.select(*FLOW, "from_id", "to_id", "step"))
    bare_ones = open_.join(links.select(*FLOW, "to_id").distinct(), [*FLOW, "to_id"], "left_anti").join(formula, [*FLOW, "ref_id"], "left")
    variable = is_("DerivedColumn") & F.coalesce(F.col("formula").rlike(r"@\[|::"), F.lit(False))
    table = F.when(variable, NO_SOURCE[1]).when(is_("DerivedColumn"), NO_SOURCE[2]).otherwise(NO_SOURCE[0])
    column = F.when(variable, "Expression").otherwise(F.col("name"))
    logic = F.when(is_("DerivedColumn"), F.coalesce("formula", F.lit("Derived"))).when(is_("MergeJoin|Sort|Aggregate"), F.concat(F.lit("Async ("), "component_name", F.lit(")"))).otherwise("Unknown Logic")
    return links, bare_ones.select(*FLOW, F.col("to_id").alias("lineage_id"), table.alias("source_table"), column.alias("source_column"), logic.alias("expression"))


def package_lineage(found: dict[str, DataFrame]) -> DataFrame:
    """From packages' catalogs to lineage rows: sources seed their output columns, transformations link ids (see
    _links), destinations map ids to table columns; ids that only pass through need no link.

    A source column is that of its command's select list where the list names it; else its table is that of the
    command, its rowset, its connection (files) or its own name, and its name that of the reference column that
    it copies (lookups), the external column or its own. confidence: exact; default (a transformation stands for the
    source); inferred (by name, where the destination's id is unknown; or the upstream table's column of that name);
    none."""
    c = found["components"]
    connected = packages.connection_of(c, found["connections"])
    named = connected.select(*FLOW, F.col("ref_id").alias("component"), F.col("name").alias("component_name"), "class", "connection")
    ports = found["ports"].select(*FLOW, F.col("ref_id").alias("port"), "direction", "is_error")
    all_ = found["columns"].join(ports, [*FLOW, "port"])
    out = all_.where("direction = 'output' and is_error <> 'true'").join(named, [*COMPONENT])
    taken = all_.where("direction = 'input' and lineage_id is not null").select(*COMPONENT, F.col("ref_id").alias("in_ref"), F.col("name").alias("_name"), F.col("position").alias("in_position"), F.col("lineage_id").alias("from_id"))
    # an input column without a cached name has that of the column it takes
    own = found["columns"].join(ports.where("direction = 'output'"), [*FLOW, "port"]).groupBy(*FLOW, F.col("lineage_id").alias("from_id")).agg(F.min("name").alias("_own"))
    taken = taken.join(own, [*FLOW, "from_id"], "left").withColumn("in_name", F.coalesce("_name", "_own")).drop("_name", "_own")
    is_source = F.col("class").rlike("Source|Lookup")
    command = commands(found).drop("class")
    stated = command.where("sql is not null").select(F.to_json(F.struct(*COMPONENT)).alias("script"), F.lit(1).alias("number"), F.col("sql").alias("statement"))
    listed = scopes.column_sources(stated).where("source_table is not null").select(F.col("script").alias("_script"), F.col("alias").alias("_alias"), F.col("source_table").alias("_table"), F.col("source_column").alias("_column"))
    # a command whose only source is a table or procedure of unknown columns: EXEC p, select * from t
    whole = listed.groupBy("_script").agg(F.max(F.col("_column") == "*").alias("_star"), F.countDistinct("_table").alias("_n"), F.min("_table").alias("_sole")).where("_star and _n = 1").select(F.col("_script").alias("_of"), "_sole")
    from_ = F.nullif(sqltext.clean_name(F.regexp_extract("sql", r"(?is)\bfrom\s+([\w.\[\]#]+)", 1)), F.lit(""))
    file = F.when(F.col("class").rlike("FlatFile|Excel|RawSource|XmlSource"), F.col("connection"))
    copied = found["properties"].where("name = 'CopyFromReferenceColumn' and trim(value) <> ''").groupBy(*FLOW, F.col("owner").alias("ref_id")).agg(F.min(F.trim("value")).alias("_copied"))
    external = found["external_columns"].select(*FLOW, F.col("ref_id").alias("external_ref"), F.col("name").alias("target_column"))
    seeds = out.where(is_source).join(command, [*COMPONENT], "left").join(copied, [*FLOW, "ref_id"], "left").join(external, [*FLOW, "external_ref"], "left")
    seeds = seeds.withColumn("origin", F.coalesce("_copied", "target_column", "name")).withColumn("_script", F.to_json(F.struct(*COMPONENT)))
    seeds = seeds.join(listed, (seeds["_script"] == listed["_script"]) & (F.upper("origin") == F.col("_alias")), "left")
    seeds = seeds.join(whole, F.to_json(F.struct(*COMPONENT)) == F.col("_of"), "left")
    table = F.coalesce("_table", "_sole", from_, sqltext.clean_name(F.col("rowset")), F.upper(file), F.upper("component_name"))
    seeds = seeds.select(*FLOW, "lineage_id", "name", table.alias("source_table"), F.coalesce("_column", "origin").alias("source_column"), F.lit("column").alias("expression"))
    links, defaults = _links(found, out.where(~is_source), taken)
    targets = found["columns"].join(named.where(F.col("class").contains("Destination")), [*COMPONENT]).join(external, [*FLOW, "external_ref"]).join(command, [*COMPONENT], "left")
    target = F.coalesce(sqltext.clean_name(F.col("rowset")), F.nullif(sqltext.clean_name(F.regexp_extract("sql", r"(?is)\b(?:from|into)\s+([\w.\[\]#]+)", 1)), F.lit("")), F.upper("connection"), F.upper("component_name"))
    targets = targets.select(*COMPONENT, target.alias("target_table"), "target_column", "lineage_id")
    by_name = seeds.select(*FLOW, "name", "source_table", "source_column", F.lit("name match").alias("expression")).distinct()
    # a destination below a table source whose columns have gone: the column of that name is assumed there
    feeds = lineage.edges(found["ports"], found["paths"]).select(*FLOW, F.col("source").alias("_from"), F.col("target").alias("component"))
    rowsets = command.where("rowset is not null").join(named.where("class like '%Source%'").select(*COMPONENT), [*COMPONENT]).select(*FLOW, F.col("component").alias("_from"), sqltext.clean_name(F.col("rowset")).alias("source_table"))
    stale = targets.join(feeds, [*COMPONENT]).join(rowsets, [*FLOW, "_from"]).select(*FLOW, F.col("target_column").alias("name"), "source_table", F.col("target_column").alias("source_column"), F.lit("stale package").alias("expression")).distinct()
    have = by_name.select(*FLOW, F.upper("name").alias("_up")).distinct()
    stale = stale.join(have, [stale[k] == have[k] for k in FLOW] + [F.upper(stale["name"]) == have["_up"]], "left_anti")
    rows = lineage.destinations(targets.drop("component"), lineage.propagate(seeds.drop("name").unionByName(defaults), links), by_name.unionByName(stale))
    return rows.withColumn("confidence", F.when(F.col("source_table").isin(*NO_SOURCE), "default").otherwise(F.col("confidence")))


def transformations(found: dict[str, DataFrame]) -> DataFrame:
    """package, flow_name, name, type, description, expressions, join_type, sort_columns of the components that transform."""
    kind = F.regexp_extract("class", r"([^.]*)$", 1)
    c = found["components"].where(kind.isin(*TRANSFORMATIONS)).select(*FLOW, "flow_name", F.col("ref_id").alias("component"), "name", kind.alias("type"), "description")
    p = found["properties"].select(*FLOW, "owner", F.col("name").alias("property"), "value")
    columns = found["columns"].select(*COMPONENT, F.col("ref_id").alias("owner"), F.col("name").alias("column"), F.col("position").cast("int").alias("place"))
    per_column = columns.join(p, [*FLOW, "owner"])
    listed = lambda rows, text, to: rows.groupBy(*COMPONENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]).alias(to))
    expressions = listed(per_column.where("property = 'FriendlyExpression'"), F.concat_ws(" = ", "column", F.coalesce("value", F.lit(""))), "expressions")
    sorts = listed(per_column.where("property = 'NewSortKeyPosition' and trim(value) <> '0'"), F.col("column"), "sort_columns")
    joins_ = p.where("property = 'JoinType'").select(*FLOW, F.col("owner").alias("component"), F.element_at(F.array(*map(F.lit, ("FULL", "LEFT", "INNER"))), F.col("value").cast("int") + 1).alias("join_type"))
    full = c
    for more in (expressions, joins_, sorts):
        full = full.join(more, [*COMPONENT], "left")
    return full.select("package", "flow_name", "name", "type", "description", "expressions", "join_type", "sort_columns")


def flow_commands(found: dict[str, DataFrame]) -> DataFrame:
    """package, flow, sql: of each flow's sources the last command, in the order of the package file."""
    c = found["components"].select(*FLOW, F.col("ref_id").alias("component"), "number")
    return commands(found).where("sql is not null and class like '%Source%'").join(c, [*COMPONENT]).groupBy(*FLOW).agg(F.max_by("sql", "number").alias("sql"))


def components_by_flow(found: dict[str, DataFrame], kind: str) -> DataFrame:
    """package, flow, flow_name, components: sorted names of a flow's components whose class holds `kind` (Source, Destination)."""
    return found["components"].where(F.col("class").contains(kind)).groupBy(*FLOW, "flow_name").agg(F.sort_array(F.collect_list("name")).alias("components"))


def target_sources(rows: DataFrame) -> DataFrame:
    """package, flow, target_table, sources (sorted, each once), columns (table.column, sorted) of lineage rows."""
    named = F.concat_ws(".", "source_table", "source_column")
    return rows.where("source_table is not null").groupBy(*FLOW, "target_table").agg(F.array_join(F.array_sort(F.collect_set("source_table")), ", ").alias("sources"), F.array_join(F.array_sort(F.collect_set(named)), ", ").alias("columns"))


def refined_commands(found: dict[str, DataFrame]) -> DataFrame:
    """package, flow, component, old, new of the SqlCommand properties that sqltext.refine changes, white space at the ends aside."""
    old = found["properties"].where("name = 'SqlCommand'").where(_filled("value").isNotNull()).select(*FLOW, F.col("owner").alias("component"), F.col("value").alias("old"))
    both = old.withColumn("new", sqltext.refine(F.col("old")))
    return both.where(F.trim("old", F.lit(_BLANK)) != F.trim("new", F.lit(_BLANK)))


def report(found: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """package, part, line_no, line: the Markdown report of each package. Parts: 1 counts, 2 connections, 3 sources, 4
    destinations, 5 lineage; tables are sorted by their lines."""
    c, command = found["components"], commands(found)
    about = packages.connection_of(c, found["connections"]).select(*FLOW, F.col("ref_id").alias("component"), "name", "class", "connection").join(command.drop("class"), [*COMPONENT], "left")
    many = lambda df, label: df.groupBy("package").agg(F.count("*").alias("n")).select("package", F.lit(label).alias("label"), "n")
    kinds = (("Connections", found["connections"]), ("Data Sources", c.where("class like '%Source%'")), ("Destinations", c.where("class like '%Destination%'")), ("Transformations", transformations(found)), ("Variables", found["variables"]), ("Tasks", found["executables"]), ("Column Mappings", rows))
    counts = None
    for label, df in kinds:
        counts = many(df, label) if counts is None else counts.unionByName(many(df, label))
    every = found["package_info"].select("package").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x, _ in kinds])))
    counts = every.join(counts, ["package", "label"], "left").select("package", "label", F.coalesce("n", F.lit(0)).alias("count"))
    parts = (
        (1, "Summary", counts),
        (2, "Connections", found["connections"].select("package", "name", "kind", "connection_string")),
        (3, "Data Sources", about.where("class like '%Source%'").select("package", "name", "connection", "rowset", "sql")),
        (4, "Destinations", about.where("class like '%Destination%'").select("package", "name", "connection", "rowset")),
        (5, "Column Lineage", rows.select("package", "target_table", "target_column", "source_table", "source_column", "expression", "confidence")),
    )
    lines = None
    for part, title, df in parts:
        one = tables.markdown_by(df, "package", title).select("package", F.lit(part).alias("part"), "line_no", "line")
        lines = one if lines is None else lines.unionByName(one)
    return lines
