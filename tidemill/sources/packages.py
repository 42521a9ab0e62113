"""Integration packages (.dtsx) as catalog tables.

Files are read as whole texts, one row each, so packages spread over tasks. A task turns each package
into rows (kind, number, attributes); the catalogs are projections of those rows, all of one schema
whatever the packages hold. Passwords and user ids of connection strings never leave the task."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.folders import fresh, spread, unestimated

# Namespaces of package files.
DTS, SQL_TASK = "{www.microsoft.com/SqlServer/Dts}", "{www.microsoft.com/sqlserver/dts/tasks/sqltask}"
#: Columns of each catalog besides package and number.
CATALOGS = {
    "package_info": ("name", "creation_date", "creator", "version_major", "version_minor", "error"),
    "connections": ("ref_id", "dtsid", "name", "kind", "connection_string"),
    "variables": ("namespace", "name", "expression", "data_type", "value"),
    "executables": ("ref_id", "parent", "name", "kind", "sql"),
    "constraints": ("from_ref", "to_ref", "value", "logical_and", "expression"),
    "components": ("flow", "flow_name", "ref_id", "name", "class", "description", "connection_ref"),
    "properties": ("flow", "owner", "name", "value"),
    "ports": ("flow", "component", "ref_id", "name", "direction", "is_error"),
    "columns": ("flow", "component", "port", "ref_id", "name", "lineage_id", "external_ref", "data_type", "length", "precision", "scale", "position"),
    "external_columns": ("flow", "component", "port", "ref_id", "name", "data_type"),
    "paths": ("flow", "ref_id", "start_ref", "end_ref"),
}
_SECRET = re.compile(r"(?i)\b(user id|uid|password|pwd)\s*=\s*[^;]*")
#: Packages that a task reads before it gives the rows made of them.
_AT_ONCE = 200


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return e.get(DTS + name, e.get(name))


def package_rows(text: str) -> Iterator[tuple[str, dict[str, str | None]]]:
    """(catalog, fields) of one package. Text that is no XML gives an error row instead of nothing."""
    try:
        root = ElementTree.fromstring(text.lstrip("﻿"))
    except ElementTree.ParseError as e:
        yield "package_info", {"error": str(e)}
        return
    info = {"name": "ObjectName", "creation_date": "CreationDate", "creator": "CreatorName", "version_major": "VersionMajor", "version_minor": "VersionMinor"}
    yield "package_info", {k: _attribute(root, v) for k, v in info.items()}
    for e in root.iter(DTS + "Variable"):
        value = e.find(DTS + "VariableValue")
        yield "variables", {"namespace": _attribute(e, "Namespace"), "name": _attribute(e, "ObjectName"), "expression": _attribute(e, "Expression"), "data_type": None if value is None else _attribute(value, "DataType"), "value": None if value is None else value.text}
    for e in root.findall(f"{DTS}ConnectionManagers/{DTS}ConnectionManager"):
        inner = e.find(f"{DTS}ObjectData/{DTS}ConnectionManager")
        shown = None if inner is None else _SECRET.sub(r"\1=***", _attribute(inner, "ConnectionString") or "")
        yield "connections", {"ref_id": _attribute(e, "refId"), "dtsid": _attribute(e, "DTSID"), "name": _attribute(e, "ObjectName"), "kind": _attribute(e, "CreationName"), "connection_string": shown}
    for e in root.iter(DTS + "PrecedenceConstraint"):
        yield "constraints", {"from_ref": _attribute(e, "From"), "to_ref": _attribute(e, "To"), "value": _attribute(e, "Value") or "0", "logical_and": _attribute(e, "LogicalAnd"), "expression": _attribute(e, "Expression")}
    waiting = deque([(root, None)])
    while waiting:
        e, parent = waiting.popleft()
        ref = _attribute(e, "refId")
        if parent is not None:
            task = e.find(f"{DTS}ObjectData/{SQL_TASK}SqlTaskData")
            yield "executables", {"ref_id": ref, "parent": parent, "name": _attribute(e, "ObjectName"), "kind": _attribute(e, "ExecutableType"), "sql": None if task is None else task.get(SQL_TASK + "SqlStatementSource")}
        for pipeline in e.findall(f"{DTS}ObjectData/pipeline"):
            yield from _flow_rows(pipeline, ref or _attribute(e, "ObjectName") or "", _attribute(e, "ObjectName") or ref or "")
        waiting += [(x, ref or "Package") for x in e.findall(f"{DTS}Executables/{DTS}Executable")]


def _flow_rows(pipeline: ElementTree.Element, flow: str, flow_name: str) -> Iterator[tuple[str, dict[str, str | None]]]:
    for c in pipeline.findall("components/component"):
        component = c.get("refId") or c.get("id")
        connection = c.find("connections/connection")
        yield "components", {"flow": flow, "flow_name": flow_name, "ref_id": component, "name": c.get("name"), "class": c.get("componentClassID"), "description": c.get("description"), "connection_ref": None if connection is None else connection.get("connectionManagerRefId") or connection.get("connectionManagerID")}
        for p in c.findall("properties/property"):
            yield "properties", {"flow": flow, "owner": component, "name": p.get("name"), "value": p.text}
        for direction in ("input", "output"):
            for port in c.findall(f"{direction}s/{direction}"):
                ref = port.get("refId") or port.get("id")
                yield "ports", {"flow": flow, "component": component, "ref_id": ref, "name": port.get("name"), "direction": direction, "is_error": port.get("isErrorOut") or "false"}
                for k, col in enumerate(port.findall(f"{direction}Columns/{direction}Column")):
                    own = col.get("refId") or col.get("id")
                    kind = lambda a: col.get(a) or col.get("cached" + a[0].upper() + a[1:])  # noqa: B023, E731
                    yield "columns", {"flow": flow, "component": component, "port": ref, "ref_id": own, "name": kind("name"), "lineage_id": col.get("lineageId"), "external_ref": col.get("externalMetadataColumnId"), "data_type": kind("dataType"), "length": kind("length"), "precision": kind("precision"), "scale": kind("scale"), "position": str(k)}
                    for p in col.findall("properties/property"):
                        yield "properties", {"flow": flow, "owner": own, "name": p.get("name"), "value": p.text}
                for x in port.findall("externalMetadataColumns/externalMetadataColumn"):
                    yield "external_columns", {"flow": flow, "component": component, "port": ref, "ref_id": x.get("refId") or x.get("id"), "name": x.get("name"), "data_type": x.get("dataType")}
    for p in pipeline.findall("paths/path"):
        yield "paths", {"flow": flow, "ref_id": p.get("refId") or p.get("id"), "start_ref": p.get("startId"), "end_ref": p.get("endId")}


def read_packages(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """package (path below the folder), text of every .dtsx and .xml file in the folder and below it, in whatever case,
    sorted by path; `names` chooses some."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[dD][tT][sS][xX],[xX][mM][lL]}").load(folder)
    below = F.regexp_replace("path", r"^(?:[a-zA-Z][\w+.-]*:/*)?/?\Q" + re.sub(r"^[a-zA-Z][\w+.-]*:/*", "", folder).strip("/") + r"\E/+", "")
    found = decode_packages(files.select(below.alias("package"), "content"))
    return (found if names is None else found.where(F.col("package").isin(*names))).orderBy("package")


def decode_packages(files: DataFrame) -> DataFrame:
    """files(package, content) with uploaded bytes -> package, text: UTF-8, else UTF-16, else null (an error row later)."""
    raw = F.col("content").cast("string")
    wide = F.substring(F.hex("content"), 1, 4).isin("FFFE", "FEFF")
    return files.select("package", F.when(wide, F.decode("content", "UTF-16")).when(F.is_valid_utf8(raw), raw).alias("text"))


def catalogs(packages: DataFrame) -> dict[str, DataFrame]:
    """The catalog tables of packages(package, text). Packages are read once: the rows of all catalogs are written to the
    shared folder together, partitioned by catalog, so that each one's reader opens its own files and columns alone."""

    every = sorted({c for columns in CATALOGS.values() for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few at a time: a package gives many rows
            for start in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(start, _AT_ONCE)
                made = [(at, k, kind, fields) for at, text in enumerate(part.column(1).to_pylist()) for k, (kind, fields) in enumerate(package_rows(text or ""))]
                place, number, catalog = (pa.array([r[c] for r in made], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string())))
                own = [pa.array([r[3].get(c) for r in made], pa.string()) for c in every]
                yield pa.RecordBatch.from_arrays([part.column(0).take(place), number, *own, catalog], names=["package", "number", *every, "catalog"])

    spark, at = packages.sparkSession, fresh(packages.sparkSession, "catalogs")
    kinds = "package string, number int, " + ", ".join(f"`{c}` string" for c in every) + ", catalog string"
    # a task sorts its rows by catalog to write them: the packages are spread, so that what it sorts does not grow with them
    spread(packages.select("package", "text"), "package", "text", rows=2_000).mapInArrow(run, kinds).write.partitionBy("catalog").parquet(at)
    found = spark.read.schema(kinds).parquet(at)
    return {name: unestimated(found.where(F.col("catalog") == name).select("package", "number", *columns)) for name, columns in CATALOGS.items()}


def server_and_database(connections: DataFrame) -> DataFrame:
    """Adds server and database, from the connection string's pairs."""
    pairs = F.str_to_map(F.coalesce("connection_string", F.lit("")), F.lit(";"), F.lit("="))
    return connections.withColumns({"server": pairs["Data Source"], "database": pairs["Initial Catalog"]})


def connection_of(components: DataFrame, connections: DataFrame) -> DataFrame:
    """Components with their connection's name: references are by ref id, by DTSID or by name."""
    keys = connections.select(F.col("package").alias("_p"), F.col("name").alias("connection"), F.explode(F.array_distinct(F.array("ref_id", "dtsid", "name"))).alias("_k")).where("_k is not null")
    one = keys.groupBy("_p", "_k").agg(F.min("connection").alias("connection"))
    on = (F.col("package") == F.col("_p")) & (F.regexp_replace("connection_ref", r":external$", "") == F.col("_k"))
    return components.join(one, on, "left").drop("_p", "_k")
